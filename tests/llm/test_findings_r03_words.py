"""op5_chunks: words of plain letters and signs do not cost the tokenizers library's time, and have its ids."""

import json
import random
from array import array

import numpy as np
import pytest

from tessera.llm import chunks, tokens

PATH = tokens.tokenizer_path("word_bpe_49k.json")


def by_library(words):
    whole = tokens.load(PATH)
    return [array("H", whole.encode(w.decode(), add_special_tokens=False).ids).tobytes() for w in words]


class Refusing:
    """A tokenizer that encodes nothing."""

    def encode_batch_fast(self, texts, add_special_tokens):
        assert texts == [], texts[:5]
        return []


def test_plain_words_do_not_pass_the_library():
    encoder = chunks.WordEncoder(PATH)
    text = "It's the Größe of ÉTÉ, don't “quote” 3.14 价格东京 Москва".encode()
    want = b"".join(by_library(text.split()))
    encoder.ids.whole = Refusing()
    assert encoder.encode([text, text]) == [want, want]


def test_every_plain_character_and_mixed_words_have_the_librarys_ids():
    plain = [c for c in map(chr, range(0x21, 0x10000)) if tokens._PLAIN.fullmatch(c)]
    assert len(plain) > 30_000
    rare = [*"ΣσςİΆ̧́ \u0085　²½Ⅷ", "‍", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "</w>", "\x1c", "\x00"]
    draw = random.Random(7)
    few = [c for c in plain if c < "ƀ"]
    words = [c + d for c in plain for d in ("", "'S", c.lower())]
    for alphabet in (few, plain, [*few, *rare], list("ab'stRE'LL1.")):
        words += ["".join(draw.choices(alphabet, k=draw.randint(1, 24))) for _ in range(4000)]
    words += [c * n for c in ("a", "ab", "é", "!", "=-", "7", "东", "the") for n in (100, 499, 500, 501, 3000)]
    words = [w for w in (x.encode() for x in words) if w.split() == [w]]
    got = tokens.WordIds(PATH).encode(words)
    wrong = [w for w, g, x in zip(words, got, by_library(words), strict=True) if g != x]
    assert not wrong, wrong[:10]


def test_learning_in_a_full_memory_loses_no_word():
    encoder = chunks.WordEncoder(PATH, most=500)
    texts = [f"one two word{k % 7} w{k} ́x" .encode() for k in range(200)]
    want = [b"".join(by_library(t.split())) for t in texts]
    assert [encoder.encode([t])[0] for t in texts] == want
    assert encoder.encode(texts) == want


@pytest.mark.parametrize("change", ["normal form", "merge"])
def test_a_vocabulary_that_cannot_serve_as_ranks_stays_with_the_library(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    if change == "normal form":
        file["normalizer"] = {"type": "Lowercase"}
    else:  # a token of (th, e</w>) is now of (t, he</w>), which th, the earlier merge, keeps apart
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        merges[merges.index(["th", "e</w>"])] = ["t", "he</w>"]
        file["model"]["merges"] = merges
    path = tmp_path / "words.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    assert tokens.word_ranks(str(path)) is None and tokens.word_ranks(PATH) is not None
    words = [b"the", b"then", b"THE"]
    whole = tokens.load(str(path))
    assert tokens.WordIds(str(path)).encode(words) == [array("H", whole.encode(w.decode(), add_special_tokens=False).ids).tobytes() for w in words]


def test_decoder_joins_tokens_and_numbers():
    d = chunks.Decoder(PATH)
    ids = np.array(tokens.load(PATH).encode("the cat", add_special_tokens=False).ids, np.uint16)
    assert d.text(ids) == tokens.load(PATH).decode(ids.tolist(), skip_special_tokens=False).encode()
    assert d.numbers(ids) == " ".join(map(str, ids)).encode() and d.text(ids[:0]) == d.numbers(ids[:0]) == b""
