"""Encoding with the public tokenizers inside tasks."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict = {}


def kept(name: str, make: Callable):
    """make(), once for each worker process; tasks that follow in it find the same object here."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def load(path: str):
    """The tokenizer of a file, without truncation and padding, on the task's own thread."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return t

    return kept(f"tokenizer {path}", make)


class ByteEncoder:
    """Ids of whole texts by the byte-level vocabulary, as the tokenizers library gives them.

    The same merges are published as ranks, which tiktoken applies several times faster; tests hold both libraries' ids
    against each other. Only a text that names a special token goes through the tokenizers library itself.
    """

    def __init__(self, path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        def make():
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
            return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.fast = kept(f"ranks {ranks_path}", make)
        self.whole = load(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; null counts as empty."""
        text = text or ""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


#: Letters and signs that the word vocabulary's normal form leaves alone but for their case, which no neighbour changes.
#: They are from Unicode 3, so all versions agree on them. Greek (final sigma), a dotted capital I, combining signs, other
#: numbers and other spaces are left out.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e\u0400-\u045f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SIGNS = "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u20ac\u3001-\u3003\u3008-\u3011"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+")
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_WORD_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}


def word_ranks(path: str) -> dict[bytes, int] | None:
    """Ids of a word-level vocabulary's tokens by their bytes, a space for the end of a run; None if they cannot serve as ranks.

    They can if ids rise with the merges and every token's own symbols merge to it: then two neighbours that together are a
    token are always that token's merge, so merging by ids is merging by the list.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if any(file.get(k) != v for k, v in _WORD_FORM.items()) or any(model.get(k) != v for k, v in _WORD_MODEL.items()):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printed))}
    vocab, end = model["vocab"], "</w>"
    if not set("".join(vocab)) <= byte.keys():
        return None
    symbols = {t: [*t[:-5], t[-5:]] if t.endswith(end) and t != end else [*t] for t in vocab}
    ranks: dict[bytes, int] = {}
    for t, i in vocab.items():
        ends = len(symbols[t][-1]) > 1
        ranks[bytes(byte[c] for c in (t[: -len(end)] if ends else t)) + b" " * ends] = i
    merges = {(a, b): vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
    order = list(merges.values())
    first = [vocab[c + e] for e in ("", end) for c in byte if c + e in vocab]
    if len(ranks) != len(vocab) or len(first) != 512 or order != sorted(set(order)) or max(first) >= min(order, default=0) or len(vocab) > 1 << 16:
        return None
    none = len(vocab) + 1
    for parts in symbols.values():
        while len(parts) > 1:
            found = [merges.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            if min(found) == none:
                return None
            at = found.index(min(found))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ranks


class WordIds:
    """Ids of words without white space by the word-level vocabulary, as the tokenizers library gives them.

    Words of plain letters and signs go by the vocabulary's ids as ranks, which tiktoken merges several times faster; tests
    hold both libraries' ids against each other. Other words, and those that name a special token, go through the
    tokenizers library itself, as all do where the vocabulary cannot serve as ranks.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.whole = load(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = word_ranks(path)
        self.fast = ranks and tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks and ranks[b"\n"]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each word."""
        texts = [w.decode() for w in words]
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        special = [s for s in self.special if any(s in t for t in texts)]
        if special:
            plain = [p and not any(s in t for s in special) for p, t in zip(plain, texts, strict=True)]
        quick = self._merged([t for t, p in zip(texts, plain, strict=True) if p])
        rest = iter(self.whole.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(quick) if p else array("H", next(rest).ids).tobytes() for p in plain]

    def _merged(self, texts: list[str]):
        if not texts:
            return
        ids = self.fast.encode_to_numpy(_RUNS.sub(r"\g<0> ", "\n".join(texts).lower()), disallowed_special=())
        ends = np.append(np.flatnonzero(ids == self.between), len(ids))
        if len(ends) != len(texts):
            raise ValueError("words and their ids do not match")
        data, at = ids.astype("<u2").tobytes(), 0
        for end in (2 * ends).tolist():
            yield data[at:end]
            at = end + 2


def in_blocks(texts: list[str | None], size: int = 1_000_000):
    """Runs of texts of about `size` characters; null counts as empty."""
    block: list[str] = []
    held = 0
    for t in texts:
        block.append(t or "")
        held += len(t or "")
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block
