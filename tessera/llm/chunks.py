"""BPE encoding and decoding in which content-defined chunks that documents share are encoded once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, key_filter, may_be_in, new_name, read_table, stored
from .tokens import WordIds, in_blocks, kept, load, tokenizer_path

_SPACES = frozenset(b" \t\n\x0b\x0c\r")
_WINDOW = 16


def _rolling_table() -> np.ndarray:
    """A fixed random value for each byte, from a seed."""
    return np.random.default_rng(20_111).integers(0, 1 << 32, 256, np.uint32)


def rolling_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Polynomial hash of the 16 bytes up to each place, by doubling the window four times."""
    h, power, step = table[data], np.uint32(0x9E3779B1), 1
    with np.errstate(over="ignore"):
        while step < _WINDOW:
            wider = h.copy()
            wider[step:] += h[:-step] * power
            h, power, step = wider, power * power, step * 2
    return h


def cuts(data: bytes, table: np.ndarray, bits: int = 9, least: int = 192, most: int = 4096) -> list[int]:
    """Chunk starts after the first, each on a character's first byte.

    A cut depends on nearby content only: it stands where the rolling hash's low bits are zero, at least `least` bytes after
    the cut before and, where no such place comes, `most` bytes after it. Cuts may split words.
    """
    n = len(data)
    if n <= least:
        return []
    a = np.frombuffer(data, np.uint8)
    places = (np.flatnonzero((rolling_hash(a, table) & np.uint32((1 << bits) - 1)) == 0) + 1).tolist()
    out, last = [], 0
    for p in [*places, n]:
        while p - last > most:
            last = _character(data, last + most)
            out.append(last)
        if p - last >= least and p < n:
            last = _character(data, p)
            out.append(last)
    return [p for p in out if p < n]


def _character(data: bytes, p: int) -> int:
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


def chunks_of(data: bytes, table: np.ndarray) -> list[bytes]:
    places = [0, *cuts(data, table), len(data)]
    return [data[a:b] for a, b in zip(places, places[1:], strict=False)]


def _key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class WordEncoder:
    """Ids of byte strings as the tokenizer gives them, by way of their words.

    Tokens of this tokenizer hold no white space, and neither normal forms nor added tokens reach over it, so a text's ids
    are those of its words one after another. Words met before are remembered by the worker, up to `most` bytes, which
    bounds memory only.
    """

    def __init__(self, path: str, most: int = 60_000_000) -> None:
        self.ids, self.table, self.most = WordIds(path), _rolling_table(), most
        self.words: dict[bytes, bytes] = {}
        self.held = 0

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The remembered words, with these among them; ids as little-endian unsigned 16-bit numbers."""
        if self.held > self.most:
            self.words.clear()
            self.held = 0
        new = list(words.difference(self.words))
        for w, ids in zip(new, self.ids.encode(new), strict=True):
            self.words[w] = ids
            self.held += len(w) + len(ids) + 130
        return self.words

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        known = [list(map(self.words.get, ws)) for ws in split]
        new = {w for ws, ids in zip(split, known, strict=True) if None in ids for w, i in zip(ws, ids, strict=True) if i is None}
        of = self.learn(new)
        return [b"".join([of[w] if i is None else i for w, i in zip(ws, ids, strict=True)] if None in ids else ids) for ws, ids in zip(split, known, strict=True)]


class Piece:
    """An encoded run of a text: its ids, and the words at its ends that another run may continue.

    head: the word it begins with, if it begins inside or at a word; tail: that it ends with. A piece without white space is
    solid: all of it is one word, head and tail alike.
    """

    __slots__ = ("head", "tail", "n_head", "n_tail", "solid", "ids")

    def __init__(self, head: bytes, tail: bytes, n_head: int, n_tail: int, solid: bool, ids: bytes) -> None:
        self.head, self.tail, self.n_head, self.n_tail, self.solid, self.ids = head, tail, n_head, n_tail, solid, ids

    @classmethod
    def encoded(cls, data: bytes, of: dict[bytes, bytes]) -> Piece:
        ws = data.split()
        ids = [of[w] for w in ws]
        head = ws[0] if data[:1] and data[0] not in _SPACES else b""
        tail = ws[-1] if data[-1:] and data[-1] not in _SPACES else b""
        return cls(head, tail, len(ids[0]) if head else 0, len(ids[-1]) if tail else 0, bool(head) and len(ws) == 1 and bool(tail), b"".join(ids))

    def packed(self) -> bytes:
        numbers = [len(self.head), len(self.tail), self.n_head, self.n_tail, int(self.solid)]
        return np.array(numbers, "<u4").tobytes() + self.head + self.tail + self.ids

    @classmethod
    def unpacked(cls, data: bytes) -> Piece:
        a, b, n_head, n_tail, solid = np.frombuffer(data, "<u4", 5).tolist()
        return cls(data[20 : 20 + a], data[20 + a : 20 + a + b], n_head, n_tail, bool(solid), data[20 + a + b :])


def join_pieces(pieces: list[Piece]) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """(parts of the text's ids, repairs): a repair (k, word, given) says that part k stands for a word that a join splits.

    The window of a join is the word around it. Where a piece is solid the window widens over it, to the next white space
    or the text's end: from there on the ids of both sides agree with any wider encoding, as no token holds white space.
    `given` are the ids that the pieces had for the window; re-encoding it tells whether they agree.
    """
    parts: list[bytes] = []
    repairs = []
    word, given, joins = b"", b"", 0

    def close() -> None:
        nonlocal word, given, joins
        if joins:
            repairs.append((len(parts), word, given))
        parts.append(given)
        word, given, joins = b"", b"", 0

    for p in pieces:
        if word and p.head:
            word, given, joins = word + p.head, given + p.ids[: p.n_head], joins + 1
            if p.solid:
                continue
            rest = p.ids[p.n_head :]
        elif p.solid:
            close()
            word, given = p.head, p.ids
            continue
        else:
            rest = p.ids
        close()
        at = len(rest) - p.n_tail
        parts.append(rest[:at])
        word, given = p.tail, rest[at:]
    close()
    return parts, repairs


class Decoder:
    """decode(ids, skip_special_tokens=False) of a tokenizer without a decoder of its own: its tokens, joined by spaces."""

    def __init__(self, path: str) -> None:
        t = load(path)
        if t.decoder is not None:
            raise ValueError("tokens of this tokenizer do not decode one by one")
        n = t.get_vocab_size(with_added_tokens=True)
        if n > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        self.token = np.array([(t.id_to_token(i) or "").encode() for i in range(n)], object)
        self.number = np.array([b"%d" % i for i in range(n)], object)

    def text(self, ids: np.ndarray) -> bytes:
        return b" ".join(self.token[ids].tolist())

    def numbers(self, ids: np.ndarray) -> bytes:
        return b" ".join(self.number[ids].tolist())


def shared_chunks(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(h, key, n): the chunks that come twice or more in all texts, by hash; counted in the tasks before the shuffle."""
    out = pa.schema([("h", pa.binary()), ("key", pa.int64())])

    def run(batches):
        table = kept(f"words {path}", lambda: WordEncoder(path)).table
        for b in batches:
            for block in in_blocks(b.column(0).to_pylist()):
                h = [_key(c) for t in block if t for c in chunks_of(t.encode(), table)]
                yield batch(out, h, np.frombuffer(b"".join(h), np.int64)[::2].copy())

    rows = arrow_map(docs.select(text_col), run, "h binary, key bigint")
    return rows.groupBy("h", "key").agg(F.count("*").alias("n")).where("n > 1")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """The columns of docs but the text, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Texts are cut into content-defined chunks. Chunks that come twice or more in the corpus go into one table, where each
    is encoded once, and their ids are joined back to the texts that hold them; all other runs are encoded where the text
    is. At each join of two pieces the word around it is encoded again and replaces what the pieces had for it where
    the two differ; a word that reaches over further pieces widens the window until both its ends stand at white space.
    A text without a shared chunk is encoded as a whole and does not travel; equal texts that do are put together once.

    Whole texts are encoded; null counts as empty, with no tokens. Repeated rows are returned as often as they come. Columns
    of docs that have a new column's name are replaced; the others stay, whatever their names.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    new = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    new |= {"ids": ("array<int>", pa.list_(pa.int32()))} if with_ids else {}
    new |= {"decoded": ("string", pa.string())} if with_decoded else {}
    fields = [f for f in docs.schema.fields if f.name != text_col and f.name not in new]
    carried = [f.name for f in fields]
    row, part, h, data = (new_name(docs, c) for c in ("row", "part", "h", "data"))
    own = {row: ("binary", pa.binary()), part: ("int", pa.int32()), h: ("binary", pa.binary()), data: ("binary", pa.binary())}
    shared = stored(shared_chunks(docs, path, text_col), "shared-chunks")
    n_shared = shared.count()
    seen = docs.sparkSession.sparkContext.broadcast(key_filter(shared, n_shared) if n_shared else None)

    def results(all_ids: list[bytes], decoder: Decoder) -> list[list]:
        out: dict[str, list] = {k: [] for k in new}
        for ids in all_ids:
            ids = np.frombuffer(ids, "<u2")
            text = decoder.text(ids)
            for k, v in (("n_tokens", len(ids)), ("ids_sha256", hashlib.sha256(decoder.numbers(ids)).hexdigest()), ("decoded_sha256", hashlib.sha256(text).hexdigest()), ("ids", ids), ("decoded", text)):
                if k in out:
                    out[k].append(v.decode() if k == "decoded" else v)
        return list(out.values())

    def split(batches):
        """A row for each text, finished or with part -1 and the text's hash; part 0 and on: the pieces of a hash, own (data)
        or shared (h); part -2: the text of a chunk that may be shared."""
        encoder, decoder = kept(f"words {path}", lambda: WordEncoder(path)), kept(f"decoder {path}", lambda: Decoder(path))
        bitmap = seen.value
        given: set[bytes] = set()
        cut: set[bytes] = set()
        for b in batches:
            at = 0
            names = [*b.schema.names[:-1], *own, *new]
            types = [*b.schema.types[:-1], *(t for _, t in own.values()), *(t for _, t in new.values())]
            for block in in_blocks(b.column(b.num_columns - 1).to_pylist()):
                whole, runs, texts = [], [], []
                for t in block:
                    raw = t.encode()
                    pieces = chunks_of(raw, encoder.table) if bitmap is not None and raw else []
                    keys = [_key(c) for c in pieces]
                    hit = may_be_in(np.frombuffer(b"".join(keys), np.uint64)[::2].copy(), bitmap).tolist() if pieces else []
                    if not any(hit):
                        whole.append((None, raw))
                        continue
                    own_run: list[bytes] = []
                    n = 0
                    whole.append((_key(raw), None))
                    if whole[-1][0] in cut:
                        continue
                    cut.add(whole[-1][0])
                    for c, key, x in zip([*pieces, b""], [*keys, b""], [*hit, True], strict=True):
                        if not x:
                            own_run.append(c)
                            continue
                        if own_run:
                            runs.append((whole[-1][0], n, None, b"".join(own_run)))
                            n, own_run = n + 1, []
                        if key:
                            runs.append((whole[-1][0], n, key, None))
                            n += 1
                            if key not in given:
                                given.add(key)
                                texts.append((key, c))
                if len(given) + len(cut) > 300_000:
                    given.clear()
                    cut.clear()
                ids = iter(encoder.encode([r for _, r in whole if r is not None]))
                done = results([next(ids) for _, r in whole if r is not None], decoder)
                finished = np.array([r is not None for _, r in whole], bool)
                place = pa.array(np.where(finished, np.cumsum(finished) - 1, 0), mask=~finished)
                rows = len(whole)
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(at, rows) for c in b.columns[:-1]), pa.array([k for k, _ in whole], pa.binary()), pa.array(np.where(finished, 0, -1).astype(np.int32), mask=finished),
                    pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary()), *(pa.array(c, t).take(place) for c, (_, t) in zip(done, new.values(), strict=True)),
                ], names=names)
                of = encoder.learn({w for *_, c in runs if c for w in c.split()})
                extra = [(r, n, key, None if c is None else Piece.encoded(c, of).packed()) for r, n, key, c in runs] + [(None, -2, key, c) for key, c in texts]
                if extra:
                    columns = [pa.nulls(len(extra), t) for t in types]
                    for k, c in enumerate(zip(*extra, strict=True), len(b.schema.names) - 1):
                        columns[k] = pa.array(c, types[k])
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                at += rows

    listed = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    found = [f"{k} {t}" for k, (t, _) in new.items()]
    plain = docs.select(*[f"`{c}`" for c in carried], f"`{text_col}`")
    pieces = arrow_map(plain, split, ", ".join([*listed, *(f"`{k}` {t}" for k, (t, _) in own.items()), *found]))
    outcome = [*[f"`{c}`" for c in carried], *new]
    if not n_shared:
        return pieces.select(*outcome)
    pieces = stored(pieces, "pieces")

    def table(batches):
        encoder = kept(f"words {path}", lambda: WordEncoder(path))
        for b in batches:
            raw = b.column(1).to_pylist()
            of = encoder.learn({w for c in raw for w in c.split()})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Piece.encoded(c, of).packed() for c in raw], pa.binary())], names=["h", "piece"])

    once = pieces.where(F.col(part) == -2).groupBy(F.col(h).alias("h")).agg(F.first(data).alias("data"))
    known = arrow_map(once, table, "h binary, piece binary")
    parts = pieces.where(F.col(part) >= 0).select(F.col(row).alias("row"), F.col(part).alias("part"), F.col(h).alias("h"), F.col(data).alias("piece"))
    joined = parts.where("h is not null").drop("piece").join(known, "h").select("row", "part", "piece").unionByName(parts.where("h is null").drop("h"))
    gathered = joined.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("part", "piece"))).alias("pieces"))

    def assemble(batches):
        encoder, decoder = kept(f"words {path}", lambda: WordEncoder(path)), kept(f"decoder {path}", lambda: Decoder(path))
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                texts = [join_pieces([Piece.unpacked(x["piece"]) for x in p]) for p in some.column(1).to_pylist()]
                of = encoder.learn({w for _, repairs in texts for _, w, _ in repairs})
                for parts, repairs in texts:
                    for i, w, before in repairs:
                        if of[w] != before:
                            parts[i] = of[w]
                done = results([b"".join(parts) for parts, _ in texts], decoder)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, (_, t) in zip(done, new.values(), strict=True))], names=["row", *new])

    finished = arrow_map(gathered, assemble, ", ".join(["row binary", *found]))
    open_rows = pieces.where(F.col(part) == -1).select(*[f"`{c}`" for c in carried], F.col(row).alias(row))
    return pieces.where(F.col(part).isNull()).select(*outcome).unionByName(open_rows.join(finished.withColumnRenamed("row", row), row).select(*outcome))


def op5_chunks(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Rows at the edge: see encode; ties do not arise."""
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False, with_decoded=False)
