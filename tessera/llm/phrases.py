"""Phrase collocations by counting quotient filters over packed word-id n-grams, merged across shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, key_filter, may_be_in, read_table, stored

LEAST, LONGEST, FIRST = 100, 5, 2000
_BLOCK = 1 << 21  # bytes of text that are tokenised together
_HELD = 1 << 20  # entries that a task holds before it sends its filters
_U = np.uint64

#: Ends of pieces and of words, as bytes; both are ASCII, so UTF-8 texts can be cut at them.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _byte_tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte: 0 in words, 1 between words, 2 between pieces; random value of each byte, A-Z as a-z)."""
    kind = np.zeros(256, np.uint8)
    kind[list(_GAPS)], kind[list(_ENDS)] = 1, 2
    value = np.random.default_rng(seed).integers(0, 1 << 64, 256, _U, endpoint=False)
    value[65:91] = value[97:123]
    return kind, value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits: shifts and odd products, each of which can be undone."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of mixed."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(31)) ^ (x >> _U(62))
        x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
        x = x ^ (x >> _U(27)) ^ (x >> _U(54))
        x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        return x ^ (x >> _U(30)) ^ (x >> _U(60))


def _chain(rest: list[np.ndarray]) -> np.ndarray | int:
    """A value of all words but the first, in order."""
    h = _U(len(rest))
    with np.errstate(over="ignore"):
        for w in rest:
            h = mixed((h * _U(0x9E3779B97F4A7C15)) ^ w)
    return h


def permuted(words: list[np.ndarray]) -> np.ndarray:
    """The first word's id, permuted by a value of the others: with the others kept as they are, a bijection of n-grams.

    Its high bits are the quotient. The number itself is also a key of the n-gram for bitmaps.
    """
    return mixed(words[0] ^ _chain(words[1:]))


def restored(x: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
    """The n-gram's word ids from its permuted first word and the others."""
    return [unmixed(x) ^ _chain(rest), *rest]


def summed(x: np.ndarray, rest: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (x, rest), equal ones counted together. rest: a column a word, none for single words."""
    if not len(x):
        return x, rest, count
    place = np.argsort(x, kind="stable")
    x, rest, count = x[place], rest[place], count[place]
    same = x[1:] == x[:-1]
    if rest.shape[1] and (same & (rest[1:] != rest[:-1]).any(1)).any():  # unlike n-grams of one x: put equal ones together
        place = np.lexsort((*rest.T[::-1], x))
        x, rest, count = x[place], rest[place], count[place]
        same = (x[1:] == x[:-1]) & (rest[1:] == rest[:-1]).all(1)
    starts = np.flatnonzero(np.r_[True, ~same])
    return x[starts], rest[starts], np.add.reduceat(count, starts)


class QuotientFilter:
    """A lossless counter of n-grams of one bucket, in the layout of a counting quotient filter.

    The number's top `skip` bits are the bucket's; the next `q` bits are the quotient. For each quotient a bit says whether
    it has entries, for each entry a bit whether it is the last of its run; the remainders stand in order, the low bytes of
    the number (without its bucket and quotient bits) and all other word ids. A count takes one byte, or eight more from 255 on.
    """

    def __init__(self, skip: int, words: int, x: np.ndarray, rest: np.ndarray, count: np.ndarray) -> None:
        self.skip, self.words, self.x, self.rest, self.count = skip, words, x, rest, count

    def to_bytes(self) -> bytes:
        n = len(self.x)
        q = max(3, (n - 1).bit_length()) if n else 3
        low = 64 - self.skip - q
        quotient = ((self.x << _U(self.skip)) >> _U(64 - q)).astype(np.int64)
        used = np.zeros(1 << q, bool)
        used[quotient] = True
        last = np.r_[quotient[1:] != quotient[:-1], True] if n else np.zeros(0, bool)
        left = (self.x & _U((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : (low + 7) // 8]
        small = np.minimum(self.count, 255).astype(np.uint8)
        head = np.array([n, q, self.skip, self.words, int(self.x[0] >> _U(64 - self.skip)) if n and self.skip else 0], "<i8")
        large = self.count[small == 255].astype("<i8")
        return b"".join([head.tobytes(), np.packbits(used).tobytes(), np.packbits(last).tobytes(), np.ascontiguousarray(left).tobytes(), np.ascontiguousarray(self.rest).astype("<u8").tobytes(), small.tobytes(), large.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        n, q, skip, words, bucket = np.frombuffer(data, "<i8", 5).tolist()
        low, at = 64 - skip - q, 40

        def take(size):
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        used = np.flatnonzero(np.unpackbits(take((1 << q) // 8)))
        last = np.unpackbits(take((n + 7) // 8))[:n].astype(bool)
        run = np.cumsum(np.r_[0, last[:-1]]) if n else np.zeros(0, np.int64)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : (low + 7) // 8] = take(n * ((low + 7) // 8)).reshape(n, (low + 7) // 8)
        x = wide.view("<u8").ravel() | (used[run].astype(_U) << _U(low))
        if skip:
            x |= _U(bucket) << _U(64 - skip)
        rest = take(n * 8 * (words - 1)).view("<u8").reshape(n, words - 1) if n else np.zeros((0, words - 1), _U)
        count = take(n).astype(np.int64)
        count[count == 255] = take(len(data) - at).view("<i8")
        return cls(skip, words, x.astype(_U), rest.astype(_U), count)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all entries; each comes sorted, so the stable sort merges runs."""
        f = filters[0]
        if len(filters) == 1:
            return f
        return cls(f.skip, f.words, *summed(*(np.concatenate(c) for c in zip(*((g.x, g.rest, g.count) for g in filters), strict=True))))


class Words:
    """The words of a block: 64-bit ids, where they stand, and how many words of their piece follow each (itself included, up
    to the longest phrase)."""

    def __init__(self, data: np.ndarray, seed_id: int, tables: tuple[np.ndarray, np.ndarray], powers: tuple[np.ndarray, np.ndarray]) -> None:
        kind = tables[0][data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        up, down = powers
        with np.errstate(over="ignore"):
            # sums of value * r**place; times r**-start they do not depend on where the word stands
            total = np.concatenate([np.zeros(1, _U), np.cumsum(tables[1][data] * up[: len(data)])])
            own = (total[self.end] - total[self.start]) * down[self.start]
            self.id = mixed((own + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93)) ^ _U(seed_id))
        ends = np.cumsum(kind == 2)
        piece = ends[self.start] if len(self.start) else np.zeros(0, np.int64)
        n = len(piece)
        self.follow = np.ones(n, np.int8)
        for k in range(1, min(LONGEST, n)):
            self.follow[: n - k] += piece[k:] == piece[: n - k]

    def grams(self, k: int, at: np.ndarray) -> list[np.ndarray]:
        return [self.id[at + j] for j in range(k)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**place and r**-place modulo 2**64 for places below n, r odd."""
    out = []
    for r in (0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)):
        x = np.full(n, r, _U)
        x[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _blocks(batches) -> Iterator[tuple[str, bytes, int]]:
    """(lang, text of many rows, place from which no phrase may begin) of each block.

    Rows end pieces. A block is cut at a gap between words; it goes on for `LONGEST - 1` words after the cut, in which no
    phrase of it begins, so none is lost or counted twice whatever the length of a piece.
    """
    for b in batches:
        langs = b.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = b.column(1).filter(pc.equal(langs.indices, code))
            for part in _slices(own):
                data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_py().encode()
                at = 0
                while at < len(data):
                    cut = _after(data, at + _BLOCK)
                    until = cut
                    for _ in range(LONGEST):
                        until = _after(data, until + 1) if until < len(data) else until
                    yield lang, data[at:until], cut - at
                    at = cut


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about a block each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    done = 0
    while done < len(texts):
        base = ends[done - 1] if done else 0
        k = max(done + 1, int(np.searchsorted(ends, base + _BLOCK)))
        yield texts.slice(done, k - done)
        done = k


_STOPS = np.zeros(256, bool)
_STOPS[list(_ENDS + _GAPS)] = True


def _after(data: bytes, at: int) -> int:
    """The first place from `at` on that begins no word: a separator that has a word or nothing after it, or the end."""
    while at < len(data):
        window = _STOPS[np.frombuffer(data, np.uint8, min(4096, len(data) - at), at)]
        found = np.flatnonzero(window & ~np.r_[window[1:], at + len(window) < len(data) and _STOPS[data[at + len(window)]]])
        if len(found):
            return at + int(found[0])
        at += len(window)
    return len(data)


def _tokenised(batches, seed: int) -> Iterator[tuple[str, np.ndarray, Words, int]]:
    """(lang, bytes, words, how many of them may begin a phrase) of each block."""
    tables, powers, ids = _byte_tables(seed), _powers(1 << 16), {}
    for lang, text, cut in _blocks(batches):
        data = np.frombuffer(text, np.uint8)
        if len(data) > len(powers[0]):
            powers = _powers(1 << (len(data) - 1).bit_length())
        if lang not in ids:
            ids[lang] = int.from_bytes(hashlib.blake2b(f"{seed}|{lang}".encode(), digest_size=8).digest(), "little")
        w = Words(data, ids[lang], tables, powers)
        yield lang, data, w, int(np.searchsorted(w.start, cut))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def vocabulary(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n): every word of each language, its id and how often it comes."""
    out = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for lang, data, w, n in _tokenised(batches, seed):
            ids, first, count = np.unique(w.id[:n], return_index=True, return_counts=True)
            if not len(ids):
                continue
            # words and the gaps between them alternate in one binary array, of which the words are taken
            offsets = np.stack([w.start[:n], w.end[:n]], 1).ravel().astype(np.int32)
            lower = data.tobytes().translate(bytes(k + 32 if 65 <= k <= 90 else k for k in range(256)))
            every = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(lower)])
            yield batch(out, [lang] * len(ids), every.take(pa.array(first * 2)), ids.view(np.int64), count.astype(np.int64))

    found = arrow_map(texts, run, "lang string, word binary, id long, n long")
    return found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")).select("lang", F.col("word").cast("string").alias("word"), "id", "n")


def numbered_vocabulary(texts: DataFrame, most: int = 20) -> tuple[DataFrame, int]:
    """(vocabulary, seed) such that no two words of the corpus share an id; a seed by which any do is passed over."""
    for seed in range(most):
        words = stored(vocabulary(texts, seed), "words")
        if not words.groupBy("id").count().where("count > 1").limit(1).count():
            return words, seed
    raise ValueError("no seed gives all words ids of their own")


def count_grams(texts: DataFrame, k: int, seed: int, bitmap: np.ndarray, expected: int, least: int) -> DataFrame:
    """(key, ids, a) of the phrases of k words that come at least `least` times.

    bitmap: keys of the frequent phrases of k - 1 words; a phrase is counted where both that it holds pass it. What passes
    by mistake is counted too, and falls below `least`. expected bounds the occurrences and sets the number of buckets, so
    the filters that meet in one group hold a bounded number of entries. Tasks send a filter for each bucket.
    """
    bits = max(8, (expected >> 20).bit_length())
    shard, out = pa.schema([("bucket", pa.int32()), ("data", pa.binary())]), pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64())), ("a", pa.int64())])

    def count(batches):
        held, size = [], 0

        def filters():
            x, rest, n = (np.concatenate(c) for c in zip(*held, strict=True)) if len(held) > 1 else held[0]
            x, rest, n = summed(x, rest, n)
            bucket = (x >> _U(64 - bits)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(x) else np.zeros(0, np.int64)
            spans = list(zip(starts, [*starts[1:], len(x)], strict=True))
            return batch(shard, bucket[starts], [QuotientFilter(bits, k, x[a:b], rest[a:b], n[a:b]).to_bytes() for a, b in spans])

        for _, _, w, n in _tokenised(batches, seed):
            if k == 2:
                part = may_be_in(w.id, bitmap)
            else:
                room = np.flatnonzero(w.follow >= k - 1)
                part = np.zeros(len(w.id), bool)
                part[room] = may_be_in(permuted(w.grams(k - 1, room)), bitmap)
            at = np.flatnonzero((w.follow[:n] >= k) & part[:n] & np.r_[part[1:], False][:n])
            if not len(at):
                continue
            ids = w.grams(k, at)
            held.append(summed(permuted(ids), np.stack(ids[1:], 1), np.ones(len(at), np.int64)))
            size += len(held[-1][0])
            if size > _HELD:
                yield filters()
                held, size = [], 0
        if held:
            yield filters()

    def merge(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, waiting = None, []
        for t in tables:
            waiting += [QuotientFilter.from_bytes(d) for d in t.column("data").to_pylist()]
            whole, waiting = QuotientFilter.merged([*([whole] if whole else []), *waiting]), []
        often = whole.count >= least
        x, rest, n = whole.x[often], whole.rest[often], whole.count[often]
        ids = np.stack(restored(x, list(rest.T)), 1)
        yield batch(out, x.view(np.int64), ids.view(np.int64).tolist(), n)

    shards = arrow_map(texts, count, "bucket int, data binary")
    return shards.groupBy("bucket").applyInArrow(merge, "key long, ids array<long>, a long")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((key, ids, a) of all phrases of 1 to `longest` words that come at least `least` times in their language, vocabulary).

    A phrase comes that often only if both phrases without its first and its last word do, so each length is counted over
    what the length before has left; a bitmap of bounded size tells tasks which may be frequent. longest is at most 5.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    texts = _texts(docs, text, lang)
    words, seed = numbered_vocabulary(texts)
    level = stored(words.where(F.col("n") >= least).select(F.col("id").alias("key"), F.array("id").alias("ids"), F.col("n").alias("a")), "phrases-1")
    levels = [level]
    for k in range(2, longest + 1):
        n, total = level.agg(F.count("*"), F.sum("a")).first()
        if not n:
            break
        level = stored(count_grams(texts, k, seed, key_filter(level, n), int(total), least), f"phrases-{k}")
        levels.append(level)
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    return found, words


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of at least two words.

    The score is the least, over the places where a phrase can be cut, of floor(1000 * a * n / (l * r)), in 38-digit
    integers; a phrase inside a longer one that comes as often is left out. Null and empty texts have no words, null
    languages are `und` (as is a language of that name), repeated rows count each time, and ties go by the phrase's bytes.
    """
    found, words = frequent_phrases(docs, text, lang, least, longest)
    size = F.size("ids")
    many = found.where(size >= 2).select("ids", "a")
    # of the longer phrases, those longer by one word are enough: what is between a phrase and one that comes as often does too
    longer = many.where(size >= 3).select("a", F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids")).groupBy("ids").agg(F.max("a").alias("longer"))
    kept = many.join(longer, "ids", "left").where("longer is null or longer < a").select("ids", "a")
    cut = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = found.select(F.col("ids").alias("part"), F.col("a").alias("f"))
    left = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("tail"))
    both = left.join(parts.toDF("head", "l"), "head").join(parts.toDF("tail", "r"), "tail")
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = words.where(F.col("n") >= least).select("id", "lang", "word")
    total = langs.join(per_lang, "lang").select(F.col("id").alias("__head"), "lang", "n")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.join(total, F.col("ids")[0] == F.col("__head")).withColumns({"__up": F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(17,0)"), "__down": big("l") * big("r")})
    scored = scored.withColumn("score", F.expr("cast(__up div __down as bigint)"))
    least_cut = stored(scored.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "n", "cut.score", "cut.l", "cut.r"), "scored")
    spelled = least_cut.select("ids", F.posexplode("ids").alias("place", "id")).join(langs.select("id", "word"), "id").groupBy("ids").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"])).alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = least_cut.join(spelled, "ids").withColumn("__salt", F.pmod(F.xxhash64("ids"), F.lit(64)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language: see collocations."""
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


def _sql() -> str:
    """DuckDB SQL of the query: all n-grams of all pieces."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, g, count(*)::HUGEINT AS a FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS g FROM w, range(1, {LONGEST + 1}) AS t(k) WHERE len(w) >= k
  ) GROUP BY lang, g HAVING count(*) >= {LEAST}
), c AS (
  SELECT * FROM f WHERE len(g) >= 2
), inside AS (
  SELECT DISTINCT lang, sub FROM (
    SELECT lang, a, unnest(list_transform(range(1, len(g) - m + 2), lambda i: g[i : i + m - 1])) AS sub FROM c, range(2, {LONGEST}) AS t(m) WHERE m < len(g)
  ) AS s JOIN c USING (lang) WHERE c.g = s.sub AND 100 * s.a >= 100 * c.a
), cuts AS (
  SELECT c.lang, c.g, c.a, k, h.a AS l, t.a AS r, (1000 * c.a * n) // (h.a * t.a) AS score
  FROM c JOIN totals USING (lang), range(1, {LONGEST}) AS x(k), f AS h, f AS t
  WHERE k < len(c.g) AND h.lang = c.lang AND h.g = c.g[1 : k] AND t.lang = c.lang AND t.g = c.g[k + 1 :]
    AND NOT EXISTS (SELECT 1 FROM inside AS i WHERE i.lang = c.lang AND i.sub = c.g)
), best AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cuts GROUP BY lang, g, a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}
"""


OP11_SQL = _sql()
