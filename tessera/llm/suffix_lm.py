"""Language-model scores by a probabilistic suffix tree over words, held in distributed tables."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, key_filter, may_be_in, read_table, release, remainder, stored, written

# Symbols are words, by their hash, and the start and the end of a text. A run of symbols has a key of its own: that of the
# run without its last symbol times _STEP, plus the last one's hash. The chance that two of n runs share a key is n*n / 2**65.
_STEP = np.uint64(0x9E3779B97F4A7C15)
START, END = b"\n", b"\n\n"
#: Which bytes are parts of words, as of bytes.split().
_PART = ~np.isin(np.arange(256), [*range(9, 14), 32])


def lm_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text."""
    return (text or "").encode().lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number by another one, which may be any; no two by the same."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def symbols(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at `first` in some bytes: their length, mixed with eight bytes after eight."""
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    out = _mixed(size.astype(np.uint64) * _STEP)
    at, left, own = first, size, slice(None)
    while len(at):
        unused = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        out[own] = _mixed(out[own] ^ (eight[at] << unused))
        longer = np.flatnonzero(left > 8)
        at, left, own = at[longer] + 8, left[longer] - 8, longer if isinstance(own, slice) else own[longer]
    return out


def symbol(word: bytes) -> int:
    return int(symbols(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def text_blocks(texts: pa.Array, most_bytes: int = 1_000_000, most: int = 2_000):
    """Slices of an array of texts, each of at most `most` texts and most_bytes; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_bytes, "right"))
        end = min(max(end, at + 1), at + most)
        yield at, min(end, len(texts))
        at = end


class Runs:
    """The symbols of some texts one after another, each text between START and END, and the keys of all their runs."""

    def __init__(self, texts: pa.Array) -> None:
        low = pc.ascii_lower(pc.fill_null(texts, ""))
        upto = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, 4 * low.offset).astype(np.int64)
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
        upto -= upto[0]
        part = _PART[data]
        # whether a word may begin, or have ended, at each place: after a separator, at one, and where a text begins
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = False
        edge[upto] = True
        first = np.flatnonzero(part & (edge[:-1] | np.append(True, ~part[:-1])[: len(part)]))
        end = np.flatnonzero(part & (edge[1:] | np.append(~part[1:], True)[: len(part)])) + 1
        self.size = np.diff(np.searchsorted(first, upto)) + 2
        self.first = np.cumsum(self.size) - self.size
        keys = np.empty(self.size.sum(), np.uint64)
        word = np.ones(len(keys), bool)
        for at, edge_symbol in ((self.first, START), (self.first + self.size - 1, END)):
            keys[at] = symbol(edge_symbol)
            word[at] = False
        keys[word] = symbols(data, first, end - first)
        self.keys = [keys]
        self.place = np.arange(len(keys)) - np.repeat(self.first, self.size)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)

    def longer(self) -> np.ndarray:
        """Keys of the runs of one symbol more that end at each place; what crosses a text's start is not `whole`."""
        last = self.keys[-1]
        with np.errstate(over="ignore"):
            new = self.keys[0].copy()
            new[1:] += last[:-1] * _STEP
        self.keys.append(new)
        return new

    def whole(self, size: int) -> np.ndarray:
        return self.place >= size - 1


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


#: Rows of a table of runs that one task gathers, about.
GATHERED = 1_500_000


def _planes(column: np.ndarray) -> bytes:
    """A column's lowest bytes, then the next ones and so on, so that high zeros stand together."""
    return column.view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Keys in ascending order, as differences, with columns that go with them."""
    data = _planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(_planes(c) for c in columns)
    return len(keys).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes, *types: type) -> list[np.ndarray]:
    """What pack() was given; types are those of the columns."""
    n, at = int.from_bytes(data[:4], "little"), 0
    width = [8, *(np.dtype(t).itemsize for t in types)]
    data = pa.decompress(data[4:], n * sum(width), "zstd", asbytes=True)
    out = []
    for w, t in zip(width, (np.uint64, *types), strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(t).reshape(n))
        at += n * w
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that have keys, where they begin and the last one ends): ascending keys are evenly spread, so their leading bits
    deal them in runs."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    full, first = np.unique(bucket, return_index=True)
    return full.astype(np.int32), np.append(first, len(keys))


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """(keys, n, ...) of tables that are in order of their keys: one row a key, in order, with the sum of n."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.argsort(columns[0], kind="stable")  # merges what is in order
    keys = columns[0][order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return [keys[first], np.add.reduceat(columns[1][order], first, dtype=columns[1].dtype) if len(first) else columns[1], *(c[order[first]] for c in columns[2:])]


class _Blocks:
    """Runs gathered by a task, combined and dealt by key into blocks of bytes, so that a shuffle moves few rows.

    Linked runs go with the key of the run without the last symbol; those of more than two symbols also with that of the run
    without the first one, which for two symbols follows from the others.
    """

    schema = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("linked", pa.bool_()), ("data", pa.binary())])

    def __init__(self, size: int, buckets: int, linked: bool, flush: int = 500_000) -> None:
        self.size, self.buckets, self.linked, self.flush = size, buckets, linked, flush // (2 if linked else 1)
        self.held, self.n, self.own = [], 0, None

    def add(self, *columns: np.ndarray) -> bool:
        """Whether there are so many different runs that they should go."""
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n > self.flush:
            self._combine()
        return self.own is not None and len(self.own[0]) > self.flush

    def _combine(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        if self.linked:
            order = np.argsort(columns[0])
            new = _summed([[columns[0][order], np.ones(len(order), np.uint32), *(c[order] for c in columns[1:])]])
        else:
            keys, n = np.unique(columns[0], return_counts=True)
            new = [keys, n.astype(np.uint32)]
        self.own = new if self.own is None else _summed([self.own, new])

    def blocks(self) -> pa.RecordBatch:
        if self.held:
            self._combine()
        if self.own is None:
            return batch(self.schema, [], [], [], [])
        own, self.own = self.own, None
        full, ends = dealt(own[0], self.buckets)
        data = [pack(*(c[a:b] for c in own)) for a, b in zip(ends, ends[1:], strict=False)]
        return batch(self.schema, [self.size] * len(full), full, [self.linked] * len(full), data)

    @staticmethod
    def gathered(blocks: list[bytes], size: int, linked: bool) -> list[np.ndarray]:
        """(keys, n[, context, suffix]) of the blocks of one bucket."""
        types = [np.uint32, *([np.uint64] * min(size - 1, 2) if linked else [])]
        parts = [unpack(b, *types) for b in blocks]
        keys, n, *more = _summed([[k, n.astype(np.int64), *m] for k, n, *m in parts])
        if linked and size == 2:
            with np.errstate(over="ignore"):
                more.append(keys - more[0] * _STEP)
        return [keys, n, *more]


def run_counts(docs: DataFrame, sizes: list[int], links: list[int], shorter: np.ndarray | None, buckets: int, least_count: int, text_col: str = "text", train_col: str = "train") -> DataFrame:
    """(size, linked, key, n, context, suffix): runs of `sizes` symbols in the training texts, counted over all of them.

    shorter: a key_filter of the frequent runs of one symbol less than the longest of sizes; a run both of whose parts are
    not there cannot be frequent and is not counted. Runs whose size is in `links` come with the keys of the run without
    its last and without its first symbol; those of a size below the longest are counted only if the filter has them.
    Of runs of more than one symbol only those are returned that come least_count times.
    """
    may = docs.sparkSession.sparkContext.broadcast(shorter)
    every = sorted({*sizes, *links})

    def run(batches):
        blocks = {size: _Blocks(size, buckets, size in links) for size in every}
        for b in batches:
            texts = b.column(0)
            for at, end in text_blocks(texts):
                runs = Runs(texts[at:end])
                while len(runs.keys) < every[-1]:
                    runs.longer()
                passes = None if may.value is None else may_be_in(runs.keys[every[-1] - 2], may.value) & runs.whole(every[-1] - 1)
                for size, own in blocks.items():
                    if size == 1:
                        ends = np.flatnonzero(runs.place > 0)
                    elif passes is None:
                        ends = np.flatnonzero(runs.whole(size))
                    elif size == every[-1]:
                        ends = np.flatnonzero(passes[1:] & passes[:-1] & runs.whole(size)[1:]) + 1
                    else:
                        ends = np.flatnonzero(passes & runs.whole(size))
                    columns = [runs.keys[size - 1][ends]]
                    if size in links:
                        columns += [runs.keys[size - 2][ends - 1], runs.keys[size - 2][ends]][: size - 1]
                    if own.add(*columns):
                        yield own.blocks()
        for own in blocks.values():
            yield own.blocks()

    def combine(key, t):
        size, _, linked = (k.as_py() for k in key)
        keys, n, *more = _Blocks.gathered(t.column("data").to_pylist(), size, linked)
        keep = n >= (least_count if size > 1 else 1)
        more = [pa.array(_signed(c[keep])) for c in more] or [pa.nulls(int(keep.sum()), pa.int64())] * 2
        m = int(keep.sum())
        return pa.table({"size": pa.array([size] * m, pa.int32()), "linked": pa.array([linked] * m, pa.bool_()), "key": _signed(keys[keep]), "n": n[keep], "context": more[0], "suffix": more[1]})

    rows = arrow_map(docs.where(train_col).select(text_col), run, "size int, bucket int, linked boolean, data binary")
    return rows.groupBy("size", "bucket", "linked").applyInArrow(combine, "size int, linked boolean, key bigint, n bigint, context bigint, suffix bigint")


@dataclass
class SuffixTree:
    """words (key, n) of all training words; values (key, n, value): what each run that ends at a place adds to the log10
    probability, in two rows for a run that has a value of its own and is a context too; per length of context how many were
    tested and retained; the figures of the base score."""

    words: DataFrame
    values: DataFrame
    tested: list[tuple[int, int, int]]
    tokens: int
    distinct: int

    def base(self, n: float) -> float:
        return math.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def grow(runs: DataFrame, shorter: DataFrame, least_gain: float) -> tuple[DataFrame, DataFrame]:
    """(level, contexts) of one length: the contexts whose next-symbol distribution diverges from their suffix's.

    runs: (key, context, suffix, n) of frequent runs; shorter: (key, n, logp) of those of one symbol less. A context's
    distribution gives each frequent continuation its count and shares a weight of one for each of them, and the counts
    of all others, by the distribution of the suffix. The divergence is the log-likelihood in nats that this gains over
    the suffix on all occurrences of the context; a context is retained if it gains least_gain for each continuation, the
    parameters that it adds. level: (key, n, logp, context, more), logp by the longest retained context and `more` what the
    run adds beyond its suffix's run and its context's weight; contexts: (key, n, rest, retained), log10 weights.
    """
    s = shorter.select(F.col("key").alias("suffix"), F.pow(F.lit(10.0), "logp").alias("q"))
    own = Window.partitionBy("context")
    # a context has as many rows as frequent continuations; all that it needs comes with one exchange
    each = runs.join(s, "suffix").select("key", "context", "n", "q").withColumns({"kept": F.sum("n").over(own), "kinds": F.count("*").over(own), "head": F.min("key").over(own) == F.col("key")})
    each = each.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("seen")), "context").withColumn("all", F.greatest("seen", "kept"))
    each = each.withColumn("left", F.col("all") - F.col("kept") + F.col("kinds")).withColumn("rest", F.col("left") / (F.col("kept") + F.col("left")))
    each = each.withColumn("p", (F.col("n") + F.col("left") * F.col("q")) / (F.col("kept") + F.col("left")))
    gain = F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).over(own) + (F.col("all") - F.col("kept")) * F.log("rest")
    each = each.withColumn("retained", gain >= least_gain * F.col("kinds"))
    more = F.log10("p") - F.log10("q") - F.log10("rest")
    level = stored(each.select(
        "key", "n", F.when(F.col("retained"), F.log10("p")).otherwise(F.log10("q")).alias("logp"), F.when(F.col("retained"), more).otherwise(0.0).alias("more"),
        *[F.when(F.col("head"), F.col(c)).alias(c) for c in ("context", "all", "rest", "retained")],
    ), "level")
    contexts = level.where("context is not null").select(F.col("context").alias("key"), F.col("all").alias("n"), F.log10("rest").alias("rest"), "retained")
    return level.select("key", "n", "logp", "more"), contexts


def fit_tree(docs: DataFrame, text_col: str = "text", train_col: str = "train", depth: int = 3, least_count: int = 4, least_gain: float = 2.0) -> SuffixTree:
    """A suffix tree of contexts of up to `depth` symbols, learnt from the rows whose train_col is true.

    A run is frequent if it comes least_count times, whatever the size of the corpus, so no number of runs is fixed and what
    is learnt of a run depends on its own counts. All runs are counted over all training texts. Contexts grow by a symbol until none of a length is retained or `depth` is
    reached. The tree is three kinds of rows in tables of the shared folder; nothing of it passes through the driver.
    """
    spark = docs.sparkSession
    # words of a corpus are about a sixth of its bytes
    ends, size = docs.where(train_col).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    buckets = max(1, -(-size // (6 * GATHERED)))
    count = lambda *a: stored(run_counts(docs, *a, buckets, least_count, text_col, train_col), "runs")
    found = count([1, 2], [], None)
    words, runs = found.where("size = 1").select("key", "n"), found.where("size = 2").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = SuffixTree(words, words, [], total, distinct)
    start = spark.range(1).select(F.lit(int(_signed(np.array([symbol(START)], np.uint64))[0])).alias("key"), F.lit(ends).cast("long").alias("n"), F.lit(0.0).alias("logp"))
    scale = total + 0.5 * (distinct + 1)
    shorter = words.where(F.col("n") >= least_count).select("key", "n", F.log10((F.col("n") + 0.5) / F.lit(scale)).alias("logp")).unionByName(start.where(F.col("n") >= least_count))
    values = []
    linked = None
    for size in range(2, depth + 2):
        # runs of this size are known; the pass that counts the next size also links them with their parts
        if linked is None:
            n = runs.count()
            if not n:
                break
            # in the last pass the longest runs, which are few, bring their links along
            last = size + 1 >= depth + 1
            found = count([size + 1] if size <= depth else [], [size, size + 1] if last and size <= depth else [size], key_filter(runs, n))
            linked = found.where(f"size = {size}")
            runs = found.where(f"size = {size + 1}")
        level, contexts = grow(linked.select("key", "context", "suffix", "n"), shorter, least_gain)
        tested, retained = contexts.agg(F.count("*"), F.count_if("retained")).first()
        if not tested:
            break
        tree.tested.append((size - 1, tested, retained))
        values += [level.where("more <> 0").select("key", "n", F.col("more").alias("value")), contexts.where("retained").select("key", "n", F.col("rest").alias("value"))]
        shorter = level.select("key", "n", "logp")
        if not retained:
            break
        linked = runs.where("linked") if size + 1 == depth + 1 else None
    none = words.where("false").select("key", "n", F.lit(0.0).alias("value"))
    tree.values = reduce(DataFrame.unionByName, values, none)
    return tree


def _sorted(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """A bounded table's columns as arrays, by key."""
    t = rows.select("key", *columns).toArrow()
    keys = t.column("key").to_numpy()
    order = np.argsort(keys)
    return [keys[order], *(t.column(c).to_numpy()[order] for c in columns)]


def _look_up(keys: np.ndarray, table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there)."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return at, table[0][at] == keys


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", hot: int = 1_000_000, **fit) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score): one row a document, repeated rows included.

    A token's log10 probability is the sum of what the runs that end at it, or just before it, add; so each run is looked up
    by itself. The most frequent runs, at most `hot` of them, go to every task. The others that a bitmap does not rule out
    are dealt by key, as are the tree's other rows, so that each bucket is looked up in one task; no key of them is
    frequent, and the number of buckets grows with the tree and the texts. What a bucket adds to the documents of a block
    comes back as one row. `hot` only decides where a run is looked up: the scores are the same for any.

    A word that training texts lack has the count 0. Null text is empty and has its end alone. A null train counts as not
    for training; null ids stay null; other columns are ignored. Equal texts score alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    before = written()
    tree = fit_tree(rows, "text", "train", **fit)
    everything = tree.words.select("key", "n", F.col("n").alias("count"), F.lit(0.0).alias("value")).unionByName(tree.values.select("key", "n", F.lit(0).cast("long").alias("count"), "value"))
    everything = everything.groupBy("key").agg(F.max("n").alias("n"), F.max("count").alias("count"), F.sum("value").alias("value"))
    # eight steps to a doubling of n: few enough to list
    everything = stored(everything.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "tree")
    release(spark, before, written() - 1)  # the tree has all that scoring reads
    least, n_hot, n_cold = 1 << 30, 0, 0
    for r in everything.groupBy("step").count().orderBy(F.desc("step")).collect():
        if n_cold or n_hot + r["count"] > hot:
            n_cold += r["count"]
        else:
            least, n_hot = r.step, n_hot + r["count"]
    cold = everything.where(F.col("step") < least)
    table = _sorted(everything.where(F.col("step") >= least), ["count", "value"])
    buckets = max(1, -(-n_cold // 500_000), -(-tree.tokens // GATHERED))
    unknown, scale = tree.base(0), tree.tokens + 0.5 * (tree.distinct + 1)
    known = spark.sparkContext.broadcast((table, key_filter(everything, n_hot + n_cold)))
    longest = 1 + max([0, *(size for size, _, _ in tree.tested)])
    block = pa.schema([("row", pa.int64()), ("bucket", pa.int32()), ("whole", pa.bool_()), ("data", pa.binary())])
    sums = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def split(batches):
        """For each block of documents what is known of them at once, and for each bucket the runs to be looked up there."""
        table, bitmap = known.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at, end in text_blocks(b.column(2)):
                runs = Runs(b.column(2)[at:end])
                n = len(runs.size)
                base, more, seen = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
                travel = []
                for size in range(1, longest + 1):
                    keys = runs.keys[0] if size == 1 else runs.longer()
                    may = may_be_in(keys, bitmap)
                    if size == 1:
                        # a text's start is looked up as a context only
                        base += unknown * np.bincount(runs.doc[~may & (runs.place > 0)], minlength=n)
                    else:
                        may &= runs.whole(size)
                    where = np.flatnonzero(may)
                    keys = _signed(keys[where])
                    # in order, so that the search walks through the table
                    order = np.argsort(keys)
                    keys, where = keys[order], where[order]
                    doc, token = runs.doc[where], (runs.place[where] > 0) & (size == 1)
                    place, there = _look_up(keys, table)
                    more += np.bincount(doc[there], table[2][place[there]], n)
                    own = np.flatnonzero(there & token)
                    count = table[1][place[own]]
                    base += np.bincount(doc[own], np.log10((count + 0.5) / scale), n)
                    seen += np.bincount(doc[own[count > 0]], minlength=n)
                    cold = ~there
                    if n_cold:
                        travel.append((keys[cold].view(np.uint64), doc[cold].astype(np.uint16) * np.uint16(2) + token[cold]))
                    else:
                        base += unknown * np.bincount(doc[cold & token], minlength=n)
                own = batch(sums, b.column(0)[at:end], b.column(1)[at:end], runs.size - 1, seen, base, base + more)
                yield batch(block, [row], [row % buckets], [True], [own.serialize().to_pybytes()])
                if travel:
                    keys, doc = (np.concatenate(c) for c in zip(*travel, strict=True))
                    order = np.argsort(keys)
                    keys, doc = keys[order], doc[order]
                    full, ends = dealt(keys, buckets)
                    m = len(full)
                    yield batch(block, [row] * m, full, [False] * m, [pack(keys[a:b_], doc[a:b_]) for a, b_ in zip(ends, ends[1:], strict=False)])
                row += 1

    pieces = arrow_map(rows.select("id", "train", "text"), split, "row bigint, bucket int, whole boolean, data binary")

    def meet(blocks, tree_rows):
        keys = tree_rows.column("key").to_numpy()
        order = np.argsort(keys)
        table = [keys[order], *(tree_rows.column(c).to_numpy()[order] for c in ("count", "value"))]
        out = []
        for row, whole, data in zip(*(blocks.column(c).to_pylist() for c in ("row", "whole", "data")), strict=True):
            if not whole:
                keys, doc = unpack(data, np.uint16)
                token, doc = (doc & 1).astype(bool), doc >> 1
                place, there = _look_up(_signed(keys), table)
                count = np.zeros(len(keys), np.int64)
                count[there] = table[1][place[there]]
                base = np.where(token, np.log10((count + 0.5) / scale), 0.0)
                more = np.zeros(len(keys))
                more[there] = table[2][place[there]]
                some, doc = np.unique(doc, return_inverse=True)
                data = pack(some.astype(np.uint64), np.bincount(doc, token & (count > 0)).astype(np.uint32), np.bincount(doc, base), np.bincount(doc, more))
            out.append((row, whole, data))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["row", "whole", "data"])

    def total(batches):
        """The documents of a block, with what all buckets add to them."""
        for b in batches:
            for parts in b.column(0).to_pylist():
                own = pa.ipc.read_record_batch(pa.py_buffer(next(p["data"] for p in parts if p["whole"])), sums)
                seen, base, score = (own.column(k).to_numpy().copy() for k in (3, 4, 5))
                for p in parts:
                    if not p["whole"]:
                        some, n, of_base, more = unpack(p["data"], np.uint32, np.float64, np.float64)
                        doc = some.astype(np.int64)
                        seen[doc] += n
                        base[doc] += of_base
                        score[doc] += of_base + more
                yield batch(sums, *own.columns[:3], seen, base, score)

    if n_cold:
        lead = F.shiftrightunsigned("key", 32) * F.lit(buckets)
        tree_rows = cold.select(F.shiftrightunsigned(lead, 32).cast("int").alias("bucket"), "key", "count", "value")
        pieces = pieces.groupBy("bucket").cogroup(tree_rows.groupBy("bucket")).applyInArrow(meet, "row bigint, whole boolean, data binary")
    parts = pieces.groupBy("row").agg(F.collect_list(F.struct("whole", "data")))
    found = arrow_map(parts.drop("row"), total, "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: How often a run of words comes at least that contexts are learnt from.
LEAST_COUNT = 8


def op8_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows at the edge: see score_documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", remainder("doc_id", 5) != 1)
    return score_documents(docs, least_count=LEAST_COUNT).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
