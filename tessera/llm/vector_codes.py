"""Vector codes: product quantisation by integer Lloyd rounds, in which trees over parts and entries are met together."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, read_table, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components stay below this, so that squared distances and their sums fit 64-bit integers.
_MOST = 1 << 25
_LEAF = 16


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * x); the product is exact, as 256 is a power of two."""
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


@dataclass
class BoxTree:
    """A balanced tree over the rows of a matrix: level l holds 2**l nodes of equal size, each a run of `order`.

    Rows are padded to leaf * 2**depth by repeating the last row at weight 0, so nodes need no pointers: node k of level l
    has the children 2k and 2k + 1. Each level caches its nodes' bounding boxes, counts and sums.
    """

    order: np.ndarray
    weight: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    count: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def over(cls, rows: np.ndarray, leaf: int) -> BoxTree:
        n, width = rows.shape
        depth = max(0, (-(-n // leaf) - 1).bit_length())
        size = leaf << depth
        order = np.minimum(np.arange(size), n - 1)
        weight = (np.arange(size) < n).astype(np.int64)
        low, high, count, sums = [], [], [], []
        for level in range(depth + 1):
            own = rows[order].reshape(1 << level, -1, width)
            w = weight.reshape(1 << level, -1)
            low.append(own.min(1))
            high.append(own.max(1))
            count.append(w.sum(1))
            sums.append((own * w[:, :, None]).sum(1))
            if level < depth:  # each node is halved at the median of its widest side
                side = (high[-1] - low[-1]).argmax(1) if width else np.zeros(1 << level, np.int64)
                key = np.take_along_axis(own, side[:, None, None], 2)[:, :, 0] if width else w
                place = np.argsort(key, 1, kind="stable")
                order = np.take_along_axis(order.reshape(1 << level, -1), place, 1).ravel()
                weight = np.take_along_axis(w, place, 1).ravel()
        return cls(order, weight, low, high, count, sums)

    @property
    def depth(self) -> int:
        return len(self.low) - 1


class DualTree:
    """Assigns points to their nearest entries by descending a tree over each together.

    Pairs of nodes are dropped when the least distance of their boxes is above the most distance that any entry of the
    point node's pairs can have. A point node with one entry left is assigned whole, by its cached count and sums; what is
    left at the leaves is decided by integer distances, ties to the lower entry.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.tree = entries, BoxTree.over(entries, 1)

    def pairs(self, points: BoxTree):
        """Yields (level, point nodes, their one entry) assigned whole, and last (None, leaf nodes, entries) undecided pairs."""
        node, own = np.zeros(1, np.int64), np.zeros(1, np.int64)
        level = at = 0
        while True:
            lp, hp, le, he = points.low[level][node], points.high[level][node], self.tree.low[at][own], self.tree.high[at][own]
            gap = np.maximum(0, np.maximum(le - hp, lp - he))
            reach = np.maximum(np.abs(he - lp), np.abs(hp - le))
            least, most = (gap * gap).sum(1), (reach * reach).sum(1)
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(node)]))
            keep = least <= bound
            node, own = node[keep], own[keep]
            if at == self.tree.depth:
                entry = self.tree.order[own]
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                # padded copies of the last entry are one entry
                alone = np.minimum.reduceat(entry, starts) == np.maximum.reduceat(entry, starts)
                yield level, node[starts[alone]], entry[starts[alone]]
                rest = np.repeat(~alone, np.diff(np.r_[starts, len(node)]))
                node, own = node[rest], own[rest]
                if not len(node):
                    return
                if level == points.depth:
                    yield None, node, self.tree.order[own]
                    return
            if at < self.tree.depth:
                node, own = np.repeat(node, 2), np.repeat(own * 2, 2) + np.tile([0, 1], len(own))
                at += 1
            if level < points.depth:
                # the children of a node stand together: all pairs of the first, then all of the second
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
                both = np.concatenate([group * 2, group * 2 + 1])
                place = np.argsort(both, kind="stable")
                node, own = np.concatenate([node * 2, node * 2 + 1])[place], np.concatenate([own, own])[place]
                level += 1

    def _nearest(self, rows: np.ndarray, points: BoxTree, leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the tree's order, entry) of the points of undecided leaves."""
        size = len(points.order) >> points.depth
        starts = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
        place = (leaves[:, None] * size + np.arange(size)).reshape(-1, size)
        d = ((rows[points.order[place]] - self.entries[entries][:, None, :]) ** 2).sum(2)
        least = np.minimum.reduceat(d, starts)
        sizes = np.diff(np.r_[starts, len(leaves)])
        chosen = np.where(d == np.repeat(least, sizes, 0), entries[:, None], len(self.entries))
        return place[starts].ravel(), np.minimum.reduceat(chosen, starts).ravel()

    def sums(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, component sums) of the rows nearest to each entry; no single row is assigned inside whole nodes."""
        points = BoxTree.over(rows, _LEAF)
        count, total = np.zeros(len(self.entries), np.int64), np.zeros(self.entries.shape, np.int64)
        for level, nodes, entry in self.pairs(points):
            if level is None:
                place, entry = self._nearest(rows, points, nodes, entry)
                np.add.at(count, entry, points.weight[place])
                np.add.at(total, entry, rows[points.order[place]] * points.weight[place][:, None])
            else:
                np.add.at(count, entry, points.count[level][nodes])
                np.add.at(total, entry, points.sums[level][nodes])
        return count, total

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """The nearest entry of each row."""
        points = BoxTree.over(rows, _LEAF)
        out = np.zeros(len(points.order), np.int64)
        for level, nodes, entry in self.pairs(points):
            if level is None:
                place, entry = self._nearest(rows, points, nodes, entry)
            else:
                size = len(points.order) >> level
                place, entry = (nodes[:, None] * size + np.arange(size)).ravel(), np.repeat(entry, size)
            out[place] = entry
        found = np.zeros(len(rows), np.int64)
        found[points.order] = out
        return found


def _usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has components, none of them null or not finite. An empty vector counts as null."""
    x = F.col(vec)
    return df.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))


def _blocks(batches, width: int, parts: int, at: int = 0, most: int = 1 << 16):
    """(record batches, integer matrix) of up to about `most` vectors a time; a vector of another width is an error."""
    held, n = [], 0

    def out():
        flat = [b.column(at) for b in held]
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in flat])
        if (sizes != width).any() or width % parts:
            raise ValueError(f"vectors must all have one width that {parts} divides; found {sorted(set(sizes.tolist()) | {width})[:5]}")
        x = scaled(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in flat]).reshape(-1, width))
        if np.abs(x).max() >= _MOST:
            raise ValueError(f"components must be below {_MOST // SCALE} in size")
        return held, x

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _trees(books: np.ndarray) -> list[DualTree]:
    return [DualTree(b) for b in books]


def lloyd_round(vectors: DataFrame, vec: str, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round: each entry is the floored mean of its parts; unused ones stay.

    A task returns one row for each part and entry that it used, and those are summed by Spark, so the driver gets at most
    parts * entries rows.
    """
    parts, _, inner = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        trees = _trees(books)
        for _, x in _blocks(batches, parts * inner, parts):
            for p, tree in enumerate(trees):
                count, total = tree.sums(x[:, p * inner : (p + 1) * inner])
                used = np.flatnonzero(count)
                yield batch(schema, [p] * len(used), used.astype(np.int32), count[used], total[used].tolist())

    partial = arrow_map(vectors.select(vec), run, "part int, entry int, n long, sums array<long>")
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(inner)]).collect()
    new = books.copy()
    for r in found:
        new[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(inner)]
    return new


def fit_codebooks(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) after the rounds, started from the vectors of the smallest ids.

    Rows without a usable vector play no part; null ids come first, and repeated ids count once for each row, in the order
    of their vectors. Fewer rows than entries give smaller codebooks; none give None. The driver holds entries vectors.
    """
    usable = _usable(df.select(vec_id, vec), vec)
    first = [r[0] for r in usable.orderBy(F.col(vec_id).asc_nulls_first(), F.col(vec).asc()).select(vec).limit(entries).collect()]
    if not first:
        return None
    width = len(first[0])
    if width % parts or any(len(v) != width for v in first):
        raise ValueError(f"vectors must all have one width that {parts} divides")
    books = scaled(np.array(first)).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = lloyd_round(usable, vec, books)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(df: DataFrame, books: np.ndarray, vec: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The kept columns of rows with a usable vector, and `code` (two hexadecimal digits a part) and `error`."""
    parts, _, inner = books.shape
    fields = [df.schema[c] for c in keep]
    names = [*(f.name for f in fields), "code", "error"]

    def run(batches):
        trees = _trees(books)
        for held, x in _blocks(batches, parts * inner, parts, at=len(fields)):
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees):
                own = x[:, p * inner : (p + 1) * inner]
                chosen = tree.nearest(own)
                code[:, p] = chosen
                error += ((own - tree.entries[chosen]) ** 2).sum(1)
            done = 0
            for b in held:
                n = b.num_rows
                text = [c.tobytes().hex() for c in code[done : done + n]]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.array(text, pa.string()), pa.array(error[done : done + n])], names=names)
                done += n

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["code string", "error long"])
    return arrow_map(_usable(df, vec).select(*[f"`{c}`" for c in keep], vec), run, schema)


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty or hold null or non-finite components are dropped; rows repeat, null labels are one label,
    a table without usable vectors gives no rows. Vectors of different widths and components of 131,072 and more are errors.
    """
    df = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit_codebooks(df)
    if books is None:
        return df.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(df, books, keep=("vec_id", "label")), "codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB SQL of the query: the rounds as plain joins of all parts with all entries."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS (SELECT r, p, min((d, e)) AS best FROM (
  SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM x JOIN b{k} AS b ON x.p = b.p) GROUP BY r, p)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""c{k} AS (SELECT x.p, best[2] AS e, i, floor(sum(x.v[i])::HUGEINT / count(*))::BIGINT AS m,
  sum(x.v[i]) AS s, count(*) AS n FROM x JOIN a{k} AS a ON x.r = a.r AND x.p = a.p, range(1, (SELECT max(len(v)) + 1 FROM x)) AS t(i) GROUP BY ALL),
b{k + 1} AS (SELECT b.p, b.e, coalesce((SELECT list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i)::BIGINT[] FROM c{k} AS c WHERE c.p = b.p AND c.e = b.e), b.v) AS v FROM b{k} AS b)"""
            )
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) AS t(p)
), b0 AS (
  SELECT p, r - 1 AS e, v FROM x WHERE r <= {ENTRIES}
), {", ".join(steps)}, coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN coded USING (r), digest
"""


OP12_SQL = _sql()
