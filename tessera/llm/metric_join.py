"""Embedding near-duplicates by an exact metric range join on angles."""

from __future__ import annotations

import math
from functools import reduce
from math import fsum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, read_table, stored
from .components import connected_components
from .simhash import _forest


# Added to every angle's bound: more than the error of arccos near 0.
SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _hits(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs whose cosine reaches `least`, as double precision decides.

    A single-precision product settles all pairs further from the bound than its largest possible error; the few others
    are decided in double precision, and those within its rounding by an exactly rounded sum.
    """
    margin = 1e-6 + 2.5e-7 * a.shape[1]
    c = a.astype(np.float32) @ b.astype(np.float32).T
    i, j = np.nonzero(c >= np.float32(least - margin))
    sure = c[i, j] >= np.float32(least + margin)
    for k in np.array_split(np.flatnonzero(~sure), max(1, int((~sure).sum()) // 100_000)):
        exact = (a[i[k]] * b[j[k]]).sum(axis=1)
        sure[k] = exact >= least
        for q in k[np.abs(exact - least) < 1e-13]:
            sure[q] = fsum((a[i[q]] * b[j[q]]).tolist()) >= least - 2e-16
    return i[sure], j[sure]


def _groups(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, unit vectors) of the vectors of each length in an Arrow column."""
    dims = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        out.append((int(d), at, _unit(pc.list_flatten(column.take(pa.array(at))).to_numpy().astype(np.float64).reshape(len(at), -1))))
    return out


def distinct_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, m, v): each distinct usable vector once, and how many rows hold it.

    Null, empty and zero vectors and those with null or non-finite components are left out: they link with nothing.
    """
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    groups = rows.where(fine).groupBy(v.alias("v")).agg(F.min(id_col).alias("id"), F.count("*").alias("m"))
    return groups.select(F.struct(F.col("id").isNull().alias("none"), "id", F.monotonically_increasing_id().alias("g")).alias("node"), "m", "v")


def choose_pivots(vectors: DataFrame, most: int) -> list[list[float]]:
    """About as many pivots as the square root of the vectors, lowest hash first; `most` bounds what every task holds.

    Any choice gives the same links: fewer pivots only leave more vectors to be compared in blocks.
    """
    n = vectors.count()
    wanted = min(most, math.isqrt(n) + (n > 0))
    return [list(r.v) for r in vectors.orderBy(F.xxhash64("v"), "node").limit(wanted).collect()] if n else []


def partitioned(vectors: DataFrame, pivots: list[list[float]], least: float) -> tuple[DataFrame, DataFrame]:
    """(cells, rest): cells (cell, home, node, m, v) join independently; rest (node, m, v) are far from every pivot.

    Let r be the largest angle of a link. A vector within r of its nearest pivot is at home in that pivot's cell; the
    cell's radius is its farthest home vector's angle. By the triangle inequality a vector linked with one of the cell's is
    within that radius + r of the pivot, and, if its own nearest pivot is at angle d, within d + 2r: only such vectors are
    replicated into the cell as guests. Vectors that are at home elsewhere enter only cells that come before their home, so
    a pair of vectors meets once. The rest can link with each other outside all cells. Vectors of another length than all
    pivots are of the rest too.
    """
    reach = math.acos(least) + SLACK
    by_dim: dict[int, list] = {}
    for p in pivots:
        by_dim.setdefault(len(p), []).append(p)
    by_dim = {d: _unit(np.array(p, np.float64)) for d, p in by_dim.items()}
    offset = dict(zip(by_dim, np.cumsum([0, *map(len, by_dim.values())])[:-1].tolist(), strict=True))

    def far(batches):
        for b in batches:
            for d, _, x in _groups(b.column(0)):
                if d in by_dim:
                    angles = _angles(x, by_dim[d])
                    home, own = angles.argmin(axis=1), angles.min(axis=1)
                    near = own <= reach
                    widest = np.full(len(by_dim[d]), -1.0)
                    np.maximum.at(widest, home[near], own[near])
                    at = np.flatnonzero(widest >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(at + offset[d]), pa.array(widest[at])], names=["cell", "angle"])

    # one row a pivot at most
    radius = {r.cell: r.angle for r in arrow_map(vectors.select("v"), far, "cell bigint, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect()}

    def deal(batches):
        for b in batches:
            for d, at, x in _groups(b.column("v")):
                rows, cells, own = [np.arange(len(at))], [np.full(len(at), -1)], [np.ones(len(at), bool)]
                if d in by_dim:
                    angles = _angles(x, by_dim[d])
                    home, nearest = angles.argmin(axis=1), angles.min(axis=1)
                    home = np.where(nearest <= reach, home, angles.shape[1])
                    cells[0] = np.where(nearest <= reach, home + offset[d], -1)
                    for p in range(angles.shape[1]):
                        i = np.flatnonzero((p < home) & (angles[:, p] <= nearest + 2 * reach) & (angles[:, p] <= radius.get(p + offset[d], -9.0) + reach))
                        rows.append(i)
                        cells.append(np.full(len(i), p + offset[d]))
                        own.append(np.zeros(len(i), bool))
                picked = b.take(pa.array(at[np.concatenate(rows)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(own)), *picked.columns], names=["cell", "home", *picked.schema.names])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    dealt = stored(arrow_map(vectors, deal, f"cell bigint, home boolean, {types}"), "cells")
    return dealt.where("cell >= 0"), dealt.where("cell < 0").select(*vectors.columns)


def links(cells: DataFrame, least: float, block_rows: int = 8192) -> DataFrame:
    """(node, n, to): for each vector with links, how many rows of others a piece of work links it with, and its star.

    cells: (cell, home, node, m, v). A cell's home and guest vectors are cut into blocks by hash, and a piece of work is two
    home blocks, or a home and a guest block: so every home pair and every home and guest pair meets once, no piece
    holds more than two blocks however large the cell, and a vector is copied once for each block it meets, not for
    each vector. Counts and stars grow with the rows, not with the pairs.
    """
    sizes = cells.groupBy("cell").agg(*[F.ceil(F.count_if(F.col("home") == h) / block_rows).cast("int").alias(n) for n, h in (("homes", True), ("guests", False))])
    dealt = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node.g", F.lit(5)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda a, b, guests: F.struct(a.alias("a"), b.alias("b"), F.lit(guests).alias("guests"))
    mine = F.col("block")
    at_home = F.concat(F.transform(up_to("homes"), lambda j: unit(F.least(mine, j), F.greatest(mine, j), False)), F.transform(up_to("guests"), lambda j: unit(mine, j, True)))
    units = F.when(F.col("home"), at_home).otherwise(F.transform(up_to("homes"), lambda j: unit(j, mine, True)))
    work = dealt.select("cell", "home", "block", "node", "m", "v", F.explode(units).alias("u")).select("cell", "u.*", "home", "block", "node", "m", "v")
    node = cells.schema["node"].dataType.simpleString()

    def run(key, t):
        _, a, b, guests = (k.as_py() for k in key)
        t = t.combine_chunks()
        block, home = t.column("block").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        m, nodes = t.column("m").to_numpy(), t.column("node").combine_chunks()
        n = np.zeros(len(m), np.int64)
        stars = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for _, at, x in _groups(t.column("v").combine_chunks()):
            left = np.flatnonzero(home[at] if guests else block[at] == a)
            alone = not guests and a == b
            right = left if alone else np.flatnonzero(~home[at] if guests else block[at] == b)
            for p in range(0, len(left), 2048):
                for q in range(p if alone else 0, len(right), 2048):
                    i, j = _hits(x[left[p : p + 2048]], x[right[q : q + 2048]], least)
                    if alone and p == q:
                        i, j = i[i < j], j[i < j]
                    i, j = at[left[p + i]], at[right[q + j]]
                    np.add.at(n, i, m[j])
                    np.add.at(n, j, m[i])
                    if len(i):
                        # one star for each group of this tile, numbered within the tile
                        seen, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                        label = _forest(place[: len(i)], place[len(i) :], len(seen))
                        stars.append((seen, seen[label]))
        i, j = (np.concatenate(c) for c in zip(*stars, strict=True))
        if not len(i):
            return pa.table({"node": nodes[:0], "n": pa.array([], pa.int64()), "to": nodes[:0]})
        label = _forest(i, j, len(m))
        linked = np.flatnonzero(n)
        return pa.table({"node": nodes.take(pa.array(linked)), "n": pa.array(n[linked]), "to": nodes.take(pa.array(label[linked]))})

    return work.groupBy("cell", "a", "b", "guests").applyInArrow(run, f"node {node}, n bigint, to {node}")


def near_vectors(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", most_pivots: int = 4096, worth: float = 0.05) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row. Links: cosine of at least `least`, in double precision.

    The vectors that are far from every pivot get pivots of their own, as long as a round brings at least the share
    `worth` of them home; what is left then has no structure that a pivot could use, and is one cell, joined in blocks.

    Equal vectors are compared once; each of their rows links with the others. A vector that cannot link stands alone.
    Repeated ids stay repeated; a null id has a null component if no linked row has one. Empty tables give empty tables;
    other columns are ignored. A component is named by its smallest id, so ties do not matter.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    vectors = stored(distinct_vectors(rows, "id", "v"), "vectors")
    left, found, n = vectors, [], vectors.count()
    while n:
        cells, rest = partitioned(left, choose_pivots(left, most_pivots), least)
        found.append(links(cells, least))
        before, left, n = n, rest, rest.count()
        if n > (1 - worth) * before:
            found.append(links(left.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), *left.columns), least))
            break
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    every = stored(reduce(DataFrame.unionByName, found), "links")
    groups = connected_components(every.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = every.groupBy("node").agg(F.sum("n").alias("n"))
    named = vectors.join(counts, "node", "left").join(groups, "node", "left")
    known = named.select("v", F.coalesce("component.id", "node.id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    # the hash deals the rows; equality of the vectors themselves decides
    key = lambda df: df.withColumn("h", F.xxhash64("v"))
    done = key(rows).join(key(known), ["h", "v"], "left")
    done = done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op1_metric_join(spark, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Rows at the edge: see near_vectors."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
