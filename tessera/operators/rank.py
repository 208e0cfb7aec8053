"""Canonical ranks, tie blocks, top-k, quantile bins: no step needs a whole table or group in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import running_sums, stored

#: Keys that break ties of each track, in order.
KEYS = {"A": ["i_iso", "stage", "j_iso"], "B1": ["i_iso", "stage"], "B2": ["j_iso"]}


def canonical(score: str, track: str) -> list[Column]:
    """Score descending, then the track's keys ascending: a total order that does not depend on row order."""
    return [F.col(score).desc(), *[F.col(k).asc() for k in KEYS[track]]]


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows; each task keeps k and only those meet."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits each group before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def score_blocks(df: DataFrame, score: str, sums: dict[str, Column], group: list[str] | None = None, descending: bool = True) -> DataFrame:
    """One row for each distinct score (of a group) with sums over its rows and their running sums `c_<name>`.

    Tied rows form one block, so ranks and precisions of ties do not depend on row order. Rows are combined by score in
    the tasks first; the running sums are taken by range.
    """
    group = group or []
    blocks = df.groupBy(*group, score).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return running_sums(blocks, group, [F.col(score).desc() if descending else F.col(score).asc()], {f"c_{n}": n for n in sums})


def _ranked_blocks(rows: DataFrame, score: str, group: list[str]) -> DataFrame:
    """(group, score, n, c_n, midrank) of each distinct score."""
    blocks = score_blocks(rows, score, {"n": F.lit(1).cast("long")}, group, descending=False)
    return blocks.withColumn("midrank", F.col("c_n") - F.col("n") + (F.col("n") + 1) / 2)


def _given_back(rows: DataFrame, blocks: DataFrame, keys: list[str], values: list[str], share: int = 10_000) -> DataFrame:
    """rows with the values of their block. blocks: keys, n (how many rows have them) and values, each key once.

    Keys of more than one row in `share` number fewer than `share`, so they are broadcast; no other key can bring a task
    more than that part of the rows. So a score that a third of the rows share is spread like any. Nulls are keys too.
    """
    total = blocks.agg(F.sum("n")).first()[0] or 0
    table = blocks.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("n").alias("__of"), *values)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    often, seldom = F.broadcast(table.where(F.col("__of") * share > total)), table.where(F.col("__of") * share <= total)
    wanted = [*rows.columns, *values]
    return rows.join(often, on).select(*wanted).unionByName(rows.join(often, on, "left_anti").join(seldom, on).select(*wanted))


def midrank(df: DataFrame, score: str, group: list[str] | None = None) -> DataFrame:
    """df with midrank: the mean of the places, from 1, that rows of equal score take in ascending order; rows without a
    score are left out."""
    group = group or []
    rows = stored(df.where(F.col(score).isNotNull()), "scored")
    return _given_back(rows, stored(_ranked_blocks(rows, score, group), "blocks"), [*group, score], ["midrank"])


def midrank_ecdf(df: DataFrame, score: str, group: list[str] | None = None) -> DataFrame:
    """df with midrank and ecdf = (midrank - 0.5) / n; rows without a score are left out and not counted."""
    group = group or []
    rows = stored(df.where(F.col(score).isNotNull()), "scored")
    blocks = stored(_ranked_blocks(rows, score, group), "blocks")
    # the last block's running count is its group's size, and the counts are of blocks, not of rows
    sizes = blocks.groupBy(*[F.col(g).alias(f"__in_{g}") for g in group]).agg(F.max("c_n").alias("__n"))
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__in_{g}")) for g in group], F.lit(True))
    ranked = (blocks.join(sizes, on) if group else blocks.crossJoin(F.broadcast(sizes))).withColumn("ecdf", (F.col("midrank") - 0.5) / F.col("__n"))
    return _given_back(rows, ranked, [*group, score], ["midrank", "ecdf"])


def exact_quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbouring values; null values are left out.

    Equal values are combined first and places are taken by range, so no task holds the column; two rows a quantile at
    most come back.
    """
    blocks = stored(score_blocks(df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x")), "x", {"n": F.lit(1).cast("long")}, descending=False), "blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    wanted = sorted({int(f(x)) + 1 for x in places for f in (math.floor, math.ceil)})
    holds = [(F.col("c_n") >= k) & (F.col("c_n") - F.col("n") < k) for k in wanted]
    rows = blocks.where(reduce(lambda a, b: a | b, holds)).select("x", "n", "c_n").collect()
    at = {k: next(r.x for r in rows if r.c_n - r.n < k <= r.c_n) for k in wanted}
    low = [(at[math.floor(x) + 1], at[math.ceil(x) + 1], x - math.floor(x)) for x in places]
    return [a + (b - a) * t for a, b, t in low]


def quantile_bins(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """df with bin: right-open ranges between distinct exact quantiles, the last one closed; one edge means one bin."""
    edges = [e for e in exact_quantiles(df, col, [b / bins for b in range(bins + 1)]) if e is not None]
    inner = sorted(set(edges))[1:-1]
    return df.withColumn("bin", reduce(lambda a, e: a + F.when(F.col(col) >= e, 1).otherwise(0), inner, F.lit(0)))


def zscore(df: DataFrame, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """df with z_<column> = (x - mean) / (population deviation + eps)."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = df.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + eps) for c in columns})
    return z.drop(*stats.columns)


def group_max(df: DataFrame, group: list[str], col: str, name: str) -> DataFrame:
    """df with the group's maximum on every row; the maxima are combined in the tasks before they meet."""
    return df.join(df.groupBy(*group).agg(F.max(col).alias(name)), group)


def top_k_multiplicity(df: DataFrame, order: list[Column], times: str, value: str, k: int, group: list[str] | None = None) -> DataFrame:
    """(group, taken value) of the first k units where a row counts `times`: a row in part beyond k counts in part."""
    group = group or []
    rows = running_sums(df.where(F.col(times) > 0), group, order, {"__upto": times})
    take = F.least(F.col(times), F.greatest(F.lit(0), F.lit(k) - (F.col("__upto") - F.col(times))))
    return rows.groupBy(*group).agg(F.sum(take * F.col(value)).alias("value"), F.sum(take).alias("units"))
