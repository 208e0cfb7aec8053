"""Cluster bootstrap: hash-indexed draws of clusters with replacement, shared by all statistics of a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored
from .draw_vectors import average_precisions, first_units, picked


def stable_seed(*parts: Column) -> Column:
    """A seed below 2**31 from hashed labels."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long") % F.lit(2**31 - 1)).cast("long")


def multiplicities(clusters: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    """(draw, cluster, m): how often each cluster comes in each draw of as many clusters as there are.

    Only drawn clusters are returned; see picked.
    """
    each = picked(clusters, cluster, draws, seed).select(cluster, F.explode("picks").alias("draw"))
    return each.groupBy(F.col("draw").cast("long").alias("draw"), cluster).agg(F.count("*").alias("m")).select("draw", cluster, "m")


def _interval(values: DataFrame, columns: list[str], draws: int, group: list[str]) -> DataFrame:
    """2.5 and 97.5 percentiles and the number of finite draws; null where too few are finite."""
    least = max(20, draws / 2)
    out = []
    for c in columns:
        n = F.count(F.col(c))
        out += [n.alias(f"{c}_draws"), F.when(n >= least, F.percentile(c, F.lit(0.025))).alias(f"{c}_low"), F.when(n >= least, F.percentile(c, F.lit(0.975))).alias(f"{c}_high")]
    return values.groupBy(*group).agg(*out)


def _by_draw(df: DataFrame, **columns: np.ndarray) -> DataFrame:
    """(draw, columns): one row a draw; NaN as null."""
    rows = [(d, *(None if np.isnan(x) else float(x) for x in r)) for d, r in enumerate(zip(*columns.values(), strict=True))]
    return df.sparkSession.createDataFrame(rows, ", ".join(["draw long", *(f"{c} double" for c in columns)]))


def ap_interval(df: DataFrame, label: str, score: str, cluster: str, draws: int, seed: int) -> DataFrame:
    """Interval of the average precision over draws of clusters."""
    df = stored(df.select(cluster, label, score), "scored")
    ap = average_precisions(df, label, score, cluster, stored(picked(df, cluster, draws, seed), "picks"), draws)
    return _interval(_by_draw(df, average_precision=ap), ["average_precision"], draws, [])


def group_interval(stats: DataFrame, cluster: str, columns: list[str], draws: int, seed: int) -> DataFrame:
    """Interval of macro means over entry groups, each group in its cluster."""
    values = stats.join(multiplicities(stats, cluster, draws, seed), cluster).groupBy("draw").agg(*[(F.sum(F.col(c) * F.col("m")) / F.sum(F.when(F.col(c).isNotNull(), F.col("m")))).alias(c) for c in columns])
    return _interval(values, columns, draws, [])


def value_interval(df: DataFrame, order: list[Column], oracle: list[Column], by: tuple[str, str], value: str, cluster: str, k: int, draws: int, seed: int) -> DataFrame:
    """Intervals of the value that the first k units hold, of the most they could hold, and of their difference.

    by: the columns that the two orders begin with, descending.
    """
    picks = stored(picked(df, cluster, draws, seed), "picks")
    model, _, total = first_units(df, order, by[0], value, cluster, k, picks, draws)
    best, _, _ = first_units(df, oracle, by[1], value, cluster, k, picks, draws, total=False)
    share = lambda x: np.divide(x, total, out=np.full(draws, np.nan), where=total != 0)
    values = _by_draw(df, capture=share(model), oracle=share(best), gap=share(best - model), headroom=best - model)
    return _interval(values, ["capture", "oracle", "gap", "headroom"], draws, [])


def top_k_draws(df: DataFrame, order: list[Column], by: str, value: str, cluster: str, k: int, draws: int, seed: int) -> DataFrame:
    """(draw, value, units) of the first k units of each draw."""
    found, units, _ = first_units(df, order, by, value, cluster, k, stored(picked(df, cluster, draws, seed), "picks"), draws, total=False)
    return _by_draw(df, value=found, units=units).withColumn("units", F.col("units").cast("long"))


def paired_delta(df: DataFrame, label: str, left: str, right: str, cluster: str, draws: int, seed: int) -> DataFrame:
    """Interval of the difference of two scores' average precision on the same draws."""
    df = stored(df.select(cluster, label, left, right), "scored")
    picks = stored(picked(df, cluster, draws, seed), "picks")
    a, b = (average_precisions(df, label, c, cluster, picks, draws) for c in (left, right))
    return _interval(_by_draw(df, delta=a - b), ["delta"], draws, [])
