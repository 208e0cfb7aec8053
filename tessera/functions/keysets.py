"""Comparisons of key sets and of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap(left: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of intersection, differences and union, Jaccard and retention; both shares are 1 where nothing is compared."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = reference.select(*keys).distinct().withColumn("__b", F.lit(1))
    n = a.join(b, keys, "full_outer").agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"), F.count_if(F.col("__b").isNull()).alias("left_only"), F.count_if(F.col("__a").isNull()).alias("reference_only"), F.count("*").alias("either"))
    share = lambda total: F.coalesce(F.try_divide("both", total), F.lit(1.0))
    return n.withColumns({"jaccard": share(F.col("either")), "retention": share(F.col("both") + F.col("reference_only"))})


def difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from found, and extra ones."""
    a, b = expected.select(*keys), found.select(*keys)
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def difference_counts(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    d = difference(expected, found, keys).agg(F.count_if(F.col("side") == "extra").alias("extra"), F.count_if(F.col("side") == "missing").alias("missing"))
    return d.crossJoin(expected.agg(F.count("*").alias("n")))


def leaking_groups(df: DataFrame, group: list[str], split: str) -> DataFrame:
    """Groups that are on more than one side of a split."""
    return df.groupBy(*group).agg(F.min(split).alias("__lo"), F.max(split).alias("__hi")).where(F.col("__lo") != F.col("__hi")).select(*group)


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n, digest): a digest of the key set that row order does not change: sums of two halves of each key's SHA-256."""
    h = F.sha2(F.concat_ws("|", *keys), 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.select(*keys).distinct().agg(F.count("*").alias("n"), F.concat_ws("-", part(1).cast("string"), part(13).cast("string")).alias("digest"))
