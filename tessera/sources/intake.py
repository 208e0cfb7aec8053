"""Intake of files from outside: closed schemas, coercion with rejects, and score files that must match their candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that tell the outcome and so may never be or accompany a score.
OUTCOMES = frozenset({"y", "z", "lateval", "entry_lateval", "n_materialized_destinations"})


def closed_columns(found: list[str], wanted: list[str], what: str) -> None:
    """Raises unless the columns are exactly the wanted ones, each once, in any order."""
    missing, unexpected = sorted(set(wanted) - set(found)), sorted(set(found) - set(wanted))
    if missing or unexpected or len(found) != len(set(found)):
        raise ValueError(f"{what}: schema mismatch; missing={missing}, unexpected={unexpected}, columns={found}")


def read_closed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table whose files say exactly this schema: other names or types are an error before any row is read."""
    found = spark.read.parquet(path)
    closed_columns(found.columns, schema.names, path)
    wrong = [f"{f.name} is {found.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}" for f in schema if found.schema[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return found.select(*schema.names)


def blank(c: str | Column) -> Column:
    """Null, empty, or a spelling of a missing value."""
    x = F.col(c) if isinstance(c, str) else c
    return x.isNull() | F.lower(F.trim(x.cast("string"))).isin("", "nan", "none")


def coerced(df: DataFrame, numbers: dict[str, str], allow_null: frozenset[str] = frozenset(), nonnegative: bool = True) -> DataFrame:
    """df with the named columns as numbers of the given types, and `reject`: why a row cannot be taken, null if it can.

    Text that is no number becomes null and is named, as are infinite values, NaN, nulls where none are allowed, and values
    below zero. Rows of any kind stay; see split_rejects.
    """
    reasons = []
    for c, kind in numbers.items():
        x = F.expr(f"try_cast(`{c}` AS {kind})")
        there = F.col(c).isNotNull()
        endless = F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
        reasons += [F.when(there & x.isNull(), f"{c} is not a number"), F.when(x.isNotNull() & endless, f"{c} is not finite"), F.when(~there, f"{c} is null") if c not in allow_null else F.lit(None), F.when(x < 0, f"{c} is negative") if nonnegative else F.lit(None)]
    return df.withColumn("reject", F.coalesce(*[r.cast("string") for r in reasons])).withColumns({c: F.expr(f"try_cast(`{c}` AS {kind})") for c, kind in numbers.items()})


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a reject, rows with one)."""
    return df.where("reject is null").drop("reject"), df.where("reject is not null")


def read_scores(spark: SparkSession, path: str, candidates: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, score) of a CSV score file that has exactly one finite score for each candidate, and nothing else.

    An outcome column, and any column beside the keys and the score, is an error before a row is read; every file of a folder
    must have the header. Lines that do not parse, null keys, repeated, missing and extra keys, and scores that are no
    finite number raise in the job that reads the scores: they are assertions in its plan, so no other pass is needed.
    """
    if score in OUTCOMES or score in keys:
        raise ValueError(f"{score} may not be a score")
    found = spark.read.option("header", True).csv(path).columns
    if leaked := sorted(OUTCOMES & set(found)):
        raise ValueError(f"{path} holds outcome columns {leaked}")
    closed_columns(found, [*keys, score], path)
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in found), T.StructField("__corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").csv(path)
    number = F.expr(f"try_cast(`{score}` AS double)")
    own = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(number).alias("__score"), F.max("__corrupt").alias("__bad"))
    on = [own[k].eqNullSafe(candidates[k].cast("string")) for k in keys]
    joined = candidates.select(*keys, F.lit(1).alias("__candidate")).join(own, on, "full_outer")
    name = F.concat_ws("|", *[F.coalesce(own[k], candidates[k].cast("string"), F.lit("null")) for k in keys])
    is_null = reduce(lambda a, b: a | b, [own[k].isNull() for k in keys])
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), name))
    checked = (
        F.when(F.col("__bad").isNotNull(), fail("line does not parse")).when(F.col("__n").isNotNull() & is_null, fail("null key")).when(F.col("__n") > 1, fail("duplicate key"))
        .when(F.col("__candidate").isNull(), fail("key of no candidate")).when(F.col("__n").isNull(), fail("candidate without a score"))
        .when(F.col("__score").isNull() | F.isnan("__score") | (F.abs("__score") == float("inf")), fail("score is not finite")).otherwise(F.col("__score"))
    )
    return joined.select(*[candidates[k] for k in keys], checked.cast("double").alias(score))
