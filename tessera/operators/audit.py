"""Data-quality checks and reconciliation: each returns counts of violations, zero where a table is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_differences(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, problem): missing and unexpected columns of a closed schema."""
    rows = [(c, "missing") for c in expected if c not in df.columns] + [(c, "unexpected") for c in df.columns if c not in expected]
    one = df.sparkSession.range(1)
    items = F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("problem")) for a, b in rows]) if rows else F.expr("cast(array() as array<struct<column:string,problem:string>>)")
    return one.select(F.explode(items).alias("x")).select("x.*")


def blank(col: str) -> Column:
    """Null, blank, or a text that stands for null."""
    text = F.lower(F.trim(F.col(col).cast("string")))
    return F.col(col).isNull() | text.isin("", "nan", "none", "null")


def identity_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.count_if(blank(k)).alias(f"blank_{k}") for k in keys])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def constant_violations(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    return df.agg(*[F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"not_{c}") for c, v in constants.items()])


def range_violations(df: DataFrame, finite: list[str], non_negative: list[str] = (), binary: list[str] = ()) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return df.agg(*[F.count_if(bad(c)).alias(f"not_finite_{c}") for c in finite], *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in non_negative], *[F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(f"not_binary_{c}") for c in binary])


def outcome_violations(df: DataFrame, label: str, value: str, threshold: float) -> DataFrame:
    """Label 0 must go with value 0, label 1 with a value above the threshold."""
    return df.agg(F.count_if((F.col(label) == 0) & (F.col(value) != 0)).alias("zero_with_value"), F.count_if((F.col(label) == 1) & ~(F.col(value) > threshold)).alias("one_without_value"))


def size_violations(df: DataFrame, size: str, parts: list[str], rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return df.agg(F.count("*").alias("n"), F.count_if(~(F.abs(F.col(size) - total) <= F.lit(atol) + F.lit(rtol) * F.abs(total))).alias("violations"))


def column_mismatches(expected: DataFrame, found: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Full comparison by key: keys on one side only, and for each column how many values differ."""
    numeric = {c for c, t in expected.dtypes if t in ("double", "float")}
    a = expected.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(1).alias("__a"))
    b = found.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__b"))
    x = a.join(b, keys, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()

    def differ(c):
        l_, r_ = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        return both & (~l_.eqNullSafe(r_) if c not in numeric else ~F.coalesce(F.abs(l_ - r_) <= tolerance * F.greatest(F.lit(1.0), F.abs(l_)), l_.isNull() & r_.isNull()))

    return x.agg(F.count_if(F.col("__b").isNull()).alias("missing"), F.count_if(F.col("__a").isNull()).alias("extra"), *[F.count_if(differ(c)).alias(f"differ_{c}") for c in columns])


def subset_violations(lanes: DataFrame, subset: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """How many rows the subset lacks of, or has beyond, the rows of lanes that meet the condition; repeats count."""
    tagged = lambda df, n: df.select(*columns, F.lit(n).alias("__n"))
    # dealt by the whole row: Spark 4.1 may take a union's parts for equally dealt when their tasks were merged differently
    rows = tagged(lanes.where(condition), 1).unionByName(tagged(subset, -1)).repartition(*columns)
    left = rows.groupBy(*columns).agg(F.sum("__n").alias("n"))
    total = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("long")
    return left.agg(total(F.col("n")).alias("missing"), total(-F.col("n")).alias("extra"))


def reconcile_raw(candidates: DataFrame, early: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with early_mean and late_mean from independently rebuilt windows, 0 where raw has no flow."""
    c = candidates.join(early.select(*keys, F.col("v").alias("early_mean")), keys, "left").join(late.select(*keys, F.col("v").alias("late_mean")), keys, "left")
    return c.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in ("early_mean", "late_mean")})


def audit_labels(reconciled: DataFrame, threshold: float, group: list[str], rtol: float = 1e-9) -> DataFrame:
    """Violations of labels, values, early absence and sign, with the largest value error, by group."""
    expected = (F.col("late_mean") > threshold).cast("int")
    value = F.when(expected == 1, F.col("late_mean")).otherwise(0.0)
    error = F.abs(F.col("lateval") - value)
    return reconciled.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") != expected).alias("label_violations"), F.count_if(error > rtol * F.greatest(F.lit(1.0), value)).alias("value_violations"),
        F.count_if(F.col("early_mean") > threshold).alias("early_violations"), F.count_if((F.col("early_mean") < 0) | (F.col("late_mean") < 0)).alias("negative_violations"), F.max(error).alias("max_error"),
    )


def registry_violations(stage_edges: DataFrame, upstream: DataFrame, excluded: DataFrame) -> DataFrame:
    """(problem, n): codes owned twice in a chain, edge ends that are no stage, self edges, excluded codes in use."""
    stages = stage_edges.select("chain", "stage").distinct()
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        one(stage_edges.groupBy("chain", "code").agg(F.count("*").alias("c")).where("c > 1"), "code_owned_twice"),
        one(upstream.select("chain", "stage").join(stages, ["chain", "stage"], "left_anti"), "unknown_target"),
        one(upstream.select("chain", F.col("source").alias("stage")).join(stages, ["chain", "stage"], "left_anti"), "unknown_source"),
        one(upstream.where("stage = source"), "self_edge"),
        one(stage_edges.join(excluded, "code", "left_semi"), "excluded_in_use"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
