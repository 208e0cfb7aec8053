"""Calendar-window panels of sparse flows: an absent row means zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_window(raw: DataFrame, years: list[int], year_col: str = "year", strict: bool = False, needs: tuple[str, ...] = ()) -> DataFrame:
    """The rows of the years. No years, repeated years and missing columns are errors; so is, if strict, a row of another year
    or without one, in the job that reads the rows."""
    if not years or len(set(years)) != len(years):
        raise ValueError(f"years must be given and unique, got {years}")
    if missing := [c for c in (*needs, year_col) if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    inside = F.coalesce(F.col(year_col).isin(*years), F.lit(False))
    if strict:
        inside = F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit("row outside the window: "), F.coalesce(F.col(year_col).cast("string"), F.lit("null")))).cast("boolean"))
    return raw.where(inside)


def _years(df: DataFrame, years: list[int], year_col: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(y) for y in years])).alias(year_col))


def stage_year_totals(raw: DataFrame, years: list[int], keys: list[str], year_col: str = "year", value_col: str = "v", expected: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Sum of products for each key and requested year, zeros filled in; null keys are keys.

    expected: keys to materialise even where raw lacks them. The years are a literal, so the crossing is a small explode.
    """
    totals = in_window(raw, years, year_col, strict, (*keys, value_col)).groupBy(*keys, year_col).agg(F.sum(value_col).alias(value_col))
    known = totals.select(*keys)
    if expected is not None:
        known = known.unionByName(expected.select(*keys))
    dense = known.distinct().crossJoin(F.broadcast(_years(raw, years, year_col)))
    names = [*keys, year_col]
    found = totals.select(*[F.col(c).alias(f"__{c}") for c in names], F.col(value_col).alias("__total"))
    joined = dense.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names], "left")
    return joined.select(*names, F.coalesce("__total", F.lit(0)).alias(value_col))


def window_calendar_mean(raw: DataFrame, years: list[int], keys: list[str], year_col: str = "year", value_col: str = "v", expected: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Window total of each key over the number of requested years, not of years present.

    Zeros add nothing to a sum, so the dense panel is never built: one aggregation, plus a union for expected keys.
    """
    rows = in_window(raw, years, year_col, strict, (*keys, value_col)).select(*keys, value_col)
    if expected is not None:
        rows = rows.unionByName(expected.select(*keys, F.lit(0).cast(raw.schema[value_col].dataType).alias(value_col)))
    return rows.groupBy(*keys).agg((F.sum(value_col).cast("double") / len(years)).alias(value_col))


def window_pair(raw: DataFrame, early: list[int], late: list[int], keys: list[str], year_col: str = "year", value_col: str = "v") -> tuple[DataFrame, DataFrame]:
    """Both windows' calendar means, as window_calendar_mean gives them, from one pass over the flows."""
    return tuple(window_means(raw, [early, late], keys, year_col, value_col))


def window_means(raw: DataFrame, windows: list[list[int]], keys: list[str], year_col: str = "year", value_col: str = "v") -> list[DataFrame]:
    """Each window's calendar means, as window_calendar_mean gives them, from one pass over the flows; windows may overlap."""
    from ..functions.shared import stored

    total = lambda years: F.sum(F.when(F.col(year_col).isin(*years), F.col(value_col)))
    for years in windows:
        in_window(raw, years, year_col)
    sums = raw.where(F.col(year_col).isin(*sorted({y for years in windows for y in years}))).groupBy(*keys).agg(*[total(years).alias(f"__{k}") for k, years in enumerate(windows)])
    every = stored(sums, "windows")
    return [every.where(F.col(f"__{k}").isNotNull()).select(*keys, (F.col(f"__{k}").cast("double") / len(y)).alias(value_col)) for k, y in enumerate(windows)]


def window_present_mean(raw: DataFrame, years: list[int], keys: list[str], product_col: str = "k", year_col: str = "year", value_col: str = "v", strict: bool = False) -> DataFrame:
    """The older rule: each product's mean over the years in which it is present, summed over products."""
    yearly = in_window(raw, years, year_col, strict, (*keys, product_col, value_col)).groupBy(*dict.fromkeys([*keys, product_col]), year_col).agg(F.sum(value_col).cast("double").alias(value_col))
    means = yearly.groupBy(*dict.fromkeys([*keys, product_col])).agg(F.avg(value_col).alias(value_col))
    return means.groupBy(*keys).agg(F.sum(value_col).alias(value_col))


def active(window: DataFrame, threshold: float, value_col: str = "v") -> DataFrame:
    """Strictly above the threshold: a mean equal to it is inactive."""
    return window.where(F.col(value_col) > threshold)


def load_window(flows: DataFrame, stages: DataFrame, years: list[int], stage_threshold: float, product_threshold: float, dissolved: list[str] = (), mode: str = "calendar", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The active (i, j, stage) and (i, j, k) lanes of a window: registered products only, dissolved ends dropped.

    stages: (code, stage) of the registry, codes of the first `digits` of a flow's product code. mode: `calendar` divides by the
    years of the window, `legacy` takes each product's mean over the years in which it is present.
    """
    if mode not in ("calendar", "legacy"):
        raise ValueError(f"mode must be calendar or legacy, got {mode}")
    rows = flows.drop("stage").withColumn("__code", F.substring("k", 1, digits)).join(stages.select(F.col("code").alias("__code"), "stage"), "__code").drop("__code")
    rows = drop_entities(rows, list(dissolved), ["i_iso", "j_iso"])
    mean = window_calendar_mean if mode == "calendar" else window_present_mean
    by_stage, by_product = (mean(rows, years, ["i_iso", "j_iso", c]) for c in ("stage", "k"))
    return active(by_stage, stage_threshold), active(by_product, product_threshold)


def drop_entities(df: DataFrame, entities: list[str], columns: list[str]) -> DataFrame:
    """Rows none of whose columns names one of the entities."""
    for c in columns if entities else []:
        df = df.where(~F.col(c).isin(*entities))
    return df


def active_years(flows: DataFrame, lanes: DataFrame, years: list[int], threshold: float, keys: list[str]) -> DataFrame:
    """lanes with active_years: in how many of the years the annual total is above the threshold; 0 if in none."""
    yearly = flows.where(F.col("year").isin(*years)).join(lanes.select(*keys), keys, "left_semi").groupBy(*keys, "year").agg(F.sum("v").alias("v"))
    counts = yearly.where(F.col("v") > threshold).groupBy(*keys).agg(F.count("*").alias("active_years"))
    return lanes.join(counts, keys, "left").withColumn("active_years", F.coalesce("active_years", F.lit(0)))
