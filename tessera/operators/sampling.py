"""Stratified samples with certainty units, Hamilton allocation, design weights, estimators and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratify(frame: DataFrame, columns: list[str]) -> DataFrame:
    """frame with stratum and its size; sizes are counted and joined, so a large stratum is spread."""
    rows = frame.withColumn("stratum", F.concat_ws("|", *columns))
    return rows.join(rows.groupBy("stratum").agg(F.count("*").alias("stratum_size")), "stratum")


def certainty_units(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """rows with reasons: the names of the conditions that make a row certain to be drawn."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])))


def hamilton(counts: DataFrame, slots: int, key: str = "stratum", n: str = "n") -> DataFrame:
    """(stratum, n, slots): whole shares of the slots, the rest by largest remainder, ties by key.

    Strata are few, so ranking their remainders fits one task. No stratum gets more slots than it has rows, as slots may
    not exceed the total.
    """
    total = counts.agg(F.sum(n).alias("__t"))
    x = counts.crossJoin(F.broadcast(total)).withColumns({"__q": F.expr(f"({slots} * {n}) div __t"), "__r": F.expr(f"({slots} * {n}) % __t")})
    used = x.agg(F.sum("__q").alias("__u"))
    ranked = x.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__r").desc(), F.col(key))))
    return ranked.crossJoin(F.broadcast(used)).select(key, n, (F.col("__q") + F.when(F.col("__rank") <= F.lit(slots) - F.col("__u"), 1).otherwise(0)).alias("slots"))


def hash_ranked(rows: DataFrame, unit: str, salt: str, allocation: DataFrame) -> DataFrame:
    """The rows of each stratum's lowest hash ranks, as many as its slots, with their rank.

    Each task first keeps its own lowest ranks of a stratum, as many as the largest allocation, so what is shuffled follows
    the sample's size and not the stratum's.
    """
    most = allocation.agg(F.max("slots")).first()[0] or 0
    scored = rows.withColumn("__h", F.sha2(F.concat_ws("|", F.lit(salt), "stratum", F.col(unit).cast("string")), 256))
    order = Window.partitionBy("stratum").orderBy(F.col("__h").asc(), F.col(unit).asc())
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= F.lit(int(most)))
    return ranked.join(F.broadcast(allocation.select("stratum", "slots")), "stratum").where(F.col("rank") <= F.col("slots")).drop("__h")


def design_weights(sample: DataFrame, allocation: DataFrame) -> DataFrame:
    """sample with inclusion probability and weight: certain units 1, others slots over eligible rows of the stratum."""
    x = sample.join(F.broadcast(allocation.select("stratum", F.col("n").alias("__n"), F.col("slots").alias("__s"))), "stratum", "left")
    p = F.when(F.size("reasons") > 0, F.lit(1.0)).otherwise(F.col("__s") / F.col("__n"))
    return x.withColumn("inclusion", p).withColumn("weight", 1 / F.col("inclusion")).drop("__n", "__s")


def horvitz_thompson(sample: DataFrame, value: str, population: int) -> DataFrame:
    """Weighted total and rate of a value under the design; rows without a value count as zero."""
    return sample.agg(F.count("*").alias("n"), F.sum("weight").alias("weights"), F.sum(F.col("weight") * F.coalesce(value, F.lit(0))).alias("total")).withColumn("rate", F.col("total") / F.lit(population))


def rater_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Percent agreement and Cohen's kappa of two raters over rows that both judged; kappa is null if chance is 1."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "c").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    x = n.crossJoin(chance).withColumns({"agreement": F.col("same") / F.col("t"), "chance": F.col("xy") / (F.col("t") * F.col("t"))})
    return x.select(F.col("t").alias("n"), "agreement", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))
