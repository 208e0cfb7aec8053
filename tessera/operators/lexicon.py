"""Lexicon recall over descriptions, negative controls, and the decision ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(rows: DataFrame, lexicons: dict[str, str], code: str, text: str) -> DataFrame:
    """(class, code): the rows whose text matches a class's pattern, letter case aside. Patterns are literals, so the
    scan is one pass without a join."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), F.lit(c)) for c, p in lexicons.items()]))
    return rows.select(F.explode(hits).alias("class"), F.col(code).alias("code")).distinct()


def negative_control(rows: DataFrame, lexicons: dict[str, str], challenges: list[tuple[str, str, str]], text: str) -> DataFrame:
    """(class, challenge, hits, recalled, unrecalled, status) of each challenge pattern against its class's lexicon."""
    flags = [F.struct(F.lit(c).alias("class"), F.lit(i).alias("challenge"), F.col(text).rlike(f"(?i){p}").alias("hit"), F.col(text).rlike(f"(?i){lexicons[c]}").alias("main")) for c, i, p in challenges]
    x = rows.select(F.explode(F.array(*flags)).alias("x")).select("x.*")
    n = x.groupBy("class", "challenge").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("main")).alias("recalled"), F.count_if(F.col("hit") & ~F.col("main")).alias("unrecalled"))
    status = F.when(F.col("hits") == 0, "no_source_hits").when(F.col("unrecalled") == 0, "all_source_hits_recalled").otherwise("unrecalled_hits_present")
    return n.withColumn("status", status)


def decision_coverage(recalled: DataFrame, decisions: DataFrame) -> DataFrame:
    """(recalled, decided, undecided, unrecalled, decided_twice): decisions must cover the recalled pairs, each once."""
    keys = ["class", "code"]
    d = decisions.groupBy(*keys).agg(F.count_distinct("decision").alias("__d"))
    x = recalled.select(*keys).distinct().withColumn("__r", F.lit(1)).join(d, keys, "full_outer")
    return x.agg(F.count("__r").alias("recalled"), F.count("__d").alias("decided"), F.count_if(F.col("__d").isNull()).alias("undecided"), F.count_if(F.col("__r").isNull()).alias("unrecalled"), F.count_if(F.col("__d") > 1).alias("decided_twice"))


def ledger(recalled: DataFrame, decisions: DataFrame, legacy: DataFrame) -> DataFrame:
    """One row for each recalled or legacy pair: its decision (legacy-only pairs are out_of_stage), source, reassignment."""
    keys = ["class", "code"]
    x = recalled.select(*keys).distinct().withColumn("__r", F.lit(1)).join(legacy.select(*keys, F.col("stage").alias("previous_stage")), keys, "full_outer").join(decisions.select(*keys, "decision", "stage"), keys, "left")
    source = F.when(F.col("__r").isNull(), "legacy_only").when(F.col("previous_stage").isNull(), "recalled_only").otherwise("both")
    return x.select(*keys, F.coalesce("decision", F.lit("out_of_stage")).alias("decision"), "stage", "previous_stage", source.alias("source"), F.coalesce(F.col("stage") != F.col("previous_stage"), F.lit(False)).alias("reassigned"))


def apply_changes(ledger_rows: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger with changes class, code, old, new applied, counts of applied and stale ones): a change whose old decision
    is not the ledger's is stale and leaves its row alone."""
    keys = ["class", "code"]
    x = ledger_rows.join(changes.select(*keys, "old", "new"), keys, "left")
    fits = F.col("old").isNotNull() & (F.col("old") == F.col("decision"))
    done = x.withColumn("decision", F.when(fits, F.col("new")).otherwise(F.col("decision"))).drop("old", "new")
    counts = changes.join(ledger_rows.select(*keys, "decision"), keys, "left").agg(F.count_if(F.col("old").eqNullSafe(F.col("decision"))).alias("applied"), F.count_if(~F.col("old").eqNullSafe(F.col("decision"))).alias("stale"))
    return done, counts
