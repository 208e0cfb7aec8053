"""Candidate cohorts: who may newly serve which market, labelled by a later window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import exact_sum

LANE = ["i_iso", "j_iso", "stage"]
ENTRY = ["i_iso", "stage"]


@dataclass(frozen=True)
class FoldSpec:
    """Early years, late years, and the year of pair covariates."""

    name: str
    early: tuple[int, ...]
    late: tuple[int, ...]

    @property
    def covariate_year(self) -> int:
        return self.early[-1]


def qualify_upstream(early: DataFrame, upstream: DataFrame) -> DataFrame:
    """(i_iso, stage): exporters active early in any upstream stage registered for the stage."""
    edges = F.broadcast(upstream.select("stage", F.col("source")))
    return early.select("i_iso", F.col("stage").alias("source")).distinct().join(edges, "source").select(*ENTRY).distinct()


def incumbent_pool(qualified: DataFrame, early: DataFrame) -> DataFrame:
    """Qualified exporters that export the stage early."""
    return qualified.join(early.select(*ENTRY), ENTRY, "left_semi")


def entrant_pool(qualified: DataFrame, early: DataFrame) -> DataFrame:
    """Qualified exporters that do not export the stage early."""
    return qualified.join(early.select(*ENTRY), ENTRY, "left_anti")


def enumerate_lanes(pool: DataFrame, early: DataFrame) -> DataFrame:
    """Each pooled exporter with each early importer of the stage, but itself and lanes established early.

    The join is on stage and bound by its output; established lanes go by an anti join on the whole key.
    """
    markets = early.select("stage", "j_iso").distinct()
    return pool.join(markets, "stage").where("i_iso <> j_iso").join(early.select(*LANE), LANE, "left_anti").select(*LANE)


def label_late(lanes: DataFrame, late: DataFrame, value: str = "v") -> DataFrame:
    """y = 1 and lateval = the late mean where the lane is active late; else 0 and exactly 0."""
    labelled = lanes.join(late.select(*LANE, F.col(value).alias("__late")), LANE, "left")
    return labelled.withColumns({"y": F.when(F.col("__late").isNull(), 0).otherwise(1), "lateval": F.coalesce("__late", F.lit(0.0))}).drop("__late")


def size_lookups(early: DataFrame, upstream: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exporter output, importer demand, upstream output by target stage), of lanes that passed the early threshold."""
    output = early.groupBy("i_iso", "stage").agg(exact_sum("v").alias("v"))
    demand = early.groupBy("j_iso", "stage").agg(exact_sum("v").alias("v"))
    source = early.select("i_iso", F.col("stage").alias("source"), "v").join(F.broadcast(upstream.select("stage", "source")), "source")
    return output, demand, source.groupBy("i_iso", "stage").agg(exact_sum("v").alias("v"))


def candidate_size(lanes: DataFrame, capacity: DataFrame, demand: DataFrame) -> DataFrame:
    """log_exporter_capacity, log_importer_demand and their sum, size; an end without early flows counts as zero."""
    sized = lanes.join(capacity.withColumnRenamed("v", "__c"), ENTRY, "left").join(demand.withColumnRenamed("v", "__d"), ["j_iso", "stage"], "left")
    c, d = (F.log1p(F.coalesce(F.col(x), F.lit(0.0))) for x in ("__c", "__d"))
    return sized.withColumns({"log_exporter_capacity": c, "log_importer_demand": d, "size": c + d}).drop("__c", "__d")


def track_a(early: DataFrame, late: DataFrame, upstream: DataFrame) -> DataFrame:
    """New destinations of incumbents; capacity is the exporter's own output in the stage."""
    output, demand, _ = size_lookups(early, upstream)
    lanes = enumerate_lanes(incumbent_pool(qualify_upstream(early, upstream), early), early)
    return candidate_size(label_late(lanes, late), output, demand)


def track_b(early: DataFrame, late: DataFrame, upstream: DataFrame) -> DataFrame:
    """First entry into a stage, by destination; capacity is the exporter's output upstream of the stage."""
    _, demand, above = size_lookups(early, upstream)
    lanes = enumerate_lanes(entrant_pool(qualify_upstream(early, upstream), early), early)
    return candidate_size(label_late(lanes, late), above, demand)


def all_exporters(early: DataFrame, late: DataFrame) -> DataFrame:
    """Candidates without the upstream rule: every early exporter of every stage."""
    return label_late(enumerate_lanes(early.select(*ENTRY).distinct(), early), late)


def entry_id() -> Column:
    return F.concat_ws("|", "i_iso", "stage")


def entry_view(lanes: DataFrame) -> DataFrame:
    """One row for each entry of Track B lanes. Capacity is an entry's constant, so its minimum is its value."""
    return lanes.groupBy(*ENTRY).agg(
        F.max("y").alias("z"), exact_sum("lateval").alias("entry_lateval"), F.min("log_exporter_capacity").alias("size"), F.min("log_exporter_capacity").alias("log_upstream_capacity"),
        F.count("*").alias("n_candidate_destinations"), F.sum("y").alias("n_materialized_destinations"),
    ).withColumn("entry_id", entry_id())


def conditional_lanes(lanes: DataFrame) -> DataFrame:
    """Lanes of entries that took place."""
    return lanes.join(lanes.where("y = 1").select(*ENTRY).distinct(), ENTRY, "left_semi")


def with_metadata(lanes: DataFrame, **constants: str) -> DataFrame:
    return lanes.withColumns({k: F.lit(v) for k, v in constants.items()})


def labels_at(lanes: DataFrame, threshold: float, value: str = "late_mean") -> DataFrame:
    """Outcome-only labels at another threshold; the cohort stays as it was enumerated."""
    hit = F.coalesce(F.col(value) > threshold, F.lit(False))
    return lanes.withColumns({"y": hit.cast("int"), "lateval": F.when(hit, F.col(value)).otherwise(0.0)})


def geometry(early: DataFrame, late: DataFrame, upstream: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, i_iso, j_iso, stage, track, y, lateval): both cohorts rebuilt at each threshold, in one pass.

    early, late: all window means, inactive ones too. Lanes carry their threshold through every join.
    """
    t = early.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    e, l_ = (w.join(F.broadcast(t), F.col("v") > F.col("threshold")) for w in (early, late))
    edges = F.broadcast(upstream.select("stage", "source"))
    qualified = e.select("threshold", "i_iso", F.col("stage").alias("source")).distinct().join(edges, "source").select("threshold", *ENTRY).distinct()
    held = e.select("threshold", *ENTRY).distinct().withColumn("__held", F.lit(True))
    pool = qualified.join(held, ["threshold", *ENTRY], "left").withColumn("track", F.when(F.col("__held"), "A").otherwise("B")).drop("__held")
    markets = e.select("threshold", "stage", "j_iso").distinct()
    lanes = pool.join(markets, ["threshold", "stage"]).where("i_iso <> j_iso").join(e.select("threshold", *LANE), ["threshold", *LANE], "left_anti")
    done = lanes.join(l_.select("threshold", *LANE, F.col("v").alias("__late")), ["threshold", *LANE], "left")
    return done.select("threshold", *LANE, "track", F.when(F.col("__late").isNull(), 0).otherwise(1).alias("y"), F.coalesce("__late", F.lit(0.0)).alias("lateval"))


def late_starts(early: DataFrame, late: DataFrame, upstream: DataFrame) -> DataFrame:
    """(i_iso, j_iso, stage, v, eligible_market): all late lanes of qualified entrants, markets inactive early too."""
    pool = entrant_pool(qualify_upstream(early, upstream), early)
    markets = early.select("stage", "j_iso").distinct().withColumn("eligible_market", F.lit(True))
    realised = late.where("i_iso <> j_iso").join(pool, ENTRY, "left_semi")
    return realised.join(markets, ["stage", "j_iso"], "left").select(*LANE, "v", F.coalesce("eligible_market", F.lit(False)).alias("eligible_market"))


def coverage(starts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Realised starts by whether their market was a candidate: entries covered, mixed and inactive-only, lanes, value."""
    group = group or []
    entries = starts.groupBy(*group, *[c for c in ENTRY if c not in group]).agg(
        F.bool_or("eligible_market").alias("covered"), F.bool_or(~F.col("eligible_market")).alias("inactive"),
        F.count("*").alias("lanes"), F.count_if("eligible_market").alias("eligible_lanes"), exact_sum("v").alias("value"), exact_sum(F.when(F.col("eligible_market"), F.col("v")).otherwise(0.0)).alias("eligible_value"),
    )
    n = entries.groupBy(*group).agg(
        F.count("*").alias("n_entries"), F.count_if("covered").alias("n_covered"), F.count_if(~F.col("covered")).alias("n_inactive_only"), F.count_if(F.col("covered") & F.col("inactive")).alias("n_mixed"),
        F.coalesce(F.sum("lanes"), F.lit(0)).alias("n_lanes"), F.coalesce(F.sum("eligible_lanes"), F.lit(0)).alias("n_eligible_lanes"), F.coalesce(exact_sum("value"), F.lit(0.0)).alias("value"), F.coalesce(exact_sum("eligible_value"), F.lit(0.0)).alias("eligible_value"),
    )
    return n.withColumns({"entry_coverage": F.try_divide("n_covered", "n_entries"), "lane_coverage": F.try_divide("n_eligible_lanes", "n_lanes"), "value_coverage": F.try_divide("eligible_value", "value")})


def split_uniform(key: Column, salt: str) -> Column:
    """A stable uniform in [0, 1) from the first 8 bytes of SHA-256 of salt|key; labels and row order play no part."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(2.0**64)


def split_key(unit: str, chain: Column) -> Column:
    """The identity that a split keeps together: lane, exporter_stage, exporter or importer."""
    parts = {"lane": ["i_iso", "stage", "j_iso"], "exporter_stage": ENTRY, "exporter": ["i_iso"], "importer": ["j_iso"]}[unit]
    return F.concat_ws("|", chain, *([] if unit == "lane" else [F.lit(unit)]), *parts)


def split_assign(lanes: DataFrame, unit: str, chain: Column, salt: str, test_share: float) -> DataFrame:
    return lanes.withColumn("split", F.when(split_uniform(split_key(unit, chain), salt) < test_share, "test").otherwise("train"))


def entry_features(lanes: DataFrame) -> DataFrame:
    """Entry table with demand and gravity (`grav`, null where unknown) over candidate destinations."""
    log_g = F.log1p("grav")
    mean = lambda c: exact_sum(c, 15) / F.count(c)
    return lanes.groupBy(*ENTRY).agg(
        F.max("y").alias("z"), F.max("log_importer_demand").alias("max_demand"), mean(F.col("log_importer_demand")).alias("mean_demand"), F.max(log_g).alias("max_gravity"), mean(log_g).alias("mean_gravity"),
        F.log1p(F.coalesce(exact_sum("grav", 15), F.lit(0.0))).alias("logsum_gravity"), F.avg(F.col("grav").isNotNull().cast("double")).alias("gravity_coverage"), F.log1p(F.count("*")).alias("log_destinations"),
    )


def summary(lanes: DataFrame, group: str = "chain") -> DataFrame:
    """Counts, base rate and value of each group and of all, whose rate is taken over its own counts."""
    each = lanes.rollup(group).agg(F.count("*").alias("candidates"), F.sum("y").alias("positives"), exact_sum("lateval").alias("value"))
    return each.select(F.coalesce(group, F.lit("TOTAL")).alias(group), "candidates", "positives", (F.col("positives") / F.col("candidates")).alias("base_rate"), "value")


def partition_entries(starts: DataFrame) -> DataFrame:
    """(i_iso, stage, part): covered, mixed or inactive_only."""
    e = starts.groupBy(*ENTRY).agg(F.bool_and("eligible_market").alias("every"), F.bool_or("eligible_market").alias("some"))
    return e.select(*ENTRY, F.when(F.col("every"), "covered").when(F.col("some"), "mixed").otherwise("inactive_only").alias("part"))


def persistent(lanes: DataFrame, least: int, col: str = "active_years") -> DataFrame:
    """Labels by the number of active years; not conjoined with the default label."""
    return lanes.withColumn("y", (F.col(col) >= least).cast("int"))
