"""The given tables in the roles of the panel operators: flows, registry, folds, cohorts, covariates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import cohorts as C
from ..operators import panel as P
from ..sources import tables as S

THRESHOLD = 50000.0
FOLDS = {f.name: f for f in (C.FoldSpec("main", (1997, 1998), (1999, 2000)), C.FoldSpec("history", (1995, 1996), (1997, 1998)))}
#: Two-digit index of a part type's first word.
TYPES = {"ECONOMY": "01", "STANDARD": "02", "SMALL": "03", "MEDIUM": "04", "LARGE": "05", "PROMO": "06"}
#: Which positions of a chain are upstream of which.
UPSTREAM = {2: (0, 1), 3: (0, 2), 4: (1, 3)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_code(col: str, letter: str = "N", width: int = 2):
    return F.concat(F.lit(letter), F.lpad(F.col(col).cast("string"), width, "0"))


def flows(spark: SparkSession, sf_dir: str, view: str = "S") -> DataFrame:
    """(i_iso, j_iso, stage, k, year, v): one row a line item. View S: suppliers to nations; N: nations to nations.

    Only the joined columns are read. Dimensions are joined without hints: Spark broadcasts those below its threshold.
    """
    t = lambda n, *c: table(spark, sf_dir, n).select(*c)
    kind = reduce(lambda a, x: F.when(F.split("p_type", " ")[0] == x[0], x[1]).otherwise(a), list(TYPES.items())[:-1], F.lit(TYPES["PROMO"]))
    part = t("part", "p_partkey", "p_brand", "p_size", "p_type").select("p_partkey", F.col("p_brand").alias("stage"), F.concat(F.lpad(F.split("p_brand", "#")[1], 2, "0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), kind).alias("k"))
    supplier = t("supplier", "s_suppkey", "s_nationkey").select("s_suppkey", (nation_code("s_suppkey", "S", 5) if view == "S" else nation_code("s_nationkey")).alias("i_iso"))
    customer = t("customer", "c_custkey", "c_nationkey").select("c_custkey", nation_code("c_nationkey").alias("j_iso"))
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    lines = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    value = F.expr("CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("i_iso", "j_iso", "stage", "k", "year", value.alias("v"))


def registry(spark: SparkSession) -> DataFrame:
    """The registry of five chains of five stages, parsed from its documents."""
    brand = lambda c, p: f"Brand#{5 * c + p + 1}"
    import json

    documents = [json.dumps({
        "id": f"c{c}", "stages": {brand(c, p): [f"{5 * c + p + 1:02d}{s:02d}" for s in range(1, 51)] for p in range(5)}, "upstream": [brand(c, 0), brand(c, 1)],
        "upstream_map": {brand(c, p): [brand(c, s) for s in UPSTREAM[p]] for p in UPSTREAM}, "derived_from": {brand(c, p): [brand(c, UPSTREAM[p][0])] for p in UPSTREAM}, "form_of": [[brand(c, 0), brand(c, 2)]],
    }) for c in range(5)]
    return S.parse_registry(spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in documents])).alias("document")))


def upstream(spark: SparkSession) -> DataFrame:
    return S.upstream_edges(registry(spark))


def windows(spark: SparkSession, sf_dir: str, fold: str = "main", view: str = "S", rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All window means of a fold, inactive lanes too."""
    rows, f = rows or flows(spark, sf_dir, view), FOLDS[fold]
    return P.window_pair(rows, list(f.early), list(f.late), C.LANE)


def fold(spark: SparkSession, sf_dir: str, name: str = "main") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(early, late, upstream) of a fold, active lanes only."""
    early, late = windows(spark, sf_dir, name)
    return P.active(early, THRESHOLD), P.active(late, THRESHOLD), upstream(spark)


def folds(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """Both folds, as fold gives them, from one pass over the flows."""
    years = list(dict.fromkeys(y for f in FOLDS.values() for y in (f.early, f.late)))
    means = dict(zip(years, P.window_means(flows(spark, sf_dir), [list(y) for y in years], C.LANE), strict=True))
    return {n: (P.active(means[f.early], THRESHOLD), P.active(means[f.late], THRESHOLD), upstream(spark)) for n, f in FOLDS.items()}


def track_a(spark, sf_dir, name="main") -> DataFrame:
    return C.track_a(*fold(spark, sf_dir, name))


def track_b(spark, sf_dir, name="main") -> DataFrame:
    return C.track_b(*fold(spark, sf_dir, name))


def track_b_once(spark, sf_dir, name="main") -> DataFrame:
    """Track B written to the shared folder, for queries that read its lanes several times."""
    return stored(track_b(spark, sf_dir, name), "track-b")


def n_early(spark, sf_dir) -> DataFrame:
    """View N's early lanes: those above the average mean of the window."""
    means = P.window_calendar_mean(flows(spark, sf_dir, "N"), list(FOLDS["main"].early), C.LANE)
    return means.crossJoin(F.broadcast(means.agg(F.avg("v").alias("__a")))).where("v > __a").drop("__a")


def covariates(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    own = s.join(n.toDF("s_nationkey", "s_regionkey"), "s_nationkey")
    pairs = own.crossJoin(F.broadcast(n))
    return pairs.select(nation_code("s_suppkey", "S", 5).alias("i_iso"), nation_code("n_nationkey").alias("j_iso"), (F.abs(F.col("s_nationkey") - F.col("n_nationkey")) + 1).alias("dist"), (F.col("s_regionkey") == F.col("n_regionkey")).cast("int").alias("contig"), (F.col("s_nationkey") % 2 == F.col("n_nationkey") % 2).cast("int").alias("comlang"))


def chain_of(col: str = "stage"):
    return F.concat(F.lit("c"), ((F.split(col, "#")[1].cast("int") - 1) / 5).cast("int").cast("string"))


def r(name: str, digits: int = 5):
    return F.round(name, digits).alias(name)
