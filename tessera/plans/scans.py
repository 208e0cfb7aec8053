"""Queries of scans, dimensions, registry tables and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import exact_sum, shared_dir, stored
from ..operators import cohorts as C
from ..sources import archives as A
from ..sources import intake as I
from ..sources import tables as S
from . import views as V
from .registry import query

_FLOW = "SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(c_nationkey AS BIGINT) AS j, lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS k, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def _raw(s, d):
    l_, o, c = (V.table(s, d, t) for t in ("lineitem", "orders", "customer"))
    x = l_.join(o, l_.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return x.select(F.col("l_suppkey").cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("j"), S.pad_code("l_partkey").alias("k"), F.year("o_orderdate").alias("year"), F.col("l_extendedprice").cast("double").alias("v"))


def _path(s, name):
    return f"{shared_dir(s)}/tessera-{name}-{uuid.uuid4().hex}"


@query(f"SELECT year, count(*) AS n, round(sum(v), 2) AS v FROM ({_FLOW}) WHERE year IN (1997, 1998) GROUP BY year")
def scan_flows(s, d):
    path = _path(s, "flows")
    A.write_archives(_raw(s, d), path)
    return A.read_archives(s, path, [1997, 1998]).groupBy("year").agg(F.count("*").alias("n"), F.round(exact_sum("v"), 2).alias("v"))


@query(f"SELECT year, count(*) AS n, round(sum(v), 2) AS v FROM ({_FLOW}) WHERE CAST(k AS BIGINT) % 3 = 0 GROUP BY year")
def scan_flows_filtered(s, d):
    path = _path(s, "filtered")
    # the rule is on the code, which keeps six digits of a longer key
    products = V.table(s, d, "part").select(S.pad_code("p_partkey").alias("k")).where(F.col("k").cast("long") % 3 == 0)
    S.write_flows_filtered(_raw(s, d), products, path)
    return S.read_flows(s, path).groupBy("year").agg(F.count("*").alias("n"), F.round(exact_sum("v"), 2).alias("v"))


@query("SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS iso, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def scan_country_dim(s, d):
    return S.unique_dimension(V.table(s, d, "customer").select(V.nation_code("c_nationkey").alias("iso")), "iso")


@query("SELECT i_iso, j_iso, round(ln(dist), 9) AS log_dist, contig, comlang FROM covariates WHERE i_iso <> j_iso AND dist > 0")
def scan_pair_covariates(s, d):
    x = S.pair_covariates(V.covariates(s, d), "i_iso", "j_iso", ["dist"], ["contig", "comlang"])
    return x.select("i_iso", "j_iso", F.round("log_dist", 9).alias("log_dist"), "contig", "comlang")


_USED = "SELECT DISTINCT substr(k, 1, 4) AS code FROM flows"


@query(f"SELECT chain, stage, code FROM (SELECT *, 'Brand#' || CAST(substr(code, 1, 2) AS INTEGER) AS stage FROM ({_USED})) JOIN stages USING (stage)")
def registry_stage_edges(s, d):
    used = V.flows(s, d).select(F.substring("k", 1, 4).alias("code")).distinct()
    return S.stage_edges(V.registry(s)).join(used, "code", "left_semi").select("chain", "stage", "code")


@query("SELECT chain, stage, source, count(*) AS n FROM upstream JOIN flows f USING (stage) GROUP BY ALL")
def registry_upstream_edges(s, d):
    n = V.flows(s, d).groupBy("stage").agg(F.count("*").alias("n"))
    return V.upstream(s).join(n, "stage").select("chain", "stage", "source", "n")


@query(f"SELECT chain || '.' || stage AS stage, count(*) AS codes FROM (SELECT *, 'Brand#' || CAST(substr(code, 1, 2) AS INTEGER) AS stage FROM ({_USED})) JOIN stages USING (stage) GROUP BY ALL")
def registry_pool(s, d):
    used = V.flows(s, d).select(F.substring("k", 1, 4).alias("code")).distinct()
    return S.pooled_registry(V.registry(s)).join(used, "code", "left_semi").groupBy("stage").agg(F.count("*").alias("codes"))


@query("SELECT stage, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM a_raw GROUP BY stage")
def scan_task_table(s, d):
    path = _path(s, "task")
    lanes = V.track_a(s, d).select(*C.LANE, "y", "lateval")
    lanes.write.parquet(path)
    return I.read_closed(s, path, T.StructType([T.StructField(c, t) for c, t in (*((k, T.StringType()) for k in C.LANE), ("y", T.IntegerType()), ("lateval", T.DoubleType()))])).groupBy("stage").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("SELECT count(*) AS n, round(sum(size), 5) AS total FROM a_lanes")
def scan_scores(s, d):
    path = _path(s, "scores")
    lanes = stored(V.track_a(s, d), "lanes")
    lanes.select(*C.LANE, F.col("size").alias("score")).write.option("header", True).csv(path)
    return I.read_scores(s, path, lanes.select(*C.LANE), C.LANE).agg(F.count("score").alias("n"), F.round(F.sum("score"), 5).alias("total"))


@query("SELECT i_iso, j_iso, stage FROM a_raw")
def label_free_scan(s, d):
    path = _path(s, "labelled")
    V.track_a(s, d).write.parquet(path)
    return s.read.parquet(path).select(*C.LANE)


@query("SELECT i_iso, j_iso, stage, y FROM a_raw")
def sink_tables(s, d):
    path = _path(s, "sorted")
    S.write_sorted(stored(V.track_a(s, d).select(*C.LANE, "y"), "lanes"), C.LANE, path)
    return S.read_committed(s, path)


@query("SELECT chain, m AS metric, CASE m WHEN 'candidates' THEN n ELSE p END AS value FROM (SELECT chain, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM a_raw JOIN stages USING (stage) GROUP BY chain), (VALUES ('candidates'), ('positives')) v(m)")
def sink_metrics_long(s, d):
    wide = C.summary(V.track_a(s, d).withColumn("chain", V.chain_of())).where("chain <> 'TOTAL'")
    return S.metrics_long(wide, ["chain"], ["candidates", "positives"])
