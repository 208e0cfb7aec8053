"""Queries of the panel operators: predicates, joins and aggregates over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import panel as P
from ..operators import rank as R
from . import views as V
from .registry import query
from .views import r

EARLY = list(V.FOLDS["main"].early)
_MEAN = "SELECT i_iso, j_iso, stage, CAST(sum(v) AS DOUBLE) / 2 AS v FROM flows WHERE year IN (1997, 1998) GROUP BY ALL"


@query("SELECT DISTINCT k, lpad(k, 8, '0') AS padded FROM flows")
def pad_product_code(s, d):
    from ..sources.tables import pad_code

    return V.flows(s, d).select("k").distinct().withColumn("padded", pad_code("k", 8))


@query("SELECT year, count(*) AS n, CAST(sum(v) AS DOUBLE) AS v FROM flows WHERE substr(k, 1, 4) IN (SELECT lpad(CAST(b AS VARCHAR), 2, '0') || lpad(CAST(z AS VARCHAR), 2, '0') FROM range(1, 26) t(b), range(1, 26) u(z)) GROUP BY year")
def filter_registered_products(s, d):
    from ..sources.tables import stage_edges

    codes = stage_edges(V.registry(s)).where(F.substring("code", 3, 2).cast("int") <= 25).select(F.col("code").alias("p"))
    rows = V.flows(s, d)
    return rows.join(F.broadcast(codes), F.substring(rows.k, 1, 4) == F.col("p"), "left_semi").groupBy("year").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("v"))


@query("SELECT n_name AS market, count(*) AS n, CAST(sum(v) AS DOUBLE) AS v FROM flows JOIN nation ON CAST(substr(j_iso, 2) AS INTEGER) = n_nationkey WHERE n_regionkey <> 0 GROUP BY n_name")
def map_iso_drop_unmapped(s, d):
    n = V.table(s, d, "nation").where("n_regionkey <> 0").select(V.nation_code("n_nationkey").alias("j_iso"), F.col("n_name").alias("market"))
    return V.flows(s, d).join(n, "j_iso").groupBy("market").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("v"))


@query("SELECT year, count(*) AS n FROM nflows WHERE i_iso NOT IN ('N24') AND j_iso NOT IN ('N24') GROUP BY year")
def drop_dissolved_entities(s, d):
    return P.drop_entities(V.flows(s, d, "N"), ["N24"], ["i_iso", "j_iso"]).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT i_iso, j_iso, stage, round(v, 5) AS v FROM early")
def threshold_strict(s, d):
    return V.fold(s, d)[0].select(*C.LANE, r("v"))


@query("SELECT i_iso, j_iso, stage, y FROM a_lanes WHERE i_iso NOT IN ('S00001', 'S00002') AND j_iso NOT IN ('N00', 'N01')")
def exclude_hubs(s, d):
    rows = P.drop_entities(P.drop_entities(V.track_a(s, d), ["N00", "N01"], ["j_iso"]), ["S00001", "S00002"], ["i_iso"])
    return rows.select(*C.LANE, "y")


@query("SELECT i_iso, stage, j_iso, i_iso IN (SELECT i_iso FROM h_a_raw) AS seen FROM a_raw")
def slice_seen_unseen(s, d):
    old = V.track_a(s, d, "history").select("i_iso").distinct()
    now = V.track_a(s, d).select(*C.LANE)
    return now.join(old, "i_iso", "left_semi").withColumn("seen", F.lit(True)).unionByName(now.join(old, "i_iso", "left_anti").withColumn("seen", F.lit(False)))


@query("SELECT DISTINCT i_iso, stage, i_iso || '|' || stage AS entry_id FROM b_raw")
def entry_key(s, d):
    return V.track_b(s, d).select(*C.ENTRY).distinct().withColumn("entry_id", C.entry_id())


@query("SELECT i_iso, j_iso, stage, y, 'v2' AS benchmark_version, 'calendar_mean' AS aggregation, '1997-1998' AS early_window, '1999-2000' AS late_window, 'target' AS temporal_role, 'extension' AS task, 'lane' AS task_unit FROM a_raw")
def attach_task_metadata(s, d):
    return C.with_metadata(V.track_a(s, d).select(*C.LANE, "y"), benchmark_version="v2", aggregation="calendar_mean", early_window="1997-1998", late_window="1999-2000", temporal_role="target", task="extension", task_unit="lane")


_PANEL = "SELECT k.i_iso, k.stage, y.year, coalesce(CAST(sum(f.v) AS DOUBLE), 0) AS v FROM ({keys}) k CROSS JOIN (VALUES (1997), (1998)) y(year) LEFT JOIN flows f ON f.i_iso = k.i_iso AND f.stage = k.stage AND f.year = y.year GROUP BY ALL"


@query(_PANEL.format(keys="SELECT DISTINCT i_iso, stage FROM flows WHERE year IN (1997, 1998)"))
def calendar_completion(s, d):
    return P.stage_year_totals(V.flows(s, d), EARLY, ["i_iso", "stage"]).withColumn("v", F.col("v").cast("double"))


@query(_PANEL.format(keys="SELECT DISTINCT i_iso, stage FROM flows"))
def expected_key_completion(s, d):
    f = V.flows(s, d)
    return P.stage_year_totals(f, EARLY, ["i_iso", "stage"], expected=f.select("i_iso", "stage").distinct()).withColumn("v", F.col("v").cast("double"))


@query("SELECT k.i_iso, k.j_iso, k.stage, y.year, coalesce(CAST(sum(f.v) AS DOUBLE), 0) AS v FROM (SELECT DISTINCT i_iso, j_iso, stage FROM flows WHERE year IN (1997, 1998)) k CROSS JOIN (VALUES (1997), (1998)) y(year) LEFT JOIN flows f ON f.i_iso = k.i_iso AND f.j_iso = k.j_iso AND f.stage = k.stage AND f.year = y.year GROUP BY ALL")
def stage_year_totals(s, d):
    return P.stage_year_totals(V.flows(s, d), EARLY, C.LANE).withColumn("v", F.col("v").cast("double"))


@query(f"SELECT i_iso, j_iso, stage, round(v, 5) AS v FROM ({_MEAN})")
def window_calendar_mean(s, d):
    return P.window_calendar_mean(V.flows(s, d), EARLY, C.LANE).select(*C.LANE, r("v"))


@query("SELECT i_iso, stage, round(sum(m), 5) AS v FROM (SELECT i_iso, stage, k, avg(t) AS m FROM (SELECT i_iso, stage, k, year, CAST(sum(v) AS DOUBLE) AS t FROM flows WHERE year IN (1997, 1998) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL")
def window_present_mean(s, d):
    return P.window_present_mean(V.flows(s, d), EARLY, ["i_iso", "stage"]).select("i_iso", "stage", r("v"))


_REGISTERED = "(SELECT f.* FROM flows f JOIN stages USING (stage) WHERE chain <> 'c4')"


@query(f"""SELECT 'stage' AS level, i_iso, j_iso, stage AS code, round(v, 5) AS v FROM (SELECT i_iso, j_iso, stage, CAST(sum(v) AS DOUBLE) / 2 AS v FROM {_REGISTERED} WHERE year IN (1997, 1998) GROUP BY ALL) WHERE v > 50000 UNION ALL
  SELECT 'product', i_iso, j_iso, k, round(v, 5) FROM (SELECT i_iso, j_iso, k, CAST(sum(v) AS DOUBLE) / 2 AS v FROM {_REGISTERED} WHERE year IN (1997, 1998) GROUP BY ALL) WHERE v > 25000""")
def load_window(s, d):
    from ..sources.tables import stage_edges

    # the documents of four of the five chains: flows of the fifth are not registered
    codes = stage_edges(V.registry(s).where("id <> 'c4'")).select("code", "stage")
    stage, product = P.load_window(V.flows(s, d), codes, EARLY, V.THRESHOLD, V.THRESHOLD / 2, digits=4)
    both = stage.select(F.lit("stage").alias("level"), "i_iso", "j_iso", F.col("stage").alias("code"), "v")
    return both.unionByName(product.select(F.lit("product").alias("level"), "i_iso", "j_iso", F.col("k").alias("code"), "v")).select("level", "i_iso", "j_iso", "code", r("v"))


@query("SELECT f.stage, s.chain, count(*) AS n, CAST(sum(v) AS DOUBLE) AS v FROM flows f JOIN stages s ON f.stage = s.stage GROUP BY ALL")
def stage_lookup(s, d):
    from ..sources.tables import stage_edges

    edges = stage_edges(V.registry(s)).select("chain", "stage", F.col("code").alias("p"))
    f = V.flows(s, d).drop("stage").withColumn("p", F.substring("k", 1, 4))
    return f.join(F.broadcast(edges), "p").groupBy("stage", "chain").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("v"))


@query("SELECT i_iso, j_iso, stage, year, CAST(sum(v) AS DOUBLE) AS v FROM flows f SEMI JOIN a_raw a ON a.i_iso = f.i_iso AND a.j_iso = f.j_iso AND a.stage = f.stage GROUP BY ALL")
def raw_semijoin(s, d):
    return V.flows(s, d).join(V.track_a(s, d).select(*C.LANE), C.LANE, "left_semi").groupBy(*C.LANE, "year").agg(F.sum("v").cast("double").alias("v"))


@query("SELECT i_iso, stage, 'output' AS kind, round(v, 5) AS v FROM own_output UNION ALL SELECT j_iso, stage, 'demand', round(sum(v), 5) FROM early GROUP BY j_iso, stage UNION ALL SELECT i_iso, stage, 'upstream', round(v, 5) FROM upstream_output")
def size_lookups(s, d):
    early, _, up = V.fold(s, d)
    parts = [t.select(F.col(c).alias("i_iso"), "stage", F.lit(k).alias("kind"), r("v")) for t, c, k in zip(C.size_lookups(early, up), ("i_iso", "j_iso", "i_iso"), ("output", "demand", "upstream"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_YEARS = "SELECT a.i_iso, a.j_iso, a.stage, count(t.v) AS active_years FROM a_raw a LEFT JOIN (SELECT i_iso, j_iso, stage, year, sum(v) AS v FROM flows WHERE year IN (1999, 2000) GROUP BY ALL HAVING sum(v) > 50000) t ON t.i_iso = a.i_iso AND t.j_iso = a.j_iso AND t.stage = a.stage GROUP BY ALL"


def _late_years(s, d):
    return P.active_years(V.flows(s, d), V.track_a(s, d), list(V.FOLDS["main"].late), V.THRESHOLD, C.LANE)


@query(_YEARS)
def active_years(s, d):
    return _late_years(s, d).select(*C.LANE, "active_years")


@query(f"SELECT active_years, count(*) AS n FROM ({_YEARS}) GROUP BY ALL")
def active_year_distribution(s, d):
    return _late_years(s, d).groupBy("active_years").agg(F.count("*").alias("n"))


@query("SELECT i_iso, k, CAST(sum(v) AS DOUBLE) AS v FROM flows GROUP BY ALL")
def exporter_product_totals(s, d):
    return V.flows(s, d).groupBy("i_iso", "k").agg(F.sum("v").cast("double").alias("v"))


@query("SELECT i_iso, j_iso, stage, y, row_number() OVER (ORDER BY round(size, 9) DESC, i_iso, stage, j_iso) AS rank FROM a_lanes")
def rank_canonical(s, d):
    from ..functions.shared import global_rank

    lanes = V.track_a(s, d).withColumn("score", F.round("size", 9))
    return global_rank(lanes, R.canonical("score", "A")).select(*C.LANE, "y", "rank")
