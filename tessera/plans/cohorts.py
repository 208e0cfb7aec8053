"""Queries of cohort construction, views, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keysets as K
from ..operators import cohorts as C
from ..operators import panel as P
from . import views as V
from .registry import query
from .views import r

_LANE_SQL = "SELECT i_iso, j_iso, stage, y, round(lateval, 5) AS lateval, round(log_exporter_capacity, 6) AS log_exporter_capacity, round(log_importer_demand, 6) AS log_importer_demand, round(size, 6) AS size FROM {}"


def _lane(df):
    return df.select(*C.LANE, "y", r("lateval"), r("log_exporter_capacity", 6), r("log_importer_demand", 6), r("size", 6))


@query("SELECT * FROM (VALUES ('main', 'early', 1997), ('main', 'early', 1998), ('main', 'late', 1999), ('main', 'late', 2000), ('history', 'early', 1995), ('history', 'early', 1996), ('history', 'late', 1997), ('history', 'late', 1998)) t(fold, side, year) SEMI JOIN flows f ON f.year = t.year")
def fold_spec(s, d):
    rows = [F.struct(F.lit(f.name).alias("fold"), F.lit(side).alias("side"), F.lit(y).alias("year")) for f in V.FOLDS.values() for side in ("early", "late") for y in getattr(f, side)]
    return s.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*").join(V.flows(s, d).select("year"), "year", "left_semi").select("fold", "side", "year")


@query("SELECT i_iso, stage FROM qualified")
def qualify_upstream(s, d):
    early, _, up = V.fold(s, d)
    return C.qualify_upstream(early, up)


@query("SELECT i_iso, stage FROM incumbents")
def incumbent_pool(s, d):
    early, _, up = V.fold(s, d)
    return C.incumbent_pool(C.qualify_upstream(early, up), early)


@query("SELECT i_iso, stage FROM entrants")
def entrant_pool(s, d):
    early, _, up = V.fold(s, d)
    return C.entrant_pool(C.qualify_upstream(early, up), early)


_NLANES = "SELECT p.i_iso, m.j_iso, p.stage FROM (SELECT DISTINCT i_iso, stage FROM n_early) p JOIN (SELECT DISTINCT j_iso, stage FROM n_early) m ON p.stage = m.stage AND p.i_iso <> m.j_iso ANTI JOIN n_early e ON e.i_iso = p.i_iso AND e.j_iso = m.j_iso AND e.stage = p.stage"


@query(_NLANES)
def enumerate_lanes(s, d):
    early = V.n_early(s, d)
    return C.enumerate_lanes(early.select(*C.ENTRY).distinct(), early)


@query("SELECT i_iso, j_iso, stage, y, round(lateval, 5) AS lateval FROM a_raw")
def label_late(s, d):
    early, late, up = V.fold(s, d)
    lanes = C.enumerate_lanes(C.incumbent_pool(C.qualify_upstream(early, up), early), early)
    return C.label_late(lanes, late).select(*C.LANE, "y", r("lateval"))


@query("SELECT a.i_iso, a.j_iso, stage, dist, contig, comlang FROM a_raw a LEFT JOIN (SELECT * FROM covariates WHERE dist > 1) c ON c.i_iso = a.i_iso AND c.j_iso = a.j_iso")
def attach_gravity(s, d):
    return V.track_a(s, d).select(*C.LANE).join(V.covariates(s, d).where("dist > 1"), ["i_iso", "j_iso"], "left").select(*C.LANE, "dist", "contig", "comlang")


@query(_LANE_SQL.format("a_lanes"))
def track_a_candidates(s, d):
    return _lane(V.track_a(s, d))


@query(_LANE_SQL.format("b_lanes"))
def track_b_lanes(s, d):
    return _lane(V.track_b(s, d))


@query(_LANE_SQL.format("h_b_lanes"))
def candidate_size(s, d):
    return _lane(V.track_b(s, d, "history"))


@query("SELECT p.i_iso, m.j_iso, p.stage, CASE WHEN l.v IS NULL THEN 0 ELSE 1 END AS y FROM (SELECT DISTINCT i_iso, stage FROM early) p JOIN (SELECT DISTINCT j_iso, stage FROM early) m ON p.stage = m.stage AND p.i_iso <> m.j_iso LEFT JOIN late l ON l.i_iso = p.i_iso AND l.j_iso = m.j_iso AND l.stage = p.stage ANTI JOIN early e ON e.i_iso = p.i_iso AND e.j_iso = m.j_iso AND e.stage = p.stage")
def all_export_candidates(s, d):
    early, late, _ = V.fold(s, d)
    return C.all_exporters(early, late).select(*C.LANE, "y")


_ENTRY_SQL = "SELECT i_iso, stage, entry_id, z, round(entry_lateval, 5) AS entry_lateval, round(size, 6) AS size, round(log_upstream_capacity, 6) AS log_upstream_capacity, n_candidate_destinations, n_materialized_destinations FROM {}entries"


def _entry(df):
    return df.select(*C.ENTRY, "entry_id", "z", r("entry_lateval"), r("size", 6), r("log_upstream_capacity", 6), "n_candidate_destinations", "n_materialized_destinations")


@query(_ENTRY_SQL.format(""))
def track_b1_entries(s, d):
    return _entry(C.entry_view(V.track_b(s, d)))


@query(_ENTRY_SQL.format("h_"))
def entry_view(s, d):
    return _entry(C.entry_view(V.track_b(s, d, "history")))


@query(_LANE_SQL.format("b2_lanes"))
def track_b2_lanes(s, d):
    return _lane(C.conditional_lanes(V.track_b(s, d)))


@query("""SELECT b.i_iso, b.stage, max(y) AS z, round(max(log_importer_demand), 6) AS max_demand, round(avg(log_importer_demand), 6) AS mean_demand,
  round(max(ln(1 + g)), 6) AS max_gravity, round(avg(ln(1 + g)), 6) AS mean_gravity, round(ln(1 + coalesce(sum(g), 0)), 6) AS logsum_gravity,
  round(avg(CASE WHEN g IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS gravity_coverage, round(ln(1 + count(*)), 6) AS log_destinations
  FROM b_lanes b LEFT JOIN (SELECT i_iso, j_iso, 100.0 / dist AS g FROM covariates WHERE dist > 1) c ON c.i_iso = b.i_iso AND c.j_iso = b.j_iso GROUP BY b.i_iso, b.stage""")
def entry_features(s, d):
    g = V.covariates(s, d).where("dist > 1").select("i_iso", "j_iso", (F.lit(100.0) / F.col("dist")).alias("grav"))
    x = C.entry_features(V.track_b(s, d).join(g, ["i_iso", "j_iso"], "left"))
    return x.select("i_iso", "stage", "z", *[r(c, 6) for c in x.columns if c not in ("i_iso", "stage", "z")])


@query("SELECT i_iso, j_iso, stage, y, max(y) OVER (PARTITION BY i_iso, stage) AS entry_y FROM b_raw")
def entry_label_broadcast(s, d):
    from ..operators.rank import group_max

    return group_max(V.track_b(s, d).select(*C.LANE, "y"), C.ENTRY, "y", "entry_y").select(*C.LANE, "y", "entry_y")


@query("SELECT stage, i_iso, j_iso, y, round(lateval, 5) AS lateval, max(lateval) OVER (PARTITION BY stage) = lateval AS is_stage_max FROM a_raw")
def group_max_broadcast(s, d):
    from ..operators.rank import group_max

    return group_max(V.track_a(s, d), ["stage"], "lateval", "m").select("stage", "i_iso", "j_iso", "y", r("lateval"), (F.col("m") == F.col("lateval")).alias("is_stage_max"))


_SUM = """SELECT coalesce(chain, 'TOTAL') AS chain, count(*) AS candidates, CAST(sum(y) AS BIGINT) AS positives, round(sum(y) / count(*), 9) AS base_rate, round(sum(lateval), 5) AS value
  FROM a_raw JOIN stages s USING (stage) GROUP BY GROUPING SETS ((s.chain), ())"""


@query(_SUM)
def cohort_summary(s, d):
    return C.summary(V.track_a(s, d).withColumn("chain", V.chain_of())).withColumns({"base_rate": r("base_rate", 9), "value": r("value")})


@query("""WITH starts AS (SELECT l.i_iso, l.j_iso, l.stage, l.v, m.j_iso IS NOT NULL AS ok FROM late l SEMI JOIN entrants q ON q.i_iso = l.i_iso AND q.stage = l.stage
    LEFT JOIN (SELECT DISTINCT j_iso, stage FROM early) m ON m.j_iso = l.j_iso AND m.stage = l.stage WHERE l.i_iso <> l.j_iso),
  e AS (SELECT i_iso, stage, bool_or(ok) AS c, bool_or(NOT ok) AS x FROM starts GROUP BY ALL)
  SELECT (SELECT count(*) FROM e) AS n_entries, (SELECT count(*) FROM e WHERE c) AS n_covered, (SELECT count(*) FROM e WHERE NOT c) AS n_inactive_only, (SELECT count(*) FROM e WHERE c AND x) AS n_mixed,
  count(*) AS n_lanes, count(*) FILTER (ok) AS n_eligible_lanes, round(sum(v), 5) AS value, round(sum(CASE WHEN ok THEN v ELSE 0 END), 5) AS eligible_value,
  round((SELECT avg(CASE WHEN c THEN 1.0 ELSE 0.0 END) FROM e), 9) AS entry_coverage, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS lane_coverage, round(sum(CASE WHEN ok THEN v ELSE 0 END) / sum(v), 9) AS value_coverage FROM starts""")
def b1_coverage(s, d):
    x = C.coverage(C.late_starts(*V.fold(s, d)))
    return x.withColumns({**{c: F.round(c, 5) for c in ("value", "eligible_value")}, **{c: F.round(c, 9) for c in ("entry_coverage", "lane_coverage", "value_coverage")}})


_STARTS = """SELECT l.i_iso, l.j_iso, l.stage, round(l.v, 5) AS v, m.j_iso IS NOT NULL AS eligible_market FROM late l SEMI JOIN entrants q ON q.i_iso = l.i_iso AND q.stage = l.stage
  LEFT JOIN (SELECT DISTINCT j_iso, stage FROM early) m ON m.j_iso = l.j_iso AND m.stage = l.stage WHERE l.i_iso <> l.j_iso"""


@query(_STARTS)
def late_start_universe(s, d):
    return C.late_starts(*V.fold(s, d)).withColumn("v", F.round("v", 5))


@query(f"SELECT i_iso, stage, CASE WHEN bool_and(eligible_market) THEN 'covered' WHEN bool_or(eligible_market) THEN 'mixed' ELSE 'inactive_only' END AS part FROM ({_STARTS}) GROUP BY ALL")
def entry_partition(s, d):
    return C.partition_entries(C.late_starts(*V.fold(s, d)))


_GEO = """SELECT t.threshold, {f} FROM (VALUES (45000.0), (50000.0), (55000.0)) t(threshold)"""


def _geometry_sql() -> str:
    means = {k: f"SELECT i_iso, j_iso, stage, CAST(sum(v) AS DOUBLE) / 2 AS v FROM flows WHERE year IN {y} GROUP BY ALL" for k, y in (("e0", "(1997, 1998)"), ("l0", "(1999, 2000)"))}
    return f"""WITH t AS (SELECT CAST(x AS DOUBLE) AS threshold FROM (VALUES (45000), (50000), (55000)) v(x)), e AS (SELECT t.threshold, m.* FROM ({means['e0']}) m JOIN t ON m.v > t.threshold),
      l AS (SELECT t.threshold, m.* FROM ({means['l0']}) m JOIN t ON m.v > t.threshold),
      q AS (SELECT DISTINCT e.threshold, e.i_iso, u.stage FROM e JOIN upstream u ON u.source = e.stage),
      p AS (SELECT q.*, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.threshold = q.threshold AND e.i_iso = q.i_iso AND e.stage = q.stage) THEN 'A' ELSE 'B' END AS track FROM q),
      g AS (SELECT p.threshold, p.i_iso, m.j_iso, p.stage, p.track, CASE WHEN l.v IS NULL THEN 0 ELSE 1 END AS y, coalesce(l.v, 0.0) AS lateval FROM p JOIN (SELECT DISTINCT threshold, stage, j_iso FROM e) m ON m.threshold = p.threshold AND m.stage = p.stage AND m.j_iso <> p.i_iso
        LEFT JOIN l ON l.threshold = p.threshold AND l.i_iso = p.i_iso AND l.j_iso = m.j_iso AND l.stage = p.stage ANTI JOIN e ON e.threshold = p.threshold AND e.i_iso = p.i_iso AND e.j_iso = m.j_iso AND e.stage = p.stage)"""


def _geometry(s, d):
    early, late = V.windows(s, d)
    return C.geometry(early, late, V.upstream(s), [45000, 50000, 55000])


@query(_geometry_sql() + " SELECT threshold, track, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(sum(lateval), 5) AS value FROM g GROUP BY ALL")
def threshold_geometry(s, d):
    return _geometry(s, d).groupBy("threshold", "track").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.round(F.sum("lateval"), 5).alias("value"))


@query(_geometry_sql() + """ SELECT x.threshold, count(*) FILTER (x.a AND x.b) AS both, count(*) FILTER (x.a AND NOT x.b) AS left_only, count(*) FILTER (x.b AND NOT x.a) AS reference_only, count(*) AS either,
  round(count(*) FILTER (x.a AND x.b) / count(*), 9) AS jaccard, round(count(*) FILTER (x.a AND x.b) / count(*) FILTER (x.b), 9) AS retention FROM (
  SELECT t.threshold, coalesce(g.i_iso, k.i_iso) AS i, g.i_iso IS NOT NULL AS a, k.i_iso IS NOT NULL AS b FROM (VALUES (CAST(45000 AS DOUBLE)), (CAST(55000 AS DOUBLE))) t(threshold) JOIN (SELECT DISTINCT i_iso, j_iso, stage FROM g WHERE track = 'A') u ON true
  LEFT JOIN (SELECT * FROM g WHERE track = 'A') g ON g.threshold = t.threshold AND g.i_iso = u.i_iso AND g.j_iso = u.j_iso AND g.stage = u.stage LEFT JOIN (SELECT * FROM g WHERE track = 'A' AND threshold = 50000) k ON k.i_iso = u.i_iso AND k.j_iso = u.j_iso AND k.stage = u.stage
  WHERE g.i_iso IS NOT NULL OR k.i_iso IS NOT NULL) x GROUP BY x.threshold""")
def key_set_overlap(s, d):
    g = _geometry(s, d).where("track = 'A'")
    ref = g.where("threshold = 50000")
    parts = [K.overlap(g.where(F.col("threshold") == t), ref, C.LANE).withColumn("threshold", F.lit(t)) for t in (45000.0, 55000.0)]
    return parts[0].unionByName(parts[1]).withColumns({c: F.round(c, 9) for c in ("jaccard", "retention")})


@query(_geometry_sql() + " SELECT (SELECT count(*) FROM (SELECT i_iso, j_iso, stage, y FROM g WHERE track = 'A' AND threshold = 50000 EXCEPT SELECT i_iso, j_iso, stage, y FROM a_raw)) AS extra, (SELECT count(*) FROM (SELECT i_iso, j_iso, stage, y FROM a_raw EXCEPT SELECT i_iso, j_iso, stage, y FROM g WHERE track = 'A' AND threshold = 50000)) AS missing, (SELECT count(*) FROM a_raw) AS n")
def reconcile_reference_threshold(s, d):
    g = _geometry(s, d).where("track = 'A' and threshold = 50000")
    return K.difference_counts(V.track_a(s, d), g, [*C.LANE, "y"])


@query("SELECT i_iso, j_iso, stage, 'missing' AS side FROM h_a_raw ANTI JOIN a_raw USING (i_iso, j_iso, stage) UNION ALL SELECT i_iso, j_iso, stage, 'extra' FROM a_raw ANTI JOIN h_a_raw USING (i_iso, j_iso, stage)")
def key_set_difference(s, d):
    return K.difference(V.track_a(s, d, "history"), V.track_a(s, d), C.LANE)


@query("SELECT i_iso, j_iso, stage FROM a_raw UNION SELECT i_iso, j_iso, stage FROM b_raw")
def union_cohorts(s, d):
    return V.track_a(s, d).select(*C.LANE).unionByName(V.track_b(s, d).select(*C.LANE)).dropDuplicates()


@query("SELECT 'A' AS track, count(*) AS overlap FROM a_raw SEMI JOIN early USING (i_iso, j_iso, stage) UNION ALL SELECT 'B', count(*) FROM b_raw SEMI JOIN early USING (i_iso, j_iso, stage)")
def candidate_early_overlap(s, d):
    fold = V.fold(s, d)  # one pass over the flows for both tracks and the lanes they are held against
    one = lambda t, n: t.join(fold[0].select(*C.LANE), C.LANE, "left_semi").agg(F.count("*").alias("overlap")).select(F.lit(n).alias("track"), "overlap")
    return one(C.track_a(*fold), "A").unionByName(one(C.track_b(*fold), "B"))


_U01 = "CAST(('0x' || substr(sha256('tessera|' || {k}), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0"


@query(f"SELECT i_iso, j_iso, stage, round({_U01.format(k='i_iso || chr(124) || j_iso')}, 12) AS u FROM a_raw")
def split_uniform(s, d):
    return V.track_a(s, d).select(*C.LANE, F.round(C.split_uniform(F.concat_ws("|", "i_iso", "j_iso"), "tessera"), 12).alias("u"))


_UNITS = {"lane": "chain || '|' || i_iso || '|' || stage || '|' || j_iso", "exporter_stage": "chain || '|exporter_stage|' || i_iso || '|' || stage", "exporter": "chain || '|exporter|' || i_iso", "importer": "chain || '|importer|' || j_iso"}
_SPLIT = " UNION ALL ".join(f"SELECT '{u}' AS unit, i_iso, j_iso, stage, CASE WHEN {_U01.format(k=k)} < 0.25 THEN 'test' ELSE 'train' END AS split FROM a_raw JOIN stages USING (stage)" for u, k in _UNITS.items())


def _splits(s, d):
    lanes = V.track_a(s, d).select(*C.LANE)
    parts = [C.split_assign(lanes, u, V.chain_of(), "tessera", 0.25).withColumn("unit", F.lit(u)) for u in _UNITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(_SPLIT)
def split_assign(s, d):
    return _splits(s, d).select("unit", *C.LANE, "split")


@query(f"SELECT unit, count(*) AS leaking FROM (SELECT unit, i_iso, stage FROM ({_SPLIT}) WHERE unit IN ('exporter_stage', 'importer') GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY unit")
def split_leakage_check(s, d):
    return K.leaking_groups(_splits(s, d).where(F.col("unit").isin("exporter_stage", "importer")), ["unit", *C.ENTRY], "split").groupBy("unit").agg(F.count("*").alias("leaking"))


_LATE = "SELECT a.i_iso, a.j_iso, a.stage, CAST(sum(f.v) AS DOUBLE) / 2 AS m FROM a_raw a LEFT JOIN (SELECT * FROM flows WHERE year IN (1999, 2000)) f ON f.i_iso = a.i_iso AND f.j_iso = a.j_iso AND f.stage = a.stage GROUP BY ALL"


@query(f"SELECT i_iso, j_iso, stage, CASE WHEN m > 60000 THEN 1 ELSE 0 END AS y, round(CASE WHEN m > 60000 THEN m ELSE 0 END, 5) AS lateval FROM ({_LATE})")
def threshold_relabel(s, d):
    late = V.windows(s, d)[1].withColumnRenamed("v", "late_mean")
    return C.labels_at(V.track_a(s, d).select(*C.LANE).join(late, C.LANE, "left"), 60000.0).select(*C.LANE, "y", r("lateval"))


@query("SELECT a.i_iso, a.j_iso, a.stage, CASE WHEN count(t.v) >= 2 THEN 1 ELSE 0 END AS y FROM a_raw a LEFT JOIN (SELECT i_iso, j_iso, stage, year, sum(v) AS v FROM flows WHERE year IN (1999, 2000) GROUP BY ALL HAVING sum(v) > 50000) t ON t.i_iso = a.i_iso AND t.j_iso = a.j_iso AND t.stage = a.stage GROUP BY ALL")
def persistence_relabel(s, d):
    lanes = P.active_years(V.flows(s, d), V.track_a(s, d).drop("y"), list(V.FOLDS["main"].late), V.THRESHOLD, C.LANE)
    return C.persistent(lanes, 2).select(*C.LANE, "y")


@query("SELECT i_iso, j_iso, stage, round(size, 6) AS score FROM a_lanes ORDER BY i_iso, stage, j_iso")
def canonical_sort(s, d):
    return V.track_a(s, d).select(*C.LANE, F.round("size", 6).alias("score")).orderBy("i_iso", "stage", "j_iso")
