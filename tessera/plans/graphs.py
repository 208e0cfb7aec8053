"""Queries of graph operators and the product space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import cohorts as C
from ..operators import graph as G
from ..operators import panel as P
from ..operators import product_space as PS
from . import views as V
from .registry import query

_PL = "SELECT i_iso, j_iso, k FROM (SELECT i_iso, j_iso, k, CAST(sum(v) AS DOUBLE) / 2 AS v FROM flows WHERE year IN (1997, 1998) GROUP BY ALL) WHERE v > 25000"


def _product_lanes(s, d, rows=None):
    lanes = P.active(P.window_calendar_mean(V.flows(s, d) if rows is None else rows, [1997, 1998], ["i_iso", "j_iso", "k"]), 25000.0)
    return stored(lanes.select("i_iso", "j_iso", "k"), "product-lanes")


def _early(s, d):
    return V.fold(s, d)[0]


def _rows(s, d):
    """The flows of the main fold's years, joined once and written, for queries that sum them in several ways."""
    f = V.FOLDS["main"]
    return stored(V.flows(s, d).where(F.col("year").isin(*f.early, *f.late)), "flows")


def _stages(s):
    from ..sources.tables import stage_edges

    return stage_edges(V.registry(s)).select("stage").distinct()


@query("WITH RECURSIVE t(stage, depth) AS (SELECT stage, 0 FROM stages UNION SELECT u.stage, t.depth + 1 FROM t JOIN upstream u ON u.source = t.stage), x AS (SELECT stage, max(depth) AS tier FROM t GROUP BY stage) SELECT x.stage, x.tier, count(f.v) AS lines FROM x LEFT JOIN flows f ON f.stage = x.stage GROUP BY ALL")
def stage_tiers(s, d):
    tiers = G.stage_tiers(V.upstream(s), _stages(s))
    n = V.flows(s, d).groupBy("stage").agg(F.count("*").alias("lines"))
    return tiers.join(n, "stage", "left").select("stage", "tier", F.coalesce("lines", F.lit(0)).alias("lines"))


_PREFIX = "SELECT DISTINCT k AS head, 'hs_parent' AS relation, substr(k, 1, 4) AS tail FROM {t} UNION SELECT DISTINCT substr(k, 1, 4), 'hs_parent', substr(k, 1, 2) FROM {t}"


@query(_PREFIX.format(t="flows"))
def hs_prefixes(s, d):
    return G.prefixes(V.flows(s, d).select("k").distinct())


_TRIPLES = f"""SELECT i_iso AS head, stage AS relation, j_iso AS tail FROM early UNION ALL SELECT * FROM ({_PREFIX.format(t=f'({_PL})')}) UNION ALL SELECT s.stage, 'form_of', t.stage FROM stages s JOIN stages t ON s.chain = t.chain AND s.position = 0 AND t.position = 2
  UNION ALL SELECT u.stage, 'derived_from', u.source FROM upstream u JOIN stages s ON s.stage = u.source JOIN stages t ON t.stage = u.stage WHERE (t.position = 2 AND s.position = 0) OR (t.position = 3 AND s.position = 0) OR (t.position = 4 AND s.position = 1)
  UNION ALL SELECT DISTINCT i_iso, 'supplies', k FROM ({_PL}) UNION ALL SELECT DISTINCT j_iso, 'demands', k FROM ({_PL})"""


def _triples(s, d, early=None, rows=None):
    reg = V.registry(s)
    form = reg.select(F.explode("form_of").alias("f")).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
    derived = reg.select(F.explode("derived_from").alias("stage", "sources")).select("stage", F.explode("sources").alias("source"))
    return G.triples(_early(s, d) if early is None else early, _product_lanes(s, d, rows), form, derived)


@query(f"SELECT head, relation, tail FROM ({_TRIPLES})")
def build_triples(s, d):
    return _triples(s, d)


_TIERED = f"""SELECT DISTINCT i_iso AS head, 'exp_tier' || tier AS relation, j_iso AS tail FROM early JOIN stages USING (stage) UNION SELECT i_iso, 'supplies', k FROM ({_PL}) WHERE i_iso IN (SELECT i_iso FROM early UNION SELECT j_iso FROM early) UNION SELECT j_iso, 'demands', k FROM ({_PL}) WHERE j_iso IN (SELECT i_iso FROM early UNION SELECT j_iso FROM early)"""


@query(_TIERED)
def build_tier_triples(s, d):
    return G.tier_triples(_early(s, d), _product_lanes(s, d), G.stage_tiers(V.upstream(s), _stages(s)))


@query("SELECT i_iso AS head, stage AS relation, j_iso AS tail FROM early UNION ALL SELECT j_iso, stage || '^-1', i_iso FROM early")
def inverse_edges(s, d):
    return G.with_inverse(_early(s, d).select(F.col("i_iso").alias("head"), F.col("stage").alias("relation"), F.col("j_iso").alias("tail")))


@query(f"SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS id FROM (SELECT head AS entity FROM ({_TRIPLES}) UNION SELECT tail FROM ({_TRIPLES}))")
def entity_ids(s, d):
    return G.entity_ids(_triples(s, d))


@query(f"SELECT relation, count(*) AS edges, count(DISTINCT (head, tail)) AS unique_edges, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM ({_TRIPLES}) GROUP BY relation")
def graph_profile(s, d):
    return G.profile(_triples(s, d))


@query(f"WITH t AS ({_TRIPLES}), n AS (SELECT head AS x FROM t UNION SELECT tail FROM t) SELECT 'head' AS kind, count(*) AS missing FROM (SELECT DISTINCT i_iso AS x FROM a_raw ANTI JOIN n ON n.x = i_iso) UNION ALL SELECT 'tail', count(*) FROM (SELECT DISTINCT j_iso AS x FROM a_raw ANTI JOIN n ON n.x = j_iso) UNION ALL SELECT 'relation', count(*) FROM (SELECT DISTINCT stage FROM a_raw ANTI JOIN t ON t.relation = stage)")
def graph_coverage(s, d):
    rows = _rows(s, d)
    f = V.FOLDS["main"]
    early, late = (P.active(w, V.THRESHOLD) for w in P.window_pair(rows, list(f.early), list(f.late), C.LANE))
    return G.graph_gaps(C.track_a(early, late, V.upstream(s)), _triples(s, d, early, rows))


@query("SELECT code, owners FROM (SELECT substr(k, 1, 2) AS code, count(DISTINCT chain) AS owners FROM flows JOIN stages USING (stage) GROUP BY ALL) WHERE owners = 1")
def product_disjointness(s, d):
    x = V.flows(s, d).select(F.substring("k", 1, 2).alias("code"), V.chain_of().alias("chain")).groupBy("code").agg(F.count_distinct("chain").alias("owners"))
    return x.where("owners = 1")


@query("SELECT i_iso AS head, stage AS relation, j_iso AS tail FROM early ORDER BY sha256('cap|' || i_iso || '|' || stage || '|' || j_iso), 1, 2, 3 LIMIT 100")
def supervision_cap(s, d):
    return G.capped(_early(s, d).select(F.col("i_iso").alias("head"), F.col("stage").alias("relation"), F.col("j_iso").alias("tail")), 100)


_NBR = "WITH nb AS (SELECT i_iso AS node, j_iso AS nbr FROM n_early UNION SELECT j_iso, i_iso FROM n_early), deg AS (SELECT node, count(*) AS degree FROM nb GROUP BY node), pr AS (SELECT DISTINCT i_iso, j_iso FROM n_early WHERE i_iso <> j_iso)"


def _heuristics(s, d):
    early = stored(V.n_early(s, d), "early")
    return G.link_heuristics(early.where("i_iso <> j_iso"), early)


_COMMON = "(SELECT pr.i_iso, pr.j_iso, a.nbr FROM pr JOIN nb a ON a.node = pr.i_iso JOIN nb b ON b.node = pr.j_iso AND b.nbr = a.nbr)"


@query(f"{_NBR} SELECT pr.i_iso, pr.j_iso, count(c.nbr) AS common_neighbors FROM pr LEFT JOIN {_COMMON} c ON c.i_iso = pr.i_iso AND c.j_iso = pr.j_iso GROUP BY ALL")
def common_neighbors(s, d):
    return _heuristics(s, d).select("i_iso", "j_iso", "common_neighbors")


@query(f"{_NBR} SELECT c.nbr, count(*) AS pairs FROM {_COMMON} c GROUP BY c.nbr")
def common_neighbors_join(s, d):
    early = stored(V.n_early(s, d), "early")
    nbr, _ = G.neighbours(early)
    return G.wedges(early.where("i_iso <> j_iso"), nbr).groupBy("nbr").agg(F.count("*").alias("pairs"))


@query(f"{_NBR} SELECT pr.i_iso, pr.j_iso, round(coalesce(sum(CASE WHEN degree > 1 THEN 1 / ln(degree) ELSE 0 END), 0), 8) AS adamic_adar FROM pr LEFT JOIN {_COMMON} c ON c.i_iso = pr.i_iso AND c.j_iso = pr.j_iso LEFT JOIN deg ON deg.node = c.nbr GROUP BY ALL")
def adamic_adar(s, d):
    return _heuristics(s, d).select("i_iso", "j_iso", F.round("adamic_adar", 8).alias("adamic_adar"))


@query(f"{_NBR} SELECT pr.i_iso, pr.j_iso, a.degree * b.degree AS pref_attach FROM pr JOIN deg a ON a.node = pr.i_iso JOIN deg b ON b.node = pr.j_iso")
def pref_attach(s, d):
    return _heuristics(s, d).select("i_iso", "j_iso", "pref_attach")


@query("SELECT i_iso, stage, served, importers, round(served / importers, 9) AS saturation FROM (SELECT i_iso, stage, count(DISTINCT j_iso) AS served FROM n_early GROUP BY ALL) JOIN (SELECT stage, count(DISTINCT j_iso) AS importers FROM n_early GROUP BY ALL) USING (stage)")
def market_saturation(s, d):
    return G.saturation(V.n_early(s, d)).withColumn("saturation", F.round("saturation", 9))


_GAPS = """SELECT i_iso, stage, j_iso, round(demand, 5) AS demand, row_number() OVER (PARTITION BY i_iso, stage ORDER BY round(demand, 5) DESC, j_iso) AS rank FROM (SELECT p.i_iso, p.stage, m.j_iso, m.demand FROM (SELECT DISTINCT i_iso, stage FROM n_early) p JOIN (SELECT stage, j_iso, sum(v) AS demand FROM n_early GROUP BY ALL) m ON m.stage = p.stage AND m.j_iso <> p.i_iso
  ANTI JOIN n_early e ON e.i_iso = p.i_iso AND e.j_iso = m.j_iso AND e.stage = p.stage)"""


@query(f"SELECT * FROM ({_GAPS}) WHERE rank <= 3")
def gap_ranking(s, d):
    return G.gap_ranking(V.n_early(s, d), 3).select("i_iso", "stage", "j_iso", F.round("demand", 5).alias("demand"), "rank")


@query(f"""SELECT i_iso, stage, j_iso, first, second, paths, rank FROM (SELECT *, row_number() OVER (PARTITION BY i_iso, stage, j_iso ORDER BY paths DESC, first, second) AS rank FROM (SELECT g.i_iso, g.stage, g.j_iso, a.stage AS first, b.stage AS second, count(*) AS paths
  FROM (SELECT * FROM ({_GAPS}) WHERE rank <= 1) g JOIN n_early a ON a.i_iso = g.i_iso JOIN n_early b ON b.i_iso = a.j_iso AND b.j_iso = g.j_iso GROUP BY ALL)) WHERE rank <= 2""")
def supporting_paths(s, d):
    early = stored(V.n_early(s, d), "early")
    return G.supporting_paths(G.gap_ranking(early, 1), early, 2)


_TOT = "tot AS (SELECT i_iso, substr(k, 1, 4) AS p, CAST(sum(v) AS DOUBLE) AS v FROM flows WHERE year IN (1997, 1998) GROUP BY ALL)"
_MEM = f"{_TOT}, mem AS (SELECT i_iso, p FROM (SELECT i_iso, p, v, sum(v) OVER (PARTITION BY i_iso) AS r, sum(v) OVER (PARTITION BY p) AS c, sum(v) OVER () AS t FROM tot) WHERE round((v / r) / (c / t), 9) >= 1)"
_TGT = "tgt AS (SELECT DISTINCT p FROM mem WHERE 'Brand#' || CAST(substr(p, 1, 2) AS INTEGER) IN (SELECT stage FROM upstream))"
_PROX = f"{_MEM}, {_TGT}, ub AS (SELECT p, count(*) AS u FROM mem GROUP BY p), co AS (SELECT a.p, b.p AS q, count(*) AS n FROM mem a SEMI JOIN tgt ON tgt.p = a.p JOIN mem b ON a.i_iso = b.i_iso GROUP BY ALL), prox AS (SELECT co.p, co.q, n / greatest(x.u, y.u) AS proximity FROM co JOIN ub x ON x.p = co.p JOIN ub y ON y.p = co.q WHERE co.p <> co.q)"
_DENS = f"{_PROX}, dens AS (SELECT m.i_iso, x.p, sum(proximity) / t.t AS density FROM prox x JOIN mem m ON m.p = x.q JOIN (SELECT p, sum(proximity) AS t FROM prox GROUP BY p) t ON t.p = x.p GROUP BY m.i_iso, x.p, t.t)"


def _members(s, d, rows=None):
    f = (V.flows(s, d) if rows is None else rows).where("year in (1997, 1998)")
    totals = stored(f.groupBy("i_iso", F.substring("k", 1, 4).alias("p")).agg(F.sum("v").cast("double").alias("v")), "totals")
    return stored(G.rca_membership(totals), "members")


def _targets(s, members):
    """(stage, p): the products of every stage that has upstream stages, as far as any exporter is a member."""
    stages = V.upstream(s).select("stage").distinct()
    own = members.select("p").distinct().select(F.concat(F.lit("Brand#"), F.substring("p", 1, 2).cast("int")).alias("stage"), "p")
    return own.join(F.broadcast(stages), "stage", "left_semi")


@query(f"WITH {_MEM} SELECT i_iso, p FROM mem")
def rca_membership(s, d):
    return _members(s, d)


@query(f"WITH {_PROX} SELECT p, q, n FROM co")
def product_cooccurrence(s, d):
    m = _members(s, d)
    return PS.cooccurrence(m, _targets(s, m))


@query(f"WITH {_PROX} SELECT p, q, round(proximity, 9) AS proximity FROM prox")
def product_proximity(s, d):
    m = _members(s, d)
    return PS.proximity(m, _targets(s, m)).withColumn("proximity", F.round("proximity", 9))


def _density(s, m):
    return PS.density(m, stored(PS.proximity(m, _targets(s, m)), "proximity"))


@query(f"WITH {_DENS} SELECT i_iso, p, round(density, 8) AS density FROM dens")
def product_density(s, d):
    return _density(s, _members(s, d)).withColumn("density", F.round("density", 8))


@query(f"WITH {_DENS}, sp AS (SELECT 'Brand#' || CAST(substr(p, 1, 2) AS INTEGER) AS stage, p FROM tgt) SELECT e.i_iso, e.stage, round(coalesce(sum(density) / any_value(n.k), 0), 8) AS score FROM entries e LEFT JOIN (SELECT stage, count(*) AS k FROM sp GROUP BY stage) n ON n.stage = e.stage LEFT JOIN sp ON sp.stage = e.stage LEFT JOIN dens ON dens.i_iso = e.i_iso AND dens.p = sp.p GROUP BY e.i_iso, e.stage")
def stage_density_score(s, d):
    rows, f = _rows(s, d), V.FOLDS["main"]
    m = _members(s, d, rows)
    products = _targets(s, m)
    early, late = (P.active(w, V.THRESHOLD) for w in P.window_pair(rows, list(f.early), list(f.late), C.LANE))
    entries = C.entry_view(C.track_b(early, late, V.upstream(s))).select(*C.ENTRY)
    sums = PS.density_sums(m, stored(PS.proximity(m, products), "proximity"), products)
    return G.stage_mean(entries, sums, products).withColumn("score", F.round("score", 8))
