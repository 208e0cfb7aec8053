"""Queries of ranks, metrics and bootstrap intervals over the cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import bootstrap as B
from ..operators import cohorts as C
from ..operators import metrics as M
from ..operators import rank as R
from . import views as V
from .registry import query

S9 = "round(size, 9)"


def _a(s, d):
    return V.track_a(s, d).withColumn("score", F.round("size", 9)).withColumn("chain", V.chain_of())


def _b2(s, d):
    return C.conditional_lanes(V.track_b(s, d)).withColumn("score", F.round("log_importer_demand", 9))


def _entries(s, d):
    return C.entry_view(V.track_b(s, d)).withColumn("score", F.round("size", 9))


def _rounded(df, *keep, digits=9):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c, t in df.dtypes if t == "double" and c not in keep], *[c for c, t in df.dtypes if t != "double" and c not in keep])


@query(f"SELECT i_iso, stage, j_iso, row_number() OVER (PARTITION BY i_iso ORDER BY {S9} DESC, stage, j_iso) AS rank FROM a_lanes")
def rank_in_group(s, d):
    from ..functions.shared import global_rank

    return global_rank(_a(s, d), [F.col("score").desc(), F.col("stage"), F.col("j_iso")], group=["i_iso"]).select("i_iso", "stage", "j_iso", "rank")


_MID = f"SELECT *, rank() OVER (PARTITION BY chain ORDER BY {S9}) + (count(*) OVER (PARTITION BY chain, {S9}) - 1) / 2.0 AS midrank, count(*) OVER (PARTITION BY chain) AS n FROM a_lanes JOIN stages USING (stage)"


@query(f"SELECT i_iso, j_iso, stage, midrank FROM ({_MID})")
def midrank(s, d):
    return R.midrank(_a(s, d), "score", ["chain"]).select(*C.LANE, "midrank")


@query(f"SELECT i_iso, j_iso, stage, round((midrank - 0.5) / n, 9) AS ecdf FROM ({_MID})")
def midrank_ecdf(s, d):
    return R.midrank_ecdf(_a(s, d), "score", ["chain"]).select(*C.LANE, F.round("ecdf", 9).alias("ecdf"))


_BLOCKS = f"SELECT chain, score, p, n, CAST(sum(p) OVER w AS BIGINT) AS c_p, CAST(sum(n) OVER w AS BIGINT) AS c_n FROM (SELECT chain, {S9} AS score, CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM a_lanes JOIN stages USING (stage) GROUP BY ALL) WINDOW w AS (PARTITION BY chain ORDER BY score DESC)"


@query(_BLOCKS)
def cumulative_tp(s, d):
    x = R.score_blocks(_a(s, d), "score", {"p": F.col("y").cast("long"), "n": F.lit(1).cast("long")}, ["chain"])
    return x.select("chain", "score", "p", "n", "c_p", "c_n")


@query(f"SELECT chain, round(CASE WHEN sum(p) > 0 THEN sum(p * c_p / c_n) / sum(p) END, 9) AS average_precision FROM ({_BLOCKS}) GROUP BY chain")
def average_precision(s, d):
    return _rounded(M.average_precision(_a(s, d), "y", "score", ["chain"]), "chain")


_WBLOCKS = f"SELECT chain, score, p, n, sum(p) OVER w AS c_p, sum(n) OVER w AS c_n FROM (SELECT chain, {S9} AS score, sum(y * w) AS p, sum(w) AS n FROM (SELECT *, 1.0 + length(j_iso || stage) % 3 AS w FROM a_lanes JOIN stages USING (stage)) GROUP BY ALL) WINDOW w AS (PARTITION BY chain ORDER BY score DESC)"


@query(f"SELECT chain, round(CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN sum(p * c_p / c_n) / sum(p) END, 9) AS average_precision FROM ({_WBLOCKS}) GROUP BY chain")
def weighted_average_precision(s, d):
    x = _a(s, d).withColumn("w", F.lit(1.0) + F.length(F.concat("j_iso", "stage")) % 3)
    return _rounded(M.weighted_average_precision(x, "y", "score", "w", ["chain"]), "chain")


_AUC = "CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN midrank ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END"


@query(f"SELECT chain, round({_AUC}, 9) AS auc FROM ({_MID}) GROUP BY chain")
def roc_auc(s, d):
    return _rounded(M.roc_auc(_a(s, d), "y", "score", ["chain"]), "chain")


_EDGES = "SELECT list_distinct(quantile_cont(log_exporter_capacity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM a_r"
_BINS = f"a_r AS (SELECT * REPLACE (round(log_exporter_capacity, 9) AS log_exporter_capacity) FROM a_lanes), edges AS (SELECT unnest(list_sort(e)[2:-2]) AS edge FROM ({_EDGES})), binned AS (SELECT a.*, (SELECT count(*) FROM edges WHERE edge <= a.log_exporter_capacity) AS bin FROM a_r a)"


def _sized(s, d):
    return _a(s, d).withColumn("log_exporter_capacity", F.round("log_exporter_capacity", 9))


@query(f"WITH {_BINS} SELECT bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM binned GROUP BY bin")
def quantile_bins(s, d):
    return R.quantile_bins(_sized(s, d), "log_exporter_capacity").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query(f"""WITH {_BINS}, c AS (SELECT bin FROM binned GROUP BY bin HAVING sum(y) >= 3 AND count(*) - sum(y) >= 3),
  m AS (SELECT bin, y, rank() OVER (PARTITION BY bin ORDER BY {S9}) + (count(*) OVER (PARTITION BY bin, {S9}) - 1) / 2.0 AS midrank FROM binned SEMI JOIN c USING (bin)),
  v AS (SELECT bin, {_AUC} AS auc, count(*) AS n FROM m GROUP BY bin)
  SELECT round(sum(auc * n) / sum(n), 9) AS auc, count(*) AS valid_bins, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_valid_bins, (SELECT count(DISTINCT bin) FROM binned) AS formed_bins FROM v""")
def within_size_bin_auc(s, d):
    return _rounded(M.within_bin_auc(_sized(s, d), "y", "score", "log_exporter_capacity"))


@query("SELECT i_iso, j_iso, stage, round((size - (SELECT avg(size) FROM a_lanes)) / ((SELECT stddev_pop(size) FROM a_lanes) + 1e-9), 6) AS z FROM a_lanes")
def zscore(s, d):
    return R.zscore(V.track_a(s, d), ["size"]).select(*C.LANE, F.round("z_size", 6).alias("z"))


_RANKED = f"SELECT *, row_number() OVER (ORDER BY {S9} DESC, i_iso, stage, j_iso) AS r FROM a_lanes"


@query(f"SELECT i_iso, j_iso, stage, y FROM ({_RANKED}) WHERE r <= 500")
def topk_global(s, d):
    return R.top_k(_a(s, d), R.canonical("score", "A"), 500).select(*C.LANE, "y")


_PER_I = f"SELECT *, row_number() OVER (PARTITION BY i_iso ORDER BY {S9} DESC, stage, j_iso) AS r FROM a_lanes"


@query(f"SELECT i_iso, j_iso, stage, r AS rank FROM ({_PER_I}) WHERE r <= 5")
def topk_per_exporter(s, d):
    return R.top_k_per_group(_a(s, d), ["i_iso"], [F.col("score").desc(), F.col("stage"), F.col("j_iso")], 5).select(*C.LANE, "rank")


_PER_E = "SELECT *, row_number() OVER (PARTITION BY i_iso, stage ORDER BY round(log_importer_demand, 9) DESC, j_iso) AS r FROM b2_lanes"


@query(f"SELECT i_iso, j_iso, stage, r AS rank FROM ({_PER_E}) WHERE r <= 3")
def topk_per_entry(s, d):
    return R.top_k_per_group(_b2(s, d), C.ENTRY, R.canonical("score", "B2"), 3).select(*C.LANE, "rank")


_BUDGET = """SELECT CAST(k AS BIGINT) AS k, count(*) FILTER (r <= k) AS effective, CAST(coalesce(sum({y}) FILTER (r <= k), 0) AS BIGINT) AS found, round(sum({y}) FILTER (r <= k) / count(*) FILTER (r <= k), 9) AS precision,
  round(sum({y}) FILTER (r <= k) / sum({y}), 9) AS recall, round(sum({v}) FILTER (r <= k) / sum({v}), 9) AS value_captured FROM ({t}) CROSS JOIN (VALUES {ks}) b(k) GROUP BY k"""


_KS = "(50), (100), (250), (500)"


@query(_BUDGET.format(y="y", v="lateval", t=_RANKED, ks=f"{_KS}, (1000)"))
def budget_metrics(s, d):
    return _rounded(M.budget_metrics(_a(s, d), "y", "lateval", R.canonical("score", "A"), [50, 100, 250, 500, 1000]))


_HASHED = "SELECT *, row_number() OVER (ORDER BY sha256(i_iso || stage || j_iso) DESC, i_iso, stage, j_iso) AS r FROM a_lanes"


@query(f"SELECT 'size' AS method, k, precision, value_captured FROM ({_BUDGET.format(y='y', v='lateval', t=_RANKED, ks=_KS)}) UNION ALL SELECT 'hash', k, precision, value_captured FROM ({_BUDGET.format(y='y', v='lateval', t=_HASHED, ks=_KS)}) UNION ALL SELECT 'random', CAST(k AS BIGINT), round(avg(y), 9), round(least(k, count(*)) / count(*), 9) FROM a_raw, (VALUES {_KS}) b(k) GROUP BY k")
def topk_value_table(s, d):
    ks = [50, 100, 250, 500]
    a = _a(s, d).withColumn("hash", F.sha2(F.concat("i_iso", "stage", "j_iso"), 256))
    parts = [M.budget_metrics(a, "y", "lateval", R.canonical(c, "A"), ks).select(F.lit(m).alias("method"), "k", "precision", "value_captured") for m, c in (("size", "score"), ("hash", "hash"))]
    k = s.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in ks])).alias("k"))
    base = a.agg(F.avg("y").alias("precision"), F.count("*").alias("n")).crossJoin(k).select(F.lit("random").alias("method"), "k", "precision", (F.least("k", "n") / F.col("n")).alias("value_captured"))
    return _rounded(parts[0].unionByName(parts[1]).unionByName(base), "method", "k")


def _shares_sql(ranked: str, group: str, ks: str) -> str:
    return f"SELECT k, {group}, count(*) FILTER (r <= k) AS chosen, sum(y) FILTER (r <= k) AS hits, sum(y) AS positives, sum(lateval) FILTER (r <= k) AS captured, sum(lateval) AS available FROM ({ranked}) CROSS JOIN (VALUES {ks}) b(k) GROUP BY ALL"


@query(f"""SELECT CAST(k AS BIGINT) AS k, count(*) AS exporters, count(*) FILTER (positives > 0) AS exporters_with_positive, round(avg(hits / chosen), 9) AS macro_precision, round(avg(CASE WHEN positives > 0 THEN hits / positives END), 9) AS macro_recall,
  round(sum(hits) / sum(positives), 9) AS micro_recall, round(avg(CASE WHEN available > 0 THEN captured / available END), 9) AS macro_value, round(sum(captured) / sum(available), 9) AS micro_value FROM ({_shares_sql(_PER_I, 'i_iso', '(5), (10)')}) GROUP BY k""")
def exporter_shortlist_metrics(s, d):
    return _rounded(M.exporter_shortlists(_a(s, d), "score"))


@query(f"""SELECT CAST(k AS BIGINT) AS k, count(*) AS entries, round(avg(hits / positives), 9) AS macro_recall, round(avg(captured / available), 9) AS macro_value, round(sum(hits) / sum(positives), 9) AS micro_recall, round(sum(captured) / sum(available), 9) AS micro_value
  FROM ({_shares_sql(_PER_E, 'i_iso, stage', '(1), (3), (5)')}) GROUP BY k""")
def conditional_metrics(s, d):
    return _rounded(M.conditional_metrics(_b2(s, d), "score"))


@query(f"""WITH m AS ({_RANKED}), o AS (SELECT *, row_number() OVER (ORDER BY lateval DESC, i_iso, stage, j_iso) AS r FROM a_raw), t AS (SELECT count(*) AS candidates, CAST(sum(y) AS BIGINT) AS positives, sum(lateval) AS total_value FROM a_raw),
  x AS (SELECT t.*, (SELECT count(*) FROM m WHERE r <= 500) AS effective_k, (SELECT CAST(sum(y) AS BIGINT) FROM m WHERE r <= 500) AS model_hits, (SELECT sum(lateval) FROM m WHERE r <= 500) AS model_value, (SELECT CAST(sum(y) AS BIGINT) FROM o WHERE r <= 500) AS oracle_hits, (SELECT sum(lateval) FROM o WHERE r <= 500) AS oracle_value FROM t)
  SELECT candidates, positives, effective_k, model_hits, oracle_hits, round(model_value / total_value, 9) AS model_capture, round(oracle_value / total_value, 9) AS oracle_capture, round((oracle_value - model_value) / total_value, 9) AS gap, round(model_value / oracle_value, 9) AS recovered FROM x""")
def value_oracle_gap(s, d):
    return _rounded(M.value_oracle_gap(_a(s, d), "y", "lateval", "score", "A", 500).drop("total_value", "model_value", "oracle_value", "headroom"))


@query(f"""WITH m AS (SELECT i_iso, sum(lateval) FILTER (r <= 5) AS model, sum(lateval) AS available FROM ({_PER_I}) GROUP BY i_iso), o AS (SELECT i_iso, sum(lateval) FILTER (r <= 5) AS oracle FROM (SELECT *, row_number() OVER (PARTITION BY i_iso ORDER BY lateval DESC, stage, j_iso) AS r FROM a_raw) GROUP BY i_iso)
  SELECT count(*) AS "groups", count(*) FILTER (available > 0) AS groups_with_value, round(avg(CASE WHEN available > 0 THEN model / available END), 9) AS macro_model, round(avg(CASE WHEN available > 0 THEN oracle / available END), 9) AS macro_oracle, round(avg(CASE WHEN available > 0 THEN (oracle - model) / available END), 9) AS macro_gap,
  round(sum(model) / sum(available), 9) AS pooled_model, round(sum(oracle) / sum(available), 9) AS pooled_oracle FROM m JOIN o USING (i_iso)""")
def group_value_oracle_gap(s, d):
    return _rounded(M.group_value_oracle_gap(_a(s, d), ["i_iso"], "y", "lateval", "score", ["stage", "j_iso"], 5))


_ERANK = "SELECT *, row_number() OVER (ORDER BY round(size, 9) DESC, i_iso, stage) AS r FROM entries"


@query(f"""WITH g AS (SELECT i_iso, stage, z FROM ({_ERANK}) WHERE r <= 50), t AS (SELECT x.*, CASE WHEN g.i_iso IS NULL THEN 0 ELSE 1 END AS inside FROM ({_shares_sql(_PER_E, 'i_iso, stage', '(3)')}) x LEFT JOIN g ON g.i_iso = x.i_iso AND g.stage = x.stage)
  SELECT count(*) AS positive_entries, round(avg(inside * hits / positives), 9) AS macro_recall, round(avg(inside * captured / available), 9) AS macro_value, round(sum(inside * hits) / greatest(sum(positives), 1), 9) AS micro_recall, round(sum(inside * captured) / greatest(sum(available), 1), 9) AS value_capture,
  (SELECT count(*) FROM g) AS effective_b1, (SELECT CAST(sum(z) AS BIGINT) FROM g) AS selected_positive, round((SELECT sum(z) / greatest(count(*), 1) FROM g), 9) AS gate_precision, round((SELECT sum(z) FROM g) / greatest(count(*), 1), 9) AS gate_recall FROM t""")
def two_stage_metrics(s, d):
    lanes = V.track_b_once(s, d).withColumn("b2", F.round("log_importer_demand", 9))
    entries = C.entry_view(lanes).withColumn("score", F.round("size", 9))
    return _rounded(M.two_stage(lanes, entries, "b2", 50, 3))


@query("SELECT k, effective, coalesce(precision, 0) AS precision, round(found / greatest(p, 1), 9) AS recall, round(coalesce(value_captured, 0) * v / greatest(v, 1), 9) AS value_captured FROM (" + _BUDGET.format(y="z", v="entry_lateval", t=_ERANK, ks=_KS) + "), (SELECT sum(z) AS p, sum(entry_lateval) AS v FROM entries)")
def entry_budget_metrics(s, d):
    return _rounded(M.entry_budget(_entries(s, d), [50, 100, 250, 500]))


_ECDF = "SELECT *, (rank() OVER (ORDER BY round(size, 9)) + (count(*) OVER (PARTITION BY round(size, 9)) - 1) / 2.0 - 0.5) / count(*) OVER () AS e FROM b_lanes"


@query(f"""SELECT 'raw_max' AS kind, i_iso, stage, round(max(round(size, 9)), 9) AS score FROM b_lanes GROUP BY ALL UNION ALL SELECT 'ecdf_mean', i_iso, stage, round(avg(e), 9) FROM ({_ECDF}) GROUP BY ALL
  UNION ALL SELECT 'ecdf_top_mean', i_iso, stage, round(avg(e), 9) FROM (SELECT *, row_number() OVER (PARTITION BY i_iso, stage ORDER BY e DESC, j_iso) AS r FROM ({_ECDF})) WHERE r <= 3 GROUP BY ALL""")
def b1_pool_scores(s, d):
    lanes = V.track_b(s, d).withColumn("score", F.round("size", 9))
    parts = [M.pool_to_entries(lanes, "score", k).select(F.lit(k).alias("kind"), *C.ENTRY, F.round("score", 9).alias("score")) for k in ("raw_max", "ecdf_mean", "ecdf_top_mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _models_sql() -> str:
    one = lambda m, c: f"SELECT '{m}' AS model, chain, CASE WHEN sum(p) > 0 THEN sum(p * c_p / c_n) / sum(p) END AS ap FROM (SELECT chain, p, n, sum(p) OVER w AS c_p, sum(n) OVER w AS c_n FROM (SELECT chain, {c} AS score, sum(y) AS p, count(*) AS n FROM a_lanes JOIN stages USING (stage) GROUP BY ALL) WINDOW w AS (PARTITION BY chain ORDER BY score DESC)) GROUP BY chain"
    return " UNION ALL ".join((one("size", S9), one("capacity", "round(log_exporter_capacity, 9)"), one("demand", "round(log_importer_demand, 9)")))


def _models(s, d):
    a = _a(s, d)
    cols = {"size": "score", "capacity": "log_exporter_capacity", "demand": "log_importer_demand"}
    long = a.select("chain", "y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(c, 9).alias("score")) for m, c in cols.items()])).alias("x")).select("chain", "y", "x.*")
    return M.average_precision(long, "y", "score", ["model", "chain"]).withColumnRenamed("average_precision", "ap")


@query(f"""WITH m AS ({_models_sql()}), dd AS (SELECT a.model AS left_model, b.model AS right_model, round(a.ap, 9) - round(b.ap, 9) AS d FROM m a JOIN m b ON a.chain = b.chain AND a.model < b.model WHERE a.ap IS NOT NULL AND b.ap IS NOT NULL)
  SELECT left_model, right_model, count(*) AS n, round(avg(d), 8) AS mean_delta, round(quantile_cont(d, 0.5), 8) AS median_delta, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses FROM dd GROUP BY ALL""")
def pairwise_deltas(s, d):
    return _rounded(M.pairwise_deltas(_models(s, d).withColumn("ap", F.round("ap", 9)), "chain", "model", "ap"), digits=8)


@query(f"SELECT model, round(avg(ap), 9) AS mean, round(stddev_pop(ap), 9) AS sd, count(ap) AS n FROM ({_models_sql()}) GROUP BY model")
def chain_macro_mean(s, d):
    return _rounded(M.macro_mean(_models(s, d), ["model"], "ap"), "model")


@query(f"WITH m AS ({_models_sql()}) SELECT count(*) AS pairs, round(avg(a.ap), 9) AS in_domain, round(avg(b.ap), 9) AS held_out, round(avg(a.ap - b.ap), 9) AS gap FROM m a JOIN m b USING (chain) WHERE a.model = 'size' AND b.model = 'demand'")
def matched_gap(s, d):
    m = _models(s, d)
    return _rounded(M.matched_gap(m.where("model = 'size'"), m.where("model = 'demand'"), ["chain"], "ap"))


@query(f"WITH m AS ({_models_sql()}) SELECT a.model, count(*) FILTER (round(a.ap, 9) > round(b.ap, 9)) AS higher, count(*) FILTER (round(a.ap, 9) = round(b.ap, 9)) AS equal, count(*) FILTER (round(a.ap, 9) < round(b.ap, 9)) AS lower FROM m a JOIN m b USING (chain) WHERE b.model = 'size' AND a.model <> 'size' GROUP BY a.model")
def reference_relation_counts(s, d):
    m = _models(s, d).withColumn("ap", F.round("ap", 9))
    return M.relation_counts(m.where("model <> 'size'"), m.where("model = 'size'"), ["chain"], "model", "ap")


@query("SELECT count(*) AS n, round(max(abs(size - round(size, 3))), 4) AS max_delta, true AS all_close FROM a_lanes")
def score_repeatability(s, d):
    a = _a(s, d)
    b = a.withColumn("size", F.round("size", 3))
    return M.repeatability(a, b, C.LANE, "size", atol=1e-3).select("n", F.round("max_delta", 4).alias("max_delta"), "all_close")


@query("SELECT (SELECT count(*) FROM a_raw ANTI JOIN h_a_raw USING (i_iso, j_iso, stage)) AS missing, (SELECT count(*) FROM h_a_raw ANTI JOIN a_raw USING (i_iso, j_iso, stage)) AS extra, (SELECT count(*) FROM h_a_raw WHERE j_iso = 'N05') AS duplicate, (SELECT count(*) FROM h_a_raw WHERE j_iso = 'N06') AS non_finite")
def align_scores(s, d):
    scores = stored(V.track_a(s, d, "history").select(*C.LANE, F.when(F.col("j_iso") == "N06", float("nan")).otherwise(F.col("size")).alias("score")), "scores")
    return M.align_scores(V.track_a(s, d), scores.unionByName(scores.where("j_iso = 'N05'")), C.LANE)


@query("SELECT track, count(*) AS n, CAST(count(*) - count(size) AS BIGINT) AS gaps, round(sum(size), 5) AS total FROM (SELECT 'A' AS track, size FROM a_lanes UNION ALL SELECT 'B', size FROM b_lanes) GROUP BY track")
def align_union_scores(s, d):
    a, b = V.track_a(s, d), V.track_b(s, d)
    scores = a.select(*C.LANE, "size").unionByName(b.select(*C.LANE, "size"))
    parts = [t.select(*C.LANE).join(scores, C.LANE, "left").agg(F.count("*").alias("n"), F.count_if(F.col("size").isNull()).alias("gaps"), F.round(F.sum("size"), 5).alias("total")).select(F.lit(n).alias("track"), "n", "gaps", "total") for n, t in (("A", a), ("B", b))]
    return parts[0].unionByName(parts[1])


_MULT = """SELECT draw, i_iso, count(*) AS m FROM (SELECT draw, ('0x' || substr(md5('7|' || draw || '|' || slot), 1, 15))::BIGINT % (SELECT count(DISTINCT i_iso) FROM {t}) + 1 AS number FROM range({n}) a(draw), range((SELECT count(DISTINCT i_iso) FROM {t})) b(slot))
  JOIN (SELECT i_iso, row_number() OVER (ORDER BY i_iso) AS number FROM (SELECT DISTINCT i_iso FROM {t})) USING (number) GROUP BY ALL"""


@query(_MULT.format(t="a_raw", n=500))
def cluster_multiplicities(s, d):
    return B.multiplicities(V.track_a(s, d), "i_iso", 500, 7)


def _ap_draws_sql(score: str) -> str:
    return f"""SELECT draw, CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN sum(p * c_p / c_n) / sum(p) END AS ap FROM (SELECT draw, p, n, sum(p) OVER w AS c_p, sum(n) OVER w AS c_n FROM (SELECT draw, {score} AS score, sum(y * m) AS p, sum(m) AS n FROM a_lanes JOIN mult USING (i_iso) GROUP BY ALL)
      WINDOW w AS (PARTITION BY draw ORDER BY score DESC)) GROUP BY draw"""


def _ci(c: str, col: str) -> str:
    return f"count({col}) AS {c}_draws, round(CASE WHEN count({col}) >= 250 THEN quantile_cont({col}, 0.025) END, 8) AS {c}_low, round(CASE WHEN count({col}) >= 250 THEN quantile_cont({col}, 0.975) END, 8) AS {c}_high"


@query(f"WITH mult AS ({_MULT.format(t='a_raw', n=500)}) SELECT {_ci('average_precision', 'ap')} FROM ({_ap_draws_sql(S9)})")
def bootstrap_ap_ci(s, d):
    return _rounded(B.ap_interval(_a(s, d), "y", "score", "i_iso", 500, 7), digits=8)


@query(f"WITH mult AS ({_MULT.format(t='a_raw', n=500)}) SELECT {_ci('delta', 'd')} FROM (SELECT a.ap - b.ap AS d FROM ({_ap_draws_sql(S9)}) a JOIN ({_ap_draws_sql('round(log_importer_demand, 9)')}) b USING (draw))")
def paired_bootstrap_delta(s, d):
    return _rounded(B.paired_delta(_a(s, d).withColumn("other", F.round("log_importer_demand", 9)), "y", "score", "other", "i_iso", 500, 7), digits=8)


@query(f"""WITH mult AS ({_MULT.format(t='b2_lanes', n=500)}), g AS ({_shares_sql(_PER_E, 'i_iso, stage', '(3)')}), x AS (SELECT draw, sum(hits / positives * m) / sum(m) AS recall, sum(captured / available * m) / sum(m) AS value FROM g JOIN mult USING (i_iso) GROUP BY draw)
  SELECT {_ci('recall', 'recall')}, {_ci('value', 'value')} FROM x""")
def bootstrap_group_ci(s, d):
    g = M.group_shares(_b2(s, d), C.ENTRY, "y", "lateval", R.canonical("score", "B2"), [3]).withColumns({"recall": F.col("hits") / F.col("positives"), "value": F.try_divide("captured", "available")})
    return _rounded(B.group_interval(g, "i_iso", ["recall", "value"], 500, 7), digits=8)


def _taken(order: str) -> str:
    return f"SELECT draw, sum(least(m, greatest(0, 200 - (upto - m))) * lateval) AS v FROM (SELECT draw, m, lateval, sum(m) OVER (PARTITION BY draw ORDER BY {order} DESC, i_iso, stage, j_iso) AS upto FROM a_lanes JOIN mult USING (i_iso)) GROUP BY draw"


@query(f"""WITH mult AS ({_MULT.format(t='a_raw', n=500)}), x AS (SELECT a.v / nullif(t.v, 0) AS capture, b.v / nullif(t.v, 0) AS oracle, (b.v - a.v) / nullif(t.v, 0) AS gap FROM ({_taken(S9)}) a JOIN ({_taken('lateval')}) b USING (draw) JOIN (SELECT draw, sum(lateval * m) AS v FROM a_lanes JOIN mult USING (i_iso) GROUP BY draw) t USING (draw))
  SELECT {_ci('capture', 'capture')}, {_ci('oracle', 'oracle')}, {_ci('gap', 'gap')} FROM x""")
def bootstrap_value_ci(s, d):
    x = B.value_interval(_a(s, d), R.canonical("score", "A"), R.canonical("lateval", "A"), ("score", "lateval"), "lateval", "i_iso", 200, 500, 7)
    return _rounded(x.drop(*[c for c in x.columns if c.startswith("headroom")]), digits=8)


@query(f"WITH mult AS ({_MULT.format(t='a_raw', n=500)}) SELECT draw, round(sum(least(m, greatest(0, 200 - (upto - m))) * lateval), 5) AS value, CAST(sum(least(m, greatest(0, 200 - (upto - m)))) AS BIGINT) AS units FROM (SELECT draw, m, lateval, sum(m) OVER (PARTITION BY draw ORDER BY {S9} DESC, i_iso, stage, j_iso) AS upto FROM a_lanes JOIN mult USING (i_iso)) GROUP BY draw")
def topk_multiplicity(s, d):
    return B.top_k_draws(_a(s, d), R.canonical("score", "A"), "score", "lateval", "i_iso", 200, 500, 7).withColumn("value", F.round("value", 5))


@query("SELECT DISTINCT stage, CAST(('0x' || substr(sha256('7|' || stage), 1, 15))::BIGINT % 2147483647 AS BIGINT) AS seed FROM a_raw")
def stable_seed(s, d):
    return V.track_a(s, d).select("stage").distinct().withColumn("seed", B.stable_seed(F.lit("7"), F.col("stage")))


_SEEDS = " UNION ALL ".join(f"SELECT {k} AS seed, chain, avg(y) AS rate FROM a_raw JOIN stages USING (stage) WHERE ('0x' || substr(md5('{k}|' || i_iso || j_iso || stage), 1, 8))::BIGINT % 2 = 0 GROUP BY chain" for k in range(3))


@query(f"SELECT chain, round(avg(rate), 9) AS mean, round(stddev_pop(rate), 9) AS sd, count(rate) AS n FROM ({_SEEDS}) GROUP BY chain")
def seed_mean_std(s, d):
    a = _a(s, d).select("chain", "y", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("seed"), F.concat("i_iso", "j_iso", "stage").alias("key"))
    a = a.where(F.conv(F.substring(F.md5(F.concat_ws("|", "seed", "key")), 1, 8), 16, 10).cast("long") % 2 == 0)
    return _rounded(M.macro_mean(a.groupBy("seed", "chain").agg(F.avg("y").alias("rate")), ["chain"], "rate"), "chain")


@query("SELECT slice, round(avg(rate), 9) AS mean, count(rate) AS n FROM (SELECT chain, 'seen' AS slice, avg(y) AS rate FROM a_raw JOIN stages USING (stage) WHERE i_iso IN (SELECT i_iso FROM h_a_raw) GROUP BY chain UNION ALL SELECT chain, 'all', avg(y) FROM a_raw JOIN stages USING (stage) GROUP BY chain) GROUP BY slice")
def slice_macro_mean(s, d):
    a = _a(s, d)
    seen = a.join(V.track_a(s, d, "history").select("i_iso").distinct(), "i_iso", "left_semi")
    both = a.withColumn("slice", F.lit("all")).unionByName(seen.select(*a.columns).withColumn("slice", F.lit("seen")))
    return _rounded(M.macro_mean(both.groupBy("slice", "chain").agg(F.avg("y").alias("rate")), ["slice"], "rate").drop("sd"), "slice")


@query("SELECT round((SELECT sum(lateval) FROM a_raw), 5) AS a_value, round((SELECT sum(entry_lateval) FROM entries), 5) AS b1_value, round((SELECT sum(lateval) FROM b2_lanes), 5) AS b2_nested, round((SELECT sum(lateval) FROM a_raw) + (SELECT sum(entry_lateval) FROM entries), 5) AS unique_total, true AS nested_equal")
def value_accounting(s, d):
    b = V.track_b(s, d)
    a1 = V.track_a(s, d).agg(F.sum("lateval").alias("a"))
    b1 = C.entry_view(b).agg(F.sum("entry_lateval").alias("b1"))
    b2 = C.conditional_lanes(b).agg(F.sum("lateval").alias("b2"))
    x = a1.crossJoin(b1).crossJoin(b2)
    return x.select(F.round("a", 5).alias("a_value"), F.round("b1", 5).alias("b1_value"), F.round("b2", 5).alias("b2_nested"), F.round(F.col("a") + F.col("b1"), 5).alias("unique_total"), (F.abs(F.col("b1") - F.col("b2")) < 1e-4).alias("nested_equal"))
