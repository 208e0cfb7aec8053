"""Queries of feature and model operators: fitted on the historical fold, scored on the main one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import boosting as BO
from ..operators import cohorts as C
from ..operators import metrics as M
from ..operators import models as L
from ..operators import panel as P
from ..operators import rank as R
from . import views as V
from .registry import query

FEATURES = ["log_exporter_capacity", "log_importer_demand", "log_grav"]
_G = "LEFT JOIN (SELECT i_iso, j_iso, ln(1 + 100.0 / dist) AS log_grav FROM covariates WHERE dist > 1) c ON c.i_iso = x.i_iso AND c.j_iso = x.j_iso"


def _with_gravity(s, d, lanes):
    g = V.covariates(s, d).where("dist > 1").select("i_iso", "j_iso", F.log1p(F.lit(100.0) / F.col("dist")).alias("log_grav"))
    return lanes.join(g, ["i_iso", "j_iso"], "left")


def _a(s, d, fold):
    return stored(_with_gravity(s, d, V.track_a(s, d, fold)), "lanes")


@query(f"SELECT x.i_iso, x.stage, x.j_iso, round(size, 6) AS size, round(log_grav, 6) AS log_grav FROM a_lanes x {_G}")
def track_a_features(s, d):
    return _with_gravity(s, d, V.track_a(s, d)).select("i_iso", "stage", "j_iso", F.round("size", 6).alias("size"), F.round("log_grav", 6).alias("log_grav"))


@query(f"SELECT x.i_iso, x.stage, x.j_iso, round(log_importer_demand, 6) AS log_importer_demand, round(log_grav, 6) AS log_grav FROM b2_lanes x {_G}")
def track_b2_features(s, d):
    return _with_gravity(s, d, C.conditional_lanes(V.track_b(s, d))).select("i_iso", "stage", "j_iso", F.round("log_importer_demand", 6).alias("log_importer_demand"), F.round("log_grav", 6).alias("log_grav"))


@query(f"SELECT x.i_iso, x.stage, x.j_iso, round(coalesce(log_grav, (SELECT quantile_cont(log_grav, 0.5) FROM h_a_lanes x {_G})), 6) AS score FROM a_lanes x {_G}")
def raw_score_freeze(s, d):
    frozen = L.freeze_medians(_with_gravity(s, d, V.track_a(s, d, "history")), ["log_grav"])
    return L.raw_scores(frozen, _with_gravity(s, d, V.track_a(s, d)), "log_grav").select("i_iso", "stage", "j_iso", F.round("score", 6).alias("score"))


@query()
def gravity_ppml(s, d):
    f = V.flows(s, d).where("year in (1997, 1998)")
    pairs = V.covariates(s, d).where("dist > 1").withColumn("log_dist", F.log("dist"))
    sums = P.window_calendar_mean(f, [1997, 1998], C.LANE)
    stages = V.registry(s).select(F.explode(F.map_keys("stages")).alias("stage"))
    dyads = pairs.crossJoin(F.broadcast(stages)).join(sums, C.LANE, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    dyads = stored(dyads, "dyads")  # each step of the fit passes over them
    return L.gravity_ppml(dyads, ["log_dist"], ["contig", "comlang"]).select(*C.LANE, "v", "grav")


_HG = f"(SELECT x.*, log_grav FROM h_a_lanes x {_G})"
_FILL = ", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {_HG})), 6) AS {c}__filled" for c in FEATURES)


@query(f"SELECT x.i_iso, x.j_iso, x.stage, {_FILL}, CASE WHEN log_grav IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS log_grav__missing FROM a_lanes x {_G}")
def impute_with_indicator(s, d):
    frozen = L.freeze_medians(_a(s, d, "history"), FEATURES)
    return frozen.prepare(_a(s, d, "main")).select(*C.LANE, *[F.round(c, 6).alias(c) for c in frozen.inputs])


@query("""SELECT CAST(f AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, count(*) AS entries, 5 AS folds FROM (
  SELECT *, (row_number() OVER (ORDER BY p DESC, n DESC, sha256('fold|' || entry_id), entry_id) - 1) % 5 AS f FROM (SELECT i_iso || '|' || stage AS entry_id, sum(y) AS p, count(*) AS n FROM h_a_raw GROUP BY ALL)) GROUP BY f""")
def group_kfold(s, d):
    rows, k = L.group_folds(V.track_a(s, d, "history").withColumn("entry_id", C.entry_id()), "entry_id", "y")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.count_distinct("entry_id").alias("entries")).withColumn("folds", F.lit(k))


def _scored(s, d, select):
    folds = V.folds(s, d)
    lanes = lambda fold: stored(_with_gravity(s, d, C.track_a(*folds[fold])), "lanes")
    history = lanes("history").withColumn("entry_id", C.entry_id())
    frozen = select(history, FEATURES, "y", "entry_id")  # the main fold's lanes have not been made yet
    return frozen, frozen.score(lanes("main"))


@query()
def logistic_select(s, d):
    _, x = _scored(s, d, L.logistic_select)
    return x.select(*C.LANE, "y", "score")


@query()
def gbdt_select(s, d):
    _, x = _scored(s, d, BO.gbdt_select)
    return x.select(*C.LANE, "y", "score")


@query()
def freeze_then_score(s, d):
    """Average precision on the main fold of what was frozen on history, beside the raw size, of tracks A, B1 and B2.

    One pass over the flows sums the windows of both folds. All three models are frozen before the main fold's lanes are made;
    all B lanes are scored before B2 is conditioned on entry.
    """
    folds = V.folds(s, d)
    a = lambda fold: stored(_with_gravity(s, d, C.track_a(*folds[fold])), "lanes")
    b = lambda fold: stored(_with_gravity(s, d, C.track_b(*folds[fold])), "lanes")
    entry = lambda lanes: C.entry_view(lanes).withColumn("y", F.col("z"))
    past = {"A": a("history"), "B": b("history")}
    tasks = {
        "A": L.logistic_select(past["A"].withColumn("entry_id", C.entry_id()), FEATURES, "y", "entry_id"),
        "B1": L.logistic_select(entry(past["B"]), ["log_upstream_capacity", "n_candidate_destinations"], "y", "i_iso"),
        "B2": L.logistic_select(C.conditional_lanes(past["B"]).withColumn("entry_id", C.entry_id()), FEATURES, "y", "entry_id"),
    }
    lanes = b("main")
    scored = {"A": tasks["A"].score(a("main")), "B1": tasks["B1"].score(entry(lanes)), "B2": C.conditional_lanes(tasks["B2"].score(lanes))}
    each = lambda m, c: F.struct(F.lit(m).alias("model"), F.col(c).alias("score"))
    long = [x.select(F.lit(t).alias("track"), "y", F.explode(F.array(each("logistic", "score"), each("size", "size"))).alias("m")).select("track", "y", "m.*") for t, x in scored.items()]
    return M.average_precision(reduce(DataFrame.unionByName, long), "y", "score", ["track", "model"])


@query()
def signal_recombination(s, d):
    """A logistic over z-scored signals, fitted on one half by hash and scored on the other."""
    rows = R.zscore(_a(s, d, "main"), ["log_exporter_capacity", "log_importer_demand"])
    rows = stored(rows.withColumn("half", F.when(C.split_uniform(F.concat_ws("|", *C.LANE), "half") < 0.5, 0).otherwise(1)), "halves")
    frozen = L.freeze_medians(rows.where("half = 0"), ["z_log_exporter_capacity", "z_log_importer_demand"])
    return L.fit_logistic(frozen, rows.where("half = 0"), "y", 1.0).score(rows.where("half = 1")).select(*C.LANE, "y", "score")


@query()
def latent_factor_score(s, d):
    early = V.fold(s, d)[0].select(*C.LANE)
    return L.latent_factors(stored(early, "lanes"), stored(V.track_a(s, d).select(*C.LANE), "pairs"))
