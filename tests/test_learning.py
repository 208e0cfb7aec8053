"""Fitted queries over the whole registry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import models as L
from tessera.operators import rank as R

from .conftest import SMALL


def test_gravity_fits_every_stage(spark):
    rows = entry.queries()["gravity_ppml"](spark, SMALL).groupBy("stage").agg(F.sum("v").alias("v"), F.count("grav").alias("fitted"), F.count("*").alias("n")).collect()
    assert {r.stage for r in rows} == {f"Brand#{k}" for k in range(1, 26)}
    assert all(r.fitted == (r.n if r.v > 0 else 0) for r in rows)


@pytest.fixture(scope="module")
def lanes(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        a, b = rng.gauss(2, 3), rng.gauss(0, 1)
        rows.append((f"g{k % 37}", a, b if k % 5 else None, int(rng.random() < 1 / (1 + np.exp(2 - a)))))
    return spark.createDataFrame(rows, "g string, a double, b double, y int").repartition(3)


def plain_fit(rows, c):
    """Balanced logistic regression with a penalised intercept, by gradient descent's zero: Newton in numpy."""
    x, y = np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows], float)
    x = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x.T * (w * mu * (1 - mu))) @ x + np.eye(len(beta)) / c, x.T @ (w * (mu - y)) + beta / c)
    return beta


def test_logistic_is_exact(lanes):
    frozen = L.logistic_select(lanes, ["a", "b"], "y", "g")
    median = np.median([r.b for r in lanes.collect() if r.b is not None])
    assert frozen.medians["b"] == pytest.approx(median) and frozen.flagged == ["b"]
    rows = [(r.a, median if r.b is None else r.b, float(r.b is None), r.y) for r in lanes.collect()]
    assert frozen.logistic.beta == pytest.approx(plain_fit(rows, frozen.choice["C"]), abs=1e-6)
    assert frozen.choice["folds"] == 5
    scores = [r.score for r in frozen.score(lanes).collect()]
    assert len(scores) == 400 and all(0 < s < 1 for s in scores)


def test_folds_hold_whole_groups(lanes):
    rows, k = L.group_folds(lanes, "g", "y")
    assert k == 5 and rows.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    positives = [r.p for r in rows.groupBy("fold").agg(F.sum("y").alias("p")).collect()]
    assert max(positives) - min(positives) <= 8
    with pytest.raises(ValueError):
        L.group_folds(lanes.withColumn("y", F.lit(0)), "g", "y")


def test_exact_quantiles(lanes):
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    assert R.exact_quantiles(lanes, "a", shares) == pytest.approx(np.quantile([r.a for r in lanes.collect()], shares))
    assert R.exact_quantiles(lanes.where("false"), "a", [0.5]) == [None]


def test_gravity_coefficients(spark):
    """Against Newton's method in numpy, group by group; a group without flows has no fit."""
    rng = np.random.default_rng(5)
    rows = [(f"g{k % 3}", float(rng.normal(8, 2)), int(rng.random() < 0.4), float(rng.poisson(np.exp(1 - 0.3 * (k % 3)))) * 1e6 * (k % 3 < 2)) for k in range(900)]
    df = spark.createDataFrame(rows, "stage string, log_dist double, contig int, v double").repartition(3)
    got = L.gravity_ppml(df, ["log_dist"], ["contig"]).collect()
    assert len(got) == 900 and all((r.grav is None) == (r.stage == "g2") for r in got)
    a = np.array([r[1] for r in rows])
    for g in ("g0", "g1"):
        own = [k for k, r in enumerate(rows) if r[0] == g]
        x = np.column_stack([(a[own] - a.mean()) / (a.std() + 1e-9), [rows[k][2] for k in own], np.ones(len(own))])
        y, beta, reg = np.array([rows[k][3] / 1e6 for k in own]), np.zeros(3), np.diag([1e-4, 1e-4, 0])
        for _ in range(60):
            mu = np.exp(x @ beta)
            beta = beta - np.linalg.solve((x.T * mu) @ x / len(y) + reg, x.T @ (mu - y) / len(y) + reg @ beta)
        want = {(r[1], r[2]): np.exp(v @ beta) for r, v in zip((rows[k] for k in own), x, strict=True)}
        assert all(r.grav == pytest.approx(want[(r.log_dist, r.contig)], rel=1e-6) for r in got if r.stage == g)


def plain_boost(x, y, leaves, rounds, least=20, rate=0.05, penalty=1.0):
    """Row by row, all splits of all leaves tried anew each time."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    z = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-z))
        g, h = w * (mu - y), w * mu * (1 - mu)
        value = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)  # noqa: E731, B023
        own = [np.arange(len(y))]
        while len(own) < leaves:
            found = [
                (value(r[x[r, f] <= c]) + value(r[x[r, f] > c]) - value(r), -k, -f, -c) for k, r in enumerate(own) for f in range(x.shape[1]) for c in np.unique(x[r, f])[:-1]
                if (x[r, f] <= c).sum() >= least and (x[r, f] > c).sum() >= least
            ]
            if not found or max(found)[0] <= 1e-12:
                break
            _, k, f, c = max(found)
            r = own.pop(-k)
            own += [r[x[r, -f] <= -c], r[x[r, -f] > -c]]
        for r in own:
            z[r] -= rate * g[r].sum() / (h[r].sum() + penalty)
    return z


def test_boosting_against_plain():
    from tessera.operators import boosting as B

    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(3 - 0.5 * x[:, 0] + 0.3 * np.abs(x[:, 1] - 6)))).astype(float)
    cells, where = np.unique(np.column_stack([x, y]).astype(np.int64), axis=0, return_inverse=True)
    for leaves, rounds in ((3, 8), (7, 5), (15, 3)):
        trees = B.boost(cells[:, :3], cells[:, 3].astype(float), np.bincount(where.ravel()).astype(float), leaves, rounds)
        assert trees.margin(x) == pytest.approx(plain_boost(x, y, leaves, rounds), abs=1e-9)
        assert all((t["input"] < 0).sum() <= leaves for t in trees.trees) and len(trees.trees) == rounds


def test_boosting_selects_and_scores(lanes):
    from tessera.operators import boosting as B

    frozen = B.gbdt_select(lanes, ["a", "b"], "y", "g", grid=[{"leaves": 3, "rounds": 20}, {"leaves": 7, "rounds": 20}])
    assert frozen.choice["folds"] == 5 and 0.3 < frozen.choice["cv_average_precision"] <= 1
    rows = frozen.score(lanes).collect()
    x = np.column_stack([[r.a for r in rows], [frozen.medians["b"] if r.b is None else r.b for r in rows], [float(r.b is None) for r in rows]])
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(frozen.edges)], 1)
    want = 1 / (1 + np.exp(-plain_boost(bins, np.array([float(r.y) for r in rows]), frozen.choice["leaves"], 20)))
    assert [r.score for r in rows] == pytest.approx(want, abs=1e-9)
    coarse = B.gbdt_select(lanes, ["a", "b"], "y", "g", grid=[{"leaves": 3, "rounds": 5}], most_cells=60)
    assert coarse.choice["bins"] < 255


def test_logistic_halves_steps_and_reports(spark):
    """Nearly separable rows with hardly a penalty, where whole Newton steps are wild; too few steps are an error."""
    rows = [(float(x), 0, float(y)) for x, y in [(-9, 0), (-8, 0), (-7, 0), (9, 1), (8, 1), (7, 1), (60, 0)] for _ in range(4)]
    df = spark.createDataFrame(rows, "a double, fold int, __y double")
    model = L.Logistic.over(0, -1, 1e-4, L._standard(df, ["a"], ["fold"]), ["a"])
    L.fit_logistics(df, [model], ["a"])
    x = np.array([[(r[0] - model.mean[0]) / model.sd[0], 1.0] for r in rows])
    y = np.array([r[2] for r in rows])
    w = np.where(y == 1, model.weights[1], model.weights[0])
    beta = np.array(model.beta)
    assert np.abs((x.T * w) @ (1 / (1 + np.exp(-x @ beta)) - y) + 1e-4 * beta).max() < 1e-6
    with pytest.raises(ValueError, match="no convergence"):
        L.fit_logistics(df, [L.Logistic.over(0, -1, 1e-4, L._standard(df, ["a"], ["fold"]), ["a"])], ["a"], steps=2)


def _ap(y, score):
    """Tie-block average precision in plain Python."""
    found, seen, total = 0, 0, 0.0
    for s in sorted(set(score), reverse=True):
        own = [b for a, b in zip(score, y, strict=True) if a == s]
        found, seen = found + sum(own), seen + len(own)
        total += sum(own) * found / seen
    return total / sum(y)


def test_frozen_models_over_tracks(spark):
    """Queries of frozen models: raw sizes agree with plain Python, and a model knows only history."""
    from tessera.plans import views as V

    got = {(r.track, r.model): r.average_precision for r in entry.queries()["freeze_then_score"](spark, SMALL).collect()}
    assert set(got) == {(t, m) for t in ("A", "B1", "B2") for m in ("logistic", "size")} and all(0 < v <= 1 for v in got.values())
    main = V.track_a(spark, SMALL).select("y", "size").collect()
    assert got["A", "size"] == pytest.approx(_ap([r.y for r in main], [r["size"] for r in main]), abs=1e-9)


def test_recombined_signals(spark):
    """The half that is scored is not the half that is learned from; scores are those of a plain fit on the other half."""
    from tessera.operators import cohorts as C
    from tessera.plans import views as V

    names = ["log_exporter_capacity", "log_importer_demand"]
    half = C.split_uniform(F.concat_ws("|", *C.LANE), "half")
    rows = V.track_a(spark, SMALL).select(*C.LANE, *names, "y", (half >= 0.5).alias("late")).collect()
    x = np.array([[r[c] for c in names] for r in rows])
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    late = np.array([r.late for r in rows])
    y = np.array([r.y for r in rows])
    beta = plain_fit([(*v, t) for v, t in zip(z[~late].tolist(), y[~late].tolist(), strict=True)], 1.0)
    own = np.column_stack([(z[late] - z[~late].mean(axis=0)) / z[~late].std(axis=0), np.ones(late.sum())])
    want = dict(zip([tuple(r[c] for c in C.LANE) for r in rows if r.late], 1 / (1 + np.exp(-own @ beta)), strict=True))
    got = {tuple(r[c] for c in C.LANE): r.score for r in entry.queries()["signal_recombination"](spark, SMALL).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_latent_factors_follow_blocks(spark):
    """Two blocks of exporters with items of their own: an untraded pair inside a block beats one across; each pair has a row."""
    lanes = [(f"e{k % 2}{k // 2 % 4}", "s", f"j{k % 2}{k // 8}") for k in range(48) if k not in (0, 1)]
    pairs = [("e00", "s", "j00"), ("e00", "s", "j10"), ("e10", "s", "j10"), ("e10", "s", "j00"), ("new", "s", "j00")]
    kinds = "i_iso string, stage string, j_iso string"
    got = {(r.i_iso, r.j_iso): r.score for r in L.latent_factors(spark.createDataFrame(lanes, kinds), spark.createDataFrame(pairs, kinds), rank=4).collect()}
    assert len(got) == 5 and got["e00", "j00"] > got["e00", "j10"] + 0.2 and got["e10", "j10"] > got["e10", "j00"] + 0.2 and abs(got["new", "j00"]) < 0.2
