"""Cases of the third round's findings on growth: passes over the flows, rows that meet models, and the rewritten sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.plans import views as V

from .conftest import SMALL


@pytest.fixture
def passes(monkeypatch):
    """The views of the flows that were asked for, each of which is a pass over the line items."""
    seen, own = [], V.flows
    monkeypatch.setattr(V, "flows", lambda s, d, view="S": (seen.append(view), own(s, d, view))[1])
    return seen


@pytest.mark.parametrize("name", ["freeze_then_score", "logistic_select"])
def test_both_folds_come_from_one_pass(spark, passes, name):
    entry.queries()[name](spark, SMALL)
    assert passes == ["S"]


def test_a_step_of_all_models_joins_no_rows(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), F.sin("id").alias("b"), (F.sin("id") + F.cos(F.col("id") * 3) > 0.3).cast("double").alias("__y"), (F.col("id") % 3).cast("int").alias("fold"))
    rows = rows.localCheckpoint()
    stats = L._standard(rows, ["a", "b"], ["fold"])
    models = [L.Logistic.over(f, f, 0.7, [r for r in stats if r["fold"] != f], ["a", "b"]) for f in range(3)]
    monkeypatch.setattr(type(rows), "join", lambda *a, **k: pytest.fail("rows met models in a join"))
    L.fit_logistics(rows, models, ["a", "b"])
    held = L.held_out_scores(rows, models, ["a", "b"]).collect()
    assert len(held) == 300
    x = np.array([(r.a, r.b, 1.0) for r in rows.collect()])
    y, fold = (np.array([r[c] for r in rows.collect()]) for c in ("__y", "fold"))
    for m in models:  # the gradient of the penalised loss is zero at the fit
        z = (x - [*m.mean, 0]) / [*m.sd, 1]
        own = fold != m.fold
        e = np.where(y == 1, m.weights[1], m.weights[0]) * (1 / (1 + np.exp(-z @ m.beta)) - y)
        assert np.abs(z[own].T @ e[own] + m.reg * np.array(m.beta)).max() < 1e-6
        want = sorted(z[~own] @ m.beta)
        assert sorted(r.score for r in held if r.name == m.name) == pytest.approx(want)


def test_precision_of_pieces_equals_that_of_running_sums(spark):
    g = F.when(F.col("id") % 5 == 4, F.lit(None)).otherwise((F.col("id") % 5).cast("string"))
    s = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, float("nan")).when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 19 == 0, -0.0).otherwise(F.round(F.sin("id"), 2))
    df = spark.range(3000).select(g.alias("g"), s.alias("s"), ((F.col("id") % 7 == 0) & (F.col("id") % 5 != 2)).cast("int").alias("y"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for group in (["g"], []):
            plain = M.weighted_average_precision(df.withColumn("w", F.lit(1.0)), "y", "s", "w", group, null_if_one_class=False)
            own = M.average_precision(df, "y", "s", group)
            of = lambda x: {tuple(r)[:-1]: -1.0 if r[-1] is None else r[-1] for r in x.collect()}
            assert of(own) == pytest.approx(of(plain), rel=1e-12) and len(of(own)) == (5 if group else 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
