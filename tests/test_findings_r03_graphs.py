"""Graph queries over one pass of the flows, and densities summed by stage in the tasks."""

import pytest

import __spark_entry__ as entry
from tessera.operators import graph as G
from tessera.operators import product_space as PS
from tessera.plans import views as V

from . import test_oracles as O


@pytest.mark.parametrize("name", ["graph_coverage", "stage_density_score"])
def test_flows_are_joined_once_and_match_sql(spark, duck, monkeypatch, name):
    seen, own = [], V.flows
    monkeypatch.setattr(V, "flows", lambda s, d, view="S": (seen.append(view), own(s, d, view))[1])
    O.test_matches_sql(spark, duck, name)
    assert seen == ["S"]


def test_sums_by_stage_equal_those_of_densities(spark):
    rows = [(f"e{e}", f"p{p:03d}") for e in range(40) for p in range(300) if (e * 7 + p * 5) % 11 < 3]
    members = spark.createDataFrame(rows, "i_iso string, p string").localCheckpoint()
    products = spark.createDataFrame([(f"s{p % 4}", f"p{p:03d}") for p in range(0, 300, 2)], "stage string, p string")
    prox = PS.proximity(members, products).localCheckpoint()
    entries = members.select("i_iso").distinct().crossJoin(products.select("stage").distinct())
    of = lambda x: {(r.i_iso, r.stage): r.score for r in x.collect()}
    want = of(G.stage_density(entries, PS.density(members, prox), products))
    assert of(G.stage_mean(entries, PS.density_sums(members, prox, products), products)) == pytest.approx(want, rel=1e-12) and max(want.values()) > 0
