"""Metrics against a plain Python version, ties included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.operators import product_space as PS
from tessera.operators import rank as R


def plain_ap(rows):
    total = sum(y for y, _ in rows)
    if not total:
        return None
    out = 0.0
    for s in {s for _, s in rows}:
        above = [y for y, t in rows if t >= s]
        out += sum(y for y, t in rows if t == s) * sum(above) / len(above)
    return out / total


def plain_auc(rows):
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def test_ap_and_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 1), float(rng.randint(0, 9))) for g in "ab" for _ in range(60)] + [("none", 0, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, y int, s double")
    ap = {r.g: r.average_precision for r in M.average_precision(df, "y", "s", ["g"]).collect()}
    auc = {r.g: r.auc for r in M.roc_auc(df, "y", "s", ["g"]).collect()}
    for g in "ab":
        own = [(y, s) for h, y, s in rows if h == g]
        assert ap[g] == pytest.approx(plain_ap(own)) and auc[g] == pytest.approx(plain_auc(own))
    assert ap["none"] is None and auc["none"] is None
    again = {r.g: r.average_precision for r in M.average_precision(df.repartition(7), "y", "s", ["g"]).collect()}
    assert again == pytest.approx(ap)


def test_budget_ties_follow_keys(spark):
    df = spark.createDataFrame([("b", "s", "x", 1, 5.0, 1.0), ("a", "s", "x", 0, 0.0, 1.0)], "i_iso string, stage string, j_iso string, y int, lateval double, score double")
    r = M.budget_metrics(df, "y", "lateval", R.canonical("score", "A"), [1, 5]).orderBy("k").collect()
    assert [(x.effective, x.found, x.recall) for x in r] == [(1, 0, 0.0), (2, 1, 1.0)]


def test_multiplicity_counts_in_part(spark):
    df = spark.createDataFrame([(3, 10.0, 9.0), (2, 1.0, 8.0)], "m long, v double, s double")
    r = R.top_k_multiplicity(df, [F.col("s").desc()], "m", "v", 4).first()
    assert (r.value, r.units) == (31.0, 4)


def test_product_space(spark):
    members = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y")], "i_iso string, p string")
    prox = {(r.p, r.q): r.proximity for r in PS.proximity(members).collect()}
    assert prox == {("x", "y"): 0.5, ("y", "x"): 0.5}
    dens = {(r.i_iso, r.p): r.density for r in PS.density(members, PS.proximity(members)).collect()}
    assert dens == {("A", "x"): 1.0, ("B", "x"): 1.0, ("A", "y"): 1.0}


def test_link_heuristics(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "i_iso string, j_iso string")
    r = G.link_heuristics(spark.createDataFrame([("a", "d")], "i_iso string, j_iso string"), e).first()
    assert (r.common_neighbors, r.pref_attach) == (1, 2) and r.adamic_adar == pytest.approx(1 / math.log(3))


def test_tier_cycle_is_an_error(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "a")], "stage string, source string")
    with pytest.raises(ValueError):
        G.stage_tiers(up, spark.createDataFrame([("a",), ("b",)], "stage string"))


def test_blank_identities(spark):
    df = spark.createDataFrame([(" ",), ("NaN",), (None,), ("x",)], "k string")
    assert A.identity_violations(df, ["k"]).first().blank_k == 3


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i_iso string, stage string, j_iso string, y int, lateval double, score double")
    assert M.average_precision(df, "y", "score", ["stage"]).collect() == []
    assert M.budget_metrics(df, "y", "lateval", R.canonical("score", "A"), [5]).first().found == 0


def test_draw_vectors_against_plain_draws(spark):
    """Ties, a cluster with a third of the rows, missing scores and many pieces, against one draw after another in numpy."""
    from tessera.operators import draw_vectors as D

    rng = np.random.default_rng(6)
    rows = [(f"c{0 if k % 3 == 0 else int(rng.integers(1, 9))}", None if k % 50 == 7 else float(rng.integers(0, 25)), int(rng.random() < 0.3), float(rng.random()), k) for k in range(600)]
    df = spark.createDataFrame(rows, "c string, s double, y int, v double, k int").repartition(5)
    draws = 40
    picks = D.picked(df, "c", draws, 7)
    times = {r.c: np.bincount(r.picks, minlength=draws) for r in picks.collect()}
    assert (sum(times.values()) == 9).all()
    m = np.array([times.get(r[0], np.zeros(draws, int)) for r in rows])
    score = np.array([-np.inf if r[1] is None else r[1] for r in rows])
    y, v = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    ap = D.average_precisions(df, "y", "s", "c", picks, draws)
    value, units, total = D.first_units(df, [F.col("s").desc(), F.col("k").asc()], "s", "v", "c", 50, picks, draws)
    order = sorted(range(len(rows)), key=lambda k: (-score[k], k))
    for d in range(draws):
        w = m[:, d]
        want = sum((w * y)[score == x].sum() * (w * y)[score >= x].sum() / max(w[score >= x].sum(), 1) for x in set(score)) / (w * y).sum()
        assert ap[d] == pytest.approx(want)
        left, got = 50, 0.0
        for k in order:
            take = min(left, w[k])
            got, left = got + take * v[k], left - take
        assert value[d] == pytest.approx(got) and units[d] == 50 and total[d] == pytest.approx((w * v).sum())


def test_draw_vectors_one_class_and_empty(spark):
    from tessera.operators import draw_vectors as D

    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "c string, s double, y int")
    assert np.isnan(D.average_precisions(df, "y", "s", "c", D.picked(df, "c", 5, 1), 5)).all()
    none = df.where("false")
    assert np.isnan(D.average_precisions(none, "y", "s", "c", D.picked(none, "c", 5, 1), 5)).all()
    assert D.first_units(none, [F.col("s").desc()], "s", "y", "c", 3, D.picked(none, "c", 5, 1), 5)[1].tolist() == [0.0] * 5


def test_wedges_of_hubs_are_split(spark):
    """Two nodes linked to all others: right counts, and no key holds more than a block of a hub's list."""
    rng = random.Random(3)
    n = 300
    edges = [("h1", f"n{k}") for k in range(n)] + [(f"n{k}", "h2") for k in range(n)] + [("h1", "h2")] + [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(400)]
    nbr: dict = {}
    for a, b in edges:
        nbr.setdefault(a, set()).add(b)
        nbr.setdefault(b, set()).add(a)
    df = spark.createDataFrame([*edges, edges[0]], "i_iso string, j_iso string").repartition(4)
    pairs = spark.createDataFrame([("h1", "h2"), ("n1", "h1"), ("h2", "n2"), ("n1", "n2"), ("n5", "n5x"), *edges[650:700]], "i_iso string, j_iso string")
    got = {(r.i_iso, r.j_iso): r for r in G.link_heuristics(pairs, df, block=32).collect()}
    for (i, j), r in got.items():
        both = nbr.get(i, set()) & nbr.get(j, set())
        assert r.common_neighbors == len(both) and r.pref_attach == len(nbr.get(i, ())) * len(nbr.get(j, ()))
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(nbr[x])) for x in both if len(nbr[x]) > 1))
    lists, sizes = G.blocked(G.neighbours(df)[0], "node", "nbr", 32)
    assert lists.groupBy("node", "__block").count().agg(F.max("count")).first()[0] < 70
    assert sizes.where("node = 'h1'").first()["__blocks"] == math.ceil(len(nbr["h1"]) / 32)


def test_supporting_paths_both_ways(spark):
    rng = random.Random(1)
    lanes = [("hub", rng.choice("st"), f"n{k}") for k in range(80)] + [(f"n{k}", rng.choice("st"), "end") for k in range(0, 80, 3)] + [("a", "s", "n0"), ("a", "t", "n3")] + [(f"n{k}", "s", "far") for k in range(0, 80, 5)]
    df = spark.createDataFrame(lanes, "i_iso string, stage string, j_iso string")
    gaps = [("hub", "s", "end"), ("a", "s", "end"), ("hub", "t", "far"), ("a", "t", "none")]
    got = sorted(tuple(r) for r in G.supporting_paths(spark.createDataFrame(gaps, "i_iso string, stage string, j_iso string"), df, 9, block=8).drop("rank").collect())
    want: dict = {}
    for i, s, j in gaps:
        for a, f, x in lanes:
            for y, g, b in lanes:
                if a == i and x == y and b == j:
                    want[(i, s, j, f, g)] = want.get((i, s, j, f, g), 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())


def test_running_sums_over_pieces(spark):
    """Groups over many pieces, null groups and values, decimals, against Python."""
    from decimal import Decimal

    from tessera.functions.shared import global_rank, running_sums

    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None, f"g{k % 40}"]), k, rng.choice([None, rng.randrange(-5, 9)]), rng.random(), Decimal(rng.randrange(10**6)) / 100) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, n int, x double, d decimal(12,2)").repartition(7)
    df = df.withColumns({"__p": F.lit(1), "__piece": F.lit(2), "__n": F.lit(3)})
    for group in (["g"], []):
        got = {r.k: r for r in running_sums(df, group, [F.col("k").desc()], {"sn": "n", "sx": "x", "sd": "d"}).collect()}
        assert len(got) == 2000
        held: dict = {}
        for g, k, n, x, d in sorted(rows, key=lambda r: -r[1]):
            own = held.setdefault(g if group else 0, [0, 0.0, Decimal(0)])
            own[0] += n or 0
            own[1] += x
            own[2] += d
            assert got[k].sn == own[0] and got[k].sx == pytest.approx(own[1]) and got[k].sd == own[2]
    ranks = sorted(r["rank"] for r in global_rank(df, [F.col("k").asc()]).collect())
    assert ranks == list(range(1, 2001)) and global_rank(df.where("false"), [F.col("k").asc()]).count() == 0


def test_midranks_of_frequent_scores(spark):
    """A score that half of the rows share, scores of one row each, null groups; rows without a score are left out."""
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 5 == 0 else f"g{k % 2}", 0.0 if k % 2 else float(rng.integers(-40, 40)), int(rng.random() < 0.3)) for k in range(600)]
    df = spark.createDataFrame([*rows, (600, "g0", None, 1)], "id long, g string, score double, y int").repartition(3)
    want = {}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        for r in own:
            below, same = sum(x[2] < r[2] for x in own), sum(x[2] == r[2] for x in own)
            want[r[0]] = (below + (same + 1) / 2, (below + same / 2) / len(own))
    both = R.midrank_ecdf(df, "score", ["g"]).collect()
    assert {r.id: r.midrank for r in both} == {k: v[0] for k, v in want.items()} and {r.id: r.ecdf for r in both} == pytest.approx({k: v[1] for k, v in want.items()})
    assert {r.id: r.midrank for r in R.midrank(df, "score", ["g"]).collect()} == {k: v[0] for k, v in want.items()}
    # every block beyond the share, none beyond it, and some
    blocks = R._ranked_blocks(df.where("score is not null"), "score", ["g"])
    for share in (1, 10, 10_000):
        back = R._given_back(df.where("score is not null"), blocks, ["g", "score"], ["midrank"], share)
        assert {r.id: r.midrank for r in back.collect()} == {k: v[0] for k, v in want.items()}
    auc = {r.g: r.auc for r in M.roc_auc(df, "y", "score", ["g"]).collect()}
    for g in auc:
        p, n = ([r[2] for r in rows if r[1] == g and r[3] == y] for y in (1, 0))
        assert auc[g] == pytest.approx(np.mean([[(a > b) + (a == b) / 2 for b in n] for a in p]))


def test_hash_ranked_takes_the_lowest(spark):
    import hashlib

    from tessera.operators import sampling as S

    rows = [(k, "big" if k % 3 else "small") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, stratum string").repartition(4)
    slots = spark.createDataFrame([("big", 200, 7), ("small", 100, 3)], "stratum string, n long, slots long")
    got = {(r.stratum, r["rank"]): r.id for r in S.hash_ranked(df, "id", "salt", slots).collect()}
    for stratum, n in (("big", 7), ("small", 3)):
        order = sorted((hashlib.sha256(f"salt|{stratum}|{k}".encode()).hexdigest(), k) for k, s in rows if s == stratum)
        assert [got[stratum, i + 1] for i in range(n)] == [k for _, k in order[:n]]
    assert len(got) == 10 and S.hash_ranked(df, "id", "salt", slots.where("false")).count() == 0
