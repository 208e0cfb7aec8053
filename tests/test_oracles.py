"""A query of each kind against its SQL on the smallest tables."""

import decimal

import pytest

import __spark_entry__ as entry

from .conftest import SMALL

NAMES = ["track_a_candidates", "track_b1_entries", "threshold_geometry", "split_assign", "within_size_bin_auc", "two_stage_metrics", "bootstrap_ap_ci", "graph_profile", "product_density", "audit_labels", "hash_ranked_sample", "decision_ledger"]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["i_iso", "j_iso", "stage"]
