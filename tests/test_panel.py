"""Hand-worked panels and windows."""

import pytest

from tessera.operators import cohorts as C
from tessera.operators import panel as P

YEARS = [2018, 2019, 2020, 2021, 2022]


def flows(spark, rows):
    return spark.createDataFrame(rows, "i_iso string, j_iso string, stage string, k string, year int, v double")


def value(df):
    return [r.v for r in df.collect()]


def test_intermittent_product(spark):
    f = flows(spark, [("A", "B", "s", "1", 2018, 500.0)])
    assert sorted(value(P.stage_year_totals(f, YEARS, C.LANE)), reverse=True) == [500, 0, 0, 0, 0]
    assert value(P.window_calendar_mean(f, YEARS, C.LANE)) == [100]
    assert value(P.window_present_mean(f, YEARS, C.LANE)) == [500]


def test_two_products_in_different_years(spark):
    f = flows(spark, [("A", "B", "s", "1", 2018, 200.0), ("A", "B", "s", "2", 2019, 300.0)])
    assert value(P.window_calendar_mean(f, YEARS, C.LANE)) == [100]
    assert value(P.window_present_mean(f, YEARS, C.LANE)) == [500]


def test_expected_key_without_rows(spark):
    f, keys = flows(spark, []), spark.createDataFrame([("A", "B", "s")], "i_iso string, j_iso string, stage string")
    assert value(P.stage_year_totals(f, YEARS, C.LANE, expected=keys)) == [0] * 5
    assert value(P.window_calendar_mean(f, YEARS, C.LANE, expected=keys)) == [0]


def test_null_keys_are_keys(spark):
    f = flows(spark, [(None, "B", "s", "1", 2018, 5.0)])
    assert sorted(value(P.stage_year_totals(f, [2018, 2019], C.LANE))) == [0, 5]


def test_sum_before_mean(spark):
    f = flows(spark, [("A", "B", "s", str(k), 2018, v) for k, v in enumerate((100.0, 150.0, 50.0))])
    assert value(P.window_calendar_mean(f, YEARS, C.LANE)) == [60]


def test_threshold_is_strict(spark):
    f = flows(spark, [("A", "B", "s", "1", 2018, 200.0)])
    assert P.active(P.window_calendar_mean(f, [2018, 2019], C.LANE), 100.0).count() == 0


def test_cohorts_by_hand(spark):
    w = lambda rows: spark.createDataFrame(rows, "i_iso string, j_iso string, stage string, v double")
    early = w([("X", "M", "raw", 9.0), ("Y", "M", "raw", 4.0), ("Y", "N", "p", 5.0), ("Z", "X", "p", 2.0)])
    late = w([("X", "N", "p", 7.0), ("Y", "X", "p", 3.0), ("X", "Q", "p", 1.0)])
    up = spark.createDataFrame([("c", "p", "raw")], "chain string, stage string, source string")
    a = {(r.i_iso, r.j_iso): (r.y, r.lateval) for r in C.track_a(early, late, up).collect()}
    assert a == {("Y", "X"): (1, 3.0)}
    b = {(r.i_iso, r.j_iso): r.y for r in C.track_b(early, late, up).collect()}
    assert b == {("X", "N"): 1}  # X itself is no destination of X
    cov = C.coverage(C.late_starts(early, late, up)).first()
    assert (cov.n_entries, cov.n_covered, cov.n_mixed, cov.n_inactive_only, cov.n_lanes) == (1, 1, 1, 0, 2)
    assert cov.value_coverage == pytest.approx(7 / 8)
