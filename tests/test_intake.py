"""Archives, score files, coercion and windows: each violation has an input that fails."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import panel as P
from tessera.operators import product_space as PS
from tessera.sources import archives as A
from tessera.sources import intake as I

FLOWS = "i long, j long, k string, year int, v double"


def test_archives_round_trip(spark, tmp_path):
    rows = [(k % 7, k % 5, f"{k % 11}", 1995 + k % 4, None if k % 9 == 0 else k / 3) for k in range(400)]
    A.write_archives(spark.createDataFrame(rows, FLOWS).repartition(3), str(tmp_path))
    want = sorted(map(repr, [(i, j, k.zfill(6), y, v) for i, j, k, y, v in rows]))
    assert sorted(repr(tuple(r)) for r in A.read_archives(spark, str(tmp_path)).collect()) == want
    some = A.read_archives(spark, str(tmp_path), [1996, 1996, 1998])
    assert some.count() == 200 and {r.year for r in some.collect()} == {1996, 1998}
    assert A.read_archives(spark, str(tmp_path), [2050]).count() == 0


def test_archives_leave_other_years_closed(spark, tmp_path):
    """A member of another year that cannot be read does no harm until its year is asked for."""
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("x_Y1997_V1.csv", "v,k,j,i,t,note\n1.5,7,2,1,1997,a\n,8,2,1,1997,b\n")
        z.writestr("x_Y1998_V1.csv", "no,header\n1,2\n")
        z.writestr("x_Y1999_V1.csv", "t,i,j,k,v\n1998,1,2,3,4\n")
        z.writestr("README.txt", "none of a year")
    read = lambda years: [tuple(r) for r in A.read_archives(spark, str(tmp_path / "all.zip"), years).collect()]
    assert sorted(read([1997]), key=repr) == [(1, 2, "000007", 1997, 1.5), (1, 2, "000008", 1997, None)]
    with pytest.raises(Exception, match="lacks"):
        read([1998])
    with pytest.raises(Exception, match="another year"):
        read([1999])
    x = A.read_archives(spark, str(tmp_path / "all.zip")).where("year >= 1997 and year < 1998 and i = 1")
    assert x.count() == 2


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "i string, j string")


GOOD = "i,j,score\na,x,1\na,y,2.5\nb,x,-3e1\n"


def scores(spark, tmp_path, candidates, text, more=None):
    folder = tmp_path / "scores"
    folder.mkdir()
    (folder / "1.csv").write_text(text)
    if more:
        (folder / "2.csv").write_text(more)
    return sorted(tuple(r) for r in I.read_scores(spark, str(folder), candidates, ["i", "j"]).collect())


def test_scores_taken(spark, tmp_path, candidates):
    assert scores(spark, tmp_path, candidates, GOOD.replace("b,x,-3e1\n", ""), "i,j,score\nb,x,-3e1\n") == [("a", "x", 1.0), ("a", "y", 2.5), ("b", "x", -30.0)]


@pytest.mark.parametrize("text, says", [
    (GOOD.replace("score", "y"), "outcome"), (GOOD.replace("score", "other"), "schema mismatch"), ("i,j,score,extra\na,x,1,1\n", "schema mismatch"), ("i,score\na,1\n", "schema mismatch"),
    (GOOD + "a,x,1\n", "duplicate key"), (GOOD + "c,x,1\n", "of no candidate"), (GOOD.replace("a,y,2.5\n", ""), "without a score"), (GOOD.replace("2.5", "NaN"), "not finite"),
    (GOOD.replace("2.5", "Infinity"), "not finite"), (GOOD.replace("2.5", "high"), "not finite"), (GOOD.replace("2.5", ""), "not finite"), (GOOD + ",x,1\n", "null key"), (GOOD.replace("a,y,2.5", "a,y,2.5,9"), "does not parse"),
])
def test_scores_refused(spark, tmp_path, candidates, text, says):
    with pytest.raises(Exception, match=says):
        scores(spark, tmp_path, candidates, text)


def test_scores_of_outcome_or_key(spark, candidates):
    for bad in ("lateval", "i"):
        with pytest.raises(ValueError, match="may not be a score"):
            I.read_scores(spark, "nowhere", candidates, ["i", "j"], bad)


def test_scores_headers_of_all_files(spark, tmp_path, candidates):
    with pytest.raises(Exception, match="(?i)header|schema"):
        scores(spark, tmp_path, candidates, GOOD.replace("b,x,-3e1\n", ""), "j,i,score\nx,b,-3e1\n")


def test_closed_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "n int, s string").write.parquet(path)
    fields = {"n": T.IntegerType(), "s": T.StringType()}
    schema = lambda f: T.StructType([T.StructField(k, t) for k, t in f.items()])
    assert I.read_closed(spark, path, schema(fields)).count() == 1
    for bad in (fields | {"more": T.IntegerType()}, {"n": T.IntegerType()}, fields | {"n": T.LongType()}):
        with pytest.raises(ValueError):
            I.read_closed(spark, path, schema(bad))


def test_coercion(spark):
    df = spark.createDataFrame([("1.5", "2"), ("x", "2"), (None, "2"), ("-1", "2"), ("Infinity", "2"), ("NaN", None), ("2", None), ("3", "4.7x")], "a string, b string")
    clean, rejects = I.split_rejects(I.coerced(df, {"a": "double", "b": "int"}, frozenset({"b"})))
    assert sorted((r.a, r.b) for r in clean.where("b is not null").collect()) == [(1.5, 2)] and clean.where("b is null").first().a == 2.0
    assert sorted(r.reject for r in rejects.collect()) == ["a is negative", "a is not a number", "a is not finite", "a is not finite", "a is null", "b is not a number"]
    assert rejects.where("reject = 'a is not a number'").count() == 1 and I.coerced(df.limit(0), {"a": "double"}).count() == 0
    assert spark.range(1).select(I.blank(F.lit(" NaN ")), I.blank(F.lit("0"))).first()[:] == (True, False)


def test_windows_refuse(spark):
    df = spark.createDataFrame([("a", "p", 1997, 2.0), ("a", "p", 1998, 4.0), ("a", "q", 1998, 6.0), ("a", "p", 2001, 8.0)], "i string, k string, year int, v double")
    for years in ([], [1997, 1997]):
        for f in (P.window_calendar_mean, P.window_present_mean, P.stage_year_totals):
            with pytest.raises(ValueError, match="unique"):
                f(df, years, ["i"])
    with pytest.raises(ValueError, match="missing"):
        P.window_calendar_mean(df.drop("v"), [1997], ["i"])
    with pytest.raises(Exception, match="outside the window: 2001"):
        P.window_calendar_mean(df, [1997, 1998], ["i"], strict=True).collect()
    with pytest.raises(Exception, match="outside the window"):
        P.stage_year_totals(df.withColumn("year", F.lit(None).cast("int")), [1997], ["i"], strict=True).collect()
    assert P.window_calendar_mean(df, [1997, 1998], ["i"]).first().v == 6.0 and P.window_present_mean(df, [1997, 1998], ["i"]).first().v == 9.0


def test_load_window_keeps_registered(spark):
    flows = spark.createDataFrame([("a", "b", "001101", 1997, 10.0), ("a", "b", "001101", 1998, 30.0), ("a", "b", "990001", 1997, 500.0), ("x", "b", "001102", 1998, 8.0)], "i_iso string, j_iso string, k string, year int, v double").withColumn("stage", F.lit("old"))
    codes = spark.createDataFrame([("0011", "s")], "code string, stage string")
    got = {m: {(r.i_iso, r.v) for r in P.load_window(flows, codes, [1997, 1998], 1.0, 1.0, mode=m, digits=4)[0].collect()} for m in ("calendar", "legacy")}
    assert got == {"calendar": {("a", 20.0), ("x", 4.0)}, "legacy": {("a", 20.0), ("x", 8.0)}}
    assert {r.i_iso for r in P.load_window(flows, codes, [1997, 1998], 1.0, 1.0, ["x"], digits=4)[1].collect()} == {"a"}
    with pytest.raises(ValueError):
        P.load_window(flows, codes, [1997], 1.0, 1.0, mode="none")


def test_product_space_over_tiles(spark):
    """More products than a tile, one exporter with all of them, repeated members."""
    rows = [("hub", f"p{k:03d}") for k in range(600)] + [(f"e{k % 90}", f"p{(k * 37) % 600:03d}") for k in range(1500)]
    df = spark.createDataFrame([*rows, rows[0], rows[700]], "i_iso string, p string").repartition(4)
    own: dict = {}
    for i, p in rows:
        own.setdefault(p, set()).add(i)
    targets = spark.createDataFrame([(f"p{k:03d}",) for k in range(0, 600, 7)] + [("none",)], "p string")
    got = {(r.p, r.q): r.n for r in PS.cooccurrence(df, targets).collect()}
    names = [f"p{k:03d}" for k in range(0, 600, 7)]
    assert got == {(p, q): len(own[p] & own[q]) for p in names for q in own if own[p] & own[q]}
    prox = PS.proximity(df, targets)
    near = {(r.p, r.q): r.proximity for r in prox.collect()}
    dens = {(r.i_iso, r.p): r.density for r in PS.density(df, prox).collect()}
    held: dict = {}
    for i, p in set(rows):
        held.setdefault(i, set()).add(p)
    for p in names[::9]:
        total = sum(v for (a, _), v in near.items() if a == p)
        for i, mine in held.items():
            want = sum(v for (a, q), v in near.items() if a == p and q in mine) / total
            assert dens.get((i, p), 0.0) == pytest.approx(want, abs=1e-12)
    none = df.where("false")
    assert PS.cooccurrence(none).count() == 0 and PS.density(none, prox.where("false")).count() == 0


def test_committed_sink(spark, tmp_path):
    """Equal tables have equal digests whatever their partitions; a table is seen only once it is committed, and tampering is found."""
    from tessera.sources import tables as S

    rows = [(k % 17, f"k{k}", None if k % 5 == 0 else k / 7, [k]) for k in range(500)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "a int, b string, c double, d array<int>")
    one = S.write_sorted(df.repartition(1), ["a", "b"], str(tmp_path / "one"))
    two = S.write_sorted(df.repartition(7).select("d", "c", "b", "a"), ["a", "b"], str(tmp_path / "two"), rows_a_file=40)
    assert (one["rows"], one["digest"]) == (two["rows"], two["digest"]) == (502, one["digest"]) and two["files"] >= 13
    assert S.content(df.limit(501))[1] != one["digest"] and S.content(df.withColumn("c", F.coalesce("c", F.lit(0.0))))[1] != one["digest"]
    assert S.content(S.read_committed(spark, str(tmp_path / "two"), verify=True)) == (502, one["digest"])
    # another write is not seen before its manifest, and replaces the table after it
    spark.range(3).write.parquet(str(tmp_path / "one" / "data-unfinished"))
    assert S.read_committed(spark, str(tmp_path / "one")).count() == 502
    S.write_sorted(df.limit(0), ["a"], str(tmp_path / "one"))
    assert S.read_committed(spark, str(tmp_path / "one"), verify=True).count() == 0
    spark.range(1).select(F.lit(1).alias("a"), F.lit("x").alias("b"), F.lit(0.0).alias("c"), F.array(F.lit(1)).alias("d")).write.mode("append").parquet(str(tmp_path / "two" / two["folder"]))
    with pytest.raises(ValueError, match="manifest says 502"):
        S.read_committed(spark, str(tmp_path / "two"), verify=True)


def test_sums_do_not_depend_on_order(spark):
    from tessera.functions.shared import exact_sum

    rows = [(k, x) for k, x in enumerate([1e9, 0.1, 0.2, 0.3, -1e9, 123456.789] * 50)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {df.orderBy(F.xxhash64("k", F.lit(seed))).coalesce(1).agg(exact_sum("x").alias("s")).first().s for seed in range(6)}
    assert len(got) == 1 and got.pop() == pytest.approx(50 * 123457.389)
