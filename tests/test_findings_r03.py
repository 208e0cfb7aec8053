"""Cases of the third round's findings, each of which failed before its mend."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.llm import simhash
from tessera.operators import audit as A
from tessera.operators import cohorts as C
from tessera.operators import draw_vectors as D
from tessera.operators.rank import group_max

from . import test_oracles as O


@pytest.mark.parametrize("name", ["audit_rollup", "reconcile_cohort"])
def test_audits_match_sql(spark, duck, name):
    O.test_matches_sql(spark, duck, name)


@pytest.fixture
def shuffled_joins(spark):
    """Joins and unions as large tables have them in Spark's own setting."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.unionOutputPartitioning": "true", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_subset_is_compared_over_shuffled_unions(shuffled_joins, tmp_path):
    n = F.col("id")
    shuffled_joins.range(12500).select(F.format_string("S%05d", n % 500).alias("i_iso"), F.format_string("N%02d", (n / 500).cast("int")).alias("j_iso"), F.lit("s").alias("stage"), (n % 7 == 0).cast("int").alias("y")).write.parquet(f"{tmp_path}/lanes")
    lanes = shuffled_joins.read.parquet(f"{tmp_path}/lanes")
    own = C.conditional_lanes(lanes)
    found = own.where("j_iso <> 'N03'").unionByName(own.where("j_iso = 'N04'").withColumn("j_iso", F.lit("X04")))
    x = A.subset_violations(group_max(lanes, C.ENTRY, "y", "entry_y"), found, F.col("entry_y") == 1, [*C.LANE, "y"])
    assert tuple(x.first()) == (500, 500)


def test_subset_counts_repeats_and_nulls(spark):
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    x = A.subset_violations(rows("a", "a", None, "b", "no"), rows("a", None, None, "c"), F.expr("k is distinct from 'no'"), ["k"])
    assert tuple(x.first()) == (2, 2)
    assert tuple(A.subset_violations(rows(), rows(), F.lit(True), ["k"]).first()) == (0, 0)


def test_conditional_subset_matches_sql_over_shuffled_joins(shuffled_joins, duck):
    O.test_matches_sql(shuffled_joins, duck, "check_conditional_subset")


def test_codes_of_seven_digits_match_sql(spark, tmp_path):
    import duckdb

    c = duckdb.connect()
    for t, q in {
        "part": "select unnest([3, 4, 999999, 1000001, 1000002, 1234562]) as p_partkey",
        "customer": "select 1 as c_custkey, 7 as c_nationkey",
        "orders": "select 1 as o_orderkey, 1 as o_custkey, date '1997-05-05' as o_orderdate",
        "lineitem": "select p_partkey as l_partkey, 1 as l_orderkey, 2 as l_suppkey, 10.5::double as l_extendedprice from part",
    }.items():
        c.execute(f"create table {t} as {q}")
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = [tuple(r) for r in entry.queries()["scan_flows_filtered"](spark, str(tmp_path)).collect()]
    assert got == c.execute(entry.oracle_sql()["scan_flows_filtered"]).fetchall()


def test_tiles_travel_without_nodes(spark):
    fps = spark.range(64).select(F.col("id").alias("fp"), F.struct("id", F.repeat(F.lit("x"), 40).alias("name")).alias("node"))
    links = simhash.near_links(fps, tile_rows=16)
    assert "repeat" not in links._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]
    assert {x for r in links.collect() for x in (r.a.id, r.b.id)} == set(range(64))


def test_first_units_are_the_same_with_and_without_a_head(spark):
    """The head's rows serve where they hold all units; a head that ends too early gives way to the sweep."""
    df = spark.range(400).select((F.col("id") % 7).alias("c"), (F.col("id") % 31).cast("double").alias("s"), F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"))
    picks, order = D.picked(df, "c", 20, 3), [F.col("s").desc(), F.col("k").asc()]
    want, served, short = (D.first_units(df, order, "s", "v", "c", 60, picks, 20, head=h) for h in (0, 300, 20))
    for x, y, z in zip(want, served, short, strict=True):
        assert x == pytest.approx(y) and x == pytest.approx(z)
    assert D._in_head(df, order, "v", "c", 60, picks, 20, 300) is not None and D._in_head(df, order, "v", "c", 60, picks, 20, 20) is None
