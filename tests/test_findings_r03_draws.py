"""Average precisions of bootstrap draws with rows that carry their draws as bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import draw_vectors as D
from tessera.sources import archives as A


@pytest.mark.parametrize("rows_at_once", [3, 2048])
def test_draws_as_bytes_against_plain_draws(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(D, "_ROWS", rows_at_once)
    s = F.when(F.col("id") % 29 == 0, F.lit(None)).when(F.col("id") % 31 == 0, float("nan")).when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.sin("id"), 2))
    df = spark.range(900).select((F.col("id") * 7 % 23).alias("c"), s.alias("s"), (F.col("id") % 6 == 0).cast("int").alias("y")).localCheckpoint()
    draws = 15
    picks = D.picked(df, "c", draws, 5).localCheckpoint()
    got = D.average_precisions(df, "y", "s", "c", picks, draws, pieces=5)
    m = np.zeros((23, draws))
    for r in picks.collect():
        np.add.at(m[r.c], r.picks, 1)
    rows = [(r.c, (2, 0) if r.s is not None and np.isnan(r.s) else (0, 0) if r.s is None else (1, r.s), r.y) for r in df.collect()]
    for k in range(draws):
        want, cp, cn = 0.0, 0.0, 0.0
        for key in sorted({x[1] for x in rows}, reverse=True):
            p, n = (sum(m[c, k] * (y if only else 1) for c, x, y in rows if x == key) for only in (True, False))
            cp, cn = cp + p, cn + n
            want += p * cp / cn if cn else 0.0
        assert got[k] == pytest.approx(want / cp, rel=1e-12)
    assert [f.dataType.typeName() for f in D.counted(picks, "c", draws).schema] == ["long", "binary"]


def test_a_year_is_written_by_several_tasks(spark, tmp_path):
    import os

    n = F.col("id")
    flows = spark.range(4000).select((n % 50).alias("i"), (n % 7).alias("j"), F.lpad((n % 900).cast("string"), 6, "0").alias("k"), F.lit(1997).alias("year"), n.cast("double").alias("v"))
    A.write_archives(flows, f"{tmp_path}/z")
    assert len(os.listdir(f"{tmp_path}/z")) > 1
    assert A.read_archives(spark, f"{tmp_path}/z", [1997]).agg(F.count("*"), F.sum("v")).first() == (4000, 4000 * 3999 / 2)
