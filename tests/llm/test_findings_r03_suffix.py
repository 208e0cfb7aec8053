"""What op8_suffix_tree moves and leaves on disk: each case failed before its mend."""

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import suffix_lm
from tessera.llm.common import shared_dir, stored


def test_stored_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {str(x) for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    before = files()
    df = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()
    assert stored(df, "test").agg(F.sum("count")).first()[0] == 5000
    of_write = [x for x in files() - before if x.endswith(".data")]
    assert len(of_write) <= 1, of_write  # the sum's own, a single row


def _blocks(texts, size, linked, buckets=5, flush=2000):
    own, out = suffix_lm._Blocks(size, buckets, linked, flush), []
    for at in range(0, len(texts), 3):
        runs = suffix_lm.Runs(pa.array(texts[at : at + 3], pa.string()))
        while len(runs.keys) < size:
            runs.longer()
        ends = np.flatnonzero(runs.whole(size))
        links = [runs.keys[size - 2][ends - 1], runs.keys[size - 2][ends]][: size - 1] if linked else []
        if own.add(runs.keys[size - 1][ends], *links):
            out.append(own.blocks())
    return [*out, own.blocks()]


def test_runs_travel_once_and_packed():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, 500)) for _ in range(60)]
    words = [["<", *t.split(), ">"] for t in texts]
    for size, linked, width in ((1, False, 20), (2, False, 8), (2, True, 17), (3, True, 25)):
        flush = 100_000
        found = _blocks(texts, size, linked, flush=flush)
        assert sum(b.num_rows > 0 for b in found) == 1  # nothing went before the task's end
        plain = collections.Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
        data = [x for b in found for x in b.column(3).to_pylist()]
        assert sum(map(len, data)) < width * len(plain) + 200 * len(data)
        for flush in (flush, 2000):
            by_bucket = collections.defaultdict(list)
            for b in _blocks(texts, size, linked, flush=flush):
                for bucket, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                    by_bucket[bucket].append(x)
            got = [suffix_lm._Blocks.gathered(x, size, linked) for x in by_bucket.values()]
            assert sorted(np.concatenate([g[1] for g in got]).tolist()) == sorted(plain.values())
            symbol = {w: np.uint64(suffix_lm.symbol({"<": suffix_lm.START, ">": suffix_lm.END}.get(w, w.encode()))) for w in {y for x in plain for y in x}}

            def key(run):
                with np.errstate(over="ignore"):
                    k = symbol[run[0]]
                    for w in run[1:]:
                        k = k * suffix_lm._STEP + symbol[w]
                return int(k)  # noqa: B023

            expected = {key(x): (n, *((key(x[:-1]), key(x[1:])) if linked else ())) for x, n in plain.items()}
            assert {int(r[0]): tuple(map(int, r[1:])) for g in got for r in zip(*g, strict=True)} == expected


def test_words_are_those_of_bytes_split():
    texts = [None, "", " ", " Ab  c\n", "x\x0by\x0cz\x1cq \u0085r s", "AÄİ" * 9 + " " + " ".join("w" * k for k in range(1, 40)), "a\x00 a a\x00\x00", "end"]
    for lo, hi in ((0, 8), (3, 7), (0, 3), (0, 0)):
        runs = suffix_lm.Runs(pa.array(texts, pa.string())[lo:hi])
        plain = [w for t in texts[lo:hi] for w in (suffix_lm.START, *suffix_lm.lm_words(t), suffix_lm.END)]
        assert runs.keys[0].tolist() == [suffix_lm.symbol(w) for w in plain]
        assert len(set(runs.keys[0].tolist())) == len(set(plain))


def test_blocks_of_texts_are_bounded_by_bytes():
    texts = pa.array(["a" * 10] * 5 + [None] + ["b" * 100] + ["c"] * 3)
    assert list(suffix_lm.text_blocks(texts, 25, 3)) == [(0, 2), (2, 4), (4, 6), (6, 7), (7, 10)]


def test_only_the_tree_is_left_for_scoring(spark):
    import pathlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    tables = lambda: {p.name for p in pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("tessera-*")}
    other, before = stored(spark.range(3), "other"), tables()
    scored = suffix_lm.score_documents(docs.withColumn("train", F.col("doc_id") % 5 != 1), hot=300)
    assert [p.split("-")[1] for p in tables() - before] == ["tree"]
    assert scored.count() == docs.count() and other.count() == 3 and before <= tables()
