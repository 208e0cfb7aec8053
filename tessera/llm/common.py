"""Helpers shared by the training-data operators: words, Arrow maps, shared-folder tables, hashing splits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six separators of a word, `[^\x20\x09-\x0D]+`, are those of bytes.split().


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes.split() cuts at exactly space and \\x09-\\x0D. Null has none."""
    return text.encode().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local master, as in tests, gets a folder of
    its own; on a cluster that is an error, as no machine could read what another one wrote."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and a lost executor recomputes nothing before it.

    The folder goes when the application ends, or with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    # the write's own shuffle files go with it: a collector's run right after it comes too soon, and two steps' files add up
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    _written.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    # the driver's collector tells executors which other shuffle files and broadcasts nothing needs any more
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables stored() has written that are still there."""
    return len(_written)


def release(spark: SparkSession, first: int = 0, end: int | None = None) -> None:
    """Delete what stored() has written, or the tables from the first to before the end of them, in the order of writing. Call it
    once the results that read those tables are written themselves."""
    for at in _written[first:end]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _written[first:end]


def new_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, held: int, most_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, text, label) of documents with a label, outside the held-out remainder: at most per_class ids of each class,
    lowest id hash first, and one row an id.

    per_class bounds the rows, which are therefore safe to broadcast or collect; a text of more than most_chars characters
    is left out of the sample (never out of what is scored), as a few of them would outweigh it. Null ids and labels other
    than 0 and 1 teach nothing; an id labelled both ways counts as 1.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(remainder("doc_id", folds) != held)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.where("label = 0").orderBy(*by_hash).limit(per_class).unionByName(rows.where("label = 1").orderBy(*by_hash).limit(per_class))
    return one_text(docs, most_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def one_text(docs: DataFrame, most_chars: int) -> DataFrame:
    """(doc_id, text) with nulls as empty texts, without texts longer than most_chars."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= most_chars)


_SLICE = 1 << 16


def key_filter(keys: DataFrame, n: int, most_bits: int = 1 << 28) -> np.ndarray:
    """A bitmap with the bits `key mod its size` of all keys (long) set; it tells tasks which keys may be in the table.

    It has some 16 bits a key and at most most_bits, 32 MB, whatever the table's size. A key that is not there may pass,
    so the table itself decides later; a bitmap that is too full costs rows that travel in vain, no results. It is made of
    slices, so no task sets the bits of more than a slice.
    """
    bits = max(_SLICE, min(most_bits, 1 << (16 * max(n, 1) - 1).bit_length()))
    place = F.pmod(F.col("key"), F.lit(bits))
    slices = keys.select(F.floor(place / _SLICE).alias("slice"), (place % _SLICE).cast("int").alias("bit")).groupBy("slice").agg(F.collect_set("bit").alias("bits"))
    out = pa.schema([("slice", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            for slice_, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flags = np.zeros(_SLICE, np.uint8)
                flags[own.values.to_numpy()] = 1
                yield batch(out, [slice_], [np.packbits(flags, bitorder="little").tobytes()])

    whole = np.zeros(bits // 8, np.uint8)
    for r in arrow_map(slices, run, "slice bigint, bytes binary").collect():
        whole[r.slice * _SLICE // 8 : (r.slice + 1) * _SLICE // 8] = np.frombuffer(r.bytes, np.uint8)
    return whole


def may_be_in(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which unsigned or signed 64-bit keys pass a key_filter; its size is a power of two, so signs do not matter."""
    place = keys.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
