"""Tables in the cluster's shared folder, and running sums and ranks that no single task has to hold."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


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


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and a lost executor recomputes nothing before it.

    The folder goes when the application ends, or with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> None:
    """Delete what stored() has written so far. Call it once the results that read those tables are written themselves."""
    while _written:
        fs, at = _place(spark, _written.pop())
        fs.delete(at, True)


def exact_sum(value: str | Column, scale: int = 6) -> Column:
    """The sum of doubles as decimals, as a double: it does not depend on the order of rows, so ties and ranks do not either.

    Values are taken to `scale` places, which is all that window means of amounts in cents have. A sum of 10**(38 - scale) and
    more does not fit and is an error.
    """
    x = F.col(value) if isinstance(value, str) else value
    return F.sum(x.cast(f"decimal(38,{scale})")).cast("double")


def running_sums(df: DataFrame, group: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """df with, for each new name -> column, the sum over the rows of the group up to and including this one; nulls add nothing.

    The order must be total within a group. Rows are dealt by range and sorted once; sums run through the sorted piece, and
    the sums of earlier pieces are added to the group that a piece continues, at most one a piece, so that table is small
    whatever the rows and a group of any size is spread over tasks.
    """
    # the range's sample reads the rows too, so what makes them must not run twice
    keyed = stored(df, "unranged")
    types = dict(zip(values, keyed.agg(*[F.sum(old).alias(new) for new, old in values.items()]).schema.fields, strict=True)) if values else {}
    schema = T.StructType([*keyed.schema.fields, T.StructField("__rs_piece", T.IntegerType()), T.StructField("__rs_first", T.BooleanType()), *[T.StructField(f"__rs_l_{n}", t.dataType) for n, t in types.items()]])
    names, olds = keyed.columns, list(values.values())
    ranked = keyed.repartitionByRange(*[F.col(g).asc() for g in group], *order).sortWithinPartitions(*[F.col(g).asc() for g in group], *order)

    def run(batches):
        import pyspark

        piece = pyspark.TaskContext.get().partitionId()
        last, sums, first = None, [0] * len(olds), True
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b, [names.index(g) for g in group])
            key = tuple(b.column(names.index(g))[0] for g in group)
            goes_on = last is not None and key == last
            bounds = [*starts, b.num_rows]
            flags = [first and (last is None or goes_on)] + [False] * (len(starts) - 1)
            out = []
            for k, old in enumerate(olds):
                x, whole = _summable(b.column(names.index(old)))
                parts = []
                for j, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    parts.append(_cumulated(x[lo:hi], sums[k] if j == 0 and goes_on else 0))
                run_ = np.concatenate(parts)
                sums[k] = run_[-1]
                out.append(pa.array(run_, pa.from_numpy_dtype(run_.dtype)) if whole else pa.array(run_.tolist(), b.column(names.index(old)).type))
            first = first and len(starts) == 1 and (last is None or goes_on)
            last = tuple(b.column(names.index(g))[b.num_rows - 1] for g in group)
            lead = np.repeat(flags, np.diff(bounds))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, piece, np.int32)), pa.array(lead), *[o.cast(t) for o, t in zip(out, _arrow(types), strict=True)]], names=schema.names)

    pieces = stored(ranked.mapInArrow(run, schema), "ranged")
    before = Window.partitionBy(*group).orderBy("__rs_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("__rs_piece", *group).agg(F.bool_or("__rs_first").alias("__rs_first"), *[F.sum(old).alias(f"__rs_t_{new}") for new, old in values.items()])
    offsets = totals.withColumns({f"__rs_o_{new}": F.coalesce(F.sum(f"__rs_t_{new}").over(before), F.lit(0)) for new in values}).where("__rs_first").select(F.col("__rs_piece").alias("__rs_of"), *[f"__rs_o_{new}" for new in values])
    joined = pieces.join(F.broadcast(offsets), (F.col("__rs_piece") == F.col("__rs_of")) & F.col("__rs_first"), "left")
    return joined.select(*[pieces[c] for c in df.columns], *[(F.coalesce(F.col(f"__rs_l_{new}"), F.lit(0)) + F.coalesce(F.col(f"__rs_o_{new}"), F.lit(0))).alias(new) for new in values])


def _starts(b: pa.RecordBatch, columns: list[int]) -> list[int]:
    """Where a run of equal group columns begins; equal nulls are equal."""
    change = np.zeros(b.num_rows, bool)
    change[0] = True
    for c in columns:
        codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change).tolist()


def _summable(c: pa.Array) -> tuple[np.ndarray, bool]:
    """(values with zeros for nulls, whether they are machine numbers); decimals stay exact as objects."""
    if pa.types.is_decimal(c.type):
        return np.array([0 if v is None else v for v in c.to_pylist()], object), False
    kind = np.float64 if pa.types.is_floating(c.type) else np.int64
    return c.fill_null(0).to_numpy(zero_copy_only=False).astype(kind), True


def _cumulated(x: np.ndarray, start) -> np.ndarray:
    out = np.cumsum(x)
    return out + start if len(out) else out


def _arrow(types: dict) -> list[pa.DataType]:
    kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64()}
    return [pa.decimal128(t.dataType.precision, t.dataType.scale) if isinstance(t.dataType, T.DecimalType) else kinds[type(t.dataType)] for t in types.values()]


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", group: list[str] | None = None) -> DataFrame:
    """df with its place, from 1, in a total order over the whole table or each group."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), group or [], order, {name: "__one"}).drop("__one")
