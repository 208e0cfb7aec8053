"""Scans and sinks: flows, dimensions, registry documents, task tables and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("k", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("v", T.DoubleType())])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("stages", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("upstream", T.ArrayType(T.StringType())),
    T.StructField("upstream_map", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("derived_from", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("form_of", T.ArrayType(T.ArrayType(T.StringType()))),
])


def read_flows(spark: SparkSession, path: str, years: list[int] | None = None, fmt: str = "parquet") -> DataFrame:
    """Flows (i, j, k, year, v) of the years asked for; year is a partition column, so other years are not opened."""
    df = spark.read.schema(FLOW_SCHEMA).format(fmt).option("header", True).load(path)
    return df if years is None else df.where(F.col("year").isin(*years))


def write_flows_filtered(flows: DataFrame, products: DataFrame, path: str) -> None:
    """Keep registered products, normalise codes, write one folder a year."""
    flows.withColumn("k", pad_code("k")).join(products.select("k"), "k", "left_semi").write.mode("overwrite").partitionBy("year").parquet(path)


def pad_code(col: str, width: int = 6) -> Column:
    return F.lpad(F.col(col).cast("string"), width, "0")


def unique_dimension(dim: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that a dimension repeats or leaves null; empty where it is sound."""
    return dim.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def pair_covariates(pairs: DataFrame, i: str, j: str, positive: list[str], flags: list[str]) -> DataFrame:
    """Pairs of different ends with every covariate there and the positive ones above zero, as logarithms."""
    ok = F.col(i) != F.col(j)
    for c in positive:
        ok &= F.col(c) > 0
    return pairs.where(ok).dropna(subset=[*positive, *flags]).select(i, j, *[F.log(c).alias(f"log_{c}") for c in positive], *flags)


def parse_registry(documents: DataFrame, col: str = "document") -> DataFrame:
    return documents.select(F.from_json(col, REGISTRY_SCHEMA).alias("d")).select("d.*")


def stage_edges(registry: DataFrame) -> DataFrame:
    """(chain, stage, code) of every registered product."""
    return registry.select(F.col("id").alias("chain"), F.explode("stages").alias("stage", "codes")).select("chain", "stage", F.explode("codes").alias("code"))


def upstream_edges(registry: DataFrame) -> DataFrame:
    """(chain, stage, source): which upstream stages qualify an exporter for a stage."""
    return registry.select(F.col("id").alias("chain"), F.explode("upstream_map").alias("stage", "sources")).select("chain", "stage", F.explode("sources").alias("source"))


def pooled_registry(registry: DataFrame) -> DataFrame:
    """(stage, code) of all chains, stages named <chain>.<stage>."""
    return stage_edges(registry).select(F.concat_ws(".", "chain", "stage").alias("stage"), "code")


def content(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table's content: the sum of its rows' hashes, whatever their order, partitioning or column order."""
    columns = sorted(df.columns)
    h = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in columns], F.lit("|".join(columns)))
    n, low, high = df.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 32)).cast("decimal(38,0)")), F.sum(F.shiftright(h, 32).cast("decimal(38,0)"))).first()
    return n, f"{int(low or 0):x}.{int(high or 0):x}"


def write_sorted(df: DataFrame, keys: list[str], path: str, fmt: str = "parquet", rows_a_file: int = 1_000_000) -> dict:
    """Writes df in key order in files of at most rows_a_file rows, and commits it by a manifest; returns the manifest.

    The data stand in a folder of this write's own under `path`. They are read back and compared with df's row count and
    digest, and only then does `manifest.json` name their folder; until it does, and if they differ, readers see what was
    there before. Two writes of equal tables have equal digests, however they were partitioned.
    """
    import json
    import uuid

    spark, part = df.sparkSession, f"data-{uuid.uuid4().hex}"
    wanted = content(df)
    df.orderBy(*keys).write.option("maxRecordsPerFile", rows_a_file).format(fmt).save(f"{path}/{part}")
    back = spark.read.schema(df.schema).format(fmt).load(f"{path}/{part}")
    if (found := content(back)) != wanted:
        raise ValueError(f"{path}: {found[0]} rows with digest {found[1]} were written, not {wanted[0]} with {wanted[1]}")
    each = back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    manifest = {"folder": part, "format": fmt, "rows": wanted[0], "digest": wanted[1], "schema": df.schema.json(), "files": each.count()}
    _put(spark, f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def read_committed(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The table that the manifest under path names; verify compares rows and digest first."""
    import json

    m = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    df = spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).format(m["format"]).load(f"{path}/{m['folder']}")
    if verify and (found := content(df)) != (m["rows"], m["digest"]):
        raise ValueError(f"{path}: {found[0]} rows with digest {found[1]}, the manifest says {m['rows']} with {m['digest']}")
    return df


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and renamed, in any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    to, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(new, to):
        raise OSError(f"{path} could not be committed")


def metrics_long(metrics: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """One row for each metric of a wide metrics table: ids, metric, value; null values stay."""
    return metrics.unpivot(ids, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
