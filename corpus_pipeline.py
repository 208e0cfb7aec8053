"""Corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. The
classifiers learn from labels of the documents that reach them.

Rows at the edge: null and empty texts are scored like any text (and are copies of each other), repeated rows are rows,
null ids stay null, an empty table passes as an empty one, and columns beside text keep their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, quality, simhash, toxicity
from tessera.llm.common import read_table, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as not toxic."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the smallest id."""
    return simhash.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars, where there is one, follows the new text."""
    done = pii.anonymise(docs, pii.session_key(spark), entities_col=None)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in a sequence of at most 2048 tokens."""
    return packing.packed_documents(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

# SQL can express neither the learned classifiers nor the tokenizer; tests/llm compares the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
