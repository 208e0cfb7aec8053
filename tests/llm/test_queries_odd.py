"""The registered queries and the pipeline themselves, on odd and on empty tables."""

import zlib

import pytest

from tessera.llm.queries import QUERIES

WORDS = "The quick brown fox jumps over the lazy dog near a calm river bank. "
COLUMNS = {
    "op1_metric_join": ["vec_id", "n_links", "component_id", "kept"], "op2_quality": ["doc_id", "held_out", "score", "predicted"], "op3_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_chunks": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op6_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_suffix_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op10_simhash": ["doc_id", "fingerprint", "component_id"], "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op13_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


def write(spark, folder, documents, labels, embeddings, pages):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string, record_type string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = [(k, WORDS * (k % 4 + 1) + ("stupid trash scum. " if k % 6 == 0 else "") + str(k), "en", None, None, "x", "y") for k in range(40)]
    docs += [(40, None, None, None, None, None, None), (41, "", None, None, None, None, None), (None, WORDS, "en", None, None, None, None), docs[3], docs[3], (42, "wort " * 60_000, "de", None, None, None, None), (43, "x" * 200_000, "de", None, None, None, None), (44, " \t\n. ", "und", None, None, None, None)]
    labels = [(k, k % 3 and 1, int(k % 6 == 0)) for k in range(0, 40)] + [(None, 1, 1), (3, None, None), (999, 1, 0), (5, 7, 9)]
    vecs = [(k, [float((k * 7 + j) % 5 - 2) for j in range(32)], k % 2, "z") for k in range(30)] + [(31, None, None, "z"), (32, [float("nan")] * 32, 1, None), (33, [0.0] * 32, None, "z"), (2, [1.0] * 32, 1, "z"), (34, [None] * 32, 1, "z")]
    pages = [(k, None if k % 4 == 0 else f"http://x/{k}", None if k == 3 else WORDS * (k % 3)) for k in range(12)] + [(None, "u", WORDS), (2, "u", WORDS * 2), (20, "u", "é" * 80_000)]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, vecs, [(*p, "r") for p in pages])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), [], [], [], [])


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_odd_and_empty_tables(spark, tables, nothing, name):
    df = QUERIES[name](spark, tables)
    rows = df.collect()
    assert rows or name == "op11_collocations"
    wanted = COLUMNS.get(name, df.columns)
    assert df.columns[: len(wanted)] == wanted
    per_document = name not in ("op1_metric_join", "op6_packing", "op11_collocations", "op12_vector_codes", "op13_warc")
    if per_document:
        assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").collect())
    if "held_out" in df.columns:
        n, k = {"op2_quality": (3, 1), "op7_toxicity": (5, 0), "op8_suffix_tree": (5, 1)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in rows if r.doc_id is not None)
    if "predicted" in df.columns:
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = QUERIES[name](spark, nothing)
    assert none.columns == df.columns and none.count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, tables, nothing):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").collect()} and rows
    assert corpus_pipeline.run(spark, nothing).count() == 0
