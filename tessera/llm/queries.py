"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from . import chunks, licences, metric_join, packing, phrases, pii, quality, rules, simhash, suffix_lm, toxicity, vector_codes, warc

QUERIES = {
    "op1_metric_join": metric_join.op1_metric_join,
    "op2_quality": quality.op2_quality,
    "op3_rules": rules.op3_rules,
    "op4_licences": licences.op4_licences,
    "op5_chunks": chunks.op5_chunks,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_tree": suffix_lm.op8_suffix_tree,
    "op9_pii": pii.op9_pii,
    "op10_simhash": simhash.op10_simhash,
    "op11_collocations": phrases.op11_collocations,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL: dict[str, str] = {"op3_rules": rules.OP3_SQL, "op11_collocations": phrases.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_warc": warc.OP13_SQL}
