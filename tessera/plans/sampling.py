"""Queries of sampling, agreement, lexicon recall and the decision ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import sampling as S
from . import views as V
from .registry import query

SLOTS = 100
_FRAME = "frame AS (SELECT doc_id, lang || '|' || source AS stratum, count(*) OVER (PARTITION BY lang, source) AS stratum_size, n_chars FROM documents)"
_CERT = f"{_FRAME}, cert AS (SELECT *, CASE WHEN stratum_size <= 5 THEN 1 ELSE 0 END + CASE WHEN n_chars > 15000 THEN 1 ELSE 0 END AS reasons FROM frame)"
_ALLOC = f"{_CERT}, c AS (SELECT stratum, count(*) AS n FROM cert WHERE reasons = 0 GROUP BY stratum), q AS (SELECT stratum, n, ({SLOTS} * n) // (SELECT sum(n) FROM c) AS q, ({SLOTS} * n) % (SELECT sum(n) FROM c) AS r FROM c), alloc AS (SELECT stratum, n, CAST(q + CASE WHEN row_number() OVER (ORDER BY r DESC, stratum) <= {SLOTS} - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS slots FROM q)"
_SAMPLE = f"{_ALLOC}, ranked AS (SELECT cert.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('sample|' || stratum || '|' || doc_id), doc_id) AS rank FROM cert WHERE reasons = 0), sample AS (SELECT doc_id, r.stratum, rank, slots / n AS inclusion FROM ranked r JOIN alloc a ON a.stratum = r.stratum AND rank <= slots UNION ALL SELECT doc_id, stratum, 0, 1.0 FROM cert WHERE reasons > 0)"


def _cert(s, d):
    rows = S.stratify(V.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"])
    return S.certainty_units(rows, {"small_stratum": F.col("stratum_size") <= 5, "very_long": F.col("n_chars") > 15000})


def _alloc(cert):
    return S.hamilton(cert.where(F.size("reasons") == 0).groupBy("stratum").agg(F.count("*").alias("n")), SLOTS)


def _sample(s, d):
    cert = _cert(s, d)
    alloc = _alloc(cert)
    drawn = S.hash_ranked(cert.where(F.size("reasons") == 0), "doc_id", "sample", alloc).select("doc_id", "stratum", "reasons", "rank")
    return S.design_weights(drawn.unionByName(cert.where(F.size("reasons") > 0).select("doc_id", "stratum", "reasons", F.lit(0).cast("long").alias("rank"))), alloc)


@query(f"WITH {_FRAME} SELECT doc_id, stratum, stratum_size FROM frame")
def stratify(s, d):
    return _cert(s, d).select("doc_id", "stratum", "stratum_size")


@query(f"WITH {_CERT} SELECT doc_id, stratum, reasons AS n_reasons FROM cert WHERE reasons > 0")
def certainty_units(s, d):
    return _cert(s, d).where(F.size("reasons") > 0).select("doc_id", "stratum", F.size("reasons").alias("n_reasons"))


@query(f"WITH {_ALLOC} SELECT stratum, n, slots FROM alloc")
def hamilton_allocation(s, d):
    return _alloc(_cert(s, d))


@query(f"WITH {_SAMPLE} SELECT doc_id, stratum, rank FROM sample WHERE rank > 0")
def hash_ranked_sample(s, d):
    return _sample(s, d).where("rank > 0").select("doc_id", "stratum", "rank")


@query(f"WITH {_SAMPLE} SELECT doc_id, round(inclusion, 9) AS inclusion, round(1 / inclusion, 6) AS weight FROM sample")
def design_weights(s, d):
    return _sample(s, d).select("doc_id", F.round("inclusion", 9).alias("inclusion"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_SAMPLE} SELECT count(*) AS n, round(sum(1 / inclusion), 5) AS weights, round(sum(quality / inclusion), 5) AS total, round(sum(quality / inclusion) / (SELECT count(*) FROM documents), 8) AS rate FROM sample LEFT JOIN labels USING (doc_id)")
def horvitz_thompson(s, d):
    x = S.horvitz_thompson(_sample(s, d).join(V.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left"), "quality", V.table(s, d, "documents").count())
    return x.select("n", F.round("weights", 5).alias("weights"), F.round("total", 5).alias("total"), F.round("rate", 8).alias("rate"))


@query("WITH t AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), c AS (SELECT sum(x.n * y.n) / ((SELECT count(*) FROM t) ** 2) AS pe FROM (SELECT a, count(*) AS n FROM t GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM t GROUP BY b) y ON x.a = y.b) SELECT count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS agreement, round((avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - any_value(pe)) / (1 - any_value(pe)), 9) AS kappa FROM t, c")
def rater_agreement(s, d):
    x = S.rater_agreement(V.table(s, d, "labels").select("quality", (1 - F.col("toxic")).alias("other")), "quality", "other")
    return x.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


#: Lexicons of part names, and challenges against them.
LEXICONS = {"ring": r"\bring\b", "metal": r"\b(?:bolt|nut|screw)\b", "pump": r"\b(?:pump|valve)\b"}
CHALLENGES = [("ring", "plural", r"rings?"), ("metal", "stem", r"bolt"), ("metal", "none", r"rivets"), ("pump", "colour", r"\b(?:red|blue)\b")]
_CASE = lambda p: f"regexp_matches(p_name, '(?i){p}')"
_RECALL = " UNION ".join(f"SELECT '{c}' AS class, p_name AS code FROM part WHERE {_CASE(p)}" for c, p in LEXICONS.items())


def _recalled(s, d):
    return L.recall(V.table(s, d, "part").select("p_name"), LEXICONS, "p_name", "p_name")


@query(_RECALL)
def lexicon_recall(s, d):
    return _recalled(s, d)


_NEG = " UNION ALL ".join(f"SELECT '{c}' AS class, '{i}' AS challenge, count(*) FILTER ({_CASE(p)}) AS hits, count(*) FILTER ({_CASE(p)} AND {_CASE(LEXICONS[c])}) AS recalled, count(*) FILTER ({_CASE(p)} AND NOT {_CASE(LEXICONS[c])}) AS unrecalled FROM part" for c, i, p in CHALLENGES)


@query(f"SELECT *, CASE WHEN hits = 0 THEN 'no_source_hits' WHEN unrecalled = 0 THEN 'all_source_hits_recalled' ELSE 'unrecalled_hits_present' END AS status FROM ({_NEG})")
def lexicon_negative_control(s, d):
    return L.negative_control(V.table(s, d, "part").select("p_name"), LEXICONS, CHALLENGES, "p_name")


# Decisions follow from a name's length, so that every kind occurs; some recalled names stay undecided.
_DEC = f"SELECT class, code, CASE length(code) % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE 'out_of_stage' END AS decision, 'stage' || CAST(length(code) % 2 AS VARCHAR) AS stage FROM ({_RECALL}) WHERE length(code) % 5 <> 0"
_LEG = "SELECT DISTINCT 'pump' AS class, p_name AS code, 'stage0' AS stage FROM part WHERE length(p_name) % 4 = 0"


def _decisions(s, d):
    n = F.length("code")
    return _recalled(s, d).where(n % 5 != 0).select("class", "code", F.when(n % 3 == 0, "include").when(n % 3 == 1, "exclude").otherwise("out_of_stage").alias("decision"), F.concat(F.lit("stage"), n % 2).alias("stage"))


def _legacy(s, d):
    return V.table(s, d, "part").where(F.length("p_name") % 4 == 0).select(F.lit("pump").alias("class"), F.col("p_name").alias("code"), F.lit("stage0").alias("stage")).distinct()


@query(f"WITH rec AS ({_RECALL}), dec AS ({_DEC}) SELECT (SELECT count(*) FROM rec) AS recalled, (SELECT count(*) FROM dec) AS decided, (SELECT count(*) FROM rec ANTI JOIN dec USING (class, code)) AS undecided, 0 AS unrecalled, 0 AS decided_twice")
def decision_coverage(s, d):
    return L.decision_coverage(_recalled(s, d), _decisions(s, d))


_LEDGER = f"""WITH rec AS ({_RECALL}), dec AS ({_DEC}), leg AS ({_LEG}), led AS (SELECT k.class, k.code, coalesce(dec.decision, 'out_of_stage') AS decision, dec.stage, leg.stage AS previous_stage, CASE WHEN rec.code IS NULL THEN 'legacy_only' WHEN leg.code IS NULL THEN 'recalled_only' ELSE 'both' END AS source,
  coalesce(dec.stage <> leg.stage, false) AS reassigned FROM (SELECT class, code FROM rec UNION SELECT class, code FROM leg) k LEFT JOIN rec USING (class, code) LEFT JOIN leg USING (class, code) LEFT JOIN dec USING (class, code))"""


def _ledger(s, d):
    return L.ledger(_recalled(s, d), _decisions(s, d), _legacy(s, d))


@query(f"{_LEDGER} SELECT * FROM led")
def decision_ledger(s, d):
    return _ledger(s, d)


@query(f"{_LEDGER}, ch AS (SELECT class, code, CASE WHEN length(code) % 2 = 0 THEN decision ELSE 'stale' END AS old, 'include' AS new FROM led WHERE class = 'metal') SELECT led.class, led.code, CASE WHEN ch.old = led.decision THEN ch.new ELSE led.decision END AS decision, (SELECT count(*) FROM ch WHERE old <> 'stale') AS applied, (SELECT count(*) FROM ch WHERE old = 'stale') AS stale FROM led LEFT JOIN ch USING (class, code)")
def apply_change_set(s, d):
    led = _ledger(s, d)
    changes = led.where("class = 'metal'").select("class", "code", F.when(F.length("code") % 2 == 0, F.col("decision")).otherwise("stale").alias("old"), F.lit("include").alias("new"))
    done, counts = L.apply_changes(led, changes)
    return done.select("class", "code", "decision").crossJoin(F.broadcast(counts))
