"""Rule-based quality, lines first: failing lines are removed, then documents that lose too much text are rejected."""

from __future__ import annotations

import operator
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, read_table

#: Separators of words, symbols, and phrases of boilerplate lines (lower case).
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "read more", "sign in", "log in", "subscribe to", "share this", "lorem ipsum"]

_ENDED = re.compile(rb"[.!?][\"')\]]*[\x20\x09-\x0D]*\Z")
_UPPER, _LOWER = re.compile(rb"[A-Z]"), re.compile(rb"[a-z]")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())

LOST_PERCENT = 40
RULES = ["punctuation", "navigation", "symbols", "capitals", "repeats", "boilerplate"]


def line_failures(line: bytes, words: list[bytes]) -> list[str]:
    """The rules that a line with a word fails."""
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    failed = [
        not _ENDED.search(line),  # a sentence's end, maybe with closing quotes or brackets after it
        line.count(b"|") >= 3,  # items between bars: a menu, a trail or a table row
        symbols * 4 > len(words),
        len(words) >= 3 and bool(_UPPER.search(line)) and not _LOWER.search(line),
        3 * sum(map(operator.eq, words, words[1:])) > len(words),  # words that repeat the one before
        bool(_BOILER.search(line.lower())),
    ]
    return [r for r, f in zip(RULES, failed, strict=True) if f]


def repeated_words(w: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more in the text."""
    windows = list(zip(w, w[1:], w[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside = bytearray(len(w))
    for i, x in enumerate(windows):
        if counts[x] > 1:
            inside[i : i + 3] = b"\x01\x01\x01"
    return sum(inside)


def measure(text: str | None) -> dict:
    """Counts, the cleaned text and the verdict of one text; null has no words."""
    text = text or ""
    data = text.encode()
    w = data.split()
    seen: set[bytes] = set()
    n_dup, lost, total, kept_lines, failures = 0, 0, 0, [], Counter()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            kept_lines.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        failed = line_failures(line, words)
        size = len(line) if line.isascii() else len(line.decode())
        total += size
        if failed:
            lost += size
            failures.update(failed)
        else:
            kept_lines.append(line)
    n_repeat = repeated_words(w)
    base_failed = len(w) < 50 or 100 * n_repeat > 50 * len(w)
    return {
        "n_words": len(w),
        "word_chars": len(text) - len(data) + len(data.translate(None, SPACE)),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "lost_chars": lost,
        "line_chars": total,
        "kept": not base_failed and 100 * lost <= LOST_PERCENT * total,
        "cleaned": b"\n".join(kept_lines).decode(),
        "failures": dict(failures),
    }


_COLUMNS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "lost_chars": "bigint", "line_chars": "bigint", "kept": "boolean"}


def apply_rules(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The columns of docs without its text, the measures, and cleaned: the text without its failing lines.

    One map over the rows, so no group or key is gathered anywhere; rows repeat and nulls stay in the other columns.
    """
    fields = [f for f in docs.schema.fields if f.name not in (text_col, "cleaned", *_COLUMNS)]
    columns = _COLUMNS | ({"cleaned": "string"} if with_text else {})
    types = [pa.bool_() if t == "boolean" else pa.string() if t == "string" else pa.int64() for t in columns.values()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{k} {t}" for k, t in columns.items()])

    def run(batches):
        for b in batches:
            rows = [measure(t) for t in b.column(b.num_columns - 1).to_pylist()]
            new = [pa.array([r[k] for r in rows], t) for k, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], *columns])

    return arrow_map(docs.select(*[f.name for f in fields], text_col), run, schema)


def op3_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: its counts, base_failed and kept.

    Null and empty texts have no words and fail the base; repeated rows repeat, null ids stay, an empty table gives none.
    """
    rows = apply_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT r, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), inside AS (
  SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r
), lines AS (
  SELECT r, l, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS l FROM d)
), judged AS (
  SELECT r, l, line, length(line) AS size,
         row_number() OVER (PARTITION BY r, line ORDER BY l) > 1 AS dup,
         NOT regexp_matches(line, '[.!?]["'')\]]*[\x20\x09-\x0D]*$')
         OR length(regexp_replace(line, '[^|]', '', 'g')) >= 3
         OR 4 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(lw)
         OR (len(lw) >= 3 AND regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]'))
         OR 3 * len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i+1])) > len(lw)
         OR regexp_matches(line, '(?i){"|".join(BOILERPLATE)}') AS failed
  FROM lines WHERE len(lw) > 0
), per_doc AS (
  SELECT r, sum(dup::INT)::BIGINT AS n_dup, sum(size) AS total, sum(CASE WHEN failed THEN size ELSE 0 END) AS lost FROM judged GROUP BY r
), base AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN inside USING (r) LEFT JOIN per_doc USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {LOST_PERCENT} * total AS kept
FROM base
"""
