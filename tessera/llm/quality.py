"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, labelled_sample, new_name, read_table, remainder

# Classes of bytes that a line's features count.
_CLASSES = [rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[#*$%&<>]", rb"\|", rb"!", rb"[.,;:?]", rb"[\x80-\xff]", rb"[ \t]"]
_TABLE = np.array([[bool(re.match(c, bytes([k]))) for k in range(256)] for c in _CLASSES])
N_BASE = len(_CLASSES) + 4
N_FEATURES = 1 + 3 * N_BASE


def base_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes, lines of each text). Every text has at least one line, maybe empty."""
    raw = [(t or "").encode() for t in texts]
    split = [r.split(b"\n") for r in raw]
    n_lines = np.array([len(s) for s in split], np.int64)
    lines = [x for s in split for x in s]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(length[:-1] + 1)]).astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    out = np.empty((len(lines), N_BASE), np.float32)
    size = np.maximum(length, 1)
    for k in range(len(_CLASSES)):
        out[:, k] = np.add.reduceat(_TABLE[k].view(np.uint8)[buffer], starts, dtype=np.int32) / size if len(lines) else 0
    out[:, -4] = np.log1p(length) / 8
    # share of words that repeat the word before
    parts = [x.split() for x in lines]
    out[:, -3] = [sum(map(operator.eq, w, w[1:])) / len(w) if w else 0.0 for w in parts]
    repeated = np.zeros(len(lines), bool)
    end = 0
    for s in split:
        seen: set[bytes] = set()
        for i, x in enumerate(s, end):
            if x in seen and x:
                repeated[i] = True
            seen.add(x)
        end += len(s)
    out[:, -2] = repeated
    out[:, -1] = length == 0
    return out, length, n_lines


def with_neighbours(base: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Constant, own features, those of the line before and of the line after (zero outside the text)."""
    n = len(base)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(n_lines)[:-1]])[: len(n_lines)].astype(int)] = n > 0
    last = np.roll(first, -1)
    before, after = np.roll(base, 1, axis=0), np.roll(base, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((n, 1), np.float32), base, before, after], axis=1)


@dataclass
class LineField:
    """Two states, 0 good and 1 bad: weights of the bad state's features, transition scores, doc calibration."""

    w: np.ndarray
    t: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, n_lines: np.ndarray, pairs: bool = False):
        """Posterior of bad for each line (and the sums of pair posteriors, 2 x 2) by scaled forward-backward.

        All texts of a batch advance together, longest first, so a step is one vector operation.
        """
        score = np.clip(x @ self.w, -30, 30).astype(np.float64)
        node = np.stack([1 / (1 + np.exp(score)), 1 / (1 + np.exp(-score))], axis=1)
        step = np.exp(self.t)
        order = np.argsort(-n_lines, kind="stable")
        begin = np.concatenate([[0], np.cumsum(n_lines)[:-1]])[order].astype(np.int64)
        count = n_lines[order]
        longest = int(count[0]) if len(count) else 0
        alive = np.searchsorted(-count, -np.arange(longest), side="left")
        forward, backward = np.empty_like(node), np.ones_like(node)
        for k in range(longest):
            at = begin[: alive[k]] + k
            a = node[at] if k == 0 else (forward[at - 1] @ step) * node[at]
            forward[at] = a / a.sum(axis=1, keepdims=True)
        total = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            at = begin[: alive[k + 1]] + k
            right = node[at + 1] * backward[at + 1]
            b = right @ step.T
            if pairs:
                joint = forward[at][:, :, None] * step[None] * right[:, None, :]
                total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward[at] = b / b.sum(axis=1, keepdims=True)
        post = forward * backward
        bad = post[:, 1] / post.sum(axis=1)
        return (bad, total) if pairs else bad

    def score(self, bad: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Quality of each text: its lines' good marginals weighted by length (an empty line weighs one byte), calibrated."""
        starts = np.concatenate([[0], np.cumsum(n_lines)[:-1]]).astype(np.int64)
        weight = np.maximum(length, 1).astype(np.float64)
        good = np.add.reduceat((1 - bad) * weight, starts) / np.add.reduceat(weight, starts)
        a, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * _logit(good) + c, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_field(base: np.ndarray, length: np.ndarray, n_lines: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 120, l2: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by Adam. Lines begin with their document's label; after each round, lines of a bad
    document that the field takes for good become good, but its worst line, so that clean lines in bad documents are learnt."""
    x = with_neighbours(base, n_lines)
    doc_of = np.repeat(np.arange(len(n_lines)), n_lines)
    doc_bad = label == 0
    y = doc_bad[doc_of].astype(np.float64)
    share = max(float(doc_bad.mean()), 1e-9) if len(label) else 1.0
    # classes weigh alike; a document's lines share its weight by length, as in the score
    weight = np.maximum(length, 1) / np.maximum(np.bincount(doc_of, np.maximum(length, 1), len(n_lines)), 1)[doc_of]
    weight = weight * np.where(doc_bad[doc_of], 0.5 / share, 0.5 / max(1 - share, 1e-9))
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(x) or doc_bad.all() or not doc_bad.any():
        # one class only: the calibrated constant is its share
        field.calibration = (0.0, float(_logit(np.array([1 - share if len(label) else 0.5]))[0]))
        return field
    inner = np.ones(len(x) - 1, bool)
    inner[np.cumsum(n_lines)[:-1] - 1] = False
    for r in range(rounds):
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
        for k in range(1, steps + 1):
            bad, pair = field.marginals(x, n_lines, pairs=True)
            g = np.concatenate([x.T @ (weight * (bad - y)) / len(n_lines) + l2 * field.w, ((pair - seen) / max(inner.sum(), 1)).ravel() + l2 * field.t.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            field.w = field.w - move[: x.shape[1]]
            field.t = field.t - move[x.shape[1] :].reshape(2, 2)
        bad = field.marginals(x, n_lines)
        if r < rounds - 1:
            y = (doc_bad[doc_of] & (bad >= 0.5)).astype(np.float64)
            worst = np.lexsort((bad, doc_of))[np.cumsum(n_lines) - 1]
            y[worst[doc_bad]] = 1.0
    good = field.score(bad, length, n_lines)
    z = _logit(good)
    a, c = 1.0, 0.0
    for _ in range(400):
        e = (1 / (1 + np.exp(-np.clip(a * z + c, -35, 35))) - label) / len(label)
        a, c = a - 0.5 * float(e @ z), c - 2.0 * float(e.sum())
    field.calibration = (max(a, 1e-3), c)
    return field


def line_features(docs: DataFrame) -> DataFrame:
    """(label, features, length): the sampled documents' line features as packed arrays, so texts stay on the executors."""
    out = pa.schema([("label", pa.int32()), ("features", pa.binary()), ("length", pa.binary())])

    def run(batches):
        for b in batches:
            base, length, n = base_features(b.column(0).to_pylist())
            ends = np.cumsum(n)
            yield batch(out, b.column(1), [base[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], [length[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)])

    return arrow_map(docs.select("text", F.col("label").cast("int")), run, "label int, features binary, length binary")


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 3, held: int = 1, label: str = "quality") -> LineField:
    """Fit on at most per_class labelled documents of each class (a documented bound), none of them held out."""
    rows = line_features(labelled_sample(docs, labels, label, per_class, folds, held).orderBy("doc_id")).collect()
    base = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, N_BASE)
    length = np.frombuffer(b"".join(r.length for r in rows), np.int64)
    return fit_field(base, length, np.array([len(r.length) // 8 for r in rows], np.int64), np.array([r.label for r in rows], np.float64))


def score_quality(docs: DataFrame, field: LineField, text_col: str = "text", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """docs (without its text, unless kept) and the score: every row is scored over its whole text.

    Null counts as empty, which is one empty line. Rows repeat; equal texts score alike; a column of docs that has
    score_col's name is replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in (text_col, score_col)] + [docs.schema[text_col]]
    kept = fields if keep_text else fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{score_col}` double"])
    names = [*(f.name for f in kept), score_col]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                base, length, n = base_features(part.column(part.num_columns - 1).to_pylist())
                s = field.score(field.marginals(with_neighbours(base, n), n), length, n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(s)], names=names)

    return arrow_map(docs.select(*[f"`{f.name}`" for f in fields]), run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose quality score reaches the threshold.

    Rows repeat, null ids stay null, null and empty texts are scored as one empty line, a score equal to the threshold
    stays, an empty table gives an empty one, and all columns of docs stay, whatever their names.
    """
    score = new_name(docs, "score")
    scored = score_quality(docs, fit_quality(docs, labels), score_col=score, keep_text=True)
    return scored.where(F.col(score) >= threshold).select(*[f"`{c}`" for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows at the edge: see score_quality; a score of 0.5 counts as 1."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


__all__ = ["LineField", "fit_field", "fit_quality", "keep_good", "op2_quality", "score_quality"]
