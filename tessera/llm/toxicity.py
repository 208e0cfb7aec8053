"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, labelled_sample, new_name, one_text, read_table, remainder

_PREFIXES = (3, 4, 5, 6, 7)
#: The share of toxic text that is assumed where the scores cannot tell it.
FALLBACK_PRIOR = 0.05
# ASCII other than letters and digits becomes a space; A-Z become a-z.
_FOLD = bytes(k if k >= 128 or chr(k).isalnum() else 32 for k in range(256)).lower()


def tokens(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(_FOLD).split())


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings of 3 to 7 characters, so that inflected and compounded forms share features."""
    w = word.decode()
    return [b"=" + word, *(w[:k].encode() for k in _PREFIXES if len(w) > k), *([word] if len(w) in _PREFIXES else [])]


class Counted:
    """A text's feature counts as the bytes `feature count feature count ...`, taken apart when they are read: a sample of
    thousands of texts then costs the driver its bytes, and no objects."""

    __slots__ = ("data",)

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.data.split(b" ")[::2] if self.data else ())

    def items(self) -> Iterator[tuple[bytes, int]]:
        x = self.data.split(b" ") if self.data else []
        return zip(x[::2], map(int, x[1::2]), strict=True)


@dataclass
class PUModel:
    weight: dict[bytes, float]
    bias: float

    def margin(self, counts: dict[bytes, int] | Counted) -> float:
        """The log odds of counted features."""
        return self.bias + sum(self.weight[x] * math.log2(1 + n) for x, n in sorted(counts.items()) if x in self.weight)

    def score(self, text: str | None, known: dict[bytes, tuple]) -> float:
        """P(toxic) of the whole text from log2(1 + count) of each feature. known: words met before, and their features."""
        found: Counter = Counter()
        for w, n in tokens(text).items():
            f = known.get(w)
            if f is None:
                if len(known) > 300_000:  # a memory bound only; the features are computed again
                    known.clear()
                f = known[w] = tuple(x for x in features(w) if x in self.weight)
            for x in f:
                found[x] += n
        z = self.bias + sum(self.weight[x] * math.log2(1 + n) for x, n in sorted(found.items()))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def nn_pu(p_rows: list[tuple[list, list]], u_rows: list[tuple[list, list]], dim: int, prior: float, steps: int = 300, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear classifier by the non-negative risk  prior*R_p(+1) + max(0, R_u(-1) - prior*R_p(-1)), logistic loss, Adam.

    p_rows, u_rows: each row's feature indices and values. Where the corrected negative risk falls below zero, the step follows its
    reverse alone, as the estimator prescribes, which keeps the classifier from fitting the positives among the unlabelled.
    """
    def flat(rows):
        return np.array([i for r in rows for i in r[0]], np.int64), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.array([x for r in rows for x in r[1]], np.float64)

    (pi, pr, px), (ui, ur, ux) = flat(p_rows), flat(u_rows)
    w, b = np.zeros(dim + 1), 0.0
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    value = lambda i, r, x, n: np.bincount(r, w[i] * x, n) + w[dim]

    def grad(i, r, x, n, d):
        return np.concatenate([np.bincount(i, d[r] * x, dim), [d.sum()]]) / max(n, 1)

    for k in range(1, steps + 1):
        zp, zu = value(pi, pr, px, len(p_rows)), value(ui, ur, ux, len(u_rows))
        sp, su = (1 / (1 + np.exp(-np.clip(z, -35, 35))) for z in (zp, zu))
        # logistic losses: l(+1) = -log s, l(-1) = -log(1 - s)
        negative = np.mean(-np.log1p(-su + 1e-12)) - prior * np.mean(-np.log1p(-sp + 1e-12))
        g_neg = grad(ui, ur, ux, len(u_rows), su) - prior * grad(pi, pr, px, len(p_rows), sp)
        g = prior * grad(pi, pr, px, len(p_rows), sp - 1) + g_neg if negative >= 0 else -g_neg
        g[:dim] += l2 * w[:dim]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    b = float(w[dim])
    return w[:dim], b


def log_odds(prior: float) -> float:
    return float(np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6))))


def bias_for(margins: np.ndarray, prior: float) -> float:
    """What must be added to the margins of the unlabelled so that their mean score is the prior, by bisection."""
    low, high = -70.0, 70.0
    for _ in range(60):
        middle = (low + high) / 2
        if np.mean(1 / (1 + np.exp(-np.clip(margins + middle, -35, 35)))) < prior:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def fit_rows(positive: list[dict[bytes, int] | Counted], unlabelled: list[dict[bytes, int] | Counted], prior: float, keep: int = 4000, least_gain: float = 5.0, sharpness: float = 2.0) -> PUModel:
    """Choose features by how much more often positives hold them (binomial deviance, at least least_gain), then learn their
    weights.

    The weights are shrunk by the clipped risk and the penalty, so all scores lean to the middle; sharpness multiplies them.
    The bias is set last: the mean score of the unlabelled is the prior. So a text without any known feature scores below
    the prior however few rows there are, and a model without features gives the prior to all.
    """
    if not positive or not unlabelled:
        return PUModel({}, log_odds(prior))
    np_, nu = len(positive), len(unlabelled)
    least = max(2, 0.002 * np_)
    cp = {f: n for f, n in Counter(f for s in positive for f in s).items() if n >= least}
    cu = Counter(f for s in unlabelled for f in s if f in cp)

    def gain(f):
        a, b = cp[f] / np_, (cu[f] + 0.5) / (nu + 1)
        return cp[f] * np.log(a / b) - np_ * (a - b) if a > b else 0.0

    chosen = sorted(((gain(f), f) for f in cp), reverse=True)[:keep]
    names = [f for g, f in chosen if g > least_gain]
    if not names:
        return PUModel({}, log_odds(prior))
    at = {f: i for i, f in enumerate(names)}

    def rows(counts):
        own = [sorted((at[f], math.log2(1 + n)) for f, n in c.items() if f in at) for c in counts]
        return [([i for i, _ in r], [x for _, x in r]) for r in own]

    w, b = nn_pu(rows(positive), rows(unlabelled), len(names), prior)
    model = PUModel(dict(zip(names, map(float, sharpness * w), strict=True)), b)
    model.bias += bias_for(np.array([model.margin(c) for c in unlabelled]), prior)
    return model


def _counted(docs: DataFrame) -> list[Counted]:
    """The feature counts of a bounded sample's texts, counted on the executors."""
    out = pa.schema([("features", pa.binary())])

    def count(text):
        c: Counter = Counter()
        for w, n in tokens(text).items():
            for f in features(w):
                c[f] += n
        return b" ".join(b"%b %d" % x for x in sorted(c.items()))

    def run(batches):
        for b in batches:
            yield batch(out, [count(t) for t in b.column(0).to_pylist()])

    rows = arrow_map(docs.orderBy("doc_id").select("text"), run, "features binary").toArrow()
    return [Counted(x) for x in rows.column(0).to_pylist()]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float | None:
    """The share of positives among the unlabelled, from scores of rows that the scoring model has not seen.

    Above any threshold the unlabelled hold at least the prior times the share that positives hold there, so the smallest
    ratio of the two shares bounds the prior from above and meets it where only positives score so high. Thresholds leave
    at least a fifth of the positives above them, and one standard error is added to the unlabelled's share, as the
    smallest of many ratios leans low by chance. None: the prior is not identified, as the scores do not tell positives from
    the unlabelled at any threshold (no ratio is below a half).
    """
    if not len(positive) or not len(unlabelled):
        return None
    p, u = np.sort(positive), np.sort(unlabelled)
    at = p[: max(1, int(0.8 * len(p)))]
    p_share = 1 - np.searchsorted(p, at, side="left") / len(p)
    u_share = (len(u) - np.searchsorted(u, at, side="left") + 0.5) / (len(u) + 1)
    u_share = u_share + np.sqrt(u_share * (1 - u_share) / len(u))
    least = float((u_share / p_share).min())
    return max(least, 0.001) if least < 0.5 else None


def prior_of(positive: list[dict[bytes, int] | Counted], unlabelled: list[dict[bytes, int] | Counted], guess: float = 0.2) -> float:
    """The class prior by two-fold cross-fitting: each half is scored by a model of the other half.

    FALLBACK_PRIOR where it is not identified, which a half without any telling feature is too.
    """
    scores: tuple[list, list] = ([], [])
    for k in (0, 1):
        model = fit_rows(positive[k::2], unlabelled[k::2], guess)
        if not model.weight:
            return FALLBACK_PRIOR
        for own, rows in zip(scores, (positive, unlabelled), strict=True):
            own += [model.margin(c) for c in rows[1 - k :: 2]]
    found = estimate_prior(np.array(scores[0]), np.array(scores[1]))
    return FALLBACK_PRIOR if found is None else found


def unlabelled_sample(docs: DataFrame, rows: int, folds: int, held: int, most_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, text) of at most `rows` documents outside the held-out remainder, drawn by id hash from the whole corpus.

    No label is looked at: the sample holds both classes as they come. One row an id; null ids are left out.
    """
    own = docs.where(F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held)).groupBy("doc_id").count()
    ids = own.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    return one_text(docs, most_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 1500, unlabelled: int = 3000, folds: int = 5, held: int = 0, prior: float | None = None) -> PUModel:
    """Confirmed toxic rows against unlabelled text of all documents; both bounds are documented, and none is held out.

    prior: the share of toxic text among all documents; by default estimated from the two samples. Negative labels play
    no part.
    """
    toxic = _counted(labelled_sample(docs, labels.where("toxic = 1"), "toxic", positives, folds, held))
    others = _counted(unlabelled_sample(docs, unlabelled, folds, held))
    return fit_rows(toxic, others, prior if prior is not None else prior_of(toxic, others))


def score_toxicity(docs: DataFrame, model: PUModel, text_col: str = "text", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """docs (without its text, unless kept) and the score of every row's whole text.

    Null and wordless texts score by the bias alone. Rows repeat; equal texts score alike; a column of docs that has
    score_col's name is replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in (text_col, score_col)] + [docs.schema[text_col]]
    kept = fields if keep_text else fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{score_col}` double"])
    names = [*(f.name for f in kept), score_col]

    def run(batches):
        known: dict[bytes, tuple] = {}
        for b in batches:
            s = [model.score(t, known) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(s, pa.float64())], names=names)

    return arrow_map(docs.select(*[f"`{f.name}`" for f in fields]), run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold.

    Rows repeat, null ids stay null, null and empty texts score by the bias, a score equal to the threshold goes, an empty
    table gives an empty one, and all columns of docs stay, whatever their names.
    """
    score = new_name(docs, "score")
    scored = score_toxicity(docs, fit_toxicity(docs, labels), score_col=score, keep_text=True)
    return scored.where(F.col(score) < threshold).select(*[f"`{c}`" for c in docs.columns])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows at the edge: see score_toxicity; 0.5 counts as 1."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
