"""Baselines fitted on a historical fold and frozen before a later fold is scored."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import average_precision
from .rank import exact_quantiles


def gravity_ppml(dyads: DataFrame, continuous: list[str], flags: list[str], value: str = "v", group: str = "stage", reg: float = 1e-4, passes: int = 25) -> DataFrame:
    """dyads with grav: Poisson pseudo-likelihood fit of flows (in millions, zeros included) for each group.

    Each group has coefficients of its own. All groups are fitted together: a pass over the dyads gives every group's
    gradient, curvature and objective as sums, of one row a group, and a Newton step follows on the driver; a step that
    made a group's objective worse is halved. The penalty is on the mean objective and spares the intercept. Groups are
    registry stages, few and known; one without any flow gets null. Raises if a group has not converged after the passes.
    """
    names = [*(f"z_{c}" for c in continuous), *flags, "__1"]
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    stats = dyads.agg(*[f(c).alias(f"{n}_{c}") for c in continuous for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = dyads.withColumns({f"z_{c}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit((stats[f"s_{c}"] or 0.0) + 1e-9) for c in continuous} | {"__y": F.col(value) / 1e6, "__1": F.lit(1.0)})
    fits = {r[0]: _Poisson(r["n"], r["s"], d) for r in z.groupBy(group).agg(F.count("*").alias("n"), F.sum("__y").alias("s")).where("s > 0").collect()}
    eta = lambda: reduce(lambda a, b: a + b, [F.col(n) * F.col("__beta")[k] for k, n in enumerate(names)])

    def joined(kind: str, of: dict):
        table = dyads.sparkSession.createDataFrame([(g, m.beta.tolist()) for g, m in of.items()], f"__g {dyads.schema[group].dataType.simpleString()}, __beta array<double>")
        return z.join(F.broadcast(table), F.col(group) == F.col("__g"), kind)

    for _ in range(passes):
        moving = {g: m for g, m in fits.items() if not m.done}
        if not moving:
            break
        x = joined("inner", moving).withColumn("__eta", eta()).withColumn("__mu", F.exp("__eta"))
        sums = x.groupBy(group).agg(
            F.sum(F.col("__mu") - F.col("__y") * F.col("__eta")).alias("loss"), *[F.sum((F.col("__mu") - F.col("__y")) * F.col(n)).alias(f"g{k}") for k, n in enumerate(names)],
            *[F.sum(F.col("__mu") * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs],
        )
        for r in sums.collect():
            fits[r[group]].move(r, pairs, reg)
    late = sorted(str(g) for g, m in fits.items() if not m.done)
    if late:
        raise ValueError(f"no convergence after {passes} passes: {late[:5]}")
    return (joined("left", fits) if fits else z.withColumn("__beta", F.lit(None).cast("array<double>"))).select(*dyads.columns, F.exp(eta()).alias("grav"))


class _Poisson:
    """A group's coefficients on their way: the point of least objective so far, and the point that is tried."""

    def __init__(self, n: int, total: float, d: int) -> None:
        self.n, self.loss, self.done = n, math.inf, False
        self.beta = np.zeros(d)
        self.beta[-1] = math.log(total / n)
        self.best, self.step = self.beta, None

    def move(self, r, pairs: list[tuple[int, int]], reg: float) -> None:
        d = len(self.beta)
        penalty = np.r_[np.full(d - 1, reg), 0.0]
        loss = r["loss"] / self.n + (penalty * self.beta**2).sum() / 2
        if not loss <= self.loss + 1e-12 * abs(loss):
            self.step = self.step / 2
        else:
            h = np.diag(penalty)
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"] / self.n + (penalty[i] if i == j else 0.0)
            g = np.array([r[f"g{k}"] for k in range(d)]) / self.n + penalty * self.beta
            self.best, self.loss, self.step = self.beta, loss, np.linalg.lstsq(h, g, rcond=None)[0]
        self.done = bool(np.abs(self.step).max() < 1e-9)
        self.beta = self.best - self.step


@dataclass
class Frozen:
    """Everything learned on history: medians of features, those with a missing flag, and the fitted model."""

    features: list[str]
    medians: dict[str, float]
    flagged: list[str]
    choice: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Median imputation with history's medians; a flag only for features that were missing in history."""
        miss = {f"{c}__missing": F.col(c).isNull().cast("double") for c in self.flagged}
        return df.withColumns(miss | {f"{c}__filled": F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.features})

    @property
    def inputs(self) -> list[str]:
        return [*[f"{c}__filled" for c in self.features], *[f"{c}__missing" for c in self.flagged]]


def freeze_medians(history: DataFrame, features: list[str]) -> Frozen:
    """Exact medians of history, 0 where a feature is all missing."""
    missing = history.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    return Frozen(features, {c: float(exact_quantiles(history, c, [0.5])[0] or 0.0) for c in features}, [c for c in features if missing[c]])


def raw_scores(frozen: Frozen, df: DataFrame, feature: str) -> DataFrame:
    """A raw feature as score, missing values at history's median."""
    return df.withColumn("score", F.coalesce(F.col(feature), F.lit(frozen.medians[feature])))


def group_folds(df: DataFrame, group: str, label: str, most: int = 5, salt: str = "fold") -> tuple[DataFrame, int]:
    """(df with fold, number of folds): whole groups, dealt in turn in order of their positives, then size, then hash.

    So folds hold about as many positives each. From 5 folds down to 2 until each has both classes; if none has, that is
    an error, as no model could be chosen.
    """
    from ..functions.shared import global_rank, stored

    sizes = df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("__p"), F.count("*").alias("__n"))
    order = [F.col("__p").desc(), F.col("__n").desc(), F.sha2(F.concat_ws("|", F.lit(salt), group), 256).asc(), F.col(group).asc()]
    placed = stored(global_rank(sizes, order, "__place"), "groups")
    for k in range(most, 1, -1):
        fold = ((F.col("__place") - 1) % k).cast("int")
        both = placed.groupBy(fold.alias("fold")).agg(F.sum("__p").alias("p"), F.sum("__n").alias("n")).where("p > 0 and p < n").count()
        if both == k:
            return df.join(placed.select(group, fold.alias("fold")), group), k
    raise ValueError("no number of folds has both classes in each")


def _standard(rows: DataFrame, inputs: list[str], by: list[str]) -> list:
    """Per group: count, positives, and each input's sum and sum of squares."""
    x = lambda c: F.col(c).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("__y").alias("p"), *[F.sum(x(c)).alias(f"s_{c}") for c in inputs], *[F.sum(x(c) * x(c)).alias(f"q_{c}") for c in inputs]).collect()


@dataclass
class Logistic:
    """A balanced logistic regression over standardised inputs; the intercept, last, is penalised like the weights."""

    name: int
    fold: int
    reg: float
    mean: list[float]
    sd: list[float]
    weights: tuple[float, float]
    beta: list[float]

    @classmethod
    def over(cls, name: int, fold: int, reg: float, stats: list, inputs: list[str]) -> Logistic:
        total = lambda c: sum(r[c] for r in stats)
        n, p = total("n"), total("p")
        mean = [total(f"s_{c}") / max(n, 1) for c in inputs]
        sd = [math.sqrt(max(total(f"q_{c}") / max(n, 1) - m * m, 0.0)) for c, m in zip(inputs, mean, strict=True)]
        return cls(name, fold, reg, mean, [s if s > 1e-12 else 1.0 for s in sd], (n / (2 * max(n - p, 1)), n / (2 * max(p, 1))), [0.0] * (len(inputs) + 1))


def _arrays(b, inputs: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Inputs, labels and folds of a batch."""
    x, y, fold = b.columns[:inputs], b.column(inputs), b.column(inputs + 1)
    return [c.to_numpy(zero_copy_only=False) for c in x], y.to_numpy(zero_copy_only=False), fold.to_numpy(zero_copy_only=False)


def _sums(rows: DataFrame, models: list[Logistic], inputs: list[str]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each model, over the rows that it learns from: loss, gradient and curvature, without the penalty.

    A task keeps one matrix of sums for all models, so rows do not meet models in a join. Sums are taken over inputs
    standardised alike for all models, and turned to each model's own standardisation, which is linear, on the driver.
    """
    d = len(inputs) + 1
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    mean, sd = np.array(models[0].mean), np.array(models[0].sd)
    turn = []
    for m in models:
        own = np.eye(d)
        own[np.arange(d - 1), np.arange(d - 1)] = sd / np.array(m.sd)
        own[:-1, -1] = (mean - np.array(m.mean)) / np.array(m.sd)
        turn.append(own)
    beta = np.stack([t.T @ np.array(m.beta) for t, m in zip(turn, models, strict=True)], 1)
    held, weights = np.array([m.fold for m in models]), np.array([m.weights for m in models]).T

    def run(batches):
        total = np.zeros((1 + d + len(pairs), len(models)))
        for b in batches:
            x, y, fold = _arrays(b, d - 1)
            z = np.stack([*((c - m) / s for c, m, s in zip(x, mean, sd, strict=True)), np.ones(len(y))], 1)
            eta = z @ beta
            t = np.exp(-np.abs(eta))
            mu = np.where(eta >= 0, 1.0, t) / (1 + t)
            w = np.where((y == 1)[:, None], weights[1], weights[0]) * (fold[:, None] != held)
            total[0] += (w * (np.maximum(eta, 0) + np.log1p(t) - y[:, None] * eta)).sum(0)
            total[1 : 1 + d] += z.T @ (w * (mu - y[:, None]))
            total[1 + d :] += np.stack([z[:, i] * z[:, j] for i, j in pairs]) @ (w * mu * (1 - mu))
        k, m = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(m.ravel(), pa.int32()), pa.array(total.ravel())], names=["k", "m", "v"])

    total = np.zeros((1 + d + len(pairs), len(models)))
    for r in rows.select(*[F.col(c).cast("double") for c in inputs], "__y", "fold").where("__y is not null").mapInArrow(run, "k int, m int, v double").groupBy("k", "m").agg(F.sum("v").alias("v")).collect():
        total[r.k, r.m] = r.v
    out = {}
    for at, (m, t) in enumerate(zip(models, turn, strict=True)):
        h = np.zeros((d, d))
        for (i, j), v in zip(pairs, total[1 + d :, at], strict=True):
            h[i, j] = h[j, i] = v
        out[m.name] = total[0, at], t @ total[1 : 1 + d, at], t @ h @ t.T
    return out


def fit_logistics(rows: DataFrame, models: list[Logistic], inputs: list[str], steps: int = 50) -> None:
    """Newton's method for all models at once: each step is one pass over the rows, which sums gradients and curvatures.

    The sums are of the inputs' products, so they are the same size whatever the number of rows. A step that made a model's
    penalised loss worse is halved; models that are done take part no more. Raises if one is not done after the steps.
    rows: inputs, __y, fold.
    """
    d = len(inputs) + 1
    at = {m.name: (np.array(m.beta), math.inf, None) for m in models}
    moving = models
    for _ in range(steps):
        found = _sums(rows, moving, inputs)
        left = []
        for m in moving:
            (best, least, step), (loss, g, h), beta = at[m.name], found[m.name], np.array(m.beta)
            now = loss + m.reg * float(beta @ beta) / 2
            if now <= least + 1e-12 * abs(now):
                best, least, step = beta, now, np.linalg.solve(h + m.reg * np.eye(d), g + m.reg * beta)
            else:
                step = step / 2
            at[m.name] = (best, least, step)
            m.beta = (best - step).tolist()
            if not np.abs(step).max() < 1e-8:
                left.append(m)
        moving = left
        if not moving:
            return
    raise ValueError(f"no convergence after {steps} steps: {[(m.name, m.fold, m.reg) for m in moving[:5]]}")


def held_out_scores(rows: DataFrame, models: list[Logistic], inputs: list[str]) -> DataFrame:
    """(name, y, score): each row by the models that held it out. Place by place in a fixed order, so equal rows tie."""

    def run(batches):
        for b in batches:
            x, y, fold = _arrays(b, len(inputs))
            for m in models:
                own = fold == m.fold
                n = int(own.sum())
                if n:
                    score = sum(((c[own] - a) / s * w for c, a, s, w in zip(x, m.mean, m.sd, m.beta, strict=False)), np.zeros(n)) + m.beta[-1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m.name, np.int32)), pa.array(y[own].astype(np.int32)), pa.array(score)], names=["name", "y", "score"])

    return rows.select(*[F.col(c).cast("double") for c in inputs], "__y", "fold").where("__y is not null").mapInArrow(run, "name int, y int, score double")


@dataclass
class FrozenLogistic(Frozen):
    logistic: Logistic | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """df with score; no label is read."""
        m = self.logistic
        terms = [(F.col(c).cast("double") - F.lit(a)) / F.lit(s) * F.lit(w) for c, a, s, w in zip(self.inputs, m.mean, m.sd, m.beta, strict=False)]
        eta = reduce(lambda a, b: a + b, terms) + F.lit(m.beta[-1])
        return self.prepare(df).withColumn("score", 1 / (1 + F.exp(-eta))).select(*df.columns, "score")


def fit_logistic(frozen: Frozen, history: DataFrame, label: str, c: float) -> FrozenLogistic:
    """Balanced logistic regression of inverse penalty c over the frozen features, fitted on all of history."""
    from ..functions.shared import stored

    rows = stored(frozen.prepare(history).select(*frozen.inputs, F.col(label).cast("double").alias("__y"), F.lit(0).alias("fold")), "fit")
    model = Logistic.over(0, -1, 1 / c, _standard(rows, frozen.inputs, ["fold"]), frozen.inputs)
    fit_logistics(rows, [model], frozen.inputs)
    return FrozenLogistic(frozen.features, frozen.medians, frozen.flagged, logistic=model)


def logistic_select(history: DataFrame, features: list[str], label: str, group: str, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> Frozen:
    """Balanced logistic regression; C by grouped cross-validation, smaller C on ties; refit on all of history.

    All models of the grid and folds are fitted together, so a step of all of them reads the rows once.
    """
    from ..functions.shared import stored

    frozen = freeze_medians(history, features)
    rows, k = group_folds(history, group, label)
    rows = stored(frozen.prepare(rows).select(*frozen.inputs, F.col(label).cast("double").alias("__y"), "fold"), "folds")
    stats = _standard(rows, frozen.inputs, ["fold"])
    models = [Logistic.over(i * k + f, f, 1 / c, [r for r in stats if r["fold"] != f], frozen.inputs) for i, c in enumerate(sorted(grid)) for f in range(k)]
    fit_logistics(rows, models, frozen.inputs)
    ap = {r["name"]: r.average_precision or 0.0 for r in average_precision(held_out_scores(rows, models, frozen.inputs), "y", "score", ["name"]).collect()}
    means = [sum(ap[i * k + f] for f in range(k)) / k for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: (round(means[i], 12), -i))
    chosen = fit_logistic(frozen, history, label, sorted(grid)[best])
    chosen.choice = {"C": sorted(grid)[best], "folds": k, "cv_average_precision": means[best]}
    return chosen


def latent_factors(lanes: DataFrame, pairs: DataFrame, rank: int = 8, seed: int = 7) -> DataFrame:
    """pairs (i_iso, stage, j_iso) with score: implicit-feedback factors of exporters against (stage, importer) items."""
    from .graph import entity_ids

    item = F.concat_ws("|", "stage", "j_iso")
    both = lanes.select(F.col("i_iso").alias("head"), item.alias("tail")).unionByName(pairs.select(F.col("i_iso").alias("head"), item.alias("tail")))
    ids = entity_ids(both).withColumn("id", F.col("id").cast("int"))
    coded = lambda df: df.withColumn("item", item).join(ids.toDF("i_iso", "u"), "i_iso").join(ids.toDF("item", "v_id"), "item")
    model = ALS(rank=rank, maxIter=6, regParam=0.1, implicitPrefs=True, alpha=10.0, userCol="u", itemCol="v_id", ratingCol="r", seed=seed, coldStartStrategy="nan").fit(coded(lanes.withColumn("r", F.lit(1.0))))
    return model.transform(coded(pairs)).select("i_iso", "stage", "j_iso", F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0)).cast("double").alias("score"))
