"""Ranking metrics: tie-exact average precision, AUC, budgets, shortlists, value gaps, two-stage retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import _starts, exact_sum, stored
from .rank import canonical, quantile_bins, score_blocks, top_k, top_k_per_group


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def average_precision(df: DataFrame, label: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Tie-block average precision of each group; null without positives.

    Rows are combined by score in the tasks and dealt by range once. Only scores that a positive has add to the sum, so each
    piece gives back those alone, with the counts above them within the piece, and its totals.
    """
    group = group or []
    if df.schema[score].dataType.typeName() != "double":
        return weighted_average_precision(df.withColumn("__w", F.lit(1.0)), label, score, "__w", group, null_if_one_class=False)
    # the range's sample reads the rows too; a sum with zero makes both zeros one
    rows = stored(df.select(*group, (F.col(score) + F.lit(0.0)).alias("__s"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("__p")), "scored")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in group]
    combined = rows.mapInArrow(_combined([*group, "__s"]), ", ".join([*fields, "__s double, __p double, __n bigint"]))
    order = [*[F.col(g).asc() for g in group], F.col("__s").desc()]
    ranked = combined.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(ranked.mapInArrow(_precision_blocks(group), ", ".join([*fields, "__piece int, __whole boolean, __p double, __cp double, __cn double"])), "positives")
    # one row a piece and group in it
    totals = blocks.where("__whole").select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("__piece").alias("__at"), F.col("__cp").alias("__tp"), F.col("__cn").alias("__tn"))
    before = Window.partitionBy(*[f"__of_{g}" for g in group]).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    totals = totals.withColumns({"__op": above("__tp"), "__on": above("__tn")})
    on = [F.col("__piece") == F.col("__at"), *[F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in group]]
    each = F.when(~F.col("__whole"), F.col("__p") * (F.col("__op") + F.col("__cp")) / (F.col("__on") + F.col("__cn")))
    sums = blocks.join(totals, on).groupBy(*group).agg(exact_sum(each, 18).alias("__s"), F.sum(F.when(F.col("__whole"), F.col("__cp"))).alias("__p"))
    return sums.select(*group, F.when(F.col("__p") > 0, F.coalesce("__s", F.lit(0.0)) / F.col("__p")).alias("average_precision"))


def _combined(keys: list[str], most: int = 200_000):
    """A task's rows combined by their keys, as far as `most` rows together have them."""

    def run(batches):
        held, n = [], 0

        def done():
            t = pa.Table.from_batches(held).group_by(keys).aggregate([("__p", "sum"), ("__p", "count")])
            yield from t.rename_columns([*t.column_names[:-2], "__p", "__n"] if t.column_names[-1] == "__p_count" else ["__p", "__n", *t.column_names[2:]]).select([*keys, "__p", "__n"]).to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                yield from done()
                held, n = [], 0
        if n:
            yield from done()

    return run


def _precision_blocks(group: list[str]):
    """Of sorted rows: each score with positives, its positives and what the piece has down to it; each group's totals in the piece."""

    def run(batches):
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId()
        carry, cp, cn = None, 0.0, 0.0  # the open block, and the group's counts before it

        def out(keys, whole, p, c_p, c_n):
            n = len(p)
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(n, piece, np.int32)), pa.array(np.full(n, whole)), pa.array(p), pa.array(c_p), pa.array(c_n)], names=[*group, "__piece", "__whole", "__p", "__cp", "__cn"])

        def closed(b, last):
            """Blocks of the rows, the last one left open unless there are no more."""
            nonlocal carry, cp, cn
            k = len(group)
            edges = _starts(b, list(range(k))) if k else [0]
            s = b.column(k)
            void, s = s.is_null().to_numpy(zero_copy_only=False), s.fill_null(0.0).to_numpy()
            new = np.ones(len(s), bool)
            new[1:] = ~(((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))) & (void[1:] == void[:-1]))
            new[edges] = True
            starts = np.flatnonzero(new)
            p, n = (np.add.reduceat(b.column(c).to_numpy().astype(np.float64), starts) for c in (k + 1, k + 2))
            for lo, hi in zip(edges, [*edges[1:], len(s)], strict=True):
                i, j = np.searchsorted(starts, [lo, hi])
                open_ = hi == len(s) and not last
                m = j - 1 if open_ else j
                c_p, c_n = cp + np.cumsum(p[i:m]), cn + np.cumsum(n[i:m])
                found = np.flatnonzero(p[i:m] > 0)
                if len(found):
                    yield out([b.column(c).take(pa.array(starts[i:m][found])) for c in range(k)], False, p[i:m][found], c_p[found], c_n[found])
                if m > i:
                    cp, cn = c_p[-1], c_n[-1]
                if open_:
                    row = b.slice(starts[m], 1)
                    carry = pa.RecordBatch.from_arrays([*row.columns[: k + 1], pa.array([p[m]]), pa.array([int(n[m])])], names=row.schema.names)
                else:
                    yield out([b.column(c).slice(lo, 1) for c in range(k)], True, np.zeros(1), np.array([cp]), np.array([cn]))
                    cp, cn = 0.0, 0.0

        for b in batches:
            if b.num_rows:
                yield from closed(b if carry is None else pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(carry.columns, b.columns, strict=True)], names=b.schema.names), False)
        if carry is not None:
            yield from closed(carry, True)

    return run


def weighted_average_precision(df: DataFrame, label: str, score: str, weight: str, group: list[str] | None = None, null_if_one_class: bool = True) -> DataFrame:
    """Average precision with row weights; null if positives (or, by default, either class) have no weight."""
    group = group or []
    blocks = score_blocks(df, score, {"p": F.col(label) * F.col(weight), "n": F.col(weight)}, group)
    sums = blocks.groupBy(*group).agg(exact_sum(F.when(F.col("c_n") > 0, F.col("p") * F.col("c_p") / F.col("c_n")), 18).alias("__s"), F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    defined = (F.col("__p") > 0) & ((F.col("__n") > F.col("__p")) | F.lit(not null_if_one_class))
    return sums.select(*group, F.when(defined, F.col("__s") / F.col("__p")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC from midranks, over one row a distinct score; null without both classes. Rows without a score are
    left out."""
    group = group or []
    blocks = score_blocks(df.where(F.col(score).isNotNull()), score, {"n": F.lit(1).cast("long"), "p": _long(label)}, group, descending=False)
    # twice the midrank is whole, so the sum is exact in any order
    twice = F.col("p") * (2 * F.col("c_n") - F.col("n") + 1)
    ranked = blocks.groupBy(*group).agg(F.sum(twice.cast("decimal(38,0)")).alias("__r"), F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    pairs = F.col("__p").cast("double") * (F.col("__n") - F.col("__p"))
    return ranked.select(*group, F.when(pairs > 0, (F.col("__r") - F.col("__p").cast("decimal(19,0)") * (F.col("__p") + 1).cast("decimal(19,0)")).cast("double") / 2 / pairs).alias("auc"))


def within_bin_auc(df: DataFrame, label: str, score: str, size: str, bins: int = 10, least: int = 3) -> DataFrame:
    """Row-weighted AUC over size bins with at least `least` of each class."""
    binned = quantile_bins(df, size, bins)
    counts = binned.groupBy("bin").agg(F.sum(_long(label)).alias("p"), F.count("*").alias("n"))
    valid = counts.where((F.col("p") >= least) & (F.col("n") - F.col("p") >= least))
    aucs = roc_auc(binned.join(F.broadcast(valid.select("bin")), "bin"), label, score, ["bin"]).join(valid, "bin")
    found = aucs.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc"), F.count("*").alias("valid_bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_valid_bins"))
    return found.crossJoin(counts.agg(F.count("*").alias("formed_bins")))


def budget_metrics(df: DataFrame, label: str, value: str, order: list[Column], budgets: list[int]) -> DataFrame:
    """(k, effective, found, precision, recall, value_captured) of the first k rows, for each budget.

    Only the largest budget's rows are ranked, so the ranking fits one task whatever the table's size.
    """
    totals = df.agg(F.count("*").alias("n"), F.sum(_long(label)).alias("p"), F.sum(value).alias("v"))
    best = top_k(df, order, max(budgets)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ks = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])).alias("k"))
    hits = best.join(F.broadcast(ks), F.col("rank") <= F.col("k")).groupBy("k").agg(F.count("*").alias("effective"), F.sum(_long(label)).alias("found"), F.sum(value).alias("captured"))
    return ks.join(hits, "k", "left").crossJoin(F.broadcast(totals)).select(
        "k", F.coalesce("effective", F.lit(0)).alias("effective"), F.coalesce("found", F.lit(0)).alias("found"),
        F.try_divide("found", "effective").alias("precision"), F.try_divide("found", "p").alias("recall"), F.when(F.col("v") > 0, F.col("captured") / F.col("v")).alias("value_captured"),
    )


def group_shares(df: DataFrame, group: list[str], label: str, value: str, order: list[Column], ks: list[int]) -> DataFrame:
    """(group, k, chosen, hits, positives, captured, available): what the first k rows of each group find."""
    totals = df.groupBy(*group).agg(F.sum(_long(label)).alias("positives"), F.sum(value).alias("available"))
    best = top_k_per_group(df, group, order, max(ks))
    each = F.broadcast(df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in ks])).alias("k")))
    hits = best.join(each, F.col("rank") <= F.col("k")).groupBy(*group, "k").agg(F.count("*").alias("chosen"), F.sum(_long(label)).alias("hits"), F.sum(value).alias("captured"))
    return hits.join(totals, group)


def exporter_shortlists(df: DataFrame, score: str, ks: list[int] = (5, 10), group: str = "i_iso") -> DataFrame:
    """Macro precision over all exporters; macro recall and value over those with a positive, a positive value; micro pooled."""
    order = [F.col(score).desc(), F.col("stage").asc(), F.col("j_iso").asc()]
    s = group_shares(df, [group], "y", "lateval", order, list(ks))
    return s.groupBy("k").agg(
        F.count("*").alias("exporters"), F.count_if(F.col("positives") > 0).alias("exporters_with_positive"), F.avg(F.col("hits") / F.col("chosen")).alias("macro_precision"),
        F.avg(F.when(F.col("positives") > 0, F.col("hits") / F.col("positives"))).alias("macro_recall"), F.try_divide(F.sum("hits"), F.sum("positives")).alias("micro_recall"),
        F.avg(F.when(F.col("available") > 0, F.col("captured") / F.col("available"))).alias("macro_value"), F.try_divide(F.sum("captured"), F.sum("available")).alias("micro_value"),
    )


def conditional_metrics(df: DataFrame, score: str, ks: list[int] = (1, 3, 5)) -> DataFrame:
    """Destinations found within each entry that took place: macro and micro recall and value at k."""
    s = group_shares(df, ["i_iso", "stage"], "y", "lateval", canonical(score, "B2"), list(ks))
    return s.groupBy("k").agg(
        F.count("*").alias("entries"), F.avg(F.col("hits") / F.col("positives")).alias("macro_recall"), F.avg(F.try_divide("captured", "available")).alias("macro_value"),
        F.try_divide(F.sum("hits"), F.sum("positives")).alias("micro_recall"), F.try_divide(F.sum("captured"), F.sum("available")).alias("micro_value"),
    )


def value_oracle_gap(df: DataFrame, label: str, value: str, score: str, track: str, k: int) -> DataFrame:
    """The model's first k against the k of most value: captures, their gap, headroom, and the share recovered."""
    model = top_k(df, canonical(score, track), k).agg(F.count("*").alias("effective_k"), F.sum(_long(label)).alias("model_hits"), F.sum(value).alias("model_value"))
    oracle = top_k(df, canonical(value, track), k).agg(F.sum(_long(label)).alias("oracle_hits"), F.sum(value).alias("oracle_value"))
    total = df.agg(F.count("*").alias("candidates"), F.sum(_long(label)).alias("positives"), F.sum(value).alias("total_value"))
    x = total.crossJoin(model).crossJoin(oracle)
    return x.withColumns({
        "model_capture": F.try_divide("model_value", "total_value"), "oracle_capture": F.try_divide("oracle_value", "total_value"), "gap": F.try_divide(F.col("oracle_value") - F.col("model_value"), F.col("total_value")),
        "headroom": F.col("oracle_value") - F.col("model_value"), "recovered": F.try_divide("model_value", "oracle_value"),
    })


def group_value_oracle_gap(df: DataFrame, group: list[str], label: str, value: str, score: str, keys: list[str], k: int) -> DataFrame:
    """The same within groups: macro means over groups with value, and pooled."""
    tie = [F.col(c).asc() for c in keys]
    model = group_shares(df, group, label, value, [F.col(score).desc(), *tie], [k]).select(*group, "available", F.col("captured").alias("model"))
    oracle = group_shares(df, group, label, value, [F.col(value).desc(), *tie], [k]).select(*group, F.col("captured").alias("oracle"))
    x = model.join(oracle, group)
    return x.agg(
        F.count("*").alias("groups"), F.count_if(F.col("available") > 0).alias("groups_with_value"), F.avg(F.try_divide("model", "available")).alias("macro_model"), F.avg(F.try_divide("oracle", "available")).alias("macro_oracle"),
        F.avg(F.try_divide(F.col("oracle") - F.col("model"), F.col("available"))).alias("macro_gap"), F.try_divide(F.sum("model"), F.sum("available")).alias("pooled_model"), F.try_divide(F.sum("oracle"), F.sum("available")).alias("pooled_oracle"),
    )


def two_stage(lanes: DataFrame, entries: DataFrame, b2_score: str, b1_budget: int, b2_budget: int) -> DataFrame:
    """Gate entries by their score, then rank destinations inside; an entry that the gate misses counts zero.

    entries: (i_iso, stage, score, z). Denominators are all entries that took place, chosen or not.
    """
    gate = top_k(entries, canonical("score", "B1"), b1_budget).select("i_iso", "stage", F.lit(1).alias("__in"), "z")
    chosen = gate.agg(F.count("*").alias("effective_b1"), F.sum(_long("z")).alias("selected_positive"))
    positive = lanes.join(entries.where("z = 1").select("i_iso", "stage"), ["i_iso", "stage"], "left_semi")
    stats = group_shares(positive, ["i_iso", "stage"], "y", "lateval", canonical(b2_score, "B2"), [b2_budget]).join(F.broadcast(gate.drop("z")), ["i_iso", "stage"], "left")
    inside = F.coalesce("__in", F.lit(0))
    sums = stats.agg(
        F.count("*").alias("positive_entries"), F.avg(inside * F.col("hits") / F.col("positives")).alias("macro_recall"), F.avg(inside * F.col("captured") / F.col("available")).alias("macro_value"),
        (F.sum(inside * F.col("hits")) / F.greatest(F.sum("positives"), F.lit(1))).alias("micro_recall"), (F.sum(inside * F.col("captured")) / F.greatest(F.sum("available"), F.lit(1.0))).alias("value_capture"),
    )
    both = sums.crossJoin(chosen)
    return both.withColumns({"gate_precision": F.col("selected_positive") / F.greatest("effective_b1", F.lit(1)), "gate_recall": F.col("selected_positive") / F.greatest("positive_entries", F.lit(1))})


def entry_budget(entries: DataFrame, budgets: list[int]) -> DataFrame:
    """Precision, recall and value of the first k entries; denominators are at least 1."""
    m = budget_metrics(entries, "z", "entry_lateval", canonical("score", "B1"), budgets)
    totals = entries.agg(F.greatest(F.sum(_long("z")), F.lit(1)).alias("__p"), F.greatest(F.sum("entry_lateval"), F.lit(1.0)).alias("__v"), F.sum("entry_lateval").alias("__t"))
    x = m.crossJoin(F.broadcast(totals))
    return x.select("k", "effective", F.coalesce("precision", F.lit(0.0)).alias("precision"), (F.col("found") / F.col("__p")).alias("recall"), (F.coalesce("value_captured", F.lit(0.0)) * F.col("__t") / F.col("__v")).alias("value_captured"))


def pool_to_entries(lanes: DataFrame, score: str, kind: str, top: int = 3) -> DataFrame:
    """(i_iso, stage, score) from lane scores: raw_max, ecdf_mean, or ecdf_top_mean over each entry's best lanes."""
    keys = ["i_iso", "stage"]
    if kind == "raw_max":
        return lanes.groupBy(*keys).agg(F.max(score).alias("score"))
    from .rank import midrank_ecdf

    e = midrank_ecdf(lanes, score)
    if kind == "ecdf_top_mean":
        e = top_k_per_group(e, keys, [F.col("ecdf").desc(), F.col("j_iso").asc()], top)
    return e.groupBy(*keys).agg(F.avg("ecdf").alias("score"))


def pairwise_deltas(metrics: DataFrame, unit: str, model: str, value: str, tie: float = 1e-12) -> DataFrame:
    """Every unordered pair of models over the units that both have: mean and median delta, wins, ties, losses."""
    a = metrics.select(unit, F.col(model).alias("left_model"), F.col(value).alias("a"))
    b = metrics.select(unit, F.col(model).alias("right_model"), F.col(value).alias("b"))
    d = a.join(b, unit).where("left_model < right_model and a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("left_model", "right_model").agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.percentile("d", F.lit(0.5)).alias("median_delta"), F.count_if(F.col("d") > tie).alias("wins"), F.count_if(F.abs("d") <= tie).alias("ties"), F.count_if(F.col("d") < -tie).alias("losses"))


def matched_gap(inside: DataFrame, outside: DataFrame, keys: list[str], value: str) -> DataFrame:
    """In-domain minus held-out over matched keys."""
    x = inside.select(*keys, F.col(value).alias("a")).join(outside.select(*keys, F.col(value).alias("b")), keys)
    return x.agg(F.count("*").alias("pairs"), F.avg("a").alias("in_domain"), F.avg("b").alias("held_out"), F.avg(F.col("a") - F.col("b")).alias("gap"))


def relation_counts(metrics: DataFrame, reference: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """How many units a model is above, level with or below a reference on."""
    x = metrics.join(reference.select(*keys, F.col(value).alias("__r")), keys)
    return x.groupBy(model).agg(F.count_if(F.col(value) > F.col("__r")).alias("higher"), F.count_if(F.col(value) == F.col("__r")).alias("equal"), F.count_if(F.col(value) < F.col("__r")).alias("lower"))


def repeatability(a: DataFrame, b: DataFrame, keys: list[str], score: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Largest and mean absolute difference of two runs' scores, and whether all are close."""
    x = a.select(*keys, F.col(score).alias("a")).join(b.select(*keys, F.col(score).alias("b")), keys, "full_outer")
    delta = F.abs(F.col("a") - F.col("b"))
    return x.agg(F.count("*").alias("n"), F.max(delta).alias("max_delta"), F.avg(delta).alias("mean_delta"), F.coalesce(F.bool_and(F.coalesce(delta <= F.lit(atol) + F.lit(rtol) * F.abs("b"), F.lit(False))), F.lit(True)).alias("all_close"))


def align_scores(candidates: DataFrame, scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(missing, extra, duplicate, non_finite): what keeps scores from matching the candidates one to one; all zero if none."""
    c = candidates.groupBy(*keys).agg(F.count("*").alias("__c"))
    s = scores.groupBy(*keys).agg(F.count("*").alias("__s"), F.count_if(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).alias("__bad"))
    x = c.join(s, keys, "full_outer")
    return x.agg(F.count_if(F.col("__s").isNull()).alias("missing"), F.count_if(F.col("__c").isNull()).alias("extra"), F.coalesce(F.sum(F.greatest(F.col("__s") - 1, F.lit(0))), F.lit(0)).alias("duplicate"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("non_finite"))


def macro_mean(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Unweighted mean and population deviation over units with a defined value, and how many there are."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
