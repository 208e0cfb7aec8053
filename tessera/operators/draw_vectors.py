"""Statistics of many bootstrap draws from one ranked list: each row carries its cluster's draws, and prefix sums are vectors
with a place for each draw, so no table of rows times draws is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import global_rank, stored

_ROWS = 2048  # rows that are made dense together


def picked(clusters: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    """(cluster, picks): the draws that pick a cluster, one entry for each time, of as many picks a draw as there are clusters.

    The slot's pick is a hash of (seed, draw, slot), so draws repeat whatever the partitioning. Clusters are numbered by
    place in key order; a cluster that no draw picks is absent.
    """
    numbered = stored(global_rank(clusters.select(cluster).distinct(), [F.col(cluster).asc()], "__number"), "clusters")
    n = max(numbered.count(), 1)
    slots = numbered.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).cast("int").alias("draw"), (F.col("id") % n).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "slot")), 1, 15), 16, 10).cast("long") % F.lit(n) + 1
    return slots.select("draw", pick.alias("__number")).groupBy("__number").agg(F.collect_list("draw").alias("picks")).join(numbered, "__number").select(cluster, "picks")


def dense(picks: pa.ListArray, draws: int) -> np.ndarray:
    """(rows, draws): how often each draw picks each row's cluster."""
    sizes = np.diff(picks.offsets.to_numpy())
    at = np.repeat(np.arange(len(picks)), sizes) * draws + picks.flatten().to_numpy()
    return np.bincount(at, minlength=len(picks) * draws).reshape(len(picks), draws)


def _parts(batches, width: int, draws: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(piece, columns, dense picks) of runs of rows of one piece."""
    for b in batches:
        piece = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for a, z in zip(edges, edges[1:], strict=False):
            for k in range(a, z, _ROWS):
                own = b.slice(k, min(_ROWS, z - k))
                yield int(piece[a]), [own.column(1 + i).to_numpy(zero_copy_only=False) for i in range(width)], dense(own.column(1 + width), draws)


class RankedDraws:
    """Rows in descending order of a column, cut into pieces at fixed bounds, each with its cluster's picks.

    The bounds are approximate quantiles, so equal values share a piece and every pass sees the same pieces. The rows are
    written once. Null values come last; rows whose cluster no draw picks count in no draw and are left out.
    """

    def __init__(self, rows: DataFrame, by: str, cluster: str, picks: DataFrame, draws: int, pieces: int | None = None) -> None:
        spark = rows.sparkSession
        pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = stored(rows, "draw-rows")
        cuts = sorted(set(rows.select(F.col(by).cast("double").alias("x")).approxQuantile("x", [k / pieces for k in range(1, pieces)], 0.2 / pieces))) if pieces > 1 else []
        piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c > F.col(by)))
        self.draws, self.by, self.pieces = draws, by, len(cuts) + 2
        self.rows = stored(rows.join(picks, cluster).withColumn("__piece", F.when(F.col(by).isNull(), len(cuts) + 1).otherwise(piece)), "draws")

    def totals(self, values: list[str]) -> np.ndarray:
        """(piece, value, draw): sums of each value over the rows of each piece. Tasks send one vector a piece, which Spark adds up."""
        width, draws = shape = (len(values), self.draws)
        out = pa.schema([("piece", pa.int32()), ("sums", pa.list_(pa.float64()))])

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for piece, columns, m in _parts(batches, width, draws):
                own = held.setdefault(piece, np.zeros(shape))
                for k, c in enumerate(columns):
                    own[k] += c @ m
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], schema=out)

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape[0] * shape[1])
            for b in batches:
                total += b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], schema=out)

        found = self.rows.select("__piece", *values, "picks").mapInArrow(run, "piece int, sums array<double>").groupBy("piece").applyInArrow(add, "piece int, sums array<double>")
        whole = np.zeros((self.pieces, *shape))
        for r in found.collect():
            whole[r.piece] = np.array(r.sums).reshape(shape)
        return whole

    def sweep(self, values: list[str], order: list[Column], wanted: list[int], start: Callable[[int], object], step: Callable, end: Callable) -> np.ndarray:
        """Sum over the wanted pieces of what a state gives that meets the piece's rows in order.

        start(piece) makes a state, step(state, columns, dense picks) meets the next rows, end(state) gives a matrix. Each
        piece is sorted in one task, and rows pass in runs of bounded size.
        """
        width, draws = len(values), self.draws
        out = pa.schema([("piece", pa.int32()), ("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

        def run(batches):
            now, state = None, None

            def done():
                x = end(state)
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([x.ravel()], pa.list_(pa.float64()))], schema=out)

            for piece, columns, m in _parts(batches, width, draws):
                if piece != now:
                    if now is not None:
                        yield done()
                    now, state = piece, start(piece)
                step(state, columns, m)
            if now is not None:
                yield done()

        rows = self.rows.where(F.col("__piece").isin(*wanted)) if len(wanted) < self.pieces else self.rows
        ranked = rows.repartition("__piece").sortWithinPartitions("__piece", *order).select("__piece", *values, "picks")
        found = sorted(ranked.mapInArrow(run, "piece int, shape array<int>, values array<double>").collect(), key=lambda r: r.piece)
        return sum((np.array(r["values"]).reshape(r["shape"]) for r in found[1:]), np.array(found[0]["values"]).reshape(found[0]["shape"])) if found else None


def counted(picks: DataFrame, cluster: str, draws: int) -> DataFrame:
    """(cluster, m): picks as one byte a draw, how often the draw picks the cluster; a fourth of the list's size."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                own = b.slice(at, _ROWS)
                m = dense(own.column(1), draws)
                if m.size and m.max() > 255:
                    raise ValueError("a draw picks a cluster more than 255 times")
                data = m.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([data[k : k + draws] for k in range(0, len(data), draws)], pa.binary())], names=[cluster, "m"])

    return picks.select(cluster, "picks").mapInArrow(run, f"`{cluster}` {picks.schema[cluster].dataType.simpleString()}, m binary")


def _bytes(column: pa.Array, draws: int) -> np.ndarray:
    """(rows, draws) of a column of counts, without a copy."""
    start = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * draws, start).reshape(len(column), draws) if len(column) else np.zeros((0, draws), np.uint8)


def _piece_bounds(rows: DataFrame, by: str, pieces: int) -> list[float]:
    x = rows.select(F.col(by).cast("double").alias("x")).where("x is not null and not isnan(x)")
    return sorted(set(x.approxQuantile("x", [k / pieces for k in range(1, pieces)], 0.2 / pieces))) if pieces > 1 else []


def _class_totals(rows: DataFrame, cluster: str, counts: DataFrame, pieces: int, draws: int) -> np.ndarray:
    """(piece, 2, draw): positives and rows of each piece in each draw. A cluster's rows are counted by piece before they
    meet its draws, so each cluster meets them once; tasks send one matrix, which Spark adds up."""
    each = rows.groupBy(cluster, "__piece").agg(F.sum("__p").alias("p"), F.sum("__n").alias("n"))
    each = each.groupBy(cluster).agg(F.collect_list(F.struct("__piece", "p", "n")).alias("cells")).join(counts, cluster).select("cells", "m")

    def run(batches):
        total = np.zeros((pieces * 2, draws))
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                own = b.slice(at, _ROWS)
                cells = own.column(0)
                flat = cells.flatten()
                row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                piece = flat.field(0).to_numpy()
                w = np.zeros((pieces * 2, len(cells)))
                for k in (0, 1):
                    w[piece * 2 + k, row] = flat.field(1 + k).to_numpy()
                total += w @ _bytes(own.column(1), draws).astype(np.float64)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["at", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draws)
        for b in batches:
            total += b.column("sums").flatten().to_numpy().reshape(b.num_rows, draws).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["at", "sums"])

    whole = np.zeros((pieces * 2, draws))
    for r in each.mapInArrow(run, "at int, sums array<double>").groupBy("at").applyInArrow(add, "at int, sums array<double>").collect():
        whole[r["at"]] = r.sums
    return whole.reshape(pieces, 2, draws)


class _Blocks:
    """Precision summed over blocks of equal score, for all draws: only scores with positives add to it, so counts are summed
    over the runs of rows between those; the last block stays open until another score follows."""

    def __init__(self, positives: np.ndarray, all_: np.ndarray) -> None:
        self.p, self.n, self.score = positives.copy(), all_.copy(), None
        self.open = np.zeros((2, len(positives)))
        self.sum = np.zeros(len(positives))

    def close(self) -> None:
        self.p += self.open[0]
        self.n += self.open[1]
        self.sum += np.divide(self.open[0] * self.p, self.n, out=np.zeros_like(self.sum), where=self.n > 0)
        self.open[:] = 0

    def meet(self, columns: list[np.ndarray], m: np.ndarray) -> None:
        """columns: score, positives and rows; a row's counts are small whole numbers, so sums of them are exact."""
        score, p, n = columns
        same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
        starts = np.flatnonzero(np.r_[True, ~same])
        if self.score is not None and not (self.score == score[0] or (np.isnan(self.score) and np.isnan(score[0]))):
            self.close()
        ends = np.r_[starts[1:], len(score)]
        self.open += [_weighed(p[: ends[0]], m[: ends[0]]), _weighed(n[: ends[0]], m[: ends[0]])]
        if len(starts) > 1:
            self.close()
            lo, hi = starts[1], starts[-1]
            if hi > lo:
                # runs that end where a block with positives ends
                block_p = np.add.reduceat(p[lo:hi], starts[1:-1] - lo)
                cuts = ends[1:-1][block_p > 0]
                at = lo
                rows = np.flatnonzero(p[lo:hi] > 0) + lo
                own_p = p[rows][:, None] * m[rows]
                if len(cuts):
                    edges = np.r_[lo, cuts[:-1]]
                    weighed = m[lo : cuts[-1]] if (n[lo : cuts[-1]] == 1).all() else n[lo : cuts[-1], None] * m[lo : cuts[-1]]
                    run_n = np.add.reduceat(weighed, edges - lo, axis=0, dtype=np.float64)
                    run_p = np.add.reduceat(own_p, np.searchsorted(rows, edges), axis=0, dtype=np.float64)
                    cum_p, cum_n = self.p + np.cumsum(run_p, 0), self.n + np.cumsum(run_n, 0)
                    self.sum += np.divide(run_p * cum_p, cum_n, out=np.zeros_like(cum_p), where=cum_n > 0).sum(0)
                    self.p, self.n, at = cum_p[-1].copy(), cum_n[-1].copy(), cuts[-1]
                self.n += _weighed(n[at:hi], m[at:hi])
            self.open[:] = _weighed(p[starts[-1] :], m[starts[-1] :]), _weighed(n[starts[-1] :], m[starts[-1] :])
        self.score = score[-1]


def _weighed(w: np.ndarray, m: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(w)
    return w[at] @ m[at].astype(np.float64)


def average_precisions(df: DataFrame, label: str, score: str, cluster: str, picks: DataFrame, draws: int, pieces: int | None = None) -> np.ndarray:
    """The average precision of each draw, NaN where a draw lacks a class.

    Rows are combined by cluster and score, so tied rows cost one row a cluster. They are cut into pieces of the score at
    approximate quantiles; equal scores share a piece. Counts by piece come from each cluster once, and then each piece is
    sorted in one task. A row carries its cluster's draws as bytes, in that one shuffle only; nothing of it is written.
    """
    small = stored(df.groupBy(cluster, F.col(score).cast("double").alias("__s")).agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).cast("double").alias("__p"), F.count("*").cast("double").alias("__n")), "draw-rows")
    cuts = _piece_bounds(small, "__s", pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = len(cuts) + 2

    def placed(batches):
        bounds = np.array(cuts)
        for b in batches:
            s = b.column(1)
            x = s.fill_null(0.0).to_numpy()
            # descending: not-a-number is above all scores, null below
            piece = np.where(np.isnan(x), 0, len(bounds) - np.searchsorted(bounds, x, "right"))
            piece[s.is_null().to_numpy(zero_copy_only=False)] = pieces - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(piece.astype(np.int32))], names=[*b.schema.names, "__piece"])

    kind = f"`{cluster}` {small.schema[cluster].dataType.simpleString()}, __s double, __p double, __n double, __piece int"
    rows = small.select(cluster, "__s", "__p", "__n").mapInArrow(placed, kind)
    counts = stored(counted(picks, cluster, draws), "counts")
    totals = _class_totals(rows, cluster, counts, pieces, draws)
    before = np.cumsum(totals, 0) - totals
    p, n = totals.sum(0)

    def run(batches):
        now, state = None, None

        def done():
            state.close()
            return pa.RecordBatch.from_arrays([pa.array([state.sum], pa.list_(pa.float64()))], names=["sums"])

        for b in batches:
            piece = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                for k in range(lo, hi, _ROWS):
                    own = b.slice(k, min(_ROWS, hi - k))
                    if piece[lo] != now:
                        if now is not None:
                            yield done()
                        now, state = piece[lo], _Blocks(*before[piece[lo]])
                    state.meet([own.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)], _bytes(own.column(4), draws))
        if now is not None:
            yield done()

    ranked = rows.join(counts, cluster).select("__piece", "__s", "__p", "__n", "m").repartition(pieces, "__piece").sortWithinPartitions("__piece", F.col("__s").desc())
    sums = ranked.mapInArrow(run, "sums array<double>").collect()
    out = np.full(draws, np.nan)
    defined = (p > 0) & (n > p)
    if sums:
        out[defined] = np.sum([r.sums for r in sums], 0)[defined] / p[defined]
    return out


def cluster_totals(df: DataFrame, value: str, cluster: str, picks: DataFrame, draws: int) -> np.ndarray:
    """The value of all rows in each draw: a cluster's sum counts as often as it is picked, so rows do not meet the draws."""
    sums = df.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("__v")).join(picks, cluster).select("__v", "picks")

    def run(batches):
        total = np.zeros(draws)
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                own = b.slice(k, _ROWS)
                total += own.column(0).fill_null(0.0).to_numpy(zero_copy_only=False) @ dense(own.column(1), draws)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.array(total)], names=["draw", "v"])

    found = sums.mapInArrow(run, "draw int, v double").groupBy("draw").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(draws)
    for r in found:
        out[r.draw] = r.v
    return out


def _taken(m: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(how much of each row each draw takes, units up to the last row) after `before` units."""
    upto = before + np.cumsum(m, 0)
    return np.clip(k - (upto - m), 0, m), upto[-1]


def first_units(df: DataFrame, order: list[Column], by: str, value: str, cluster: str, k: int, picks: DataFrame, draws: int, head: int = 16_384, total: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(value, units, value of all rows if total) of each draw: the first k units in a total order that begins with `by`
    descending, a row counting as often as its cluster is picked, in part beyond k.

    The first `head` rows mostly hold k units of every draw, and tasks send no more than those. If a draw wants more, all
    rows are swept piece by piece; pieces before which every draw has its k units are not read again.
    """
    every = cluster_totals(df, value, cluster, picks, draws) if total else None
    if head and (found := _in_head(df, order, value, cluster, k, picks, draws, head)) is not None:
        return *found, every
    ranked = RankedDraws(df.withColumn("__v", F.col(value).cast("double")).withColumn("__one", F.lit(1.0)), by, cluster, picks, draws)
    totals = ranked.totals(["__one"])
    before = np.cumsum(totals[:, 0], 0) - totals[:, 0]
    wanted = [j for j in range(ranked.pieces) if (before[j] < k).any() and totals[j, 0].any()]

    def step(state, columns, m):
        take, state["n"] = _taken(m, state["n"], k)
        state["x"] += np.stack([columns[0] @ take, take.sum(0)])

    found = ranked.sweep(["__v"], order, wanted, lambda j: {"n": before[j], "x": np.zeros((2, draws))}, step, lambda s: s["x"])
    value_, units = found if found is not None else np.zeros((2, draws))
    return value_, units, every


def _in_head(df: DataFrame, order: list[Column], value: str, cluster: str, k: int, picks: DataFrame, draws: int, head: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(value, units) of each draw from the first `head` rows alone, None if these end before a draw has its k units."""
    first = stored(df.orderBy(*order).limit(head), "head")
    more = first.count() == head
    ranked = first.join(picks, cluster).repartition(1).sortWithinPartitions(*order).select(F.col(value).cast("double").alias("__v"), "picks")

    def run(batches):
        n, x = np.zeros(draws), np.zeros((2, draws))
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                own = b.slice(at, _ROWS)
                take, n = _taken(dense(own.column(1), draws), n, k)
                x += np.stack([own.column(0).to_numpy(zero_copy_only=False) @ take, take.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*x, n)], names=["value", "units", "n"])

    rows = ranked.mapInArrow(run, "value double, units double, n double").toArrow()
    found = [rows.column(c).to_numpy() for c in range(3)] if rows.num_rows else list(np.zeros((3, draws)))
    return None if more and (found[2] < k).any() else (found[0], found[1])
