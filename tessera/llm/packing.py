"""Packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, read_table, stored
from .tokens import ByteEncoder, tokenizer_path

class Packing:
    """One packing of a shard's items: bins of item numbers, the room left in each, and each item's bin."""

    def __init__(self, bins: list[list[int]], free: list[int], where: np.ndarray, cap: int) -> None:
        self.bins, self.free, self.where, self.cap = bins, free, where, cap

    def copy(self) -> Packing:
        # bins are replaced, never changed in place, so they can be shared
        return Packing(self.bins.copy(), self.free.copy(), self.where.copy(), self.cap)

    def cost(self) -> tuple[int, float]:
        """Fewer bins first; then packings whose bins are unequally full, which leaves room that can be emptied."""
        fill = self.cap - np.array(self.free, np.float64)
        return int((fill > 0).sum()), -float((fill * fill).sum())

    def dissolve(self, numbers: set[int]) -> list[int]:
        """Empty these bins and return their items."""
        loose = [i for k in numbers for i in self.bins[k]]
        for k in numbers:
            self.bins[k], self.free[k] = [], self.cap
        return loose

    def best_fit(self, items: list[int], size: list[int]) -> None:
        """Put items, largest first, each into the fullest bin that holds it; empty bins come last."""
        room = sorted((f, k) for k, f in enumerate(self.free) if f)
        for i in sorted(items, key=lambda i: -size[i]):
            at = bisect_left(room, (size[i], -1))
            if at == len(room):
                k, f = len(self.bins), self.cap
                self.bins.append([])
                self.free.append(f)
            else:
                f, k = room.pop(at)
            self.bins[k] = [*self.bins[k], i]
            self.free[k] = f - size[i]
            self.where[i] = k
            if self.free[k]:
                insort(room, (self.free[k], k))

    def fill(self, items: list[int], size: list[int]) -> None:
        """Put items into empty bins: the first opens a bin, which the others fill as far as any choice of them can, earlier
        ones preferred; then the next of those left opens one. Reachable sums are the bits of a number."""
        empty = [k for k, b in enumerate(self.bins) if not b]
        while items:
            first, others = items[0], items[1:]
            room = self.cap - size[first]
            mask, reach = (2 << room) - 1, [1]
            for i in others:
                reach.append((reach[-1] | reach[-1] << size[i]) & mask)
            left, own, items = reach[-1].bit_length() - 1, [first], []
            unused = room - left
            for i, before in zip(reversed(others), reversed(reach[:-1]), strict=True):
                if before >> left & 1:
                    items.append(i)
                else:
                    own.append(i)
                    left -= size[i]
            items.reverse()
            if empty:
                k = empty.pop()
            else:
                k = len(self.bins)
                self.bins.append([])
                self.free.append(self.cap)
            self.bins[k], self.free[k] = own, unused
            self.where[own] = k


def lower_bound(size: np.ndarray, cap: int) -> int:
    """No packing has fewer bins: the best of the bounds that count large items and the room beside them."""
    s = np.sort(size.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // cap)
    half = int(np.searchsorted(s, cap // 2, side="right"))
    for k in np.unique(s[:half]):
        big = int(np.searchsorted(s, cap - k, side="right"))
        low = int(np.searchsorted(s, k, side="left"))
        alone, middle = len(s) - big, big - half
        small = int(total[half] - total[low])
        room = middle * cap - int(total[big] - total[half])
        best = max(best, alone + middle + max(0, -(-(small - room) // cap)))
    return best


class Island:
    """A population of packings of one shard's items."""

    def __init__(self, size: np.ndarray, cap: int, seed: int, elite: list[bytes], population: int = 6) -> None:
        self.size, self.cap, self.rng, self.bound = size.tolist(), cap, np.random.default_rng(seed), lower_bound(size, cap)
        if elite:
            self.members = [self._unpacked(e) for e in elite]
        else:
            first = Packing([], [], np.zeros(len(size), np.int64), cap)
            first.best_fit(list(range(len(size))), self.size)
            self.members = [first]
        self.costs = [m.cost() for m in self.members]
        while len(self.members) < population and not self.done():
            self._add(self._shaken(self.members[0]))

    def _unpacked(self, data: bytes) -> Packing:
        where = np.frombuffer(data, np.int32).astype(np.int64)
        bins: list[list[int]] = [[] for _ in range(int(where.max(initial=-1)) + 1)]
        for i, k in enumerate(where.tolist()):
            bins[k].append(i)
        return Packing(bins, [self.cap - sum(self.size[i] for i in b) for b in bins], where, self.cap)

    def _add(self, member: Packing) -> None:
        self.members.append(member)
        self.costs.append(member.cost())

    def best(self) -> Packing:
        return self.members[min(range(len(self.members)), key=self.costs.__getitem__)]

    def done(self) -> bool:
        return min(self.costs)[0] <= self.bound

    def _shaken(self, a: Packing, few: int = 40) -> Packing:
        """Mutation: the emptiest bin and a random few dissolve; their items fill bins anew, large ones roughly first."""
        child = a.copy()
        used = [k for k, b in enumerate(child.bins) if b]
        few = min(few, 1 + len(used) // 3)
        loose = child.dissolve({used[i] for i in self.rng.integers(0, len(used), few)} | {max(used, key=child.free.__getitem__)})
        blur = self.rng.uniform(0.6, 1, len(loose)).tolist()
        child.fill([i for _, i in sorted(zip((-self.size[i] * x for i, x in zip(loose, blur, strict=True)), loose, strict=True))], self.size)
        return child

    def _crossed(self, a: Packing, b: Packing, few: int = 60) -> Packing:
        """Crossover: well-filled bins of b are injected whole into a; bins of a that hold any of their items dissolve,
        and the displaced documents are best-fitted."""
        full = [k for k, x in enumerate(b.bins) if x and b.free[k] * 50 <= self.cap]
        few = min(few, 1 + len(full) // 3)
        chosen = [b.bins[full[i]] for i in set(self.rng.integers(0, len(full), few).tolist())] if full else []
        child = a.copy()
        held = {i for x in chosen for i in x}
        loose = child.dissolve({int(child.where[i]) for i in held})
        for x in chosen:
            k = len(child.bins)
            child.bins.append(x)
            child.free.append(self.cap - sum(self.size[i] for i in x))
            child.where[x] = k
        child.best_fit([i for i in loose if i not in held], self.size)
        return child

    def evolve(self, generations: int) -> None:
        for _ in range(generations if self.size else 0):
            if self.done():
                return
            order = sorted(range(len(self.members)), key=self.costs.__getitem__)
            a, b, last = self.members[order[0]], self.members[order[int(self.rng.integers(1, len(order)))]], order[-1]
            child = self._crossed(a, b) if self.rng.random() < 0.6 else self._shaken(a)
            self.members[last], self.costs[last] = child, child.cost()

    def packed(self) -> bytes:
        """Each item's bin in the best packing, numbered from 0 without gaps."""
        best = self.best()
        return np.unique(best.where, return_inverse=True)[1].astype(np.int32).tobytes()


def pieces(docs: DataFrame, cap: int = 2048, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32, own_sequence[, ids]): tokenised documents, each closed by end_id, longer ones cut.

    Only a document longer than cap is cut; all its pieces but the first then hold cap tokens. Null text counts as empty.
    row tells repeated rows of one id apart. own_sequence numbers the pieces of cap tokens, from -1 down; else null.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    ranks = path.removesuffix(".json") + ".tiktoken"
    end = np.uint32(end_id).tobytes()
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "own_sequence"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
    schema = pa.schema(list(zip(names, types, strict=True)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_col)

    def run(batches):
        encoder = ByteEncoder(path, ranks)
        own = -1 - (TaskContext.get().partitionId() << 40)
        for b in batches:
            out = [[] for _ in names]
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = encoder.encode(text) + end
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n % cap or cap) if piece == 0 else cap
                    part = data[4 * start : 4 * (start + length)]
                    one = [row, doc_id, piece, start, length, zlib.crc32(part), own if length == cap else None] + [np.frombuffer(part, np.uint32).astype(np.int64)] * keep_ids
                    for c, x in zip(out, one, strict=True):
                        c.append(x)
                    own -= length == cap
                    start, piece = start + length, piece + 1
            yield batch(schema, *out)

    return arrow_map(rows, run, "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, own_sequence bigint" + ", ids array<bigint>" * keep_ids)


def _evolved(islands: DataFrame, cap: int, generations: int) -> DataFrame:
    """One epoch of each island: (shard, island, size, elites) to (shard, island, size, best, bins, done)."""
    out = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("size", pa.binary()), ("best", pa.binary()), ("bins", pa.int64()), ("done", pa.bool_())])

    def run(batches):
        for b in batches:
            for shard, island, size, elites in zip(*(c.to_pylist() for c in b.columns), strict=True):
                world = Island(np.frombuffer(size, np.int32), cap, hash((shard, island, len(elites))) & 0x7FFFFFFF, elites)
                world.evolve(generations)
                yield batch(out, [shard], [island], [size], [world.packed()], [min(world.costs)[0]], [world.done()])

    return arrow_map(islands.select("shard", "island", "size", "elites"), run, "shard bigint, island int, size binary, best binary, bins bigint, done boolean")


def pack(rows: DataFrame, cap: int = 2048, shard_items: int = 8192, islands: int = 3, epochs: int = 2, generations: int = 150, level: int = 0) -> DataFrame:
    """(row, piece, sequence_id, offset) of each piece of `rows` (row, piece, length, own_sequence): every piece is placed once.

    Pieces of cap tokens are sequences of their own. The others are dealt by hash into shards of about shard_items, each
    searched by several islands; after an epoch an island's elite moves to the next island of its shard, in a ring. A
    shard is left alone as soon as it has as few bins as its lower bound. Of several shards, each gives up its emptiest bin if
    that is at most half full; the pieces of all those are packed together in the same way, at the next `level`, in no
    more sequences than they gave up, as all but one are then more than half full.
    """
    count = rows.where(F.col("length") < cap).count()
    shards = max(1, -(-count // shard_items))
    dealt = rows.where(F.col("length") < cap).select("row", "piece", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    grouped = stored(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "piece", "length"))).alias("items")), "shards")

    size_schema = pa.schema([("shard", pa.int64()), ("size", pa.binary())])

    def sizes(batches):
        for b in batches:
            yield batch(size_schema, b.column(0), [np.array(x, np.int32).tobytes() for x in b.column(1).to_pylist()])

    start = arrow_map(grouped.select("shard", F.col("items.length").alias("lengths")), sizes, "shard bigint, size binary")
    world = start.select("shard", "size", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.expr("cast(array() as array<binary>)").alias("elites"))
    for epoch in range(epochs):
        world = stored(_evolved(world.repartition(F.col("shard"), F.col("island")), cap, generations), "islands")
        if epoch == epochs - 1:
            break
        guest = world.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
        world = world.join(guest, ["shard", "island"]).select("shard", "size", "island", F.array("best", "guest").alias("elites"))
    best = world.groupBy("shard").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))
    out = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("shard", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("tail", pa.bool_())])

    def place(batches):
        for b in batches:
            for shard, items, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where = np.frombuffer(data, np.int32)
                length = np.array([x["length"] for x in items], np.int64)
                order = np.argsort(where, kind="stable")
                before = np.cumsum(length[order]) - length[order]
                first = np.concatenate([[True], np.diff(where[order]) != 0])
                offset = np.empty(len(items), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                fill = np.bincount(where, length)
                tail = where == fill.argmin() if shards > 1 and 2 * fill.min() <= cap else np.zeros(len(where), bool)
                yield batch(out, [x["row"] for x in items], [x["piece"] for x in items], length, [shard] * len(items), where.astype(np.int64), offset, tail)

    placed = arrow_map(grouped.join(best, "shard").select("shard", "items", "best"), place, "row bigint, piece int, length bigint, shard bigint, bin bigint, offset bigint, tail boolean")
    placed = stored(placed, "placed") if shards > 1 else placed
    number = (F.col("bin") * F.lit(shards) + F.col("shard")) * 64 + level
    numbered = placed.where("not tail").select("row", "piece", number.alias("sequence_id"), "offset")
    if shards > 1:
        tails = placed.where("tail").select("row", "piece", "length", F.lit(None).cast("long").alias("own_sequence"))
        # a tail has cap / 2 pieces at most, so with shards of 4 * cap each level has at most a quarter of the one before
        numbered = numbered.unionByName(pack(tails, cap, max(shard_items, 4 * cap), islands, epochs, generations, level + 1))
    full = rows.where(F.col("length") >= cap).select("row", "piece", F.col("own_sequence").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.unionByName(full)


def packed_documents(docs: DataFrame, cap: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: pieces()'s columns but row, sequence_id and offset."""
    rows = stored(pieces(docs, cap, path, id_col=id_col, text_col=text_col), "pieces")
    return rows.join(pack(rows, cap), ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token; repeated rows and null ids are packed like any row; an empty table gives
    no pieces.
    """
    return packed_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
