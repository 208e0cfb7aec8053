"""SimHash near-duplicates: fingerprints of 3-word shingles, then tiled exact comparison of population-count cells."""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, new_name, read_table, stored, words
from .components import connected_components

SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of a text's lower-cased (A-Z) word shingles, repeats included; bit set if in over half of the hashes."""
    w = words(text.translate(_LOWER)) if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        votes += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


#: A-Z to a-z.
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", keep_text: bool = False) -> DataFrame:
    """The columns of docs (without its text, unless kept), and the fingerprint as a signed long. Null or wordless text: 0.
    A column of docs that has that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name not in (text_col, name)] + [docs.schema[text_col]]
    kept = fields if keep_text else fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` bigint"])
    names = [*(f.name for f in kept), name]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(fp.view(np.int64))], names=names)

    return arrow_map(docs.select(*[f"`{f.name}`" for f in fields]), run, schema)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component under links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def links_in(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links, as places in a followed by b, joining each group of fingerprints within the radius: of a alone, or
    between a and b."""
    if b is None:
        i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius, 1))
    else:
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
        j = j + len(a)
    if not len(i):
        return i, j
    label = _forest(i, j, len(a) + (0 if b is None else len(b)))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def near_links(fps: DataFrame, radius: int = 3, bands: int = 4, tile_rows: int = 2048) -> DataFrame:
    """(a, b): links of nodes that join exactly the groups reachable at `radius` bits or fewer. fps: (fp, node), each once.

    A fingerprint's cell is the population count of each of its `bands` parts. Two fingerprints differ in at least the sum
    of the counts' differences, so a cell meets only cells at a distance up to the radius; all others are skipped. Cells
    are cut into tiles of about `tile_rows`, and a pair of tiles is compared in full by exclusive-or and bit count. A
    pair of tiles returns a star for each group it finds, so a large group gives links in proportion to its rows. Tiles
    travel as bare fingerprints, as each goes to many cells; the nodes, wider, are joined to the few links that are found.
    """
    width, levels = 64 // bands, 64 // bands + 1
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned(F.col("fp"), k * width).bitwiseAND(F.lit(mask))) for k in range(bands)]
    cell = sum((c * levels**k for k, c in enumerate(counts)), F.lit(0)).cast("int")
    cells = fps.select("fp").where("fp is not null").withColumn("cell", cell)
    # at most levels**bands rows, so small enough to broadcast whatever the input
    tiles_of = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).alias("tiles"))
    tiled = cells.join(F.broadcast(tiles_of), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = stored(tiled.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [s for s in product(range(-radius, radius + 1), repeat=bands) if sum(map(abs, s)) <= radius and s >= (0,) * bands]
    near = F.array(*[F.lit(sum(d * levels**k for k, d in enumerate(s))) for s in steps])
    inside = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(s)]) for s in steps])
    part = [F.floor(F.col("cell") / levels**k) % levels for k in range(bands)]
    ok = lambda s: F.reduce(F.array(*[(part[k] + s[f"d{k}"]).between(0, levels - 1) for k in range(bands)]), F.lit(True), lambda x, y: x & y)
    reach = F.transform(F.filter(F.arrays_zip(near.alias("near"), inside.alias("inside")), lambda z: ok(z["inside"])), lambda z: z["near"] + F.col("cell"))
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("a"), F.explode(reach).alias("cell"))
    pairs = left.join(tiles.withColumnRenamed("fps", "b"), "cell").where("cell <> cell_a or tile >= tile_a")
    pairs = pairs.select("a", F.when((F.col("cell") != F.col("cell_a")) | (F.col("tile") != F.col("tile_a")), F.col("b")).alias("b"))

    def run(batches):
        for t in batches:
            for k in range(t.num_rows):
                sides = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (t.column(0)[k], t.column(1)[k]) if x.is_valid]
                i, j = links_in(sides[0], sides[1] if len(sides) == 2 else None, radius)
                if len(i):
                    fp = np.concatenate(sides).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["fa", "fb"])

    links = arrow_map(pairs, run, "fa bigint, fb bigint")
    ends = [fps.select(F.col("fp").alias(f), F.col("node").alias(n)) for f, n in (("fa", "a"), ("fb", "b"))]
    return links.join(ends[0], "fa").join(ends[1], "fb").select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row a document; component_id is the smallest id reachable over fingerprint links.

    Documents without words (null, empty) share fingerprint zero and link like any other. Repeated rows stay repeated. A
    null id stays null and never names a component unless all ids of its group are null. Extra columns are ignored. A
    component is named by its smallest id, so ties do not matter.
    """
    marks = stored(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "fingerprints")
    firsts = stored(marks.groupBy("fp").agg(F.min("id").alias("id")), "first-ids")
    node = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    groups = connected_components(near_links(firsts.select("fp", node.alias("node")), radius))
    named = firsts.join(groups.select(F.col("node.fp").alias("fp"), F.col("component.id").alias("component_id")), "fp", "left")
    named = named.select("fp", F.coalesce("component_id", "id").alias("component_id"))
    return marks.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicate texts: that with the smallest id, null ids last.

    Rows are numbered first, and the smallest number decides between equal ids. So every text is kept or has a near copy in
    its group that is, whether ids are null or repeated with other texts. Empty and null texts are copies of each other.
    All columns of docs stay, whatever their names.
    """
    row, fp = new_name(docs, "row"), new_name(docs, "fp")
    rows = stored(fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), text_col, fp, keep_text=True), "rows")
    plain = rows.select(F.col(fp).alias("fp"), F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).alias("node"))
    firsts = stored(plain.groupBy("fp").agg(F.min("node").alias("node")), "first-rows")
    groups = connected_components(near_links(firsts, radius))
    # what is neither alone nor the first of its group goes
    dropped = groups.where("node <> component").select(F.col("node.row").alias(row))
    kept = firsts.select(F.col("node.row").alias(row)).join(dropped, row, "left_anti")
    return rows.join(kept, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id. Rows at the edge: see near_duplicates."""
    rows = near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
