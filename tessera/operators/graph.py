"""Knowledge-graph triples, stage tiers, link heuristics, gaps and supporting paths, as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import exact_sum, stored


def stage_tiers(upstream: DataFrame, stages: DataFrame) -> DataFrame:
    """(stage, tier): the longest chain of upstream stages below each; a cycle is an error.

    The stage table is registry metadata. Each round adds one step; a tier as high as the number of stages is a cycle.
    """
    edges = upstream.select("stage", "source").distinct()
    level = stages.select("stage").distinct().withColumn("tier", F.lit(0))
    n = level.count()
    for _ in range(n + 1):
        raised = edges.join(level.toDF("source", "t"), "source").groupBy("stage").agg((F.max("t") + 1).alias("up"))
        new = level.join(raised, "stage", "left").select("stage", F.coalesce("up", F.lit(0)).alias("tier"))
        rows = [(r.stage, r.tier) for r in new.orderBy("stage").collect()]
        if rows == [(r.stage, r.tier) for r in level.orderBy("stage").collect()]:
            return new
        level = stages.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("tier")) for a, b in rows])).alias("x")).select("x.*")
    raise ValueError("the stage graph has a cycle")


def prefixes(codes: DataFrame, code: str = "k", sizes: tuple[int, ...] = (6, 4, 2)) -> DataFrame:
    """(head, relation, tail): each code's parent by prefix, at each level once."""
    parts = [codes.select(F.substring(code, 1, a).alias("head"), F.lit("hs_parent").alias("relation"), F.substring(code, 1, b).alias("tail")) for a, b in zip(sizes, sizes[1:], strict=False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def triples(lanes: DataFrame, product_lanes: DataFrame, form_of: DataFrame, derived_from: DataFrame) -> DataFrame:
    """All labelled edges: trade by stage, product parents, form_of, derived_from, supplies (exporter), demands (importer)."""
    t = lambda df, h, r, x: df.select(F.col(h).alias("head"), (F.col(r[1:]) if r.startswith("$") else F.lit(r)).alias("relation"), F.col(x).alias("tail"))
    return (
        t(lanes, "i_iso", "$stage", "j_iso").unionByName(prefixes(product_lanes)).unionByName(t(form_of, "a", "form_of", "b")).unionByName(t(derived_from, "stage", "derived_from", "source"))
        .unionByName(t(product_lanes, "i_iso", "supplies", "k").distinct()).unionByName(t(product_lanes, "j_iso", "demands", "k").distinct())
    )


def tier_triples(lanes: DataFrame, product_lanes: DataFrame, tiers: DataFrame) -> DataFrame:
    """The pooled graph: a lane's relation is its stage's tier; supplies and demands only of entities that trade; distinct."""
    trade = lanes.join(F.broadcast(tiers), "stage").select(F.col("i_iso").alias("head"), F.concat(F.lit("exp_tier"), "tier").alias("relation"), F.col("j_iso").alias("tail"))
    ends = lanes.select(F.col("i_iso").alias("head")).unionByName(lanes.select(F.col("j_iso").alias("head"))).distinct()
    supplies = product_lanes.select(F.col("i_iso").alias("head"), F.lit("supplies").alias("relation"), F.col("k").alias("tail"))
    demands = product_lanes.select(F.col("j_iso").alias("head"), F.lit("demands").alias("relation"), F.col("k").alias("tail"))
    return trade.unionByName(supplies.unionByName(demands).join(ends, "head", "left_semi").select("head", "relation", "tail")).distinct()


def with_inverse(edges: DataFrame) -> DataFrame:
    """Edges and their reversals, whose relation is marked."""
    return edges.unionByName(edges.select(F.col("tail").alias("head"), F.concat("relation", F.lit("^-1")).alias("relation"), F.col("head").alias("tail")))


def entity_ids(edges: DataFrame) -> DataFrame:
    """(entity, id): dense numbers from 0 in name order, without a global window."""
    from ..functions.shared import global_rank

    names = edges.select(F.col("head").alias("entity")).unionByName(edges.select(F.col("tail").alias("entity"))).distinct()
    return global_rank(names, [F.col("entity").asc()], "id").withColumn("id", F.col("id") - 1)


def profile(edges: DataFrame) -> DataFrame:
    """(relation, edges, unique_edges, heads, tails)."""
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("head", "tail").alias("unique_edges"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails"))


def graph_gaps(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, missing): candidate heads, tails and relations that the graph lacks."""
    # each is read several times
    candidates = stored(candidates.select("i_iso", "j_iso", "stage"), "candidates")
    nodes = stored(edges.select(F.col("head").alias("x")).unionByName(edges.select(F.col("tail").alias("x"))).distinct(), "nodes")
    kinds = {"head": ("i_iso", nodes), "tail": ("j_iso", nodes), "relation": ("stage", edges.select(F.col("relation").alias("x")).distinct())}
    parts = [candidates.select(F.col(c).alias("x")).distinct().join(known, "x", "left_anti").agg(F.count("*").alias("missing")).select(F.lit(k).alias("kind"), "missing") for k, (c, known) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def capped(edges: DataFrame, limit: int, salt: str = "cap") -> DataFrame:
    """A deterministic subset: the edges of the lowest hashes."""
    h = F.sha2(F.concat_ws("|", F.lit(salt), "head", "relation", "tail"), 256)
    return edges.orderBy(h, "head", "relation", "tail").limit(limit)


def neighbours(edges: DataFrame, a: str = "i_iso", b: str = "j_iso") -> tuple[DataFrame, DataFrame]:
    """((node, nbr), (node, degree)) of the undirected graph without repeats."""
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("nbr"))
    both = one.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("nbr"))).distinct()
    return both, both.groupBy("node").agg(F.count("*").alias("degree"))


BLOCK = 1024  # neighbours of a node that stand together


def blocked(lists: DataFrame, node: str, item: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lists with __block, (node, __n, __blocks)): each node's list dealt by hash into blocks of about `block` items, so that a
    hub's list is spread over as many keys as it is long. Sizes are counted in the tasks first."""
    sizes = lists.groupBy(node).agg(F.count("*").alias("__n")).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
    return lists.join(sizes.select(node, "__blocks"), node).withColumn("__block", F.pmod(F.xxhash64(item), "__blocks").cast("int")).drop("__blocks"), sizes


def wedges(pairs: DataFrame, nbr: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i_iso, j_iso, nbr, other columns of nbr) for each neighbour that both ends of a pair have.

    nbr: (node, nbr) without repeats. The end of lower degree is followed, block by block of its list, and each neighbour is
    looked up at the other end by the key (end, neighbour); so a hub's list is followed only for pairs of hubs, and no key
    holds more than a block of it.
    """
    lists, sizes = blocked(nbr, "node", "nbr", block)
    size = lambda c: sizes.select(F.col("node").alias(c), F.col("__n").alias(f"__n_{c}"), F.col("__blocks").alias(f"__b_{c}"))
    p = pairs.select("i_iso", "j_iso").distinct().join(size("i_iso"), "i_iso").join(size("j_iso"), "j_iso")
    low = F.col("__n_i_iso") <= F.col("__n_j_iso")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    probes = p.select("i_iso", "j_iso", pick("i_iso", "j_iso").alias("node"), pick("j_iso", "i_iso").alias("__end"), F.explode(F.sequence(F.lit(0), pick("__b_i_iso", "__b_j_iso") - 1)).alias("__block"))
    reached = probes.join(lists, ["node", "__block"]).drop("node", "__block")
    return reached.join(nbr.select(F.col("node").alias("__end"), "nbr"), ["__end", "nbr"]).drop("__end")


def link_heuristics(pairs: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """pairs (i_iso, j_iso) with common_neighbors, adamic_adar (over partners of degree above 1) and pref_attach."""
    nbr, degree = neighbours(edges)
    p = pairs.select("i_iso", "j_iso").distinct()
    weight = degree.select(F.col("node").alias("nbr"), F.when(F.col("degree") > 1, 1 / F.log("degree")).otherwise(0.0).alias("w"))
    sums = wedges(p, nbr.join(weight, "nbr"), block).groupBy("i_iso", "j_iso").agg(F.count("*").alias("common_neighbors"), F.sum("w").alias("adamic_adar"))
    d = lambda c, n: degree.select(F.col("node").alias(c), F.col("degree").alias(n))
    out = p.join(sums, ["i_iso", "j_iso"], "left").join(d("i_iso", "di"), "i_iso", "left").join(d("j_iso", "dj"), "j_iso", "left")
    z = F.lit(0)
    return out.select("i_iso", "j_iso", F.coalesce("common_neighbors", z).alias("common_neighbors"), F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"), (F.coalesce("di", z) * F.coalesce("dj", z)).alias("pref_attach"))


def saturation(lanes: DataFrame) -> DataFrame:
    """(i_iso, stage, served, importers, saturation): the share of a stage's importers that an exporter serves."""
    world = lanes.groupBy("stage").agg(F.count_distinct("j_iso").alias("importers"))
    own = lanes.groupBy("i_iso", "stage").agg(F.count_distinct("j_iso").alias("served"))
    return own.join(world, "stage").withColumn("saturation", F.col("served") / F.col("importers"))


def gap_ranking(lanes: DataFrame, k: int) -> DataFrame:
    """(i_iso, stage, j_iso, demand, rank): each exporter's unserved importers by demand, the first k."""
    demand = lanes.groupBy("stage", "j_iso").agg(exact_sum("v").alias("demand"))
    gaps = lanes.select("i_iso", "stage").distinct().join(demand, "stage").where("i_iso <> j_iso").join(lanes.select("i_iso", "stage", "j_iso"), ["i_iso", "stage", "j_iso"], "left_anti")
    w = Window.partitionBy("i_iso", "stage").orderBy(F.col("demand").desc(), F.col("j_iso"))
    return gaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def supporting_paths(gaps: DataFrame, lanes: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """Typed two-step paths i -first-> x -second-> j behind each gap, counted by their pair of stages; the first k.

    Of a gap's ends the one with fewer lanes is followed, block by block, and the other lane is looked up by its two ends.
    """
    first = lanes.select("i_iso", F.col("stage").alias("first"), F.col("j_iso").alias("x"))
    second = lanes.select(F.col("i_iso").alias("x"), F.col("stage").alias("second"), "j_iso")
    out, out_size = blocked(first, "i_iso", "x", block)
    back, back_size = blocked(second, "j_iso", "x", block)
    own = gaps.select("i_iso", "stage", "j_iso").join(out_size.toDF("i_iso", "__no", "__bo"), "i_iso").join(back_size.toDF("j_iso", "__nb", "__bb"), "j_iso")
    probe = lambda rows, b: rows.select("i_iso", "stage", "j_iso", F.explode(F.sequence(F.lit(0), F.col(b) - 1)).alias("__block"))
    columns = ["i_iso", "stage", "j_iso", "first", "second"]
    forward = probe(own.where("__no <= __nb"), "__bo").join(out, ["i_iso", "__block"]).join(second, ["x", "j_iso"]).select(*columns)
    backward = probe(own.where("__no > __nb"), "__bb").join(back, ["j_iso", "__block"]).join(first, ["x", "i_iso"]).select(*columns)
    counts = forward.unionByName(backward).groupBy(*columns).agg(F.count("*").alias("paths"))
    w = Window.partitionBy("i_iso", "stage", "j_iso").orderBy(F.col("paths").desc(), "first", "second")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rca_membership(totals: DataFrame, i: str = "i_iso", p: str = "p", v: str = "v") -> DataFrame:
    """(i, p): exporter's share of a product at least the world's share."""
    row = totals.groupBy(i).agg(F.sum(v).alias("__r"))
    col = totals.groupBy(p).agg(F.sum(v).alias("__c"))
    world = totals.agg(F.sum(v).alias("__t"))
    x = totals.join(row, i).join(col, p).crossJoin(F.broadcast(world))
    rca = (F.col(v) / F.col("__r")) / (F.col("__c") / F.col("__t"))
    return x.where((F.col("__r") > 0) & (F.col("__c") > 0) & (F.round(rca, 9) >= 1)).select(i, p)


def stage_density(entries: DataFrame, dens: DataFrame, stage_products: DataFrame, i: str = "i_iso", p: str = "p") -> DataFrame:
    """entries (i, stage) with score: mean density over the stage's products; unknown exporters and products count 0."""
    return stage_mean(entries, dens.join(stage_products.select("stage", p), p).groupBy(i, "stage").agg(F.sum("density").alias("density")), stage_products, i)


def stage_mean(entries: DataFrame, sums: DataFrame, stage_products: DataFrame, i: str = "i_iso") -> DataFrame:
    """entries (i, stage) with score: the sum of densities (i, stage, density) over the number of the stage's products."""
    products = stage_products.groupBy("stage").agg(F.count("*").alias("__k"))
    sums = sums.select(i, "stage", F.col("density").alias("__s"))
    x = entries.join(sums, [i, "stage"], "left").join(products, "stage", "left")
    return x.select(*entries.columns, F.coalesce(F.col("__s") / F.col("__k"), F.lit(0.0)).alias("score"))
