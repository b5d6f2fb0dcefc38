"""Edges, degrees, connected components and reachability as iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assay.session import cut

CHAIN_ROUNDS = 12  # rounds of breadth-first search before chains are shortened


def network(df: DataFrame, src: str, dst: str, weight: Column | None = None) -> DataFrame:
    """One edge per (src, dst) with its number of transfers and total weight."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("weight")] if weight is not None else [])
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(
        F.col(src).alias("src"), F.col(dst).alias("dst")).agg(*aggs)


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct partners in, out and in total weight of edges per node."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"),
                                    F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component named by its smallest node.

    Alternates two moves until nothing changes: every node links its larger neighbours to its smallest
    one, then links itself and its smaller neighbours to it. The rounds grow with the logarithm of the
    graph's size, not with its diameter. Each round is checkpointed to the shared folder. A node's
    smallest neighbour is found by a combining aggregate, so hubs do not gather in one task; the join
    that hands it to the neighbours is a plain equi join whose skewed partitions Spark splits.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))).distinct()
    links = cut(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def signature(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = signature(links)
    while before[0]:
        # larger neighbours of every node move to the smallest of its neighbourhood
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # then the node itself and its smaller neighbours do
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        linked = moved.join(least, "a")
        links = cut(
            linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = signature(links)
        if after == before:
            break
        before = after
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clusters(edges: DataFrame, min_nodes: int = 3, min_weight: float = 0.0) -> DataFrame:
    """Components with their size and total edge weight, those above both thresholds marked suspicious."""
    member = components(edges)
    inside = edges.join(member.withColumnRenamed("node", "src"), "src").groupBy("component").agg(
        F.sum("weight").alias("weight"), F.sum("n").alias("transfers"))
    return member.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).join(inside, "component", "left").withColumn(
        "suspicious", (F.col("nodes") >= min_nodes) & (F.coalesce("weight", F.lit(0)) >= min_weight))


def chains(links: DataFrame, start: DataFrame) -> DataFrame | None:
    """Nodes inside chains (one link in, one out, no start) with the node at which their chain begins and the steps from there; None if there are none.

    Every node first points to its predecessor; pointing to where the predecessor points doubles the steps with each round, so
    a chain of n nodes takes log2(n) rounds. Nodes on a ring without an entry never leave it and are left out.
    """
    one_in = links.groupBy("dst").agg(F.count(F.lit(1)).alias("c"), F.min("src").alias("head")).where("c = 1").select(F.col("dst").alias("node"), "head")
    one_out = links.groupBy("src").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select(F.col("src").alias("node"))
    inner = cut(one_in.join(one_out, "node", "left_semi").join(start.select("node"), "node", "left_anti").withColumn("steps", F.lit(1)))
    n = inner.count()
    if not n:
        return None
    for _ in range(n.bit_length() + 1):
        jump = inner.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        open_ = inner.join(inner.select(F.col("node").alias("head")), "head", "left_semi")
        if open_.isEmpty():
            return inner
        inner = cut(inner.join(jump, "head", "left").select("node", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return cut(inner.join(inner.select(F.col("node").alias("head")), "head", "left_anti").select("node", "head", "steps"))


def impact(edges: DataFrame, start: DataFrame, condense_from: int = CHAIN_ROUNDS) -> DataFrame:
    """Nodes reachable from the start nodes with their shortest distance; ``start`` has a column ``node``.

    Breadth first: each round joins only the newest frontier, reduced to distinct nodes; it ends with the first empty one. A search that is
    not done after ``condense_from`` rounds meets long chains: these are shortened to single links with their number of steps (``chains``), and the
    search goes on over what is left, by total steps.
    """
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, condense_from + 1):
        step = (
            links.join(frontier.select(F.col("node").alias("src")), "src")
            .select(F.col("dst").alias("node")).distinct()
            .join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        frontier = cut(step)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    return _shortest(cut(links), cut(seen), frontier)


def _shortest(links: DataFrame, seen: DataFrame, frontier: DataFrame) -> DataFrame:
    """Go on from a frontier over shortened chains; ``seen`` holds all nodes up to the frontier's depth with their distance."""
    inner = chains(links, seen)
    heads = links.withColumn("steps", F.lit(1))
    if inner is not None:
        into = heads.join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
        heads = cut(into.join(inner.select(F.col("node").alias("src"), "head", F.col("steps").alias("before")), "src", "left").select(
            F.coalesce("head", "src").alias("src"), "dst", (F.col("steps") + F.coalesce("before", F.lit(0))).alias("steps")))
    while True:
        offered = heads.join(frontier.select(F.col("node").alias("src"), "depth"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        frontier = cut(offered.join(seen.select("node", F.col("depth").alias("known")), "node", "left").where("known IS NULL OR depth < known").drop("known"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier).groupBy("node").agg(F.min("depth").alias("depth")))
    if inner is None:
        return seen
    within = inner.join(seen.select(F.col("node").alias("head"), "depth"), "head").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
    return seen.unionByName(within).groupBy("node").agg(F.min("depth").alias("depth"))
