"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def contracted(edges: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One round: each node hooks to its neighbour of least rank if that is less than its own. Returns the
    hooks (node, parent) and the edges between different parents. Ranks have no ties: in round 0 most
    links come first, then a hash of the node, which is another in each round."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own, other = (F.struct(F.xxhash64(x, F.lit(turn)).alias("h"), F.col(x).alias("i")) for x in "ab")
    if not turn:
        degrees = scratch.cut(near.groupBy(F.col("a").alias("b")).agg((-F.count("*")).alias("degree")))
        near = near.join(degrees, "b")  # a plain join of written tables, so Spark can split a node of very many links
        own, other = F.struct((-F.col("n")).alias("r"), own.alias("o")), F.struct(F.col("degree").alias("r"), other.alias("o"))
    best = near.groupBy("a").agg(F.count("*").alias("n"), F.min_by("b", other).alias("parent"), F.min(other).alias("rank"))
    hooks = scratch.cut(best.where(F.col("rank") < own).select(F.col("a").alias("node"), "parent"))
    out = edges
    for x in "ab":
        out = out.join(hooks.withColumnsRenamed({"node": x, "parent": "to"}), x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
    out = out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return hooks, scratch.cut(out)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the smallest node reachable.

    Distributed union-find by hooking and contraction: each round every node hooks to one neighbour, and
    links are rewritten to the parents, without those inside one; a parent's own hook is kept by the link
    that its child had to it. The first round hooks to the neighbour of most links, so that stars go at
    once; the others by a hash new in each round, which halves the nodes of any chain on average: about
    log2 of the nodes' number of rounds, each over fewer links. Hooks are joined from the last round back."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    edges = scratch.cut(edges.where("a <> b"))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        hooks, fewer = contracted(edges, len(rounds), scratch)
        scratch.drop(edges)
        edges = fewer
        rounds.append(hooks)
    roots = nodes.withColumn("root", F.col("node"))
    if rounds:
        # A node's hook of round r leads to a node of round r + 1: from the last round to the first.
        top = rounds[-1].withColumnRenamed("parent", "root")
        for hooks in reversed(rounds[:-1]):
            known = top.withColumnsRenamed({"node": "parent"})
            here = hooks.join(known, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
            top = scratch.cut(here.unionByName(top.join(hooks.select("node"), "node", "left_anti")))
        roots = nodes.join(top, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = scratch.cut(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.cut(roots.join(least, "root").select("node", "component"))
