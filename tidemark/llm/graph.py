"""Connected components by contraction: every round hooks each node to a neighbour of a fresh random order and shrinks the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.store import stage


def contractions(edges: DataFrame) -> list[DataFrame]:
    """The rounds' maps (node, root), each over the nodes that the round before left with an edge.

    A round orders all nodes by a hash of their own and the round's number and points each to its least neighbour.  The only circles are pairs
    that point to each other; the lesser of a pair is a root.  Pointers are doubled twice, edges renamed, and those inside one node dropped.
    Every root takes at least one node with it, so a round halves the nodes whatever the graph; a chain shrinks to less than a third, a star
    to one node.  The least neighbour comes from a partial aggregate, so a centre with a third of all edges arrives as one row per
    task; renaming joins have a unique side, which adaptive execution may split against.
    """
    alive = stage(_clean(edges.select("a", "b")), "edges")
    rounds = []
    while not alive.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("draw"), F.col(c).alias("node"))
        both = alive.select("a", "b").union(alive.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy("a").agg(F.min(place("b"))["node"].alias("up")).select(F.col("a").alias("node"), "up"), "hook")
        named = lambda of, node, up: of.select(F.col("node").alias(node), F.col("up").alias(up))
        twice = hook.join(named(hook, "up", "back"), "up")
        root = (F.col("back") == F.col("node")) & (place("node") < place("up"))
        tree = twice.select("node", F.when(root, F.col("node")).otherwise(F.col("up")).alias("up"))
        for _ in range(2):
            tree = stage(tree, "tree")
            tree = tree.join(named(tree, "up", "top"), "up").select("node", F.col("top").alias("up"))
        step = stage(tree.select("node", F.col("up").alias("root")), "step")
        rounds.append(step)
        renamed = alive.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        alive = stage(_clean(renamed.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    return rounds


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root), one row per node that has an edge; root is a node of its component.

    Null ends and self loops are ignored.
    """
    rounds = contractions(edges)
    if not rounds:
        return edges.where("false").select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("root"))
    label = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
        label = stage(step.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    return label


def _clean(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, without loops."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
