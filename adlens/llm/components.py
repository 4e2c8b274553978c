"""Connected components of a link table by repeated contraction.

Each round every node moves to the neighbour (or itself) with the smallest hash, links are
rewritten between the new nodes and loops and repeats go; a constant share of the linked
nodes vanishes per round in expectation, whatever the ids look like. Everything is
``groupBy`` with map-side combine and equi-joins against one row per node; each round is
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from adlens.llm.common import written


def _target(node: str):
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("to"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b, long); the root is one node of the component."""
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(_target("b")).alias("n"))
        move = written(near.select(F.col("a").alias("node"), F.least(F.col("n"), _target("a"))["to"].alias("to")), "moves")
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(left, "a").join(right, "b").filter("x <> y")
                        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def grouped(members: DataFrame, linked: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the nodes that links between nodes of one key join; nodes without a link may be missing.

    ``members`` (key, node) has the nodes that share a key. All links that matter are found
    without listing the pairs of a key:

    1. The node that meets most others over all its keys stands in the middle of a group of
       variants. In each key the node that does is compared with the others: ``linked`` keeps
       the true links of a table of pairs (a, b).
    2. Where a key's nodes then still are in several components, those outside the key's
       largest component (``root`` is not ``main``) are to be compared with the nodes of all
       other components: ``across`` gets these keys' (key, node, root, main) and returns links
       (a, b) that join all it can join.

    Links inside one component change nothing, so leaving them out loses none.
    """
    met = members.groupBy("key").agg(F.count("*").alias("n"))
    middle = written(members.join(met, "key").groupBy("node").agg(F.sum("n").alias("met")), "middle")
    centre = F.max(F.struct("met", "node"))["node"].alias("centre")
    centres = members.join(middle, "node").groupBy("key").agg(centre)
    stars = members.join(centres, "key").filter("node <> centre")
    pairs = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    near = written(components(linked(pairs)).select(F.col("node").alias("of"), "root"), "near")

    placed = written(members.join(near, F.col("node") == F.col("of"), "left")
                     .select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = (parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts"))
             .filter("parts > 1").select("key", "main"))
    found = across(written(placed.join(mixed, "key"), "apart"))
    to = near.select(F.col("of").alias("end"), F.col("root").alias("at"))
    for side in ("a", "b"):  # links between the components of the first step
        found = found.join(to, F.col(side) == F.col("end"), "left").withColumn(side, F.coalesce("at", side)).drop("end", "at")
    more = components(found)
    more = written(more.select(F.col("node").alias("was"), F.col("root").alias("now")), "more")
    joined = near.join(more, F.col("root") == F.col("was"), "left").select(F.col("of").alias("node"), F.coalesce("now", "root").alias("root"))
    return joined.unionByName(more.join(near, F.col("was") == F.col("of"), "left_anti")
                              .select(F.col("was").alias("node"), F.col("now").alias("root")))
