"""Ordered trees over links(src, dst, idx): children, ways to the root, leaves, texts, common ancestors, bounded descent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graphs import reachable
from graphloom.sources.scratch import settled


def children(links: DataFrame) -> DataFrame:
    """(node, place, child): each node's children, numbered from 1 by idx, then id."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("idx", "dst"))
    return links.select(F.col("src").alias("node"), place.alias("place"), F.col("dst").alias("child"))


def root_paths(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, root, path, places): the ids from the root to the node, both included, and the places among siblings on that
    way, which order a tree's nodes as its text does. roots(node) are nodes without a parent unless given; a round for
    each level. Nodes on a circle hang on no root and are left out.
    """
    placed = settled(children(links))
    if roots is None:
        roots = placed.select("node").distinct().join(placed.select(F.col("child").alias("node")), "node", "left_anti")
    level = settled(roots.select("node", F.col("node").alias("root"), F.array("node").alias("path"), F.array().cast("array<int>").alias("places")))
    out = level
    while True:
        a, b = level.alias("a"), placed.alias("b")
        down = a.join(b, F.col("a.node") == F.col("b.node")).where(~F.array_contains("path", F.col("child")))
        level = settled(down.select(F.col("child").alias("node"), "root", F.array_append("path", F.col("child")).alias("path"), F.array_append("places", F.col("place")).alias("places")))
        if level.isEmpty():
            return out
        out = out.union(level)


def descend(links: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node): what stands at most `depth` links below each start, itself included; any depth if None."""
    return reachable(links.select("src", "dst"), starts, depth)


def parents(paths: DataFrame) -> DataFrame:
    """(node, parent) of root_paths(); roots have none."""
    return paths.where("size(path) > 1").select("node", F.element_at("path", -2).alias("parent"))


def leaves(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(root, leaf, place): the nodes without children of each tree, numbered from 1 in the order of its text."""
    ends = paths.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    place = F.row_number().over(Window.partitionBy("root").orderBy("places"))
    return ends.select("root", F.col("node").alias("leaf"), place.alias("place"))


def outer_leaves(found: DataFrame) -> DataFrame:
    """(root, first_leaf, last_leaf) of leaves()."""
    return found.groupBy("root").agg(F.min_by("leaf", "place").alias("first_leaf"), F.max_by("leaf", "place").alias("last_leaf"))


def texts(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """(root, text): each tree's tokens(leaf, before, text, after) in order, joined."""
    said = found.join(tokens, "leaf").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("before", "text", "after").alias("t")))).alias("s"))
    return said.select("root", F.array_join(F.transform("s", lambda x: x["t"]), "").alias("text"))


def common_ancestors(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor) of pairs(a, b): the lowest node above both, or one of them; null in different trees."""
    p, q = paths.select(F.col("node").alias("a"), F.col("path").alias("p")), paths.select(F.col("node").alias("b"), F.col("path").alias("q"))
    shared = F.filter(F.zip_with("p", "q", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    return pairs.join(p, "a").join(q, "b").select("a", "b", F.try_element_at(shared, F.lit(-1)).alias("ancestor"))
