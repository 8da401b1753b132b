"""Paths over links, and ordered trees, on small cases."""

from graphloom.operators import trees
from graphloom.sources.program import Paths


def test_paths(spark):
    rows = [(1, "a", 1, 2), (1, "a", 2, 3), (2, "b", 1, 4), (3, "c", 1, 5), (4, "a", 1, 4), (1, "b", 1, 9)]
    edges = spark.createDataFrame(rows, "src_id long, tag string, idx int, dst_id long")
    nodes = spark.createDataFrame([(k, f"n{k % 2}") for k in range(10)], "id long, name string")
    p = Paths(edges, nodes)
    of = lambda path: {tuple(r) for r in p.follow(path).collect()}
    assert of("a") == {(1, 2), (1, 3), (4, 4)} and of("^a") == {(2, 1), (3, 1), (4, 4)}
    assert of("a#2") == {(1, 3)} and of("a#-1") == {(1, 3), (4, 4)}
    assert of("a/b|a/c") == {(1, 4), (1, 5)}
    assert of("a[name = 'n0']") == {(1, 2), (4, 4)} and of("^a[name = 'n1']/b") == {(2, 9), (3, 9)}
    assert of("b?c?a") == {(1, 9), (2, 4), (3, 5), (4, 4)}
    assert {(s, d) for s, d in of("a*") if s in (1, 4)} == {(1, 1), (1, 2), (1, 3), (4, 4)} and (9, 9) in of("a*")


def test_trees(spark):
    rows = [(1, 3, 2), (1, 2, 1), (2, 4, 1), (2, 5, 2), (5, 6, 1), (7, 8, 1), (20, 21, 1), (21, 20, 1)]
    links = spark.createDataFrame(rows, "src long, dst long, idx int")
    paths = trees.root_paths(links)
    assert {(r["node"], tuple(r["path"])) for r in paths.collect()} == {(1, (1,)), (2, (1, 2)), (3, (1, 3)), (4, (1, 2, 4)), (5, (1, 2, 5)), (6, (1, 2, 5, 6)), (7, (7,)), (8, (7, 8))}
    found = trees.leaves(paths, links)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 3), (1, 4, 1), (1, 6, 2), (7, 8, 1)]
    assert sorted(map(tuple, trees.outer_leaves(found).collect())) == [(1, 4, 3), (7, 8, 8)]
    tokens = spark.createDataFrame([(3, "", "c", "!"), (4, "", "a", " "), (6, "", "b", " "), (8, "x", "y", "z")], "leaf long, before string, text string, after string")
    assert sorted(map(tuple, trees.texts(found, tokens).collect())) == [(1, "a b c!"), (7, "xyz")]
    pairs = spark.createDataFrame([(4, 6), (4, 2), (3, 6), (3, 8)], "a long, b long")
    assert sorted(map(tuple, trees.common_ancestors(paths, pairs).collect())) == [(3, 6, 1), (3, 8, None), (4, 2, 2), (4, 6, 2)]
    starts = spark.createDataFrame([(1,), (7,)], "node long")
    assert sorted(map(tuple, trees.descend(links, starts, 1).collect())) == [(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)]
    assert trees.root_paths(links.limit(0)).count() == 0
