"""Clusters of small call graphs against plain versions."""

import itertools
import random

import pytest

from graphloom.operators import clustering as C

CALLS = [(1, 2, 5), (2, 1, 1), (2, 3, 4), (1, 3, 4), (4, 5, 7), (5, 6, 3), (4, 6, 2), (3, 4, 1), (7, 7, 9)]


def calls_of(spark, rows=CALLS):
    return spark.createDataFrame(rows, "src long, dst long, n long")


def plain(ids, weights, least):
    """Joins the nearest pair, one after the other."""
    groups = [frozenset([i]) for i in ids]
    while True:
        mean = lambda p: sum(weights.get((min(x, y), max(x, y)), 0) for x in p[0] for y in p[1]) / (len(p[0]) * len(p[1]))
        pairs = sorted(itertools.combinations(sorted(groups, key=min), 2), key=lambda p: -mean(p))
        if not pairs or mean(pairs[0]) <= least:
            return {i: min(g) for g in groups for i in g}
        groups = [g for g in groups if g not in pairs[0]] + [pairs[0][0] | pairs[0][1]]


def test_weights(spark):
    rows = lambda **o: {(r.a, r.b): round(r.weight, 6) for r in C.call_weights(calls_of(spark), **o).collect()}
    assert rows()[1, 2] == 6 and (7, 7) not in rows()
    assert set(rows(transform="zero_one").values()) == {1}
    assert rows(distance="call_sum")[4, 5] == round(7 / (10 + 10 - 7), 6)
    with pytest.raises(ValueError):
        C.call_weights(calls_of(spark), distance="other")
    kept = C.without_libraries(calls_of(spark), 1).select("src", "dst").collect()
    assert {tuple(r) for r in kept} == {(1, 2), (2, 1), (4, 5), (7, 7)}


def test_agglomerative(spark):
    draw = random.Random(3)
    weights = {p: draw.random() for p in itertools.combinations(range(12), 2) if draw.random() < 0.5}
    frame = spark.createDataFrame([(*k, v) for k, v in weights.items()], "a long, b long, weight double")
    for least in (0.2,):
        got = {r.id: r.cluster for r in C.agglomerative(spark.range(12), frame, least).collect()}
        assert got == plain(range(12), weights, least)
    sized = C.agglomerative(spark.range(12), frame, max_cluster_size=3).groupBy("cluster").count().collect()
    assert max(r["count"] for r in sized) <= 3 and sum(r["count"] for r in sized) == 12
    assert C.agglomerative(spark.range(2), frame.limit(0)).count() == 2
    assert C.agglomerative(spark.range(0), frame).count() == 0


def test_genetic(spark):
    weights = C.call_weights(calls_of(spark))
    ids = spark.range(1, 8)
    of = lambda n: {r.id: r.cluster for r in C.genetic(ids, weights, population=8, iterations=n).collect()}
    value = lambda c: C.fitness(spark.createDataFrame([(1, k, v) for k, v in c.items()], "individual int, id long, cluster long"), weights).first().fitness
    start, end = of(0), of(3)
    assert len(end) == 7 and end == of(3) and value(end) >= value(start)
    two = {i: 1 if i < 4 else 4 for i in range(1, 7)}
    assert value(end) <= value(two) + 1e-9
    assert C.genetic(ids, weights.limit(0)).count() == 7
