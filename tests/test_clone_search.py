"""The door to clone searches, filters and the measures of texts."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.clone_measures import clause_measures, text_measures
from graphloom.operators.clone_search import different_calls, few_tokens, find_clones, rejected


def test_search_by_measures(spark):
    rows = [(1, 30, 5, 2, 1, 9), (2, 32, 5, 2, 1, 9), (3, 200, 5, 2, 1, 9), (4, 31, 6, 3, 2, 8), (5, 30, 5, 2, 1, 20)]
    names = ("tokens", "eloc", "tles", "funcls", "arcs")
    units = spark.createDataFrame(rows, "id long, tokens int, eloc int, tles int, funcls int, arcs int")
    delta = {"tokens": 50, "eloc": 5, "tles": 5, "funcls": 1, "arcs": 10}
    near = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and all(abs(x[k + 1] - y[k + 1]) <= delta[n] for k, n in enumerate(names))}
    found = find_clones(units)
    assert {(r.a, r.b) for r in found.found.collect()} == near == {(1, 2), (1, 4), (2, 4)}
    assert found.summary() == {"analysed_candidates_num": 5, "detected_clones_num": 3}
    assert [r.member for r in found.group("1-2-4").orderBy("member").collect()] == [1, 2, 4]
    assert {(r.a, r.b) for r in find_clones(units, max_rank=2).found.collect()} == {(1, 2)}
    assert find_clones(units, filters=(F.col("eloc2") > 5,)).found.count() == 1


def test_search_in_texts(spark):
    run = " ".join(f"w{k}" for k in range(8))
    units = spark.createDataFrame([(1, f"a {run} b"), (2, f"{run} c"), (3, f"d {run}"), (4, "x y"), (5, "X  y"), (6, None)], "id long, text string")
    assert {(r.id, r.start, r.tokens) for r in find_clones(units, "suffix_tree", minlen=5).found.collect()} == {(2, 1, 8), (3, 2, 8)}
    assert find_clones(units, "suffix_tree", minlen=5, minnum=4).found.count() == 0
    assert [(r.members, r.first) for r in find_clones(units, "exact").found.collect()] == [(2, 4)]
    lines = spark.createDataFrame([(k, p, at, t) for k, (p, at, t) in enumerate((p, at, t) for p in (1, 2, 3) for at, t in enumerate(("a b", "c d", f"only {p}")))], "id long, parent long, at int, text string")
    whole = find_clones(lines, "matrix", least=2).found
    assert {(r.parent_a, r.parent_b, r.units) for r in whole.collect()} == {(1, 2, 2), (1, 3, 2)}
    assert {r.parent_b for r in find_clones(lines, "matrix", least=2, subject=(3, 0, 0)).found.collect()} == {3}
    for wrong in ({"algorithm": "none"}, {"algorithm": "exact", "gap": 1}, {"algorithm": "matrix", "diff_limit": 1}, {"algorithm": "suffix_tree", "minlen": 0}):
        with pytest.raises(ValueError):
            find_clones(units, **wrong)


def test_filters_and_text_measures(spark):
    rows = spark.createDataFrame([(1, 19, 30, ["f"], ["f"]), (2, 20, 30, ["f"], ["g"]), (3, 20, 30, [], []), (4, None, 30, ["f"], ["f", "g"])], "id int, tokens1 int, tokens2 int, calls1 array<string>, calls2 array<string>")
    assert [r.id for r in rejected(rows, (few_tokens(), different_calls())).orderBy("id").collect()] == [3, 4]
    text = spark.createDataFrame([("f(X) -> % one, 2\n\n%% two\n  X + 1.",), (None,)], "text string")
    got = [tuple(r) for r in text.select(*[c.alias(n) for n, c in text_measures(F.col("text")).items()]).collect()]
    assert got == [(5, 2, 2, 7), (0, 0, 0, 0)]


def test_clause_measures(spark):
    make = spark.createDataFrame
    expressions = [(50, "infix_expr", False), (30, "case_expr", False), (33, "application", False), (34, "application", True), (31, "match_expr", False), (32, "variable", False)]
    nodes = {
        "clause": make([(20,), (21,)], "id long"), "function": make([(12, "throw"), (13, "spawn")], "id long, name string"),
        "variable": make([(60, "Xy"), (61, "Long1")], "id long, name string"),
        "expression": make(expressions, "id long, type string, is_last boolean").withColumn("has_side_effect", F.col("type") == "application"),
    }
    links = [(20, "guard", 50), (20, "body", 30), (20, "body", 33), (20, "body", 34), (30, "exprcl", 40), (30, "exprcl", 41), (30, "esub", 31), (31, "esub", 32), (31, "varbind", 60), (32, "varref", 61), (33, "funeref", 12), (34, "funeref", 13)]
    edges = make([(a, t, 1, b) for a, t, b in links], "src_id long, tag string, idx int, dst_id long")
    one, none = (r.asDict() for r in clause_measures(nodes, edges).orderBy("id").collect())
    want = {"nodes": 6, "decisions": 1, "arcs": 2, "indep_path": 2, "funcalls": 2, "unique_funcalls": 2, "throw": 1, "spawn": 1, "exits": 2, "avg_complexity_of_decs": 2.0, "avg_length_of_var_names": 3.5, "var_binds": 1, "unused_matching": 0, "tles": 3, "guarded_clauses": 1, "dirty_expressions": 2, "infix_ops": 1}
    assert {k: one[k] for k in want} == want
    assert {k: v for k, v in none.items() if v} == {"id": 21, "indep_path": 1}
