"""Metrics of a small program with known values, and starts by position."""

import pytest

from graphloom.functions.program_metrics import call_depths
from graphloom.operators.compiler import run
from graphloom.plans.lexer import QueryError
from graphloom.sources.program import program_catalog

# One file (1) with f (10), g (11), h (12), and io:format (13) of file 2; g calls f and h, f calls io:format.
FILES, FUNS = [(1, "m", "m.erl"), (2, "io", None)], [(10, "f", 1, True), (11, "g", 1, True), (12, "h", 1, True), (13, "format", 1, False)]
CLAUSES = [(20, "f"), (21, "g"), (22, "h")]
# g: application(case(application)) and a send; f: an application that is last; h: a fun.
EXPRS = [(30, "application", False), (31, "case_expr", False), (32, "application", True), (33, "send_expr", False), (34, "application", True), (35, "fun_expr", False)]
EDGES = [
    (1, "func", 10), (1, "func", 11), (1, "func", 12), (2, "func", 13), (11, "funcall", 10), (11, "funcall", 12), (10, "funcall", 13),
    (10, "funcl", 20), (11, "funcl", 21), (12, "funcl", 22), (21, "body", 30), (30, "esub", 31), (31, "esub", 32), (21, "body", 33), (20, "body", 34), (22, "body", 35),
    (31, "exprcl", 40), (31, "exprcl", 41), (31, "exprcl", 42), (34, "funeref", 13),
]


@pytest.fixture(scope="module")
def catalog(spark):
    tables = {
        "file": spark.createDataFrame(FILES, "id long, name string, path string"), "function": spark.createDataFrame(FUNS, "id long, name string, arity long, defined boolean"),
        "clause": spark.createDataFrame(CLAUSES, "id long, name string"), "expression": spark.createDataFrame(EXPRS, "id long, type string, is_last boolean"),
    }
    edges = spark.createDataFrame([(a, t, 1, b) for a, t, b in EDGES], "src_id long, tag string, idx int, dst_id long")
    spans = spark.createDataFrame([("m.erl", "function", 10, 0, 9), ("m.erl", "function", 11, 10, 40), ("m.erl", "expression", 30, 15, 30), ("m.erl", "expression", 31, 20, 25)], "file string, entity string, id long, start int, end int")
    return program_catalog(tables, edges, spans=spans)


def of(catalog, query, **start):
    return {r["group"]: r["value"] for r in run(catalog, query, **start).df.collect()}


def test_call_paths(catalog):
    assert of(catalog, "files.max_depth_of_calling") == {1: 2, 2: 0}
    assert of(catalog, "files.min_depth_of_calling") == {1: 1, 2: 0}
    assert of(catalog, "files.number_of_funpath") == {1: 3, 2: 0}
    assert of(catalog, "files.fun_calls_in") == {1: 0, 2: 1} and of(catalog, "files.callsout") == {1: 1, 2: 0} and of(catalog, "files.cohesion") == {1: 2, 2: 0}
    assert of(catalog, "files.funs.max_depth_of_calling") == {10: 1, 11: 2, 12: 0, 13: 0}
    assert of(catalog, "files.funs.min_depth_of_call") == {10: 1, 11: 1, 12: 0, 13: 0}
    assert set(of(catalog, "files.funs.branches_of_recursion").values()) == {0}


def test_expression_trees(catalog):
    assert of(catalog, "files.funs.max_application_depth") == {10: 1, 11: 2, 12: 0, 13: 0}
    assert of(catalog, "files.max_app_depth") == {1: 2, 2: 0} and of(catalog, "files.maxcasedepth") == {1: 1, 2: 0} and of(catalog, "files.min_depth_of_cases") == {1: 0, 2: 0}
    assert of(catalog, "files.funs.max_depth_of_structs") == {10: 0, 11: 1, 12: 1, 13: 0}
    assert of(catalog, "files.mccabe") == {1: 5, 2: 0} and of(catalog, "files.funs.mccabe") == {10: 1, 11: 3, 12: 1, 13: 0}
    assert of(catalog, "files.fun_return_points") == {1: 3, 2: 0} and of(catalog, "files.messpassnum") == {1: 1, 2: 0} and of(catalog, "files.funexprnum") == {1: 1, 2: 0}
    assert of(catalog, "files.funs.is_tail_recursive") == {10: "non_rec", 11: "non_rec", 12: "non_rec", 13: "unknown"}
    assert of(catalog, "files.funs.body.is_tailcall") == {30: False, 33: False, 34: True, 35: False}


def test_circles_and_positions(spark, catalog):
    edges = spark.createDataFrame([(a, "funcall", 1, b) for a, b in ((1, 2), (2, 1), (2, 3), (3, 4), (1, 4), (5, 5))], "src_id long, tag string, idx int, dst_id long")
    assert {r["id"]: tuple(r)[1:] for r in call_depths(edges).collect()} == {1: (2, 1, 2), 2: (2, 1, 2), 3: (1, 1, 1), 4: (0, 0, 0), 5: (0, 0, 0)}
    nodes = lambda q, **k: {r["node"] for r in run(catalog, q, **k).df.collect()}
    assert nodes("@fun.calls", file="m.erl", position=12) == {10, 12} and nodes("@expr", file="m.erl", position=22) == {31}
    assert nodes("@fun", file="m.erl", position=99) == set() and nodes("@file.funs", file="m.erl") == {10, 11, 12}
    with pytest.raises(QueryError):
        run(catalog, "@fun")
