"""Skeletons, completion, kept results."""

import pytest

from graphloom.operators.compiler import run
from graphloom.plans.completion import complete
from graphloom.plans.lexer import QueryError
from graphloom.plans.skeletons import PREDEFINED, Skeletons, predefined
from graphloom.sources.cache import QueryCache, kill, tagged
from tests.test_engine import program


@pytest.fixture(scope="module")
def pair(spark):
    return program(spark, {("m1", "f", 1): [("m2", "h", 0)], ("m2", "h", 0): [], ("m2", "g", 1): [("m2", "g", 1)]})[0]


def test_skeletons(spark, pair):
    s = Skeletons()
    s.save("named", "mods[name == $module$].funs[arity $op$ $n$].name", "me", "by arity")
    assert s.fill("named", "m2", "<", "1") == "mods[name == m2].funs[arity < 1].name"
    assert s.fill("named", "$x$", "<", "1").startswith("mods[name == $x$]")
    assert s.query("named(`m2`, `==`,`1`).") == "mods[name == m2].funs[arity == 1].name"
    assert s.query("mods.funs") == "mods.funs"
    assert [r["value"] for r in run(pair, s.query("named(`m2`,`==`,`0`)")).df.collect()] == ["h"]
    assert s.call_format("named") == "named(`module`, `op`, `n`)" and s.complete("na") == [s.call_format("named")]
    s.update("named", comment="other")
    assert Skeletons.of_table(s.table(spark)).rows == s.rows and s.get("named")[2] == "other"
    for bad in (lambda: s.save("named", "mods"), lambda: s.save("odd", "mods[$"), lambda: s.fill("named", "m1"), lambda: s.delete("none"), lambda: s.fill("none")):
        with pytest.raises(QueryError):
            bad()
    s.delete("named")
    assert s.table(spark).count() == 0
    assert predefined(spark, "macro").count() == len(PREDEFINED["macro"])


def test_completion(pair):
    names = lambda q: {n for n, _ in complete(pair, q)}
    assert {"mods", "files", "modules"} <= names("")
    assert names("mo") == {"mods", "modules"}
    assert {"functions", "name"} <= names("mods.") and "calls" not in names("mods.")
    assert {"calls", "arity"} <= names("mods.funs.") and names("mods.funs.cal") >= {"calls"}
    assert {"arity", "not"} <= names("mods.funs[")
    assert {"<", "==", "in"} <= names("mods.funs[arity ") and "~" in names("mods.funs[name ")
    assert "]" in names("mods.funs[arity == 1") and "and" in names("mods.funs[arity == 1")
    assert names("mods.funs.arity:a") == {"average", "avg"} and names("mods.funs.name:") == set()
    assert "M" in names("mods[M=name].funs[name == ") and "X" in names("mods->X.funs?")
    assert {"name", "functions"} <= names("mods.funs[arity == 1].file.")
    assert "calls" in names("mods.funs.(calls)+.") and "called_by" in names("mods.funs.(calls U .")
    assert names("mods.nothing.") == names("mods)") == names("mods.name.") == set()


def test_cache(spark, pair):
    cache = QueryCache(most=2)
    a = cache.run(pair, "mods . funs.name", owner="x")
    assert cache.run(pair, "mods.funs . name", owner="y") is a and sorted(r["value"] for r in a.df.collect()) == ["f", "g", "h"]
    assert cache.run(pair, "mods.funs.name", groupby=1) is not a and len(cache.rows) == 2
    cache.leave("x")
    assert len(cache.rows) == 2
    cache.leave("y")
    assert len(cache.rows) == 1
    pair.snapshot = "next"
    cache.run(pair, "mods.name")
    assert [k[0] for k in cache.rows] == ["next"]
    cache.flush()
    assert not cache.rows
    with tagged(spark, "one"):
        assert "one" in spark.getTags()
    assert kill(spark, "one") == [] and "one" not in spark.getTags()
