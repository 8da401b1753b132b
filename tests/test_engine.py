"""Golden and metamorphic tests of the query language on small program graphs."""

import random

import pytest

from graphloom.operators import clones, graphs
from graphloom.operators.compiler import run
from graphloom.plans.lexer import QueryError
from graphloom.sources.program import program_catalog


def program(spark, functions):
    """functions: {(module, name, arity): [callees]}."""
    modules = sorted({m for m, _, _ in functions})
    file_id = {m: i for i, m in enumerate(modules)}
    fun_id = {f: 100 + i for i, f in enumerate(functions)}
    files = spark.createDataFrame([(i, m) for m, i in file_id.items()], "id long, name string")
    funs = spark.createDataFrame([(i, n, a, m) for (m, n, a), i in fun_id.items()], "id long, name string, arity long, module string")
    rows = [(file_id[m], "func", 0, i) for (m, _, _), i in fun_id.items()]
    rows += [(fun_id[f], "funcall", k, fun_id[c]) for f, calls in functions.items() for k, c in enumerate(calls)]
    edges = spark.createDataFrame(rows, "src_id long, tag string, idx int, dst_id long")
    return program_catalog({"file": files, "function": funs}, edges), {i: f for f, i in fun_id.items()}


@pytest.fixture(scope="module")
def pair(spark):
    f, h, g = ("m1", "f", 1), ("m2", "h", 0), ("m2", "g", 1)
    return program(spark, {f: [h], h: [], g: [g]})


def values(catalog, query, **options):
    return sorted(r["value"] for r in run(catalog, query, **options).df.select("value").distinct().collect())


def nodes(catalog, query):
    return {r["node"] for r in run(catalog, query, output="nodes").df.collect()}


def test_set_operators(pair):
    c, _ = pair
    assert values(c, "mods[.name all_in |m1,m2|](.funs union .funs.calls).name") == ["f", "g", "h"]
    assert nodes(c, "mods.funs[.name any_in |g,h|]") == nodes(c, "mods.funs[name==g or name==h]")
    assert nodes(c, "mods -- mods->A") == set()


def test_closure_laws(pair):
    c, _ = pair
    assert nodes(c, "mods.funs.(calls[false])+") == nodes(c, "mods.funs")
    assert nodes(c, "mods.funs.((calls)+)+") == nodes(c, "mods.funs.(calls)+")
    assert nodes(c, "mods.funs.{calls}2") == nodes(c, "mods.funs.{calls}1{calls}1".replace("}1{", "}1.{"))
    assert values(c, "mods.funs.(calls[A=name])1.name") == values(c, "mods.funs.name U mods.funs.calls.name")


def test_chains(pair):
    c, label = pair
    got = {(tuple(label[i][1] for i in r["path"]), r["cyclic"]) for r in run(c, "mods.funs.(calls)+").df.collect()}
    assert got == {(("f", "h"), False), (("h",), False), (("g", "g"), True)}


def test_variables_and_grouping(pair):
    c, _ = pair
    assert values(c, "mods[M=name].funs[name==g].M") == ["m2"]
    rows = {r["group"]: (r["kind"], r["values"]) for r in run(c, "mods.funs.name", groupby=1).labelled().collect()}
    assert sorted(v for _, v in rows.values()) == [["f"], ["g", "h"]] and {k for k, _ in rows.values()} == {"propertylist"}
    assert run(c, "mods.funs.arity:avg").df.first()["value"] == pytest.approx(2 / 3)


def test_errors_and_help(pair):
    c, _ = pair
    for bad in ("mods.nothing", "nowhere", "mods.name.funs", "mods.name:avg", "mods["):
        with pytest.raises(QueryError):
            run(c, bad)
    assert run(c, "mods.funs.?").df.where("name = 'calls'").count() == 1


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "src int, dst int")
    scc = {r["node"]: r["component"] for r in graphs.strong_components(e).collect()}
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert {(r["src"], r["dst"]) for r in graphs.cyclic(e).collect()} == {(1, 2), (2, 3), (3, 1), (5, 5)}


def test_cliques(spark):
    rng = random.Random(3)
    edges = [(1, 2), (2, 3), (1, 3), (3, 4)] + [(rng.randrange(10, 22), rng.randrange(10, 22)) for _ in range(50)]
    got = {}
    for r in clones.clique_groups(spark.createDataFrame(edges, "a int, b int")).collect():
        got.setdefault(r["group_id"], set()).add(r["member"])
    near = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    nodes_ = {x for e in near for x in e}
    every = {frozenset(c) for c in _all_cliques(sorted(nodes_), near)}
    assert {frozenset(g) for g in got.values()} == {c for c in every if len(c) > 1 and not any(c < d for d in every)}


def test_cliques_of_a_divided_component(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"n{a}", f"n{b}") for a in range(40) for b in range(a) if rng.random() < 0.8]
    groups = lambda: sorted((r["group_id"], r["member"]) for r in clones.clique_groups(spark.createDataFrame(edges, "a string, b string")).collect())
    whole = groups()
    monkeypatch.setattr(clones, "SHARE", 100)
    assert len({g for g, _ in whole}) > 100 and groups() == whole
    assert clones.clique_groups(spark.createDataFrame([], "a int, b int")).count() == 0


def test_cliques_list_no_triangles(spark):
    n = 150
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in range(a)], "a int, b int").cache()
    edges.count()
    before = _shuffled(spark)
    assert [r["member"] for r in clones.clique_groups(edges).orderBy("member").collect()] == list(range(n))
    assert _shuffled(spark) - before < 20 * edges.count()


def _shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def _all_cliques(nodes_, near):
    out = [[]]
    for v in nodes_:
        out += [[*c, v] for c in out if all((x, v) in near for x in c)]
    return out


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _classes(texts, key):
    out = {}
    for i, t in sorted(texts):
        out.setdefault(key(t), []).append(i)
    return {v[0]: (k, len(v)) for k, v in out.items()}


def test_similar_by_edits(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 26))) for _ in range(40)]
    words += ["".join(rng.choice("abc") if rng.random() < 0.08 else c for c in w) + rng.choice(["", "b"]) for w in words] + ["", None, words[3]]
    texts = list(enumerate(words))
    for s in (0.7, 0.9):
        got = {(r["a"], r["members_a"], r["b"], r["members_b"], round(r["score"], 6)) for r in clones.similar_by_edits(spark.createDataFrame(texts, "id int, text string"), s).collect()}
        classes = _classes(texts, lambda t: t or "")
        want = {(a, n, a, n, 1.0) for a, (_, n) in classes.items() if n > 1}
        for a, (x, n) in classes.items():
            for b, (y, m) in classes.items():
                score = 1 - _distance(x, y) / max(len(x), len(y), 1)
                if a < b and score >= s - 1e-12:
                    want.add((a, n, b, m, round(score, 6)))
        assert got == want
    assert clones.similar_by_edits(spark.createDataFrame([], "id int, text string")).count() == 0


def test_similar_by_grams(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    rows = [" ".join(w) for w in base] + [" ".join(w[1:] + ["z"]) for w in base] + [" ".join(w) + " q" for w in base] + ["", None, " ".join(base[0])]

    def grams(t):
        w = (t or "").split()
        return frozenset(zip(w, w[1:])) or frozenset(w)

    texts = [(i, t) for i, t in enumerate(rows) if grams(t)]
    classes = _classes(texts, grams)
    want = {(a, n, a, n) for a, (_, n) in classes.items() if n > 1}
    want |= {(a, n, b, m) for a, (x, n) in classes.items() for b, (y, m) in classes.items() if a < b and 2 * len(x & y) / (len(x) + len(y)) >= 0.8 - 1e-12}
    got = clones.similar_by_grams(spark.createDataFrame(list(enumerate(rows)), "id int, text string"), 0.8)
    assert {(r["a"], r["members_a"], r["b"], r["members_b"]) for r in got.collect()} == want


def test_similar_by_grams_shuffles_first_grams_only(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(600)] for _ in range(150)]
    rows = [" ".join(w) for w in base] + [" ".join(w[:-3]) for w in base[::5]]
    units = spark.createDataFrame(list(enumerate(rows)), "id int, text string").repartition(2).cache()
    units.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    assert clones.similar_by_grams(units).count() == 30
    assert written() - before < 3 * sum(map(len, rows))


def test_similar_by_grams_of_a_crowd(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [[w if rng.random() > 0.025 else f"v{rng.randrange(10**6)}" for w in base] for _ in range(200)]
    sets = [set(zip(r, r[1:])) for r in rows]
    want = {(a, b): 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) for b in range(200) for a in range(b)}
    want = {(a, b, round(x, 9)) for (a, b), x in want.items() if x >= 0.9 - 1e-12}
    assert 3000 < len(want) < 19000
    units = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "id int, text string").cache()
    units.count()
    before = _shuffled(spark)
    got = [(r["a"], r["b"], round(r["score"], 9)) for r in clones.similar_by_grams(units).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert _shuffled(spark) - before < 2 * sum(len(" ".join(r)) for r in rows)  # no row for each pair


def test_runs_and_bindings(spark):
    w = [f"t{i}" for i in range(40)]
    rows = [(1, " ".join(w)), (2, "x " + " ".join(w[3:]) + " y"), (3, " ".join(w[:31])), (4, None)]
    got = [tuple(r) for r in clones.token_runs(spark.createDataFrame(rows, "id int, text string")).collect()]
    assert got == [(1, 4, 2, 2, 37)]
    short = spark.createDataFrame([(1, "a b c d e f g"), (2, "c d e f g"), (3, "b c d"), (4, "g")], "id int, text string")
    for length, want in ((1, {(1, 3, 2, 1, 5), (1, 2, 3, 1, 3), (1, 7, 4, 1, 1)}), (3, {(1, 3, 2, 1, 5), (1, 2, 3, 1, 3)}), (5, {(1, 3, 2, 1, 5)}), (6, set())):
        assert {tuple(r) for r in clones.token_runs(short, length).collect()} == want
    pairs = spark.createDataFrame([(1, ["A", "B", "A"], ["X", "Y", "X"]), (2, ["A", "B"], ["X", "X"]), (3, ["A"], ["X", "Y"])], "k int, p array<string>, q array<string>")
    assert [r["k"] for r in clones.consistent(pairs, "p", "q").collect()] == [1]
    runs = spark.createDataFrame([(1, 1, 10), (1, 2, 5), (1, 5, 9), (2, 2, 5)], "g int, s int, n int")
    assert sorted(map(tuple, clones.without_contained(runs, ["g"], "s", "n").collect())) == [(1, 1, 10), (1, 5, 9), (2, 2, 5)]
    short = spark.createDataFrame([(1, 20), (1, 11), (2, 30), (2, 1), (3, 40)], "parent int, tokens int")
    assert sorted(map(tuple, clones.merged_short(short).collect())) == [(1, 32), (2, 32)]
    units = spark.createDataFrame([(p * 10 + k, p, k, t) for p in (1, 2) for k, t in enumerate(["a b c", "d e f", f"only {p} here x"])], "id int, parent int, at int, text string")
    assert [tuple(r) for r in clones.clone_matrix(units).collect()] == [(1, 0, 2, 0, 2)]


def test_close_classes(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("pq"), rng.randrange(12), rng.randrange(12)) for i in range(150)] + [(900, None, 1, 1), (901, "p", None, 1)]
    got = clones.close_classes(spark.createDataFrame(rows, "id int, k string, x int, y int"), ["k"], {"x": 2, "y": 0})
    classes = {}
    for i, *key in rows[:150]:
        classes.setdefault(tuple(key), []).append(i)
    want = sorted((u[0], v[0]) for a, u in classes.items() for b, v in classes.items() if a[0] == b[0] and abs(a[1] - b[1]) <= 2 and a[2] == b[2] and (u[0] < v[0] or a == b and len(u) > 1))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


def test_selections_and_connections(spark, tmp_path):
    v = spark.createDataFrame([(1, "m", "f", 1, "m:f/1"), (2, "m", "ff", 1, "m:ff/1"), (3, "n", "f", 2, "n:f/2")], "id int, module string, name string, arity int, label string")
    ids = lambda p: {r["id"] for r in graphs.matching(v, p).collect()}
    assert ids("m:f/1") == {1} and ids(":f/") == {1, 3} and ids("m:") == {1, 2} and ids("f+") == {1, 2, 3} and ids("[mn]:f/.") == {1, 3}
    assert graphs.node_of(v, "m:ff/1").first()["id"] == 2
    with pytest.raises(LookupError):
        graphs.node_of(v, "none")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 2), (4, 6), (1, 7)], "src int, dst int")
    chosen = spark.createDataFrame([(1,), (4,)], "node int")
    assert graphs.connections(e, chosen, 2).count() == 0
    assert [tuple(r) for r in graphs.connections(e, chosen, 3).collect()] == [(1, 4, "1->2->3->4")]
    nodes_, arcs = graphs.indirect_connections(e, chosen)
    assert {tuple(r) for r in nodes_.collect()} == {(1, "chosen"), (2, "pnode"), (3, "pnode"), (4, "chosen")}
    assert {tuple(r) for r in arcs.collect()} == {(1, 2, "callarc"), (2, 3, "callarc"), (3, 4, "callarc"), (1, 4, "icallarc")}
    graphs.save_graph(v, e, str(tmp_path))
    assert [d.count() for d in graphs.load_graph(spark, str(tmp_path))] == [3, 6]
