"""Registered queries over the program catalog on the star program, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import clone_measures
from graphloom.operators import analyses, clustering, trees
from graphloom.operators.compiler import run
from graphloom.sources.program import Paths
from graphloom.sources.scratch import settled
from graphloom.sources.star_program import NODES, edges_sql, nodes_sql, star_program, star_tables

QUERIES, ORACLES = {}, {}

_EDGES = edges_sql().replace("{", "").replace("}", "")
#: How a query comes to all nodes of an entity, in the language and as a path.
_FROM = {
    "file": ("files", ""), "function": ("files.functions", "func"), "clause": ("files.functions.clauses", "func/funcl"), "variable": ("files.functions.clauses.variables", "func/funcl/vardef"),
    "record": ("files.records", "record"), "field": ("files.records.fields", "record/field"), "macro": ("files.macros", "macro"), "spec": ("files.specs", "spec"), "specparam": ("files.specs.arguments", "spec/specclause/specpar"),
    "type": ("files.types", "type"), "expression": ("files.functions.clauses.body.subexpression", "func/funcl/body/esub*"),
}
_EXPRS, _REFS = ("pattern", "guard", "body"), ("varref", "varbind")
_NOT_ATOM = "typeref!atom"


def _each(*parts) -> str:
    """All ways through alternatives, as paths."""
    return "|".join(reduce(lambda done, part: [f"{d}/{x}" if d else x for d in done for x in ((part,) if isinstance(part, str) else part)], parts, [""]))


#: What each selector has to give, from the definition of its links; -self leaves out the node itself.
_SELECTORS = {
    "file": {"functions": "func", "records": "record", "macros": "macro", "includes": "incl-self", "included_by": "^incl-self", "imports": "funimp", "exports": "funexp", "typedef": "type", "spec": "spec",
             "typerefs": "record/field/fielddef/typeref|type/typeref|spec/specclause/specpar/typeref|spec/specclause/specret/typeref"},
    "function": {"calls": "funcall|dyncall", "dynamic_calls": "dyncall|ambcall", "called_by": "^funcall|^dyncall", "dynamic_called_by": "^dyncall|^ambcall", "references": "^funeref|^funlref|^dynref", "dynamic_references": "^dynref|^ambref",
                 "arguments": "funcl/pattern", "body": "funcl/body", "expressions": _each("funcl", _EXPRS), "variables": "funcl/vardef", "file": "^func", "clause": "funcl", "spec": "specref", "returntype": f"specref/specclause/specret/{_NOT_ATOM}"},
    "clause": {"calls": _each(_EXPRS, "esub*", ("funeref", "dynref")), "dynamic_calls": _each("body", "esub*", ("dynref", "ambref")), "arguments": "pattern", "body": "body", "expressions": _each(_EXPRS), "variables": "vardef", "file": "^funcl/^func",
               "function": "^funcl", "spec": "^funcl/specref", "returntypes": f"^funcl/specref/specclause/specret/{_NOT_ATOM}"},
    "variable": {"references": "^varref", "bindings": "^varbind", "function_definition": "^vardef/^funcl"},
    "record": {"references": "^recref", "fields": "field", "file": "^record"},
    "field": {"references": "^fieldref", "record": "^field", "type": f"fielddef/{_NOT_ATOM}", "file": "^field/^record"},
    "macro": {"references": "^mref", "clause_references": "^cmref", "all_references": "^mref|^cmref", "file": "^macro"},
    "spec": {"fun": "^specref", "file": "^specdef", "modref": "^spec", "arguments": "specclause/specpar", "guardtype": f"specclause/specguard/{_NOT_ATOM}", "returntype": f"specclause/specret/{_NOT_ATOM}"},
    "specparam": {"type": _NOT_ATOM},
    "type": {"file": "^type", "params": "typeparamdef", "subtype": "typebody/tsub", "refs": "^typeref", "paramsrefs": "typeparamdef/^typeparamref", "specref": "^typeref/^specpar/^specclause|^typeref/^specguard/^specclause"},
    "expression": {"functions": "esub*/funeref", "dynamic_functions": _each("esub*", ("dynref", "ambref")), "variables": _each("esub*", _REFS), "records": "esub*/recref", "macros": "esub*/mref", "subexpression": "esub*", "parameter": "esub", "top_expression": "top",
                   "fundef": _each("^esub*", [f"^{e}" for e in _EXPRS], "^funcl"), "file": _each("^esub*", [f"^{e}" for e in _EXPRS], "^funcl", "^func"), "reach": "flow*", "origin": "^flow*"},
}


def _path_sql(path: str) -> str:
    """SELECT (src, dst) of a path over e(src_id, tag, dst_id) and closures c_TAG(src, dst)."""
    own, path = path.endswith("-self"), path.removesuffix("-self")
    options = []
    for option in path.split("|"):
        tables, where, at = [], [], None
        for k, step in enumerate(option.split("/")):
            back, tag = step.startswith("^"), step.removeprefix("^").removesuffix("*").removesuffix("!atom")
            ends = ("src", "dst") if step.endswith("*") else ("src_id", "dst_id")
            a, b = (f"t{k}.{x}" for x in (ends[::-1] if back else ends))
            tables.append(f"c_{tag} t{k}" if step.endswith("*") else f"e t{k}")
            where += [] if step.endswith("*") else [f"t{k}.tag = '{tag}'"]
            where += [f"{at} = {a}"] if at else []
            where += [f"{b} NOT IN (SELECT id FROM atoms)"] if step.endswith("!atom") else []
            start, at = (a if k == 0 else start), b
        options.append(f"SELECT {start} AS src, {at} AS dst FROM {', '.join(tables)} WHERE {' AND '.join([*where, f'{start} <> {at}' if own else 'true'])}")
    return " UNION ".join(options)


def _with(paths: str) -> str:
    """The CTEs that paths need."""
    out = f"WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), atoms AS (SELECT id FROM ({nodes_sql('type').replace('{', '').replace('}', '')}) WHERE name = 'atom')"
    for tag in ("esub", "flow"):
        if f"c_{tag} " in paths:
            out += f", c_{tag} AS (SELECT src_id AS src, src_id AS dst FROM e UNION SELECT dst_id, dst_id FROM e UNION SELECT c.src, e.dst_id FROM c_{tag} c JOIN e ON e.src_id = c.dst AND e.tag = '{tag}')"
    return out


def _all_sql(entity: str) -> str:
    path = _FROM[entity][1]
    return f"SELECT DISTINCT dst AS id FROM ({_path_sql(path)})" if path else f"SELECT id FROM ({nodes_sql('file').replace('{', '').replace('}', '')})"


def _register_selectors(entity: str) -> None:
    wanted = _SELECTORS[entity]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog, start = star_program(spark, sf_dir), _FROM[entity][0]
        rows = [run(catalog, f"{start}.{name}", output="nodes").df.select(F.lit(name).alias("selector"), F.col("group").cast("bigint").alias("src"), F.col("node").alias("dst")) for name in wanted]
        return reduce(DataFrame.union, rows)

    body = f"SELECT selector, src, dst FROM ({' UNION ALL '.join(f'SELECT * FROM (SELECT DISTINCT {chr(39)}{n}{chr(39)} AS selector, src, dst FROM ({_path_sql(p)}))' for n, p in wanted.items())}) WHERE src IN ({_all_sql(entity)})"
    QUERIES[f"q_prog_{entity}_selectors"], ORACLES[f"q_prog_{entity}_selectors"] = query, f"{_with(body)} {body}"


for _entity in _SELECTORS:
    _register_selectors(_entity)


def _count(path: str) -> str:
    return f"SELECT src AS id, count(*) AS value FROM (SELECT DISTINCT * FROM ({_path_sql(path)})) GROUP BY src"


def _crossing(condition: str, end: str) -> str:
    calls = "SELECT a.src_id AS f, a.dst_id AS g, x.src_id AS fa, y.src_id AS fb FROM e a LEFT JOIN e x ON x.tag = 'func' AND x.dst_id = a.src_id LEFT JOIN e y ON y.tag = 'func' AND y.dst_id = a.dst_id WHERE a.tag IN ('funcall', 'dyncall')"
    return f"SELECT {end} AS id, count(*) AS value FROM ({calls}) WHERE {condition} GROUP BY 1"


def _inside(kind: str) -> str:
    """(clause, e): expressions of a type anywhere in a clause."""
    return f"SELECT DISTINCT p.src AS clause, p.dst AS e FROM ({_path_sql(_each(_EXPRS, 'esub*'))}) p WHERE p.dst IN (SELECT id FROM x WHERE type IN ({kind}))"


_BRANCHING = "'case_expr', 'if_expr', 'receive_expr', 'try_expr'"
_MCCABE = f"SELECT clause AS id, sum(n)::BIGINT AS value FROM (SELECT dst_id AS clause, 1 AS n FROM e WHERE tag = 'funcl' UNION ALL SELECT clause, (SELECT count(*) FROM e WHERE tag = 'exprcl' AND src_id = i.e) - 1 FROM ({_inside(_BRANCHING)}) i WHERE i.e IN (SELECT src_id FROM e WHERE tag = 'exprcl')) GROUP BY 1"
_RETURNS = "SELECT dst_id AS id, 1 AS value FROM e WHERE tag = 'funcl'"
_FUNEXPR, _SENT = (f"SELECT clause AS id, count(*) AS value FROM ({_inside(k)}) GROUP BY 1" for k in ("'fun_expr'", "'send_expr'"))


def _up(sql: str, *tags: str, how: str = "sum") -> str:
    for tag in tags:
        sql = f"SELECT o.src_id AS id, {how}(v.value)::BIGINT AS value FROM ({sql}) v JOIN e o ON o.tag = '{tag}' AND o.dst_id = v.id GROUP BY 1"
    return sql


def _deep(types: str) -> str:
    """Nesting of expressions of a type below each clause: esub chains have no branches here, so paths are at most 3 long."""
    tops = " UNION ALL ".join(f"SELECT src_id AS clause, dst_id AS id FROM e WHERE tag = '{t}'" for t in _EXPRS)
    hit = lambda c: f"CASE WHEN {c} IN (SELECT id FROM x WHERE type IN ({types})) THEN 1 ELSE 0 END"
    links = "(SELECT src_id, dst_id FROM e WHERE tag = 'esub')"
    return f"SELECT clause AS id, max({hit('t.id')} + {hit('a.dst_id')} + {hit('b.dst_id')})::BIGINT AS value FROM ({tops}) t LEFT JOIN {links} a ON a.src_id = t.id LEFT JOIN {links} b ON b.src_id = a.dst_id GROUP BY 1"


_STRUCTS = "'fun_expr', 'case_expr', 'receive_expr', 'block_expr', 'try_expr', 'if_expr'"
_OWN_CALLS = "SELECT src_id AS id, count(*) AS value FROM e WHERE tag IN ('funcall', 'dyncall') AND src_id = dst_id GROUP BY 1"
_TAIL = """SELECT f.id, CASE WHEN NOT f.defined THEN 'unknown' WHEN c.tail IS NULL THEN 'non_rec' WHEN c.tail THEN 'tail_rec' ELSE 'non_tail_rec' END AS value FROM ({functions}) f LEFT JOIN (
    SELECT o.src_id AS f, bool_and(x.is_last) AS tail FROM ({calls}) i JOIN e o ON o.tag = 'funcl' AND o.dst_id = i.clause JOIN e r ON r.tag = 'funeref' AND r.src_id = i.e AND r.dst_id = o.src_id JOIN x ON x.id = i.e GROUP BY 1) c ON c.f = f.id"""
#: Properties by links: what each has to be, 0 where there is nothing.
_METRICS = {
    "file": {
        "number_of_fun": _count("func"), "number_of_macros": _count("macro"), "number_of_records": _count("record"), "included_files": _count("incl"), "number_of_funclauses": _count("func/funcl"), "imported_modules": _count("funimp/^func"),
        "function_calls_in": _crossing("fa IS DISTINCT FROM fb AND fb IS NOT NULL", "fb"), "function_calls_out": _crossing("fa IS DISTINCT FROM fb AND fa IS NOT NULL", "fa"), "cohesion": _crossing("fa = fb", "fa"),
        "branches_of_recursion": _up(_OWN_CALLS, "func"), "fun_return_points": _up(_RETURNS, "funcl", "func"), "number_of_funexpr": _up(_FUNEXPR, "funcl", "func"), "number_of_messpass": _up(_SENT, "funcl", "func"), "mcCabe": _up(_MCCABE, "funcl", "func"),
        "max_application_depth": _up(_deep("'application'"), "funcl", "func", how="max"), "max_depth_of_cases": _up(_deep("'case_expr'"), "funcl", "func", how="max"), "min_depth_of_cases": _up(_deep("'case_expr'"), "funcl", "func", how="min"), "max_depth_of_structs": _up(_deep(_STRUCTS), "funcl", "func", how="max"),
    },
    "function": {
        "number_of_funclauses": _count("funcl"), "calls_for_function": _count("^funcall"), "calls_from_function": _count("funcall"), "branches_of_recursion": _OWN_CALLS, "fun_return_points": _up(_RETURNS, "funcl"), "number_of_funexpr": _up(_FUNEXPR, "funcl"), "number_of_messpass": _up(_SENT, "funcl"),
        "mcCabe": _up(_MCCABE, "funcl"), "max_application_depth": _up(_deep("'application'"), "funcl", how="max"), "max_depth_of_cases": _up(_deep("'case_expr'"), "funcl", how="max"), "min_depth_of_cases": _up(_deep("'case_expr'"), "funcl", how="min"), "max_depth_of_structs": _up(_deep(_STRUCTS), "funcl", how="max"),
    },
    "clause": {
        "fun_return_points": _RETURNS, "number_of_funexpr": _FUNEXPR, "number_of_messpass": _SENT, "mcCabe": _MCCABE, "max_application_depth": _deep("'application'"), "max_depth_of_cases": _deep("'case_expr'"), "min_depth_of_cases": _deep("'case_expr'"), "max_depth_of_structs": _deep(_STRUCTS),
    },
}
#: Properties that are columns: entity -> property -> expression over NODES.
_COLUMNS = {
    "file": {"is_module": "is_module", "is_header": "is_header", "name": "name", "filename": "filename", "directory": "directory", "path": "path"},
    "function": {"exported": "exported", "name": "name", "arity": "arity", "pure": "NOT dirty", "defined": "defined", "is_dirty": "dirty", "module": "module", "opaque": "opaque"},
    "clause": {"name": "name", "arity": "arity", "index": "index"}, "variable": {"name": "name"}, "record": {"name": "name"}, "field": {"name": "name"}, "macro": {"name": "name", "arity": "arity", "body": "body"},
    "spec": {"funname": "name", "arity": "arity", "text": "text", "returntext": "returntext", "guardtext": "guardtext"}, "specparam": {"name": "name", "text": "text", "index": "index"},
    "type": {"name": "name", "arity": "arity", "isopaque": "isopaque", "isbuiltin": "isbuiltin", "exported": "exported"},
    "expression": {"type": "type", "value": "value", "class": "class", "index": "index", "is_last": "is_last", "has_side_effect": "has_side_effect", "is_tailcall": "is_last AND type = 'application'"},
}


def _register_properties(name: str, entity: str, wanted: dict[str, str], column: bool) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog, start = star_program(spark, sf_dir), _FROM[entity][0]
        rows = []
        for p in wanted:
            out = run(catalog, f"{start}.{p}").df.select(F.lit(p).alias("property"), F.col("group").cast("bigint").alias("id"), F.col("value").cast("string").alias("value"))
            rows.append(out if column else settled(out))
        return reduce(DataFrame.union, rows)

    nodes = nodes_sql(entity).replace("{", "").replace("}", "")
    if column:
        parts = [f"SELECT '{p}' AS property, id, CAST({e} AS VARCHAR) AS value FROM n WHERE ({e}) IS NOT NULL" for p, e in wanted.items()]
    else:
        parts = [f"SELECT '{p}' AS property, n.id, CAST({'m.value' if p == 'is_tail_recursive' else 'coalesce(m.value, 0)'} AS VARCHAR) AS value FROM n LEFT JOIN ({sql}) m ON m.id = n.id" for p, sql in wanted.items()]
    body = f"SELECT property, id, value FROM ({' UNION ALL '.join(f'SELECT * FROM ({p})' for p in parts)}) WHERE id IN ({_all_sql(entity)})"
    sql = f"{_with(body)}, n AS MATERIALIZED ({nodes}), x AS MATERIALIZED ({nodes_sql('expression').replace('{', '').replace('}', '')}) {body}"
    QUERIES[name], ORACLES[name] = query, sql


_METRICS["function"]["is_tail_recursive"] = _TAIL.format(functions=nodes_sql("function").replace("{", "").replace("}", ""), calls=_inside("'application'"))
for _entity, _wanted in _COLUMNS.items():
    _register_properties(f"q_prog_{_entity}_columns", _entity, _wanted, True)
for _entity, _wanted in _METRICS.items():
    _register_properties(f"q_prog_{_entity}_metrics", _entity, _wanted, False)


#: Paths with a link's place, the last link, tests, and a second choice where the first gives nothing.
_ALGEBRA = {
    "record[name = 'Brand#1']": "SELECT a.src_id, a.dst_id FROM e a JOIN r ON r.id = a.dst_id WHERE tag = 'record' AND r.name = 'Brand#1'",
    "^field[name <> 'Brand#2' and id % 10 = 0]": "SELECT a.dst_id, a.src_id FROM e a JOIN r ON r.id = a.src_id WHERE tag = 'field' AND r.name <> 'Brand#2' AND r.id % 10 = 0",
    "func/funcl#-1": "SELECT f.src_id, max(c.dst_id) FROM e f JOIN e c ON c.src_id = f.dst_id WHERE f.tag = 'func' AND c.tag = 'funcl' GROUP BY f.src_id, c.src_id",
    "funcall?dyncall?ambcall": "SELECT src_id, dst_id FROM (SELECT *, min(CASE tag WHEN 'funcall' THEN 1 WHEN 'dyncall' THEN 2 ELSE 3 END) OVER (PARTITION BY src_id) AS best FROM e WHERE tag IN ('funcall', 'dyncall', 'ambcall')) WHERE tag = ['funcall', 'dyncall', 'ambcall'][best]",
    "esub*/varref": "SELECT c.src, a.dst_id FROM c_esub c JOIN e a ON a.src_id = c.dst WHERE a.tag = 'varref'",
}


def q_prog_path_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = star_program(spark, sf_dir)
    paths = Paths(catalog.edges, catalog.entity("record").table().select("id", "name"))
    return reduce(DataFrame.union, [paths.follow(p).select(F.lit(p).alias("path"), "src", "dst") for p in _ALGEBRA])


QUERIES["q_prog_path_algebra"] = q_prog_path_algebra
ORACLES["q_prog_path_algebra"] = (
    f"{_with('c_esub ')}, r AS ({nodes_sql('record').replace('{', '').replace('}', '')}) SELECT path, src, dst FROM ("
    + " UNION ALL ".join(f"SELECT DISTINCT '{p.replace(chr(39), chr(39) * 2)}' AS path, t.* FROM ({q}) AS t(src, dst)" for p, q in _ALGEBRA.items()) + ")"
)


# --- ordered trees: customers as heaps in which the parent of k is (k - 1) / 3, children in falling order; two trees

_TREE = "SELECT CAST(CASE WHEN c_custkey % 3 = 0 THEN (c_custkey - 3) / 3 ELSE (c_custkey - c_custkey % 3) / 3 END AS BIGINT) AS src, CAST(c_custkey AS BIGINT) AS dst, CAST(-c_custkey AS BIGINT) AS idx FROM {customer} WHERE c_custkey > 1"
_WALK = f"""WITH RECURSIVE l AS ({_TREE.format(customer='customer')}), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY idx, dst) AS place FROM l),
    w AS (SELECT id AS node, id AS root, [id] AS path, []::BIGINT[] AS places FROM (VALUES (0::BIGINT), (1::BIGINT)) AS v(id) UNION ALL SELECT dst, root, list_append(path, dst), list_append(places, place) FROM w JOIN k ON src = node),
    f AS (SELECT root, node AS leaf, row_number() OVER (PARTITION BY root ORDER BY places) AS place FROM w WHERE node NOT IN (SELECT src FROM l))"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    links = settled(spark.sql(_TREE, customer=spark.read.parquet(f"{sf_dir}/customer.parquet")))
    return links, trees.root_paths(links)


def _register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@_register("q_tree_children", f"{_WALK} SELECT src AS node, place, dst AS child FROM k")
def q_tree_children(spark, sf_dir):
    return trees.children(_tree(spark, sf_dir)[0])


@_register("q_tree_root_paths", f"{_WALK} SELECT w.node, root, array_to_string(path, '/') AS path, p.src AS parent FROM w LEFT JOIN l p ON p.dst = w.node")
def q_tree_root_paths(spark, sf_dir):
    paths = _tree(spark, sf_dir)[1]
    return paths.join(trees.parents(paths), "node", "left").select("node", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "parent")


@_register("q_tree_leaves", f"{_WALK} SELECT f.root, leaf, place, first_value(leaf) OVER o AS first_leaf, last_value(leaf) OVER o AS last_leaf FROM f WINDOW o AS (PARTITION BY root ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def q_tree_leaves(spark, sf_dir):
    links, paths = _tree(spark, sf_dir)
    found = settled(trees.leaves(paths, links))
    return found.join(trees.outer_leaves(found), "root")


@_register("q_tree_texts", f"{_WALK} SELECT root, string_agg(' ' || c_name || ';', '' ORDER BY place) AS text FROM f JOIN customer ON c_custkey = leaf GROUP BY root")
def q_tree_texts(spark, sf_dir):
    links, paths = _tree(spark, sf_dir)
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("leaf"), F.lit(" ").alias("before"), F.col("c_name").alias("text"), F.lit(";").alias("after"))
    return trees.texts(trees.leaves(paths, links), names)


@_register("q_tree_descend", f"{_WALK} SELECT a.node AS root, b.node FROM w a JOIN w b ON list_contains(b.path, a.node) AND len(b.path) - len(a.path) <= 2 WHERE a.node % 5 = 0")
def q_tree_descend(spark, sf_dir):
    links, paths = _tree(spark, sf_dir)
    return trees.descend(links, paths.where("node % 5 = 0").select("node"), 2)


@_register("q_tree_common_ancestors", f"{_WALK} SELECT a.node AS a, b.node AS b, list_filter(a.path, lambda x: list_contains(b.path, x))[-1] AS ancestor FROM w a JOIN w b ON b.node = (a.node * 7 + 5) % (SELECT count(*) FROM w)")
def q_tree_common_ancestors(spark, sf_dir):
    _, paths = _tree(spark, sf_dir)
    nodes = paths.select("node")
    pairs = nodes.select(F.col("node").alias("a"), F.expr(f"(node * 7 + 5) % {nodes.count()}").alias("b"))
    return trees.common_ancestors(paths, pairs)


# --- program catalog: what can be named, and starts by position


@_register("q_prog_help", "SELECT * FROM (VALUES " + ", ".join(f"('variable', '{k}', '{n}', '{t}')" for k, n, t in (("selector", "references", "expression"), ("selector", "bindings", "expression"), ("selector", "function_definition", "function"), ("property", "name", "string"))) + ") AS v(entity, kind, name, type)")
def q_prog_help(spark, sf_dir):
    return run(star_program(spark, sf_dir), "files.functions.variables.?").df.select("entity", "kind", "name", "type")


# --- dead code, measures of clauses, weights of calls


def _ends(*tags: str) -> str:
    return "(SELECT dst_id FROM e WHERE tag IN (" + ", ".join(f"'{t}'" for t in tags) + "))"


def _nodes(entity: str) -> str:
    return "(" + nodes_sql(entity).replace("{", "").replace("}", "") + ")"


_DEAD = [
    f"SELECT 'fun' AS kind, id FROM {_nodes('function')} WHERE defined AND NOT exported AND id NOT IN {_ends('funeref', 'funlref', 'dynref', 'ambref', 'funcall', 'dyncall', 'ambcall', 'funexp', 'funimp')}",
    *[f"SELECT '{k}', id FROM {_nodes(n)} WHERE id NOT IN {_ends(*t)}" for k, n, t in (("rec", "record", ["recref"]), ("recfield", "field", ["fieldref"]), ("macro", "macro", ["mref", "cmref"]), ("var", "variable", ["varref"]))],
    f"SELECT 'pattern', id FROM {_nodes('expression')} WHERE id IN (SELECT src_id FROM e WHERE tag = 'varbind') AND id NOT IN (SELECT src_id FROM e WHERE tag = 'varbind' AND dst_id IN {_ends('varref')})",
    f"SELECT 'guard', id FROM {_nodes('expression')} WHERE type = 'atom' AND value = 'true' AND id IN {_ends('guard')}",
    f"SELECT 'expr', id FROM {_nodes('expression')} WHERE NOT is_last AND NOT has_side_effect AND id IN {_ends('body')}",
]


@_register("q_prog_dead", f"WITH e AS ({_EDGES}) " + " UNION ALL ".join(_DEAD))
def q_prog_dead(spark, sf_dir):
    return analyses.dead_kinds(*star_tables(spark, sf_dir))


def _linked(tag: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT dst_id, x FROM t JOIN e ON src_id = x AND tag = '{tag}' JOIN x ON x.id = t.x WHERE t.c = c.id))"


_MEASURES = {
    "nodes": "(SELECT count(*) FROM t JOIN x ON x.id = t.x WHERE t.c = c.id)",
    **{n: f"(SELECT count(*) FROM t JOIN x ON x.id = t.x WHERE t.c = c.id AND x.type IN ({', '.join(repr(v) for v in of)}))" for n, of in clone_measures.TYPES.items()},
    **{n: _linked(tag) for n, tag in (("arcs", "exprcl"), ("var_binds", "varbind"), ("records", "recref"), ("macs", "mref"))},
    "dirty_expressions": "(SELECT count(*) FROM t JOIN x ON x.id = t.x WHERE t.c = c.id AND x.has_side_effect)",
    "unique_funcalls": "(SELECT count(DISTINCT dst_id) FROM t JOIN x ON x.id = t.x JOIN e ON src_id = t.x AND tag = 'funeref' WHERE t.c = c.id)",
    "unused_matching": "(SELECT count(*) FROM t JOIN x ON x.id = t.x WHERE t.c = c.id AND x.type = 'match_expr' AND t.x NOT IN (SELECT src_id FROM e WHERE tag = 'varbind'))",
    "tles": "(SELECT count(*) FROM e JOIN x ON x.id = dst_id WHERE tag = 'body' AND src_id = c.id)",
    "guarded_clauses": "(SELECT least(count(*), 1) FROM e WHERE tag = 'guard' AND src_id = c.id)",
}


@_register("q_prog_clone_measures", f"WITH RECURSIVE e AS ({_EDGES}), x AS {_nodes('expression')}, t(c, x) AS (SELECT src_id, dst_id FROM e WHERE tag IN ('pattern', 'guard', 'body') UNION SELECT c, dst_id FROM t JOIN e ON src_id = x AND tag = 'esub') "
           "SELECT id, " + ", ".join(f"CAST({sql} AS BIGINT) AS {n}" for n, sql in _MEASURES.items()) + f" FROM {_nodes('clause')} c")  # fmt: skip
def q_prog_clone_measures(spark, sf_dir):
    return clone_measures.clause_measures(*star_tables(spark, sf_dir)).select("id", *[F.col(n).cast("bigint").alias(n) for n in _MEASURES])


@_register("q_prog_call_weights", f"""WITH e AS ({_EDGES}), w AS (SELECT least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b, CAST(count(*) AS DOUBLE) AS w FROM e WHERE tag IN ('funcall', 'dyncall') AND src_id <> dst_id GROUP BY 1, 2),
t AS (SELECT id, sum(w) AS t FROM (SELECT a AS id, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY id) SELECT a, b, round(w / (x.t + y.t - w), 9) AS weight FROM w JOIN t x ON x.id = a JOIN t y ON y.id = b""")
def q_prog_call_weights(spark, sf_dir):
    edges = star_tables(spark, sf_dir)[1].where("tag in ('funcall', 'dyncall')")
    calls = edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.lit(1).alias("n"))
    return clustering.call_weights(calls, distance="call_sum").withColumn("weight", F.round("weight", 9))


def q_prog_clusters(spark, sf_dir):
    edges = star_tables(spark, sf_dir)[1].where("tag in ('funcall', 'dyncall')")
    calls = edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.lit(1).alias("n"))
    ids = calls.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return clustering.agglomerative(ids, clustering.call_weights(calls, "zero_one"), 0.3)


QUERIES["q_prog_clusters"] = q_prog_clusters  # joins in rounds: tests hold them against joining one pair after the other
