"""A program graph made of the star schema's tables, so that the program catalog can be held against SQL.

Nations are files, suppliers functions, customers clauses, orders expressions, parts variables, records, fields and macros;
links follow keys and remainders of keys. NODES and EDGES are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.catalog import Catalog
from graphloom.sources.program import program_catalog
from graphloom.sources.scratch import settled

_KINDS = ("file", "function", "clause", "expression", "variable", "record", "field", "macro", "spec", "specparam", "type", "specclause", "specret", "specguard", "fielddef", "typebody", "exprclause")


def _id(kind: str, key: str) -> str:
    return f"{_KINDS.index(kind) + 1}0000000000 + ({key})"


_FUNS, _VARS, _CLAUSES = "(SELECT count(*) FROM {supplier})", "(SELECT count(*) FROM {part})", "(SELECT count(*) FROM {customer})"
_TYPES = "CASE o_orderkey % 8 WHEN 0 THEN 'application' WHEN 1 THEN 'send_expr' WHEN 2 THEN 'fun_expr' WHEN 3 THEN 'case_expr' WHEN 4 THEN 'infix_expr' WHEN 5 THEN 'match_expr' WHEN 6 THEN 'tuple' ELSE 'atom' END"

#: entity -> (id and columns, source).
NODES = {
    "file": (f"{_id('file', 'n_nationkey')} AS id, n_name AS name, '/src/' || n_name || '.erl' AS path, n_name || '.erl' AS filename, '/src' AS directory, n_nationkey % 5 <> 4 AS is_module, n_nationkey % 5 = 4 AS is_header", "{nation}"),
    "function": (f"{_id('function', 's_suppkey')} AS id, 'f' || CAST(s_suppkey % 40 AS VARCHAR(9)) AS name, CAST(s_suppkey % 4 AS BIGINT) AS arity, s_suppkey % 3 = 0 AS exported, s_suppkey % 7 = 0 AS dirty, s_suppkey % 10 <> 9 AS defined, s_suppkey % 11 = 0 AS opaque, 'm' || CAST(s_nationkey AS VARCHAR(9)) AS module", "{supplier}"),
    "clause": (f"{_id('clause', 'c_custkey')} AS id, c_name AS name, CAST(c_custkey % 4 AS BIGINT) AS arity, CAST(c_custkey % 6 AS BIGINT) AS index", "{customer}"),
    "expression": (f"{_id('expression', 'o_orderkey')} AS id, {_TYPES} AS type, o_orderpriority AS value, 'expr' AS class, CAST(o_orderkey % 6 AS BIGINT) AS index, o_orderkey % 2 = 1 AS is_last, o_orderkey % 9 = 0 AS has_side_effect", "{orders}"),
    "variable": (f"{_id('variable', 'p_partkey')} AS id, p_name AS name", "{part}"),
    "record": (f"{_id('record', 'p_partkey')} AS id, p_brand AS name", "{part} WHERE p_partkey % 5 = 0"),
    "field": (f"{_id('field', 'p_partkey')} AS id, p_name AS name", "{part} WHERE p_partkey % 5 IN (1, 2)"),
    "macro": (f"{_id('macro', 'p_partkey')} AS id, p_type AS name, CAST(p_size AS BIGINT) AS arity, p_name AS body", "{part} WHERE p_partkey % 5 = 3"),
    "spec": (f"{_id('spec', 's_suppkey')} AS id, s_name AS name, CAST(s_suppkey % 4 AS BIGINT) AS arity, s_name || ' text' AS text, 'int()' AS returntext, 'when X' AS guardtext", "{supplier} WHERE s_suppkey % 2 = 0"),
    "specparam": (f"{_id('specparam', 's_suppkey')} AS id, 'P' || CAST(s_suppkey AS VARCHAR(9)) AS name, 'P :: int()' AS text, CAST(s_suppkey % 3 AS BIGINT) AS index", "{supplier} WHERE s_suppkey % 2 = 0"),
    "type": (f"{_id('type', 'n_nationkey')} AS id, CASE WHEN n_nationkey % 4 = 3 THEN 'atom' ELSE 't' || CAST(n_nationkey AS VARCHAR(9)) END AS name, CAST(n_nationkey % 3 AS BIGINT) AS arity, n_nationkey % 2 = 0 AS isopaque, n_nationkey % 3 = 0 AS isbuiltin, n_nationkey % 5 = 0 AS exported", "{nation}"),
}

#: (tag, from, to, source): links, numbered by the end's id.
EDGES = [(tag, _id(*a), _id(*b), source) for tag, a, b, source in (
    ("func", ("file", "s_nationkey"), ("function", "s_suppkey"), "{supplier}"),
    ("funcl", ("function", f"c_custkey % {_FUNS}"), ("clause", "c_custkey"), "{customer}"),
    ("pattern", ("clause", "o_custkey"), ("expression", "o_orderkey"), "{orders} WHERE o_orderkey % 6 = 0"),
    ("guard", ("clause", "o_custkey"), ("expression", "o_orderkey"), "{orders} WHERE o_orderkey % 6 = 1"),
    ("body", ("clause", "o_custkey"), ("expression", "o_orderkey"), "{orders} WHERE o_orderkey % 6 IN (2, 3)"),
    ("esub", ("expression", "o_orderkey - 1"), ("expression", "o_orderkey"), "{orders} WHERE o_orderkey % 6 IN (4, 5)"),
    ("top", ("expression", "o_orderkey"), ("expression", "o_orderkey - o_orderkey % 6 + 3"), "{orders} WHERE o_orderkey % 6 IN (4, 5)"),
    ("funeref", ("expression", "o_orderkey"), ("function", f"o_orderkey % {_FUNS}"), "{orders} WHERE o_orderkey % 5 = 0"),
    ("funlref", ("expression", "o_orderkey"), ("function", f"o_orderkey % {_FUNS}"), "{orders} WHERE o_orderkey % 15 = 6"),
    ("dynref", ("expression", "o_orderkey"), ("function", f"(o_orderkey + 1) % {_FUNS}"), "{orders} WHERE o_orderkey % 7 = 0"),
    ("ambref", ("expression", "o_orderkey"), ("function", f"(o_orderkey + 2) % {_FUNS}"), "{orders} WHERE o_orderkey % 11 = 0"),
    ("varref", ("expression", "o_orderkey"), ("variable", f"o_orderkey % {_VARS}"), "{orders} WHERE o_orderkey % 2 = 0"),
    ("varbind", ("expression", "o_orderkey"), ("variable", f"(o_orderkey + 3) % {_VARS}"), "{orders} WHERE o_orderkey % 4 = 1"),
    ("vardef", ("clause", f"p_partkey % {_CLAUSES}"), ("variable", "p_partkey"), "{part}"),
    ("record", ("file", "p_partkey % 25"), ("record", "p_partkey"), "{part} WHERE p_partkey % 5 = 0"),
    ("field", ("record", "p_partkey - p_partkey % 5"), ("field", "p_partkey"), "{part} WHERE p_partkey % 5 IN (1, 2)"),
    ("macro", ("file", "p_partkey % 25"), ("macro", "p_partkey"), "{part} WHERE p_partkey % 5 = 3"),
    ("incl", ("file", "n_nationkey"), ("file", "(n_nationkey * 3 + 1) % 25"), "{nation}"),
    ("funimp", ("file", "(s_nationkey + 5) % 25"), ("function", "s_suppkey"), "{supplier} WHERE s_suppkey % 4 = 0"),
    ("funexp", ("file", "s_nationkey"), ("function", "s_suppkey"), "{supplier} WHERE s_suppkey % 3 = 0"),
    ("type", ("file", "(n_nationkey + 2) % 25"), ("type", "n_nationkey"), "{nation}"),
    ("spec", ("file", "s_nationkey"), ("spec", "s_suppkey"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("specdef", ("file", "(s_nationkey + 1) % 25"), ("spec", "s_suppkey"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("specref", ("function", "s_suppkey"), ("spec", "s_suppkey"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("specclause", ("spec", "s_suppkey"), ("specclause", "s_suppkey"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("specpar", ("specclause", "s_suppkey"), ("specparam", "s_suppkey"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("specret", ("specclause", "s_suppkey"), ("specret", "s_suppkey"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("specguard", ("specclause", "s_suppkey"), ("specguard", "s_suppkey"), "{supplier} WHERE s_suppkey % 4 = 0"),
    ("typeref", ("specparam", "s_suppkey"), ("type", "s_suppkey % 25"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("typeref", ("specret", "s_suppkey"), ("type", "(s_suppkey + 1) % 25"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("typeref", ("specguard", "s_suppkey"), ("type", "(s_suppkey + 2) % 25"), "{supplier} WHERE s_suppkey % 4 = 0"),
    ("typeref", ("fielddef", "p_partkey"), ("type", "p_partkey % 25"), "{part} WHERE p_partkey % 5 = 1"),
    ("fielddef", ("field", "p_partkey"), ("fielddef", "p_partkey"), "{part} WHERE p_partkey % 5 = 1"),
    ("typebody", ("type", "n_nationkey"), ("typebody", "n_nationkey"), "{nation}"),
    ("tsub", ("typebody", "n_nationkey"), ("type", "(n_nationkey + 7) % 25"), "{nation}"),
    ("typeparamdef", ("type", "n_nationkey"), ("type", "(n_nationkey + 3) % 25"), "{nation} WHERE n_nationkey % 2 = 0"),
    ("typeparamref", ("type", "n_nationkey"), ("type", "(n_nationkey + 4) % 25"), "{nation} WHERE n_nationkey % 3 = 0"),
    ("recref", ("expression", "o_orderkey"), ("record", "5 * (o_orderkey % 40)"), "{orders} WHERE o_orderkey % 13 = 0"),
    ("fieldref", ("expression", "o_orderkey"), ("field", "5 * (o_orderkey % 40) + 1"), "{orders} WHERE o_orderkey % 17 = 0"),
    ("mref", ("expression", "o_orderkey"), ("macro", "5 * (o_orderkey % 40) + 3"), "{orders} WHERE o_orderkey % 19 = 0"),
    ("cmref", ("clause", "c_custkey"), ("macro", "5 * (c_custkey % 40) + 3"), "{customer} WHERE c_custkey % 9 = 0"),
    ("flow", ("expression", "o_orderkey"), ("expression", "o_orderkey + 1"), "{orders} WHERE o_orderkey % 10 < 9"),
    ("funcall", ("function", "s_suppkey"), ("function", f"(s_suppkey * 7 + 3) % {_FUNS}"), "{supplier} WHERE s_suppkey % 2 = 0"),
    ("dyncall", ("function", "s_suppkey"), ("function", f"(s_suppkey * 5 + 1) % {_FUNS}"), "{supplier} WHERE s_suppkey % 3 = 0"),
    ("ambcall", ("function", "s_suppkey"), ("function", f"(s_suppkey * 11 + 2) % {_FUNS}"), "{supplier} WHERE s_suppkey % 5 = 0"),
    ("exprcl", ("expression", "o_orderkey"), ("exprclause", "2 * o_orderkey"), "{orders} WHERE o_orderkey % 8 = 3"),
    ("exprcl", ("expression", "o_orderkey"), ("exprclause", "2 * o_orderkey + 1"), "{orders} WHERE o_orderkey % 16 = 3"),
)]


def edges_sql() -> str:
    return " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS src_id, '{tag}' AS tag, CAST({b} AS BIGINT) AS idx, CAST({b} AS BIGINT) AS dst_id FROM {source}" for tag, a, b, source in EDGES)


def nodes_sql(entity: str) -> str:
    columns, source = NODES[entity]
    return f"SELECT {columns} FROM {source}"


def star_tables(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The nodes by entity, and the links, which are computed once."""
    names = ("nation", "supplier", "customer", "orders", "part")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}

    def query(sql: str) -> DataFrame:
        return spark.sql(sql, **{n: t for n, t in tables.items() if f"{{{n}}}" in sql})

    return {e: query(nodes_sql(e)).withColumn("id", F.col("id").cast("bigint")) for e in NODES}, settled(query(edges_sql()))


def star_program(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of the program graph."""
    nodes, edges = star_tables(spark, sf_dir)
    return program_catalog(nodes, edges, snapshot=sf_dir)
