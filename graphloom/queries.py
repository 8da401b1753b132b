"""Registered queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.layout import layout_expressions
from graphloom.functions.metrics import compare_snapshots, result_filter, show
from graphloom.operators import analyses, clones, graphs
from graphloom.operators.compiler import run
from graphloom.sources.driver import driver_catalog, partners, ships

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _path(name: str, query: str, columns: dict[str, str], sql: str, **options) -> None:
    """A query of the language; columns maps result columns to their names here."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(driver_catalog(spark, sf_dir), query, **options).df
        return out.select(*[F.col(k).alias(v) for k, v in columns.items()]).distinct()

    QUERIES[name], ORACLES[name] = f, sql


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reader(spark: SparkSession, sf_dir: str):
    return lambda name: _t(spark, sf_dir, name)


V, N = {"value": "value"}, {"node": "id"}
GN = {"group": "src", "node": "dst"}
_SHIPS = """ships AS (SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS n FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY ALL)"""
_PARTNER = _SHIPS + """, partner AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM ships) WHERE k <= 2)"""
_REACH = "reach AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation UNION SELECT r.root, p.dst FROM reach r JOIN partner p ON r.node = p.src)"
_DISTINCT_LINES = "SELECT DISTINCT * FROM lineitem"

# --- scans, projections, filters

_path("q_scan_select", "regions.nations.name", V, "SELECT DISTINCT n_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey")
_path("q_filter_eq", "customers[segment == 'BUILDING', acctbal > 5000].name", V, "SELECT DISTINCT c_name AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
_path("q_filter_or_not", "orders[not (status == 'O') or totalprice > 300000].id", V, "SELECT o_orderkey AS value FROM orders WHERE NOT o_orderstatus = 'O' OR o_totalprice > 300000")
_path("q_regex", "parts[type ~ 'ECON'].name", V, "SELECT DISTINCT p_name AS value FROM part WHERE regexp_matches(p_type, 'ECON')")
_path("q_like", "nations[name like 'NATION_1'].name", V, "SELECT DISTINCT n_name AS value FROM nation WHERE contains(n_name, 'NATION_1') OR levenshtein(n_name, 'NATION_1') <= 2")
_path("q_in_list", "parts[brand in |'Brand#11', 'Brand#12'|].name", V, "SELECT DISTINCT p_name AS value FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')")
_path("q_interval", "parts[size in |1..5|].id", V, "SELECT p_partkey AS value FROM part WHERE p_size BETWEEN 1 AND 5")
_path("q_compare_ops", "parts[size >= 10, size =< 20, size /= 15, id > 3, id < 900].id", V, "SELECT p_partkey AS value FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size <> 15 AND p_partkey > 3 AND p_partkey < 900")
_path("q_in_query", "parts[brand in parts[size > 45].brand].id", V, "SELECT p_partkey AS value FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 45)")
_path("q_any_in", "nations[.customers.segment any_in |BUILDING|].name", V, "SELECT DISTINCT n_name AS value FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING')")
_path("q_all_in", "orders[.lineitems.returnflag all_in |'N','R'|].id", V, """SELECT o_orderkey AS value FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag NOT IN ('N', 'R'))""")
_path("q_query_in_query", "nations[.customers.segment in .suppliers.nation.customers.segment].name", V, """SELECT DISTINCT n_name AS value FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)
    AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)""")
_path("q_exists_rel", "customers[.orders[totalprice > 400000]].name", V, "SELECT DISTINCT c_name AS value FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_path("q_not_exists", "customers[not .orders[totalprice > 300000]].id", V, "SELECT c_custkey AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_path("q_bool_compare", "parts[(size > 10) == (size < 30)].id", V, "SELECT p_partkey AS value FROM part WHERE (p_size > 10) = (p_size < 30)")
_path("q_coerce", "nations[name == \"NATION_0\" or regionkey == \"0\"].name", V, "SELECT DISTINCT n_name AS value FROM nation WHERE n_name = 'NATION_0' OR n_regionkey = 0")

# --- set operators

_path("q_union", "nations[key < 5](.customers U .customers[segment == 'BUILDING'])", N, "SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5")
_path("q_intersect", "nations(.customers I .customers[segment == 'BUILDING'])", N, "SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
_path("q_except", "nations(.customers -- .customers[segment == 'BUILDING'])", N, "SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'")
_path("q_setop_rightassoc", "parts[size < 10] -- parts[size < 5] U parts[size < 3]", N, "SELECT p_partkey AS id FROM part WHERE p_size < 10 EXCEPT (SELECT p_partkey FROM part WHERE p_size < 5 UNION SELECT p_partkey FROM part WHERE p_size < 3)")
_path("q_setop_start", "(nations[key < 3] U nations[key > 20]).name", V, "SELECT DISTINCT n_name AS value FROM nation WHERE n_nationkey < 3 OR n_nationkey > 20")
_path("q_setop_values", "regions.name U nations.name", V, "SELECT r_name AS value FROM region UNION SELECT n_name FROM nation")

# --- variables

_path("q_var_prop", "nations[K=key].customers[nationkey == K, acctbal > 9000].name", V, "SELECT DISTINCT c_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
_path("q_var_entity", "nations->A.partner?A", N, f"WITH {_PARTNER} SELECT src AS id FROM partner WHERE src = dst")
_path("q_var_not", "nations->A.partner/?A", GN, f"WITH {_PARTNER} SELECT src, dst FROM partner WHERE src <> dst")
_path("q_var_project", "nations[M=name].customers[acctbal > 9500].M", V, "SELECT DISTINCT n_name AS value FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9500")
_path("q_var_sub_bind", "nations[K=key, .partner[P=key], K < P].name", V, f"WITH {_PARTNER} SELECT DISTINCT n_name AS value FROM partner JOIN nation ON n_nationkey = src WHERE src < dst")
_path("q_var_intersect", "nations[A=name] I nations[name/=A]", N, "SELECT n_nationkey AS id FROM nation WHERE false")

# --- repetition

_path("q_iter2", "nations.{partner}2", GN, f"WITH {_PARTNER} SELECT DISTINCT a.src, b.dst FROM partner a JOIN partner b ON a.dst = b.src", output="nodes")
_path("q_bounded2", "nations.(partner)2", GN, f"WITH {_PARTNER} SELECT n_nationkey AS src, n_nationkey AS dst FROM nation UNION SELECT src, dst FROM partner UNION SELECT a.src, b.dst FROM partner a JOIN partner b ON a.dst = b.src", output="nodes")
_path("q_closure", "nations.(partner)+", GN, f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT root AS src, node AS dst FROM reach", output="nodes")
_path("q_closure_filter", "nations.(partner[regionkey == 2])+", GN, f"""WITH RECURSIVE {_PARTNER}, reach AS (SELECT n_nationkey AS src, n_nationkey AS dst FROM nation
    UNION SELECT r.src, p.dst FROM reach r JOIN partner p ON r.dst = p.src JOIN nation ON n_nationkey = p.dst WHERE n_regionkey = 2) SELECT src, dst FROM reach""", output="nodes")
_path("q_closure_values", "nations[key == 3].(partner)+.name", V, f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT DISTINCT n_name AS value FROM reach JOIN nation ON n_nationkey = node WHERE root = 3")


@_register("q_chains", f"""WITH RECURSIVE {_PARTNER}, c AS (SELECT [n_nationkey] AS p, false AS cyclic FROM nation
    UNION ALL SELECT list_append(p, dst), list_contains(p, dst) FROM c JOIN partner ON src = p[-1] WHERE NOT cyclic)
    SELECT DISTINCT array_to_string(p, '>') AS chain, cyclic FROM c WHERE cyclic OR NOT EXISTS (SELECT 1 FROM partner WHERE src = p[-1])""")
def q_chains(spark, sf_dir):
    out = run(driver_catalog(spark, sf_dir), "nations.(partner)+").df
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("chain"), "cyclic").distinct()


@_register("q_event_next", "SELECT event_id AS src, n3 AS dst FROM (SELECT event_id, lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n3 FROM events) WHERE n3 IS NOT NULL")
def q_event_next(spark, sf_dir):
    out = run(driver_catalog(spark, sf_dir), "events.{next}3", output="nodes").df
    return out.select(F.col("group").alias("src"), F.col("node").alias("dst"))


# --- grouping and statistics


def _grouped(spark, sf_dir, query, groupby):
    out = run(driver_catalog(spark, sf_dir), query, groupby=groupby).labelled()
    joined = F.array_join(F.transform("values", lambda x: x.cast("string")), ",")
    return out.select(F.col("group").alias("grp"), "kind", joined.alias("vals"))


@_register("q_group_list", "SELECT r_regionkey AS grp, 'propertylist' AS kind, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS vals FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def q_group_list(spark, sf_dir):
    return _grouped(spark, sf_dir, "regions.nations.customers.segment", 1)


@_register("q_group_eq", "SELECT n_nationkey AS grp, 'eq' AS kind, n_name AS vals FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_group_eq(spark, sf_dir):
    return _grouped(spark, sf_dir, "regions.nations.name", None)


@_register("q_group_nodes", "SELECT n_regionkey AS grp, 'list' AS kind, array_to_string(list_sort(list(n_nationkey)), ',') AS vals FROM nation GROUP BY 1")
def q_group_nodes(spark, sf_dir):
    return _grouped(spark, sf_dir, "regions.nations", None)


_STATS = ("min", "max", "sum", "avg", "median", "var", "sd")


@_register("q_stats", "SELECT " + ", ".join(f"round({sql}, 3) AS \"{n}\"" for n, sql in zip(_STATS, ("min(c_acctbal)", "max(c_acctbal)", "sum(c_acctbal)", "avg(c_acctbal)", "median(c_acctbal)", "var_samp(c_acctbal)", "stddev_samp(c_acctbal)"))) + " FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_stats(spark, sf_dir):
    catalog, out = driver_catalog(spark, sf_dir), None
    for n in _STATS:  # a row each
        one = run(catalog, f"regions.nations.customers.acctbal:{n}").df.select(F.round("value", 3).alias(n))
        out = one if out is None else out.join(F.broadcast(one))
    return out


@_register("q_stats_edge", "SELECT CASE WHEN count(*) = 1 THEN 0.0 ELSE var_samp(p_size) END AS value FROM part WHERE p_partkey = 1")
def q_stats_edge(spark, sf_dir):
    return run(driver_catalog(spark, sf_dir), "parts[id == 1].size:var").df


@_register("q_flagship", f"SELECT round(sum(l_extendedprice), 2) AS value FROM ({_DISTINCT_LINES}) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def q_flagship(spark, sf_dir):
    out = run(driver_catalog(spark, sf_dir), "customers[segment == 'BUILDING'].orders.lineitems.extendedprice:sum").df
    return out.select(F.round("value", 2).alias("value"))


# --- metrics

_LAYOUT_SQL = """SELECT doc_id AS id, len(ls) AS line_of_code, length(text) AS char_of_code, coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS max_length_of_line,
    coalesce(list_sum(list_transform(ls, lambda x: length(x))) // nullif(len(ls), 0), 0)::INT AS average_length_of_line, len(regexp_extract_all(text, ',[^ \\n]')) AS no_space_after_comma
    FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)"""


@_register("q_layout_metrics", _LAYOUT_SQL)
def q_layout_metrics(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.col("doc_id").alias("id"), *[F.expr(e).alias(names[0]) for names, e in layout_expressions("text")])


@_register("q_metricql_show", "SELECT doc_id AS id, length(text) AS value FROM documents WHERE doc_id IN (1, 2, 3, 50)")
def q_metricql_show(spark, sf_dir):
    return show(driver_catalog(spark, sf_dir), "show char_of_code for document (1, 2, 3, 50)")


@_register("q_metricql_filters", """SELECT sum(length(text))::BIGINT AS sum, max(length(text)) AS max, min(length(text)) AS min, round(avg(length(text)), 6) AS avg, arg_max(doc_id, length(text) * 1e9 - doc_id) AS fmaxname,
    array_to_string(list_sort(list(doc_id) FILTER (length(text) = (SELECT max(length(text)) FROM documents))), ',') AS maxlist FROM documents""")
def q_metricql_filters(spark, sf_dir):
    rows = show(driver_catalog(spark, sf_dir), "show choc for document ()")
    kinds = {k: result_filter(rows, k) for k in ("sum", "max", "min", "avg", "fmaxname", "maxlist")}
    out = None
    for k, df in kinds.items():
        value = F.round("value", 6) if k == "avg" else F.array_join(F.transform("value", lambda x: x.cast("string")), ",") if k == "maxlist" else F.col("value")
        one = df.select(value.alias(k))
        out = one if out is None else out.join(F.broadcast(one))
    return out


@_register("q_metricql_compare", """WITH a AS (SELECT o_custkey AS id, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS id, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT id, a.v AS stored, b.v AS now, coalesce(b.v, 0) - coalesce(a.v, 0) AS change FROM a FULL JOIN b USING (id)""")
def q_metricql_compare(spark, sf_dir):
    of = lambda s: _t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("value"))
    return compare_snapshots(of("F"), of("O"))


@_register("q_degree", f"WITH {_SHIPS} SELECT n_nationkey AS id, coalesce((SELECT sum(n) FROM ships WHERE dst = n_nationkey), 0)::BIGINT AS calls_for, coalesce((SELECT sum(n) FROM ships WHERE src = n_nationkey), 0)::BIGINT AS calls_from FROM nation")
def q_degree(spark, sf_dir):
    s = ships(_reader(spark, sf_dir))
    ends = s.select(F.col("dst").alias("id"), F.col("n").alias("i"), F.lit(0).alias("o")).union(s.select("src", F.lit(0), "n"))
    ends = ends.union(_t(spark, sf_dir, "nation").select("n_nationkey", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("calls_for"), F.sum("o").alias("calls_from"))


# --- dependency graphs


def _partner(spark, sf_dir):
    return partners(_reader(spark, sf_dir))


def _nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node int")


@_register("q_dep_modcall", f"WITH {_PARTNER} SELECT DISTINCT a.n_regionkey AS src, b.n_regionkey AS dst FROM partner JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey")
def q_dep_modcall(spark, sf_dir):
    nodes = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("module"))
    return graphs.module_calls(nodes, _partner(spark, sf_dir)).select("src", "dst").distinct()


@_register("q_dep_mb", f"""WITH {_PARTNER}, b AS (SELECT n_nationkey AS node, n_regionkey AS block FROM nation WHERE n_regionkey > 1)
    SELECT coalesce(x.block, 0) AS src, coalesce(y.block, 0) AS dst, count(*) AS n FROM partner LEFT JOIN b x ON x.node = src LEFT JOIN b y ON y.node = dst GROUP BY 1, 2""")
def q_dep_mb(spark, sf_dir):
    blocks = _t(spark, sf_dir, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("block"))
    return graphs.contracted(_partner(spark, sf_dir), blocks)


@_register("q_dep_reach", f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT DISTINCT node AS id FROM reach WHERE root IN (1, 2)")
def q_dep_reach(spark, sf_dir):
    return graphs.reached(_partner(spark, sf_dir), _nodes(spark, 1, 2)).select(F.col("node").alias("id"))


def _drawing(spark, sf_dir, **options):
    v = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("module").alias("kind"), F.col("n_name").alias("name"))
    return graphs.Drawing(v, _partner(spark, sf_dir).withColumn("type", F.lit("modcall")), level="mod", **options)


@_register("q_dep_exclude", f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT node FROM reach WHERE root = 4)")
def q_dep_exclude(spark, sf_dir):
    return _drawing(spark, sf_dir, exclude=[4]).filtered()[0].select("id")


@_register("q_dep_exclude_children", f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT n_nationkey AS id FROM nation WHERE n_nationkey = 4 OR n_nationkey NOT IN (SELECT node FROM reach WHERE root = 4)")
def q_dep_exclude_children(spark, sf_dir):
    return _drawing(spark, sf_dir, exclude_children=[4]).filtered()[0].select("id")


@_register("q_dep_exclude_lib", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (1, 2)")
def q_dep_exclude_lib(spark, sf_dir):
    return _drawing(spark, sf_dir, exclude_lib=[1, 2]).filtered()[0].select("id")


@_register("q_dep_scc", f"""WITH RECURSIVE {_PARTNER}, {_REACH}, ends AS (SELECT src AS node FROM partner UNION SELECT dst FROM partner)
    SELECT e.node, (SELECT min(a.node) FROM reach a JOIN reach b ON a.node = b.root AND b.node = a.root WHERE a.root = e.node) AS component FROM ends e""")
def q_dep_scc(spark, sf_dir):
    return graphs.strong_components(_partner(spark, sf_dir)).select("node", "component")


@_register("q_dep_cyclic", f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT src, dst FROM partner p WHERE EXISTS (SELECT 1 FROM reach WHERE root = p.dst AND node = p.src)")
def q_dep_cyclic(spark, sf_dir):
    return graphs.cyclic(_partner(spark, sf_dir)).select("src", "dst")


@_register("q_dep_cyclic_nodes", f"WITH RECURSIVE {_PARTNER}, {_REACH} SELECT DISTINCT src AS id FROM partner p WHERE EXISTS (SELECT 1 FROM reach WHERE root = p.dst AND node = p.src)")
def q_dep_cyclic_nodes(spark, sf_dir):
    return _drawing(spark, sf_dir, cycles=True).filtered()[0].select("id")


@_register("q_dep_paths", f"""WITH RECURSIVE {_PARTNER}, c AS (SELECT [n_nationkey] AS p, false AS back FROM nation WHERE n_nationkey IN (0, 1, 2, 3)
    UNION ALL SELECT list_append(p, dst), list_contains(p, dst) FROM c JOIN partner ON src = p[-1] WHERE NOT back AND len(p) <= 3)
    SELECT p[1] AS src, p[-1] AS dst, array_to_string(p, '->') AS label FROM c WHERE len(p) > 1 AND (NOT back OR p[1] = p[-1]) AND p[-1] IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 3 OR n_nationkey < 2)""")
def q_dep_paths(spark, sf_dir):
    ends = _t(spark, sf_dir, "nation").where("n_nationkey > 3 or n_nationkey < 2").select(F.col("n_nationkey").alias("node"))
    out = graphs.simple_paths(_partner(spark, sf_dir), _nodes(spark, 0, 1, 2, 3), ends, 3)
    return out.select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), "->").alias("label"))


@_register("q_dep_terms", f"WITH {_PARTNER} SELECT n_name AS node, coalesce(array_to_string(list_sort(list(dst) FILTER (dst IS NOT NULL)), ','), '') AS successors FROM nation LEFT JOIN partner ON src = n_nationkey GROUP BY n_nationkey, n_name")
def q_dep_terms(spark, sf_dir):
    return _drawing(spark, sf_dir).terms().select("node", F.array_join(F.transform("successors", lambda s: s["dst"].cast("string")), ",").alias("successors"))


# --- duplicates


def _units(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


@_register("q_clone_exact", "SELECT count(*) AS members, min(doc_id) AS first FROM documents GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) HAVING count(*) > 1")
def q_clone_exact(spark, sf_dir):
    return clones.exact_groups(_units(spark, sf_dir)).select("members", "first")


@_register("q_clone_lev", """WITH d AS (SELECT p_name AS t, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1)
    SELECT a.id AS a, a.n AS members_a, b.id AS b, b.n AS members_b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 9) AS score FROM d a JOIN d b ON a.id < b.id
    WHERE 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) >= 0.7 - 1e-12 UNION ALL SELECT id, n, id, n, 1.0 FROM d WHERE n > 1""")
def q_clone_lev(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return clones.similar_by_edits(names, 0.7).withColumn("score", F.round("score", 9))


_DICE_SQL = r"""w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g FROM w WHERE len(w) > 0),
    c AS (SELECT min(id) AS id, count(*) AS members, g, len(g) AS n FROM g GROUP BY g), u AS (SELECT id, n, unnest(g) AS x FROM c),
    m AS (SELECT a.id AS a, b.id AS b, 2 * count(*) / (a.n + b.n) AS score FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY a.id, a.n, b.id, b.n),
    dice AS (SELECT a, x.members AS members_a, b, y.members AS members_b, score FROM m JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE score >= 0.9 - 1e-12
        UNION ALL SELECT id, members, id, members, 1.0 FROM c WHERE members > 1)"""


@_register("q_clone_dice", f"WITH {_DICE_SQL} SELECT * FROM dice")
def q_clone_dice(spark, sf_dir):
    return clones.similar_by_grams(_units(spark, sf_dir))


@_register("q_clone_rank", """WITH d AS (SELECT min(p_partkey) AS id, count(*) AS n, p_brand, p_size AS x, length(p_name) AS y, length(p_type) AS z FROM part GROUP BY p_brand, x, y, z),
    p AS (SELECT a.id AS a, a.n AS members_a, b.id AS b, b.n AS members_b, (a.x = b.x)::INT + (a.y = b.y)::INT + (a.z = b.z)::INT AS eq, abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 3 AND abs(a.z - b.z) <= 3 AS ok
    FROM d a JOIN d b ON a.p_brand = b.p_brand AND (a.id < b.id OR a.id = b.id AND a.n > 1))
    SELECT a, members_a, b, members_b, CASE WHEN eq = 3 THEN 1 WHEN eq >= 2 THEN 2 WHEN eq >= 1 THEN 4 ELSE 5 END AS rank FROM p WHERE ok""")
def q_clone_rank(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").alias("x"), F.length("p_name").alias("y"), F.length("p_type").alias("z"))
    deltas = {"x": 2, "y": 3, "z": 3}
    pairs = clones.close_classes(p, ["p_brand"], deltas)
    return clones.ranked(pairs, [(f"{m}1", f"{m}2", d) for m, d in deltas.items()]).where("rank is not null").select("a", "members_a", "b", "members_b", "rank")


_RUN_SQL = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    r AS (SELECT doc_id, unnest(generate_series(1, len(w) - 31)) AS i, w FROM w WHERE len(w) >= 32), g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 31], ' ')) AS x FROM r)"""


@_register("q_clone_ngrams", f"""WITH {_RUN_SQL}, f AS (SELECT *, first_value(doc_id) OVER t AS fd, first_value(i) OVER t AS fi FROM g WINDOW t AS (PARTITION BY x ORDER BY doc_id, i)),
    m AS (SELECT fd, doc_id AS id, i, i - fi AS d FROM f WHERE doc_id <> fd OR i <> fi), s AS (SELECT *, i - row_number() OVER (PARTITION BY fd, id, d ORDER BY i) AS k FROM m)
    SELECT fd AS first, (min(i) - d)::INT AS first_start, id, min(i)::INT AS start, count(*) + 31 AS tokens FROM s GROUP BY fd, id, d, k""")
def q_clone_ngrams(spark, sf_dir):
    return clones.token_runs(_units(spark, sf_dir).select("id", "text"))


# Takes or leaves the least free node of each state; leaving it can only help where a free node is no neighbour of it.
_CLIQUES_SQL = """near AS (SELECT a AS v, list(b) AS nb FROM (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b) GROUP BY a),
    s(r, free, done) AS (SELECT [v], list_filter(nb, lambda y: y > v), list_filter(nb, lambda y: y < v) FROM near
    UNION ALL SELECT CASE WHEN take THEN list_append(r, v) ELSE r END, CASE WHEN take THEN list_intersect(free, nb) ELSE list_filter(free, lambda y: y <> v) END,
        CASE WHEN take THEN list_intersect(done, nb) ELSE list_append(done, v) END
    FROM s JOIN near ON v = list_min(free) CROSS JOIN (VALUES (true), (false)) t(take) WHERE take OR len(list_filter(free, lambda y: y <> v AND NOT list_contains(nb, y))) > 0)
    SELECT array_to_string(list_sort(r), '-') AS group_id, unnest(r) AS member FROM s WHERE len(free) = 0 AND len(done) = 0 AND len(r) > 1"""


@_register("q_clone_groups", f"WITH RECURSIVE {_PARTNER}, pairs AS (SELECT src AS a, dst AS b FROM partner), {_CLIQUES_SQL}")
def q_clone_groups(spark, sf_dir):
    e = _partner(spark, sf_dir).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return clones.clique_groups(e)


@_register("q_clone_dice_groups", f"WITH RECURSIVE {_DICE_SQL}, pairs AS (SELECT a, b FROM dice), {_CLIQUES_SQL}")
def q_clone_dice_groups(spark, sf_dir):
    return clones.clique_groups(q_clone_dice(spark, sf_dir).select("a", "b"))


@_register("q_clone_diagonal", """WITH l AS (SELECT doc_id AS p, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    u AS (SELECT p, i, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS t FROM l WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''),
    f AS (SELECT *, first_value(p) OVER w AS fp, first_value(i) OVER w AS fi FROM u WINDOW w AS (PARTITION BY t ORDER BY p, i)), m AS (SELECT fp, fi, p, i, fi - i AS d FROM f WHERE fp <> p OR fi <> i),
    n AS (SELECT *, CASE WHEN fi - lag(fi) OVER w > 2 OR lag(fi) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY fp, p, d ORDER BY fi)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY fp, p, d ORDER BY fi) AS run FROM n)
    SELECT fp AS parent_a, min(fi) AS start_a, p AS parent_b, min(i) AS start_b, max(fi) - min(fi) + 1 AS units FROM r GROUP BY fp, p, d, run""")
def q_clone_diagonal(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return clones.diagonal_runs(clones.first_links(lines.withColumn("at", F.col("at") + 1)), gap=1)


# --- other analyses


@_register("q_dead", "SELECT s_suppkey AS id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")
def q_dead(spark, sf_dir):
    used = _t(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("id"))
    return analyses.unreferenced(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), used)


@_register("q_functional_blocks", f"WITH {_PARTNER}, b AS (SELECT n_nationkey AS id, regexp_extract(n_name, '^([A-Z]+_?[0-9])', 1) AS block FROM nation) SELECT x.block AS src, y.block AS dst, count(*) AS n FROM partner JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE x.block <> '' AND y.block <> '' GROUP BY 1, 2")
def q_functional_blocks(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"))
    return analyses.block_relations(analyses.functional_blocks(names, "^([A-Z]+_?[0-9])"), _partner(spark, sf_dir))


@_register("q_lookup_position", "SELECT doc_id AS id, p - start AS at FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(text) AS n FROM documents), (VALUES (0), (1000), (123456)) AS v(p) WHERE p >= start AND p < start + n")
def q_lookup_position(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("n"))
    return analyses.at_positions(docs, [0, 1000, 123456])


@_register("q_closure_nested", f"""WITH RECURSIVE {_PARTNER}, {_REACH} SELECT DISTINCT r.root AS src, r.node AS dst FROM reach r""")
def q_closure_nested(spark, sf_dir):
    out = run(driver_catalog(spark, sf_dir), "nations.((partner)2)+", output="nodes").df
    return out.select(F.col("group").alias("src"), F.col("node").alias("dst"))


@_register("q_help", """SELECT * FROM (VALUES ('selector', 'nation', '', 'nation'), ('selector', 'orders', 'order', 'order'), ('property', 'id', 'key', 'int'), ('property', 'name', '', 'atom'), ('property', 'nationkey', '', 'int'),
    ('property', 'acctbal', '', 'float'), ('property', 'segment', 'mktsegment', 'atom'), ('property', 'num_orders', '', 'int'), ('initial selector', 'customers', '', 'customer'), ('initial selector', 'customer', '', 'customer')) AS v(kind, name, synonyms, type)""")
def q_help(spark, sf_dir):
    return run(driver_catalog(spark, sf_dir), "regions.nations.customers.?").df.select("kind", "name", "synonyms", "type")


@_register("q_skeleton", "SELECT DISTINCT c_name AS value FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 2500")
def q_skeleton(spark, sf_dir):
    from graphloom.plans.skeletons import Skeletons

    kept = Skeletons()
    kept.save("rich", "customers[segment == $segment$, acctbal > $least$].name")
    return run(driver_catalog(spark, sf_dir), kept.query("rich(`'MACHINERY'`, `2500`)")).df.select("value").distinct()


@_register("q_dep_indirect", f"""WITH RECURSIVE {_PARTNER}, {_REACH}, c AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1)
    SELECT n_nationkey AS node, CASE WHEN n_regionkey = 1 THEN 'chosen' ELSE 'pnode' END AS kind FROM nation
    WHERE n_nationkey IN (SELECT node FROM reach JOIN c ON root = id) AND n_nationkey IN (SELECT root FROM reach JOIN c ON node = id)""")
def q_dep_indirect(spark, sf_dir):
    chosen = _t(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))
    return graphs.indirect_connections(_partner(spark, sf_dir), chosen)[0]
