"""The catalog of the star schema, events and texts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.layout import layout_expressions
from graphloom.sources.catalog import Catalog, Entity, Property, Selector


def _p(names: str, kind: str, expr: str | None = None, **more) -> Property:
    names = tuple(names.split())
    return Property(names, kind, expr or names[0], **more)


def ships(t) -> DataFrame:
    """(src, dst, n): lines from the supplier's nation to the customer's."""
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    return lines.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").groupBy("src", "dst").agg(F.count("*").alias("n"))


def partners(t, most: int = 2) -> DataFrame:
    """(src, dst): each nation's `most` busiest destinations, the smaller key on a tie."""
    order = Window.partitionBy("src").orderBy(F.col("n").desc(), "dst")
    return ships(t).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("src", "dst")


def driver_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    @lru_cache
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def lines() -> DataFrame:
        table = t("lineitem")
        return table.withColumn("l_id", F.xxhash64(*table.columns))

    def events() -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return t("events").withColumn("next_id", F.lead("event_id").over(w)).withColumn("prev_id", F.lag("event_id").over(w))

    def turns() -> DataFrame:
        key = F.concat_ws(":", "conv_id", "turn")
        w = Window.partitionBy("conv_id").orderBy("turn")
        return t("conversations").select("*", key.alias("t_id")).select("*", F.lead("t_id").over(w).alias("next_id"))

    def count_of(table: str, fk: str):
        return lambda: t(table).groupBy(F.col(fk).alias("id")).agg(F.count("*").alias("value"))

    catalog = Catalog(spark, snapshot=sf_dir)
    catalog.add(
        Entity("region", "r_regionkey", lambda: t("region"), ("regions", "region"), [Selector(("nations", "nation"), "nation", child="n_regionkey")], [_p("id key", "int", "r_regionkey"), _p("name", "atom", "r_name")]),
        Entity(
            "nation", "n_nationkey", lambda: t("nation"), ("nations", "nation"),
            [
                Selector(("region",), "region", parent="n_regionkey"), Selector(("customers", "customer"), "customer", child="c_nationkey"),
                Selector(("suppliers", "supplier"), "supplier", child="s_nationkey"), Selector(("ships_to",), "nation", pairs=lambda: ships(t)),
                Selector(("ships_from",), "nation", pairs=lambda: ships(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))),
                Selector(("partner", "partners"), "nation", pairs=lambda: partners(t)),
                Selector(("partner_of",), "nation", pairs=lambda: partners(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))),
            ],
            [_p("id key", "int", "n_nationkey"), _p("name", "atom", "n_name"), _p("regionkey", "int", "n_regionkey")],
        ),
        Entity(
            "customer", "c_custkey", lambda: t("customer"), ("customers", "customer"),
            [Selector(("nation",), "nation", parent="c_nationkey"), Selector(("orders", "order"), "order", child="o_custkey")],
            [_p("id key", "int", "c_custkey"), _p("name", "atom", "c_name"), _p("nationkey", "int", "c_nationkey"), _p("acctbal", "float", "c_acctbal"), _p("segment mktsegment", "atom", "c_mktsegment"), Property(("num_orders",), "int", pairs=count_of("orders", "o_custkey"), default=0)],
        ),
        Entity(
            "order", "o_orderkey", lambda: t("orders"), ("orders", "order"),
            [Selector(("customer",), "customer", parent="o_custkey"), Selector(("lineitems", "lines", "lineitem"), "lineitem", child="l_orderkey")],
            [_p("id key", "int", "o_orderkey"), _p("custkey", "int", "o_custkey"), _p("status", "atom", "o_orderstatus"), _p("totalprice", "float", "o_totalprice"), _p("priority", "string", "o_orderpriority"), Property(("num_lines",), "int", pairs=count_of("lineitem", "l_orderkey"), default=0)],
        ),
        Entity(
            "lineitem", "l_id", lines, ("lineitems", "lines"),
            [Selector(("order",), "order", parent="l_orderkey"), Selector(("part",), "part", parent="l_partkey"), Selector(("supplier",), "supplier", parent="l_suppkey")],
            [_p("id", "int", "l_id"), _p("quantity", "float", "l_quantity"), _p("extendedprice", "float", "l_extendedprice"), _p("discount", "float", "l_discount"), _p("tax", "float", "l_tax"), _p("returnflag", "atom", "l_returnflag"), _p("linestatus", "atom", "l_linestatus"), _p("orderkey", "int", "l_orderkey"), _p("partkey", "int", "l_partkey"), _p("suppkey", "int", "l_suppkey")],
        ),
        Entity(
            "part", "p_partkey", lambda: t("part"), ("parts", "part"),
            [Selector(("lineitems", "lines"), "lineitem", child="l_partkey"), Selector(("suppliers",), "supplier", pairs=lambda: t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct())],
            [_p("id key", "int", "p_partkey"), _p("name", "atom", "p_name"), _p("brand", "atom", "p_brand"), _p("type", "string", "p_type"), _p("size", "int", "p_size"), _p("retailprice", "float", "p_retailprice")],
        ),
        Entity(
            "supplier", "s_suppkey", lambda: t("supplier"), ("suppliers", "supplier"),
            [Selector(("nation",), "nation", parent="s_nationkey"), Selector(("lineitems", "lines"), "lineitem", child="l_suppkey"), Selector(("parts",), "part", pairs=lambda: t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct())],
            [_p("id key", "int", "s_suppkey"), _p("name", "atom", "s_name"), _p("nationkey", "int", "s_nationkey"), _p("acctbal", "float", "s_acctbal")],
        ),
        Entity(
            "event", "event_id", events, ("events",),
            [Selector(("next",), "event", parent="next_id"), Selector(("prev", "previous"), "event", parent="prev_id"), Selector(("user",), "user", parent="user_id")],
            [_p("id", "int", "event_id"), _p("event_type type", "atom", "event_type"), _p("value val", "float", "value"), _p("user_id", "int")],
        ),
        Entity("user", "user_id", lambda: t("events").select("user_id").distinct(), ("users",), [Selector(("events",), "event", child="user_id")], [_p("id", "int", "user_id")]),
        Entity(
            "document", "doc_id", lambda: t("documents"), ("documents", "docs", "files"),
            [Selector(("labels", "label"), "label", child="doc_id")],
            [_p("id", "int", "doc_id"), _p("lang", "atom"), _p("source", "atom"), _p("text", "string"), *[Property(names, "int", e) for names, e in layout_expressions("text")]],
        ),
        Entity("label", "doc_id", lambda: t("labels"), ("labels",), [Selector(("document",), "document", parent="doc_id")], [_p("id", "int", "doc_id"), _p("quality", "int"), _p("toxic", "int")]),
        Entity(
            "turn", "t_id", turns, ("turns",), [Selector(("next",), "turn", parent="next_id")],
            [_p("id", "string", "t_id"), _p("role", "atom"), _p("text", "string"), _p("index", "int", "turn"), *[Property(names, "int", e) for names, e in layout_expressions("text")]],
        ),
        Entity("page", "page_id", lambda: t("pages"), ("pages",), [], [_p("id", "int", "page_id"), _p("url", "string")]),
        Entity("vector", "vec_id", lambda: t("embeddings"), ("vectors",), [], [_p("id", "int", "vec_id"), _p("label", "int")]),
    )
    return catalog
