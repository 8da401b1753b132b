"""The metrics language: show, save, compare, and filters on results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.compiler import Compiler, Frontier
from graphloom.plans.lexer import QueryError
from graphloom.sources.catalog import Catalog, Property

FILTERS = ("sum", "max", "min", "fmaxname", "maxlist", "avg", "tolist")
_SHOW = re.compile(r"show\s+(\w+)(?:\s+(\w+))?\s+for\s+(\w+)\s*\((.*)\)\s*", re.S)


def show(catalog: Catalog, query: str) -> DataFrame:
    """`show metrics`, `show filters`, or `show METRIC [FILTER] for ENTITY (id, ...)`: (id, value) of the listed entities,
    all with an empty list; a missing metric is 0. With a filter, its single row."""
    words = query.split()
    if words[:2] == ["show", "filters"]:
        return catalog.spark.createDataFrame([(f,) for f in FILTERS], "name string")
    if words[:2] == ["show", "metrics"]:
        return catalog.help().where("kind = 'property' and type = 'int'").select("entity", "name", "synonyms")
    m = _SHOW.fullmatch(query.strip())
    if not m:
        raise QueryError(f"not a metrics query: {query}")
    metric, filtered, entity, listed = m.groups()
    found = catalog.resolve(entity, metric)
    if not isinstance(found, Property) or found.kind not in ("int", "float"):
        raise QueryError(f"{metric} is not a metric of {entity}")
    compiler = Compiler(catalog)
    f = Frontier(compiler.attachment(catalog.entity(entity)), entity, attached=True)
    ids = [x.strip().strip("'\"") for x in listed.split(",") if x.strip()]
    if ids:
        f = Frontier(f.df.where(F.col("cur").cast("string").isin(ids)), entity, attached=True)
    g, column = compiler.value_column(f, found)
    rows = g.df.select(F.col("cur").alias("id"), F.coalesce(column, F.lit(0)).alias("value"))
    return rows if filtered is None else result_filter(rows, filtered)


def result_filter(rows: DataFrame, name: str) -> DataFrame:
    """One row (value): an aggregate of (id, value), the id of the first greatest value, all ids of it, or all values."""
    if name in ("sum", "max", "min", "avg"):
        return rows.agg(getattr(F, name)("value").alias("value"))
    if name == "fmaxname":
        return rows.agg(F.max(F.struct("value", (-F.col("id")).alias("i"), "id"))["id"].alias("value"))
    if name == "maxlist":
        best = rows.agg(F.max("value").alias("best"))
        return rows.join(F.broadcast(best), F.col("value") == F.col("best")).agg(F.array_sort(F.collect_list("id")).alias("value"))
    if name == "tolist":
        return rows.agg(F.array_sort(F.collect_list("value")).alias("value"))
    raise QueryError(f"unknown filter {name}")


def save(rows: DataFrame, metric: str, path: str) -> None:
    """Appends measured (id, value) to a history of metrics."""
    rows.select(F.lit(metric).alias("metric"), F.current_timestamp().alias("at"), "id", F.col("value").cast("double").alias("value")).write.mode("append").partitionBy("metric").parquet(path)


def compare_snapshots(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(id, stored, now, change) of two (id, value); change takes a missing value for 0."""
    a, b = stored.select("id", F.col("value").alias("stored")), now.select("id", F.col("value").alias("now"))
    return a.join(b, "id", "full").withColumn("change", F.coalesce("now", F.lit(0)) - F.coalesce("stored", F.lit(0)))
