"""Measures of clauses and of texts by which copies are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.program_metrics import links
from graphloom.sources.program import Paths

#: Expression types that are branchings, and names of functions that leave a clause or start a process.
DECISIONS = ("case_expr", "if_expr", "receive_expr", "try_expr")
LEAVING, STARTING = ("throw", "exit", "error"), ("spawn", "spawn_link", "spawn_monitor", "spawn_opt")
#: Measures that count expressions of a type.
TYPES = {
    "funcalls": ("application",), "messpass": ("send_expr",), "funexpr": ("fun_expr",), "infix_ops": ("infix_expr",), "loops": ("list_comp",),
    "decisions": DECISIONS,
}


def clause_measures(nodes: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """(id and a column for each measure) of every clause of nodes; 0 where there is nothing to count.

    nodes: expressions, their branches (exprcl links) and calls are those at any depth below the clause's patterns, guards
    and body, each counted once. arcs: branches. indep_path: 1 + arcs - decisions that have a branch.
    avg_complexity_of_decs: branches of a decision, on average. exits: last expressions of the body that stand for the
    clause's value, and calls of functions that leave it. tles: expressions of the body. guarded_clauses: 1 with a guard.
    unused_matching: matches that bind no variable. avg_length_of_var_names: of the variables bound or used, each once.
    """
    clauses = nodes["clause"].select("id").distinct()
    inner = Paths(edges).follow("pattern/esub*|guard/esub*|body/esub*").toDF("id", "e")
    expressions = nodes["expression"].select(F.col("id").alias("e"), "type", F.coalesce("has_side_effect", F.lit(False)).alias("dirty"), F.coalesce("is_last", F.lit(False)).alias("last"))
    own = inner.join(clauses, "id", "left_semi").join(expressions, "e")

    # Links of each expression are counted before they meet the clauses, so no row stands for two of them.
    named = nodes["function"].select(F.col("id").alias("dst"), "name")
    called = links(edges, "funeref").distinct()
    tells = called.join(named, "dst").groupBy("src").agg(
        F.sum(F.col("name").isin(*LEAVING).cast("int")).alias("throw"), F.sum(F.col("name").isin(*STARTING).cast("int")).alias("spawn")
    )
    tags = {"exprcl": "arcs", "varbind": "var_binds", "recref": "records", "mref": "macs"}
    some = edges.where(F.col("tag").isin(*tags)).select("src_id", "tag", "dst_id").distinct()
    counts = some.groupBy(F.col("src_id").alias("e")).agg(*[F.sum((F.col("tag") == t).cast("int")).alias(n) for t, n in tags.items()])
    rows = own.join(counts, "e", "left").join(tells.withColumnRenamed("src", "e"), "e", "left")
    rows = rows.fillna(0, [*tags.values(), "throw", "spawn"])
    total = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("int"))
    branching = F.col("type").isin(*DECISIONS)
    out = rows.groupBy("id").agg(
        F.count("*").alias("nodes"), *[total(F.col("type").isin(*of)).alias(n) for n, of in TYPES.items()], *[F.sum(n).alias(n) for n in (*tags.values(), "throw", "spawn")],
        total(F.col("dirty")).alias("dirty_expressions"), total((F.col("type") == "match_expr") & (F.col("var_binds") == 0)).alias("unused_matching"),
        F.sum(F.when(branching, F.col("arcs")).otherwise(0)).alias("dec_arcs"), total(branching & (F.col("arcs") > 0)).alias("dec_some"),
    )
    unique = own.select("id", F.col("e").alias("src")).join(called, "src").groupBy("id").agg(F.countDistinct("dst").alias("unique_funcalls"))
    names = nodes["variable"].select(F.col("id").alias("dst"), F.length("name").alias("size"))
    variables = own.select("id", F.col("e").alias("src")).join(links(edges, "varref", "varbind"), "src").select("id", "dst").distinct().join(names, "dst")
    lengths = variables.groupBy("id").agg(F.avg("size").alias("avg_length_of_var_names"))
    body = links(edges, "body").distinct().toDF("id", "e").join(expressions, "e").groupBy("id").agg(F.count("*").alias("tles"), total(F.col("last")).alias("ends"))
    guards = links(edges, "guard").select(F.col("src").alias("id"), F.lit(1).alias("guarded_clauses")).distinct()
    for more in (out, unique, lengths, body, guards):
        clauses = clauses.join(more, "id", "left")
    clauses = clauses.fillna(0)
    clauses = clauses.withColumns({
        "indep_path": 1 + F.col("arcs") - F.col("dec_some"), "exits": F.col("ends") + F.col("throw"),
        "avg_complexity_of_decs": F.when(F.col("decisions") > 0, F.col("dec_arcs") / F.col("decisions")).otherwise(0.0),
    })
    return clauses.drop("dec_arcs", "dec_some", "ends")


def text_measures(text: Column) -> dict[str, Column]:
    """Measures of a source text by name; comments go from a per cent sign to the end of the line. Null counts as empty."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    comments = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, "%(.*)$", 0)), lambda x: x != "")
    code = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "%.*$", ""))), lambda x: x != "")
    return {
        "tokens": F.size(F.filter(F.split(F.array_join(code, " "), r"\s+"), lambda x: x != "")), "eloc": F.size(code), "num_of_comment": F.size(comments),
        "vol_of_comment": F.length(F.regexp_replace(F.array_join(comments, ""), "[^a-zA-Z0-9]", "")),
    }
