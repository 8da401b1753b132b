"""Metrics of program graphs that need call paths or expression trees. All give (id, value); what they leave out has 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graphs import strong_components
from graphloom.sources.scratch import settled

#: Expression types that each nesting metric counts.
NESTING = {
    "application": ("application",), "cases": ("case_expr",),
    "structs": ("fun_expr", "case_expr", "receive_expr", "block_expr", "try_expr", "if_expr"),
}


def links(edges: DataFrame, *tags: str) -> DataFrame:
    """(src, dst) of the links of these tags."""
    return edges.where(F.col("tag").isin(*tags)).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


def counted(pairs: DataFrame) -> DataFrame:
    """(id, value): rows of pairs(src, dst) by src."""
    return pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("value"))


def call_depths(edges: DataFrame) -> DataFrame:
    """(id, longest, shortest, paths) of each function that is called or calls: calls on its longest and shortest chain to
    a function without calls, and how many such chains there are, 0 without calls.

    Functions that call each other in a circle count as one, so chains are finite; a circle adds no depth. Rounds peel
    off those whose callees are all known, so there are as many as the longest chain has calls.
    """
    calls = settled(links(edges, "funcall", "dyncall").distinct())
    part = settled(strong_components(calls))
    a = part.select(F.col("node").alias("src"), F.col("component").alias("cs"))
    b = part.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    arcs = settled(calls.join(a, "src").join(b, "dst").where("cs <> cd").select("cs", "cd").distinct())
    left = part.select(F.col("component").alias("c")).distinct()
    callers = arcs.select(F.col("cs").alias("c")).distinct()
    known = settled(left.join(callers, "c", "left_anti").select("c", F.lit(0).alias("longest"), F.lit(0).alias("shortest"), F.lit(1).cast("long").alias("paths")))
    left = settled(callers)
    while not left.isEmpty():
        met = arcs.join(left, F.col("cs") == F.col("c"), "left_semi").join(known, F.col("cd") == F.col("c"), "left")
        of = met.groupBy(F.col("cs").alias("c")).agg((F.max("longest") + 1).alias("longest"), (F.min("shortest") + 1).alias("shortest"), F.sum("paths").alias("paths"), F.count("longest").alias("have"), F.count("*").alias("need"))
        new = settled(of.where("have = need").drop("have", "need"))
        known, left = settled(known.union(new)), settled(left.join(new, "c", "left_anti"))
    paths = F.when(F.col("longest") > 0, F.col("paths")).otherwise(0)
    return part.join(known, F.col("component") == F.col("c")).select(F.col("node").alias("id"), "longest", "shortest", paths.alias("paths"))


def nesting(edges: DataFrame, expressions: DataFrame) -> DataFrame:
    """(id, application, cases, structs): how deep each clause nests expressions of each NESTING kind; expressions(id, type).

    Expressions form trees below a clause, so each is visited once, a round for each level.
    """
    types = settled(expressions.select("id", *[F.col("type").isin(*t).cast("int").alias(f"is_{k}") for k, t in NESTING.items()]))
    below = settled(links(edges, "esub", "exprcl_body"))
    at = links(edges, "pattern", "guard", "body").toDF("clause", "id").select("clause", "id", *[F.lit(0).alias(k) for k in NESTING])
    out = None
    while True:
        at = at.join(types, "id").select("clause", "id", *[(F.col(k) + F.col(f"is_{k}")).alias(k) for k in NESTING])
        at = settled(at)
        if at.isEmpty():
            break
        level = at.groupBy("clause").agg(*[F.max(k).alias(k) for k in NESTING])
        out = level if out is None else out.union(level)
        at = at.join(below, F.col("id") == F.col("src")).select("clause", F.col("dst").alias("id"), *NESTING)
    out = at.select("clause", *NESTING) if out is None else out
    return out.groupBy(F.col("clause").alias("id")).agg(*[F.max(k).alias(k) for k in NESTING])


def inside(edges: DataFrame, expressions: DataFrame, *types: str) -> DataFrame:
    """(src, dst): clauses and the expressions of these types anywhere in them."""
    from graphloom.sources.program import follow

    wanted = expressions.where(F.col("type").isin(*types)).select(F.col("id").alias("dst"))
    return follow(edges, "pattern/esub*|guard/esub*|body/esub*").join(wanted, "dst", "left_semi").select("src", "dst")


def module_crossings(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(into, out of, within): links (src, dst) from a file to each call that enters, leaves or stays in it."""
    own = links(edges, "func")
    a, b = own.select(F.col("src").alias("fa"), F.col("dst").alias("src")), own.select(F.col("src").alias("fb"), F.col("dst").alias("dst"))
    rows = links(edges, "funcall", "dyncall").join(a, "src", "left").join(b, "dst", "left")
    split = ~F.col("fa").eqNullSafe(F.col("fb"))
    into = rows.where(split & F.col("fb").isNotNull()).select(F.col("fb").alias("src"), "dst")
    out = rows.where(split & F.col("fa").isNotNull()).select(F.col("fa").alias("src"), "dst")
    return into, out, rows.where("fa = fb").select(F.col("fa").alias("src"), "dst")


def raised(values: DataFrame, owners: DataFrame, how) -> DataFrame:
    """(id, value): values(id, value) by their owner in owners(src, dst), aggregated by `how`."""
    return owners.join(values, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(how("value").alias("value"))


def tail_recursion(edges: DataFrame, functions: DataFrame, expressions: DataFrame) -> DataFrame:
    """(id, value): unknown without a definition, else non_rec, tail_rec (all its calls of itself are last), non_tail_rec."""
    calls = inside(edges, expressions, "application").toDF("clause", "e")
    owner = links(edges, "funcl").toDF("f", "clause")
    target = links(edges, "funeref").toDF("e", "g")
    last = expressions.select(F.col("id").alias("e"), F.coalesce("is_last", F.lit(False)).alias("is_last"))
    own = calls.join(owner, "clause").join(target, "e").where("f = g").join(last, "e").groupBy("f").agg(F.min("is_last").alias("tail"))
    rows = functions.join(own, F.col("id") == F.col("f"), "left")
    kind = F.when(~F.coalesce("defined", F.lit(True)), "unknown").when(F.col("tail").isNull(), "non_rec").when(F.col("tail"), "tail_rec").otherwise("non_tail_rec")
    return rows.select("id", kind.alias("value"))
