"""Dead entities, functional blocks, positions, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graphs import contracted, cyclic


def unreferenced(entities: DataFrame, references: DataFrame) -> DataFrame:
    """The entities (id, ...) that no reference (id) names."""
    return entities.join(references.select("id"), "id", "left_anti")


def dead_kinds(nodes: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """(kind, id) of a program's nodes that could go, by eight kinds.

    fun: defined, not exported, no reference or call, static or dynamic. rec, recfield, macro, var: no reference. pattern: an
    expression that binds variables, none of which has a reference. guard: the constant true. expr: of a clause's body, not
    its last and without side effects.
    """
    def ends(*tags):
        return edges.where(F.col("tag").isin(*tags)).select(F.col("dst_id").alias("id")).distinct()

    def of(kind, rows):
        return rows.select(F.lit(kind).alias("kind"), "id")

    functions = nodes["function"].where("coalesce(defined, true) and not coalesce(exported, false)")
    expressions = nodes["expression"]
    out = of("fun", unreferenced(functions, ends("funeref", "funlref", "dynref", "ambref", "funcall", "dyncall", "ambcall", "funexp", "funimp")))
    for kind, entity, tags in (("rec", "record", ["recref"]), ("recfield", "field", ["fieldref"]), ("macro", "macro", ["mref", "cmref"]), ("var", "variable", ["varref"])):
        out = out.union(of(kind, unreferenced(nodes[entity], ends(*tags))))
    binds = edges.where("tag = 'varbind'").select("src_id", F.col("dst_id").alias("id"))
    used = binds.join(ends("varref").withColumn("used", F.lit(1)), "id", "left").groupBy(F.col("src_id").alias("id")).agg(F.count("used").alias("n"))
    out = out.union(of("pattern", expressions.join(used.where("n = 0"), "id", "left_semi")))
    out = out.union(of("guard", expressions.where("type = 'atom' and value = 'true'").join(ends("guard"), "id", "left_semi")))
    idle = expressions.where("not coalesce(is_last, false) and not coalesce(has_side_effect, false)")
    return out.union(of("expr", idle.join(ends("body"), "id", "left_semi")))


def eliminable(members: DataFrame, parent: str) -> DataFrame:
    """The members that are not the only one of their parent."""
    many = members.groupBy(parent).count().where("count > 1").select(parent)
    return members.join(many, parent, "left_semi")


def functional_blocks(modules: DataFrame, pattern: str) -> DataFrame:
    """(node, block): the first group of the pattern in each module's path; modules(id, path) it doesn't fit are left out."""
    block = F.regexp_extract("path", pattern, 1)
    return modules.select(F.col("id").alias("node"), block.alias("block")).where("block <> ''")


def block_relations(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, n): edges between listed blocks."""
    a, b = blocks.select(F.col("node").alias("src"), F.col("block").alias("bs")), blocks.select(F.col("node").alias("dst"), F.col("block").alias("bd"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy(F.col("bs").alias("src"), F.col("bd").alias("dst")).agg(F.count("*").alias("n"))


def block_cycles(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """The relations between different blocks that lie on cycles."""
    return cyclic(contracted(edges, blocks).where("src <> dst").select("src", "dst"))


def at_positions(units: DataFrame, positions: list[int], stretch: int = 1 << 16) -> DataFrame:
    """(id, at): which of units(id, n), laid end to end by id, holds each absolute position, and where in it.

    Lengths are summed by ranges of ids first, so no single task walks all units.
    """
    spark = units.sparkSession
    from pyspark.sql import Window

    rows = units.withColumn("k", F.floor(F.col("id") / stretch))
    sums = rows.groupBy("k").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("k", before.alias("base"), "held")
    wanted = spark.createDataFrame([(p,) for p in positions], "p bigint")
    hit = starts.join(F.broadcast(wanted), (F.col("p") >= F.col("base")) & (F.col("p") < F.col("base") + F.col("held"))).select("k", "base", "p")
    inside = Window.partitionBy("k", "p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(F.broadcast(hit), "k").withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return near.where("p >= start and p < start + n").select("id", (F.col("p") - F.col("start")).alias("at"))


def to_line_column(text: str, position: int) -> tuple[int, int]:
    """1-based line and column of a 0-based position."""
    before = text[:position]
    return before.count("\n") + 1, position - (before.rfind("\n") + 1) + 1


def to_position(text: str, line: int, column: int) -> int:
    at = 0
    for _ in range(line - 1):
        at = text.index("\n", at) + 1
    return at + column - 1


def kmeans_clusters(rows: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """rows with cluster: k-means on attribute vectors such as call counts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors).transform(vectors).drop("_v")


def cluster_fitness(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(fitness): modularity of clusters(id, cluster) over edges(src, dst)."""
    a = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    m = e.agg(F.count("*").alias("m"), F.sum((F.col("ca") == F.col("cb")).cast("int")).alias("inside"))
    ends = e.select(F.col("ca").alias("c"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("cb", F.lit(0), F.lit(1)))
    ends = ends.groupBy("c").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).agg(F.sum(F.col("o") * F.col("i")).alias("chance"))
    return m.join(F.broadcast(ends)).select((F.col("inside") / F.col("m") - F.col("chance") / (F.col("m") * F.col("m"))).alias("fitness"))
