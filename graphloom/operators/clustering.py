"""Clusters of entities that call each other: weights of calls, agglomeration, a genetic search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import settled


def without_libraries(calls: DataFrame, limit: int) -> DataFrame:
    """calls(src, dst, ...) less those of and to entities that more than `limit` others call."""
    libraries = calls.where("src <> dst").groupBy("dst").agg(F.countDistinct("src").alias("callers")).where(F.col("callers") > limit)
    out = calls
    for end in ("src", "dst"):
        out = out.join(libraries.select(F.col("dst").alias(end)), end, "left_anti")
    return out.select(calls.columns)


def call_weights(calls: DataFrame, transform: str = "none", distance: str = "weight") -> DataFrame:
    """(a, b, weight), a < b: how near two entities of calls(src, dst, n) are, in either direction.

    transform: `none` counts calls, `zero_one` whether there are any. distance: `weight` is their number, `call_sum` their
    share of all calls that either of the two makes or gets. Calls of oneself and null ends are left out.
    """
    if transform not in ("none", "zero_one") or distance not in ("weight", "call_sum"):
        raise ValueError(f"unknown transform or distance: {transform}, {distance}")
    ends = calls.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "n")
    weights = ends.groupBy("a", "b").agg((F.sum("n") if transform == "none" else F.lit(1)).cast("double").alias("weight"))
    if distance == "weight":
        return weights
    each = weights.select("a", "weight").union(weights.select("b", "weight")).groupBy("a").agg(F.sum("weight").alias("total"))
    both = weights.join(each.withColumnRenamed("total", "ta"), "a").join(each.select(F.col("a").alias("b"), F.col("total").alias("tb")), "b")
    return both.select("a", "b", (F.col("weight") / (F.col("ta") + F.col("tb") - F.col("weight"))).alias("weight"))


def agglomerative(ids: DataFrame, weights: DataFrame, least: float = 0.0, max_cluster_size: int | None = None) -> DataFrame:
    """(id, cluster) for ids(id): average linkage over weights(a, b, weight), pairs without a row weigh 0. Clusters join while
    the mean weight between two is over `least` and they have `max_cluster_size` members at most together; a cluster is
    named by its least id.

    Every round joins all pairs that are each other's nearest (equal weights: least ids), which for this linkage gives the
    tree that joining one pair after the other gives, but for ties and a size limit. Only pairs with a weight are held.
    A round joins one leaf only of a hub, so hubs are best left out first; see without_libraries().
    """
    members = settled(ids.select("id", F.col("id").alias("cluster")).distinct())
    sizes = settled(members.select("cluster", F.lit(1).cast("bigint").alias("size")))
    links = settled(weights.select("a", "b", F.col("weight").cast("double").alias("weight")).join(ids.select(F.col("id").alias("a")).distinct(), "a").join(ids.select(F.col("id").alias("b")).distinct(), "b").select("a", "b", "weight"))
    while True:
        sized = links.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        mean = sized.withColumn("mean", F.col("weight") / (F.col("na") * F.col("nb"))).where(F.col("mean") > least)
        if max_cluster_size is not None:
            mean = mean.where(F.col("na") + F.col("nb") <= max_cluster_size)
        place = F.struct((-F.col("mean")).alias("far"), "a", "b")
        ends = mean.select(F.col("a").alias("end"), place.alias("place")).union(mean.select(F.col("b"), place))
        nearest = ends.groupBy("end").agg(F.min("place").alias("place"))
        joined = settled(nearest.groupBy("place.a", "place.b").agg(F.count("*").alias("wanted")).where("wanted = 2").select(F.col("b").alias("gone"), F.col("a").alias("into")))
        if joined.isEmpty():
            return members
        renamed = lambda rows, name: rows.join(joined.withColumnRenamed("gone", name), name, "left").withColumn(name, F.coalesce("into", name)).drop("into")
        members = settled(renamed(members, "cluster").select("id", "cluster"))
        sizes = settled(renamed(sizes, "cluster").groupBy("cluster").agg(F.sum("size").alias("size")))
        moved = renamed(renamed(links, "a"), "b").where("a <> b")
        links = settled(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight")))


def fitness(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """(individual, fitness): modularity of clusters(individual, id, cluster) over weights(a, b, weight)."""
    a, b = clusters.toDF("individual", "a", "ca"), clusters.toDF("individual", "b", "cb")
    rows = weights.join(a, "a").join(b, ["individual", "b"])
    ends = rows.select("individual", F.explode(F.array("ca", "cb")).alias("cluster"), "weight").groupBy("individual", "cluster").agg(F.sum("weight").alias("ends"))
    inside = rows.groupBy("individual").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    chance = ends.groupBy("individual").agg(F.sum(F.col("ends") * F.col("ends")).alias("square"))
    return inside.join(chance, "individual").select("individual", (F.col("inside") / F.col("m") - F.col("square") / (4 * F.col("m") * F.col("m"))).alias("fitness"))


def genetic(ids: DataFrame, weights: DataFrame, population: int = 10, iterations: int = 10, mutation: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, cluster) for ids(id): the fittest of `population` clusterings after `iterations` generations.

    An entity starts with its own or a neighbour's name. The fitter half stays, and the others are made anew: each
    entity's cluster comes from one of two of that half, and with probability `mutation` from a neighbour in it. Draws are
    hashes of seed, generation and id, so reruns agree. The best never gets worse. One row stands for each
    entity and individual.
    """
    ids, weights = settled(ids.select("id").distinct()), settled(weights)
    adjacent = weights.select(F.col("a").alias("id"), F.col("b").alias("near")).union(weights.select("b", "a"))
    half = max(1, population // 2)
    draw = lambda *of: F.xxhash64(F.lit(seed), *of)
    chance = lambda *of: F.pmod(draw(*of), F.lit(1 << 20)) / (1 << 20)
    every = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(population))).alias("individual"))

    def near(generation: int) -> DataFrame:
        """A drawn neighbour of each entity for each individual."""
        drawn = F.explode(F.sequence(F.lit(1), F.lit(population))).alias("individual")
        return adjacent.select("id", "near", drawn).groupBy("individual", "id").agg(F.min_by("near", draw(F.lit(generation), "individual", "id", "near")).alias("near"))

    first = F.when(chance(F.lit("start"), "individual", "id") < 0.5, F.col("id")).otherwise(F.coalesce("near", "id"))
    living = settled(every.join(near(0), ["individual", "id"], "left").select("individual", "id", first.alias("cluster")))
    best = Window.orderBy(F.desc_nulls_last("fitness"), "individual")  # one row for each individual
    for generation in range(1, iterations + 1):
        rank = fitness(living, weights).select(F.col("individual").alias("was"), F.row_number().over(best).alias("rank"))
        parents = settled(living.withColumnRenamed("individual", "was").join(F.broadcast(rank), "was").where(F.col("rank") <= half).select("rank", "id", "cluster"))
        parent = lambda which: (1 + F.pmod(draw(F.lit(which), F.lit(generation), "individual"), F.lit(half))).cast("int")  # noqa: B023, E731
        one = F.when(chance(F.lit("side"), F.lit(generation), "individual", "id") < 0.5, parent("one")).otherwise(parent("two"))
        new = every.withColumn("rank", F.when(F.col("individual") <= half, F.col("individual")).otherwise(one))
        changes = (F.col("individual") > half) & (chance(F.lit("mutation"), F.lit(generation), "individual", "id") < mutation)
        new = new.join(near(generation), ["individual", "id"], "left").withColumn("id_of", F.when(changes, F.coalesce("near", "id")).otherwise(F.col("id")))
        living = settled(new.join(parents.withColumnRenamed("id", "id_of"), ["rank", "id_of"]).select("individual", "id", "cluster"))
    top = fitness(living, weights).select("individual", F.row_number().over(best).alias("rank")).where("rank = 1")
    found = living.join(F.broadcast(top), "individual").select("id", "cluster")
    return found if not weights.isEmpty() else ids.select("id", F.col("id").alias("cluster"))
