"""What several operators of this subpackage share: tables in the shared folder, link forests, components."""

from __future__ import annotations

import tempfile
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of a batch of texts, of which Python and the JVM hold a few at a time.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most TEXT_ROWS rows, for the rest of the session. Spark reads that when a query starts,
    and its default of 10,000 whole texts a batch is what fills workers. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


class Scratch:
    """Tables of one run below the shared folder. A table cuts lineage as checkpoint() does, but is compressed and
    columnar. Folders go when drop() is called, or with the driver's JVM."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(self.path)[0].deleteOnExit(self._fs(self.path)[1])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Removes the table behind what keep() returned."""
        fs, at = self._fs(df.scratch_path)
        fs.delete(at, True)

    def release_shuffles(self) -> None:
        """Lets Spark's cleaner remove shuffle files of finished jobs now, not when the driver's heap happens to fill."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner runs beside


#: Keys of 8 bytes that are broadcast at most, so that a side of whole texts need not be shuffled.
BROADCAST_KEYS = 1 << 20


def few(keys: DataFrame) -> DataFrame:
    """keys, a written table of one long a row, marked for broadcast if its count is within BROADCAST_KEYS; beyond, joins
    shuffle both sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the components of the edges (a, b); root is the smallest node. Fewer edges than nodes."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def grouped_frames(batches, key: list[str]):
    """Frames of whole groups, from batches sorted by key: what a batch leaves open waits for the next."""
    rest = None
    for frame in _and_end(batches):
        last = frame is None
        frame = rest if last else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if frame is None or not len(frame):
            continue
        values = frame[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        end = len(frame) if last else int(starts[-1])
        rest = None if last else frame.iloc[end:]
        starts = starts[starts < end]
        if len(starts):
            yield frame.iloc[:end], starts


def _and_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _forests(batches):
    for frame in batches:
        if len(frame):
            a, b = forest(frame["a"].to_numpy(), frame["b"].to_numpy())
            yield pd.DataFrame({"a": a, "b": b})


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), component the smallest node reachable.

    Alternates large-star and small-star steps until each node hangs on its root. Every step is an aggregate with a
    map-side part and a join of which one side has a row per node, so a hub does not gather in one task: Spark splits
    its rows. Each step is written to the shared folder, so no lineage grows. Self-links are ignored.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges = edges.where("a <> b").select(hi.alias("a"), lo.alias("b"))
    edges = edges.mapInPandas(_forests, "a bigint, b bigint").distinct()
    edges = scratch.keep(edges, "edges")
    while True:
        seen = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select(F.col("b"), F.lit(0), F.lit(1))
        )
        ends = seen.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", "m")).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        before, edges = edges, scratch.keep(small.distinct(), "small")
        scratch.drop(before)
        scratch.drop(large)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def bucket_links(scratch: Scratch, rows: DataFrame, key: list[str], link, chunk: int) -> DataFrame:
    """Edges (a, b) with the same components as all links within the buckets of rows(key, node, weight, ...).

    link takes rows with ci, cj and side added and returns edges within each (key, ci, cj): of rows of side 0 with those
    of side 2, and of side 1 with all. A bucket heavier than `chunk` is cut into chunks, each linked in itself first.
    Then only rows outside the bucket's largest component so far are compared with the other chunks, so a large group
    of copies, which hangs together by then, costs a row each and not all pairs of chunks.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1")
    sizes = scratch.keep(sizes.select(*key, F.ceil(F.col("w") / chunk).cast("int").alias("chunks")), "buckets")
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    own = rows.join(sizes, key).withColumn("ci", part)
    first = scratch.keep(link(own.drop("chunks").withColumns({"cj": F.col("ci"), "side": F.lit(1)})), "links")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return first
    parts = connected_components(scratch, first).withColumnRenamed("node", "member")
    placed = rows.join(large, key)
    placed = placed.join(parts, placed["node"] == parts["member"], "left").withColumn("root", F.coalesce("component", "node")).drop("member", "component")
    placed = scratch.keep(placed.withColumn("ci", part), "placed")
    by_root = placed.groupBy(*key, "root").agg(F.sum("weight").alias("w"))
    split = by_root.groupBy(*key).agg(F.max_by("root", F.struct("w", "root")).alias("main"), F.sum("w").alias("w"), F.max("w").alias("most"))
    split = split.where("w > most").select(*key, "main", F.ceil((F.col("w") - F.col("most")) / chunk).cast("int").alias("others"))
    placed = placed.join(split, key)
    other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int")
    left = placed.where("root <> main").withColumns({"cj": other, "side": F.lit(0)})
    left = left.withColumn("ci", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = placed.withColumn("cj", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("side", F.lit(2))
    names = [*rows.columns, "ci", "cj", "side"]
    return first.union(scratch.keep(link(left.select(names).union(right.select(names))), "links"))
