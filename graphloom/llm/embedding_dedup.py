"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import Scratch, connected_components, forest

#: Rows that the rotation is fitted on. It only orders vectors and prunes blocks; any rotation gives the same links.
ROTATION_SAMPLE = 4096
#: Leading rotated dimensions that carry the grid and, with the norm of the rest, the blocks' boxes.
LEADING = 8
#: Vectors of a sequence interval, the fewest that the recursion splits further, and intervals of a stretch.
INTERVAL, LEAF, STRETCH = 16_384, 256, 256
#: Sides of the finer cells that order vectors within a cell, as a share of the cell's.
FINER = 0.25


def _unit(values) -> np.ndarray | None:
    if values is None:
        return None
    x = np.asarray(values, np.float64)  # a null component becomes NaN
    if not x.size or not np.isfinite(x).all():
        return None
    x = x / np.abs(x).max() if x.any() else x
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else None


def _units(batches):
    """(id, dim, digest, unit): digest names equal vectors, unit holds the normalised doubles; null if it links with nothing."""
    for batch in batches:
        ids, digests, units, dims = batch.column(0), [], [], []
        for x in batch.column(1):
            u = _unit(x.as_py())
            raw = None if u is None else u.tobytes()
            units.append(raw)
            digests.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            dims.append(None if u is None else len(u))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())],
            ["id", "dim", "digest", "unit"],
        )


def _matrix(units, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, dim)


def _placed(rotation: np.ndarray, eps: float):
    """Adds y0, y1, ...: the leading rotated coordinates, then the norm of what they leave; c0, ... and f0, ...: their cells
    and finer cells. Distances of y never exceed those of the vectors."""
    lead = rotation.shape[1]

    def run(frames):
        for frame in frames:
            if len(frame):
                y = _matrix(frame["unit"], rotation.shape[0]) @ rotation
                rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
                cells, finer = np.floor(y / eps).astype(np.int32), np.floor(y / (eps * FINER)).astype(np.int32)
                out = {"node": frame["node"], "m": frame["m"], "unit": frame["unit"]}
                out |= {f"y{k}": y[:, k] for k in range(lead)} | {f"y{lead}": rest}
                yield pd.DataFrame(out | {f"c{k}": cells[:, k] for k in range(lead)} | {f"f{k}": finer[:, k] for k in range(lead)})

    return run


def _join_blocks(eps: float, threshold: float, dim: int, coordinates: list[str]):
    """All links between two sequence intervals, or within one: rows (a, a, links of a) and a forest (a, b, 0)."""
    slack = 1e-9

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["interval", "rank"], kind="stable")
        x, y = _matrix(frame["unit"], dim), frame[coordinates].to_numpy()
        node, m = frame["node"].to_numpy(), frame["m"].to_numpy(np.int64)
        interval = frame["interval"].to_numpy()
        cut = int(np.searchsorted(interval, interval[0], "right"))
        count = np.zeros(len(x), np.int64)
        a, b = [], []

        def exact(i, j):
            return math.fsum((x[i] * x[j]).tolist())

        def leaf(s, e, t, u):
            c = x[s:e] @ x[t:u].T
            i, j = np.nonzero(c >= threshold - 1e-12)
            for k in np.flatnonzero(np.abs(c[i, j] - threshold) < 1e-12):  # where rounding of the product could decide
                if exact(s + i[k], t + j[k]) < threshold:
                    i[k] = -1
            i, j = i[i >= 0] + s, j[i >= 0] + t
            if s == t:
                i, j = i[i < j], j[i < j]
            np.add.at(count, i, m[j])
            np.add.at(count, j, m[i])
            p, q = forest(node[i], node[j])
            a.append(p)
            b.append(q)

        def box(s, e):
            return y[s:e].min(0), y[s:e].max(0)

        def recurse(s, e, t, u):
            if e <= s or u <= t:
                return
            if s != t:
                (l1, h1), (l2, h2) = box(s, e), box(t, u)
                gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
                if gap @ gap > (eps + slack) ** 2:
                    return
            if max(e - s, u - t) <= LEAF:
                return leaf(s, e, t, u)
            h, k = (s + e) // 2, (t + u) // 2
            if s == t:
                recurse(s, h, s, h)
                recurse(h, e, h, e)
                recurse(s, h, h, e)
            elif e - s >= u - t:
                recurse(s, h, t, u)
                recurse(h, e, t, u)
            else:
                recurse(s, e, t, k)
                recurse(s, e, k, u)

        own = frame["pi"].iloc[0] == frame["pj"].iloc[0]
        recurse(0, len(x), 0, len(x)) if own else recurse(0, cut, cut, len(x)) if cut < len(x) else None
        p, q = forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])
        some = np.flatnonzero(count)
        return pd.DataFrame({"a": np.r_[node[some], p], "b": np.r_[node[some], q], "n": np.r_[count[some], np.zeros(len(p), np.int64)]})

    return join


def _apart(first: list[tuple[Column, Column]], second: list[tuple[Column, Column]]) -> Column:
    """The squared distance of two boxes, each as (low, high) of every coordinate."""
    gaps = [F.greatest(F.lit(0.0), l1 - h2, l2 - h1) for (l1, h1), (l2, h2) in zip(first, second)]
    total = F.lit(0.0)
    for g in gaps:
        total = total + g * g
    return total


def near_pairs(boxes: DataFrame, names: list[str], eps: float, stretch: int = STRETCH) -> DataFrame:
    """(i, j), i <= j, of intervals whose boxes come within eps: boxes(interval, lo_y0, hi_y0, ...).

    Boxes of `stretch` intervals are joined first; only intervals of stretches that come within eps are held against
    each other. So the pairs that are looked at follow those that survive, not all. The theta join is over stretches: a row
    for each 4 million vectors (STRETCH x INTERVAL).
    """
    limit = (eps + 1e-9) ** 2

    def ends(df: str, a: str = "") -> list[tuple[Column, Column]]:
        return [(F.col(f"{df}.lo_{n}"), F.col(f"{df}.hi_{n}")) for n in names]

    boxes = boxes.withColumn("s", F.floor(F.col("interval") / stretch).cast("int"))
    wide = boxes.groupBy("s").agg(*[F.min(f"lo_{n}").alias(f"lo_{n}") for n in names], *[F.max(f"hi_{n}").alias(f"hi_{n}") for n in names])
    a, b = wide.alias("a"), wide.alias("b")
    stretches = a.join(b, (F.col("a.s") <= F.col("b.s")) & (_apart(ends("a"), ends("b")) <= limit)).select(F.col("a.s").alias("sa"), F.col("b.s").alias("sb"))
    i, j = boxes.alias("i"), boxes.alias("j")
    both = stretches.join(i, F.col("sa") == F.col("i.s")).join(j, F.col("sb") == F.col("j.s"))
    both = both.where((F.col("i.interval") <= F.col("j.interval")) & (_apart(ends("i"), ends("j")) <= limit))
    return both.select(F.col("i.interval").alias("i"), F.col("j.interval").alias("j"))


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links at cosine >= threshold, in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    length never link. Rows that repeat an id are vectors of their own, linked like any others. A null id links too;
    component_id is the smallest id reached, null if there is none; kept says whether it is the row's own. Equal
    vectors are joined as one with a multiplicity, so copies cost nothing. Other columns don't matter.

    Epsilon grid order: unit vectors are rotated so that variance leads, sorted by the grid cells (side eps, the chord
    of the threshold) of their leading dimensions and cut into intervals of the sequence. Interval pairs whose boxes are
    further than eps apart are skipped, and so is a vector that is further than eps from the other interval's box; the
    others are joined recursively by halves under the same rule.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "grid-order")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    units = scratch.keep(rows.mapInArrow(_units, "id bigint, dim int, digest binary, unit binary"), "units")
    reps = units.where("unit is not null").groupBy("digest", "dim")
    reps = reps.agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("unit").alias("unit"))
    reps = scratch.keep(reps.withColumn("node", F.monotonically_increasing_id()), "distinct")
    dims = [r[0] for r in reps.select("dim").distinct().collect()]  # as many as there are lengths
    links = None
    for dim in dims:
        found = _links_of_length(scratch, reps.where(F.col("dim") == dim), dim, eps, threshold)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    links = scratch.keep(links, "links")
    counts = links.where("a = b").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(scratch, links.where("a <> b").select("a", "b"))
    classes = reps.select("node", "digest", "dim", "least", "m").join(counts, F.col("node") == counts["a"], "left").drop("a")
    classes = classes.join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    classes = classes.withColumn("root", F.coalesce("component", "node"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    links_of = (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("bigint").alias("n_links")
    classes = classes.join(smallest, "root").select("digest", "dim", links_of, "component_id", F.lit(True).alias("known"))
    out = units.drop("unit").join(classes, ["digest", "dim"], "left")
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _links_of_length(scratch: Scratch, reps: DataFrame, dim: int, eps: float, threshold: float) -> DataFrame:
    spark = reps.sparkSession
    sample = reps.select("unit").orderBy(F.xxhash64("digest")).limit(ROTATION_SAMPLE).toPandas()["unit"]
    x = _matrix([bytes(u) for u in sample], dim)
    lead = min(LEADING, dim)
    rotation = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :lead])
    names = [f"y{k}" for k in range(lead + 1)]
    cells = [f"c{k}" for k in range(lead)] + [f"f{k}" for k in range(lead)]
    schema = "node bigint, m bigint, unit binary, " + ", ".join([f"{n} double" for n in names] + [f"{c} int" for c in cells])
    grid = scratch.keep(reps.select("node", "m", "unit").mapInPandas(_placed(rotation, max(eps, 1e-6)), schema), "grid")
    # Ranges of the sequence, with the node as a last key so that a crowded cell is cut like any other stretch.
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    grid = grid.repartitionByRange(int(parts), *cells, "node").sortWithinPartitions(*cells, "node")
    grid = scratch.keep(grid.select("node", "m", "unit", *names, F.monotonically_increasing_id().alias("at")), "sequence")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = grid.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    before = np.cumsum([0] + [r["count"] for r in sizes])
    starts = spark.createDataFrame([(int(r["part"]), int(s)) for r, s in zip(sizes, before)], "part bigint, start bigint")
    ranked = grid.withColumn("part", part).join(F.broadcast(starts), "part")
    ranked = ranked.withColumn("rank", F.col("start") + within).withColumn("interval", F.floor(F.col("rank") / INTERVAL).cast("int"))
    ranked = scratch.keep(ranked.select("node", "m", "unit", "rank", "interval", *names), "ranked")
    ends = [F.min(n).alias(f"lo_{n}") for n in names] + [F.max(n).alias(f"hi_{n}") for n in names]
    boxes = scratch.keep(ranked.groupBy("interval").agg(*ends), "boxes")
    pairs = scratch.keep(near_pairs(boxes, names, eps), "pairs")
    # An interval's rows go to each of its pairs: all to its own, to another those that come within eps of the other's box.
    to = pairs.select(F.col("i").alias("interval"), "i", "j", F.col("j").alias("other"))
    to = to.union(pairs.where("i < j").select("j", "i", "j", "i"))
    to = to.join(boxes.withColumnRenamed("interval", "other"), "other")
    r, t = ranked.alias("r"), to.alias("t")
    far = _apart([(F.col(f"r.{n}"), F.col(f"r.{n}")) for n in names], [(F.col(f"t.lo_{n}"), F.col(f"t.hi_{n}")) for n in names])
    dealt = r.join(t, "interval").where((F.col("t.i") == F.col("t.j")) | (far <= (eps + 1e-9) ** 2))
    dealt = dealt.select("interval", "r.node", "r.m", "r.unit", "r.rank", *(f"r.{n}" for n in names), F.col("t.i").alias("pi"), F.col("t.j").alias("pj"))
    return dealt.groupBy("pi", "pj").applyInPandas(_join_blocks(eps, threshold, dim, names), "a bigint, b bigint, n bigint")
