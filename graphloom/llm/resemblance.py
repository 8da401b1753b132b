"""Links between texts by the exact similarity of their sets of word shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import Scratch, bucket_links, connected_components, few, grouped_frames, text_batches
from graphloom.llm.simhash import link_fingerprints, shingle_hashes, simhash_of

#: Least values that make the key of a band, and bands.
ROWS, BANDS = 5, 16
#: Shingles that a task compares at once; heavier buckets are cut.
CHUNK = 1 << 19

_rng = np.random.default_rng(7)
_MULTIPLY = (_rng.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    parts = [np.unique(h.astype(np.uint64)) for h in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: the least values of ROWS permutations, hashed. None without shingles."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    low, least = hashes.astype(np.uint32), None
    for at in range(0, len(low), 1024):
        part = (low[at : at + 1024] * _MULTIPLY + _ADD).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def _raw(x) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _summaries(width: int):
    def run(batches):
        for batch in batches:
            fps, digests, keys = [], [], []
            for x in batch.column(1).cast(pa.binary()):
                raw = _raw(x)
                own = shingle_set(raw, width)
                fps.append(simhash_of(raw, width))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                keys.append(band_keys(own))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "fp", "digest", "keys"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(_raw(x), width) for x in batch.column(1).cast(pa.binary())]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "weight", "shingles"])

    return run


def tree(sets: list[np.ndarray], node: np.ndarray, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links between sets of at least that similarity: each set reached is compared with all
    that are not reached yet, by the shingles they share."""
    a, b = [], []
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mine = [ids[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
    mark = np.zeros(int(ids.max()) + 1, bool)
    left = np.arange(len(sets))
    flat, starts, rows = ids, ends - size, left
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            if len(left) * 2 <= len(rows):
                rows = left
                flat = np.concatenate([mine[k] for k in rows])
                starts = np.cumsum(size[rows]) - size[rows]
            mark[mine[at]] = True
            shared = np.zeros(len(size), np.int64)
            shared[rows] = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[mine[at]] = False
            hit = shared[left] >= similarity * (size[at] + size[left] - shared[left]) - 1e-9
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), node[at]))
                b.append(node[found])
                front.extend(found)
                left = left[~hit]
    return a, b


def _set_links(similarity: float):
    def run(batches):
        for frame, starts in grouped_frames(batches, ["key", "ci", "cj"]):
            nodes, raw = frame["node"].to_numpy(), frame["shingles"].to_numpy()
            a, b = [], []
            for x, y in zip(starts.tolist(), [*starts.tolist()[1:], len(frame)]):
                node, first = np.unique(nodes[x:y], return_index=True)
                if len(node) > 1:
                    p, q = tree([np.frombuffer(raw[x + k], np.uint64) for k in first.tolist()], node, similarity)
                    a += p
                    b += q
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _verified(similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= similarity * (len(p) + len(q) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_rows(docs: DataFrame, key: str, text: str = "text", width: int = 5, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """(row, component) of each row: the smallest row reachable over links between texts whose sets of word shingles have
    at least that Jaccard similarity. key names each row by a long of its own, never null.

    Candidates come from SimHash covering tables (fingerprints within `radius` bits) and from bands of MinHash values, in
    which a pair at 0.8 meets with probability 0.998: texts at 0.8 differ by more bits than tables can cover. Every link
    rests on the whole sets of 64-bit shingle hashes. Equal sets are one node; texts without words (null, empty) are
    one node and link with nothing else.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "resemblance")
    rows = docs.select(F.col(key).cast("bigint").alias("row"), F.col(text).alias("text"))
    summaries = scratch.keep(rows.mapInArrow(_summaries(width), "row bigint, fp bigint, digest binary, keys array<bigint>"), "summaries")
    nodes = summaries.groupBy("digest").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = scratch.keep(nodes, "nodes")
    some = nodes.where("size(keys) > 0")
    # A node for each fingerprint stands in the tables; others of that fingerprint are its candidates.
    lead = scratch.keep(some.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")), "leads")
    edges = link_fingerprints(scratch, lead.select("fp"), radius)
    edges = edges.join(lead.select(F.col("fp").alias("a"), F.col("lead").alias("p")), "a").join(lead.select(F.col("fp").alias("b"), F.col("lead").alias("q")), "b")
    alike = some.join(lead.where("n > 1"), "fp").where("node <> lead").select(F.col("lead").alias("p"), F.col("node").alias("q"))
    edges = scratch.keep(edges.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).union(alike).distinct(), "candidates")
    bands = some.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bands = scratch.keep(bands.join(shared, "key"), "bands")
    asked = scratch.keep(bands.select("node").union(edges.select("a")).union(edges.select("b")).distinct(), "asked")
    sets = rows.join(few(asked), rows["row"] == asked["node"], "left_semi").mapInArrow(_sets(width), "node bigint, weight bigint, shingles binary")
    sets = scratch.keep(sets, "sets")
    scratch.release_shuffles()

    def link(dealt: DataFrame) -> DataFrame:
        by = ["key", "ci", "cj"]
        return dealt.select(*by, "node", "shingles").repartition(*by).sortWithinPartitions(*by).mapInPandas(_set_links(similarity), "a bigint, b bigint")

    links = bucket_links(scratch, bands.join(sets, "node"), ["key"], link, CHUNK)
    scratch.release_shuffles()
    parts = scratch.keep(connected_components(scratch, links), "parts")
    # Candidates of the tables that bands have joined already need no second look.
    root = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}"))
    open_ = edges.join(root("a"), "a", "left").join(root("b"), "b", "left")
    open_ = open_.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "s"), ("b", "t")))
    checked = open_.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(_verified(similarity), "a bigint, b bigint")
    checked = scratch.keep(checked, "checked")
    if not checked.isEmpty():
        parts = connected_components(scratch, checked.union(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classes = nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    scratch.release_shuffles()
    return summaries.join(classes, "digest").select("row", "component")
