"""SimHash near-duplicates with covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import Scratch, bucket_links, connected_components, forest, grouped_frames, text_batches

BITS = 64
#: Fingerprints of one bucket that a task compares at once.
CHUNK = 4096


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 bit masks such that any set of at most `radius` bits misses at least one mask altogether.

    Bit i has a non-zero vector m(i) over F2 of radius + 1 dimensions; the mask of a non-zero vector v holds the bits
    with <m(i), v> = 1. For r bits, r linear equations <m(i), v> = 0 in r + 1 unknowns have a non-zero solution v.
    """
    n = (1 << (radius + 1)) - 1
    owner = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (owner[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def shingle_hashes(text: bytes, width: int = 4):
    """XXH64 of the word shingles of UTF-8 bytes, with repeats, in arrays of some; all words are one shingle if there are
    fewer, and without words there is none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space is \x20 \x09-\x0D
    n, step, join = len(words), 1 << 15, b" ".join
    if 0 < n <= width:
        yield np.array([xxh64_intdigest(join(words), 42)], ">u8")
        return
    for at in range(0, n - width + 1, step):
        part = words[at : at + step + width - 1]
        shingles = map(join, zip(*(part[k:] for k in range(width))))
        yield np.array([xxh64_intdigest(x, 42) for x in shingles], ">u8")


def simhash_of(text: bytes, width: int = 4) -> int:
    """The 64-bit fingerprint; 0 without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            got = [simhash_of(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed long."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(width), "id bigint, fp bigint")


def _links(radius: int):
    """Consumes buckets, each in consecutive rows, and yields forests of their links."""
    most = np.uint8(radius)

    def of_bucket(fp, side):
        a, b = [], []
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, right]) <= most)
            x, y = forest(fp[rows[i]].view(np.int64), fp[right[j]].view(np.int64))
            a.append(x)
            b.append(y)
        return forest(np.concatenate(a), np.concatenate(b)) if a else (fp[:0].view(np.int64),) * 2

    def run(batches):
        for frame, starts in grouped_frames(batches, ["mask", "part", "ci", "cj"]):
            fp, side = frame["node"].to_numpy().view(np.uint64), frame["side"].to_numpy()
            sizes = np.diff(np.r_[starts, len(fp)])
            group = np.repeat(np.arange(len(starts)), sizes)
            small = np.repeat(sizes <= 64, sizes)
            a, b = [], []
            for d in range(1, 64):
                near = (group[d:] == group[:-d]) & small[d:]
                if not near.any():
                    break
                i = np.flatnonzero(near)
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
                a.append(fp[i].view(np.int64))
                b.append(fp[i + d].view(np.int64))
            for g in np.flatnonzero(sizes > 64):
                at = slice(starts[g], starts[g] + sizes[g])
                x, y = of_bucket(fp[at], side[at])
                a.append(x)
                b.append(y)
            if a:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                if len(x):
                    yield pd.DataFrame({"a": x, "b": y})

    return run


def link_fingerprints(scratch: Scratch, fps: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that join the fingerprints of fps(fp), which are distinct, as all pairs within `radius` bits do.

    Covering hashing: one row per fingerprint and mask, keyed by the masked bits; every pair within the radius meets
    under some mask, so nothing is missed. Buckets above `chunk` rows are cut. Only a spanning forest of the links
    leaves a task.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(radius)])
    rows = fps.select(F.col("fp").alias("node"), F.posexplode(masks).alias("mask", "bits"))
    rows = rows.select("mask", F.col("node").bitwiseAND(F.col("bits")).alias("part"), "node", F.lit(1).alias("weight"))

    def link(dealt: DataFrame) -> DataFrame:
        by = ["mask", "part", "ci", "cj"]
        return dealt.select(*by, "side", "node").repartition(*by).sortWithinPartitions(*by).mapInPandas(_links(radius), "a bigint, b bigint")

    return bucket_links(scratch, rows, ["mask", "part"], link, chunk)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fp, component (smallest id reachable over links of at most `radius` bits).

    Null and empty texts have the fingerprint 0 and link like any other. Rows that repeat an id each get a row. Rows
    with a null id link too; their component is null if no row that they reach has an id. Very long texts are hashed in
    parts. Other columns of docs don't matter.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, key, text, width), "fingerprints")
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    parts = connected_components(scratch, link_fingerprints(scratch, fps.select("fp"), radius))
    classes = fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component"))
    classes = classes.join(smallest, "root").select("fp", "component")
    scratch.release_shuffles()
    return rows.join(classes, "fp", "left").select("id", "fp", "component")
