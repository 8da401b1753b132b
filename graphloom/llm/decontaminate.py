"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import text_batches

WIDTH, CONTAINMENT = 5, 0.8
#: Bytes of test items that one pass over the documents takes along: their index, texts and sketches in arrays, takes no
#: more than thrice that. A larger benchmark is searched in such blocks.
BLOCK_BYTES = 16 << 20

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def shingles(found: list[str], width: int = WIDTH) -> list[str]:
    """Word shingles, repeats included; all words as one if there are fewer; none without words."""
    if len(found) <= width:
        return [" ".join(found)] if found else []
    return list(map(" ".join, zip(*(found[k:] for k in range(width)))))


class ContainmentIndex:
    """Finds the items of which a share of at least `containment` of their distinct shingles is in a document.

    The MinHash sketch of an item with n shingles is its k least hashes, k = n - ceil(containment * n) + 1: a document
    that holds the asked share lacks k - 1 shingles at most, so it holds one of the sketch. Items are partitioned by n,
    and each partition has one hash limit that all its sketches lie below; a document's sketch for the partition is its
    hashes below the limit. So short items find long documents that no plain MinHash of the two would match, and no
    match is missed. Candidates are verified by their exact shingles.
    """

    def __init__(self, items: list[tuple[int, str | None]], width: int = WIDTH, containment: float = CONTAINMENT):
        from xxhash import xxh64_intdigest

        self.width, self.hash = width, xxh64_intdigest
        self.items: list[tuple[int, bytes, int]] = []
        partitions: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, text in items:
            own = frozenset(shingles(words(text), width))
            if not own:
                continue
            need = math.ceil(containment * len(own) - 1e-9)
            hashes = np.sort(np.fromiter(map(xxh64_intdigest, own), np.uint64, len(own)))
            partitions.setdefault(len(own).bit_length(), []).append((hashes[: len(own) - need + 1], len(self.items)))
            self.items.append((key, text.encode(), need))
        self.partitions = []
        for _, sketches in sorted(partitions.items()):
            hashes = np.concatenate([h for h, _ in sketches])
            owners = np.repeat(np.array([k for _, k in sketches], np.uint32), [len(h) for h, _ in sketches])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((hashes[order], owners[order]))

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, shared shingles, shingles of the item) of each match."""
        own = shingles(words(text), self.width)
        if not own:
            return []
        hashes = np.fromiter(map(self.hash, own), np.uint64, len(own))
        candidates: set[int] = set()
        for known, owners in self.partitions:
            sketch = hashes[hashes <= known[-1]]
            at = np.searchsorted(known, sketch)
            hit = np.unique(at[known[at] == sketch])
            for start, end in zip(hit.tolist(), np.searchsorted(known, known[hit], "right").tolist()):
                candidates.update(owners[start:end].tolist())
        have = set(own) if candidates else ()
        out = []
        for k in sorted(candidates):
            key, raw, need = self.items[k]
            of = set(shingles(words(raw.decode()), self.width))
            shared = len(of & have)
            if shared >= need:
                out.append((key, shared, len(of)))
        return out


def _matches(index: ContainmentIndex):
    def run(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                for key, shared, size in index.search(text.as_py()):
                    for column, x in zip(rows, (doc.as_py(), key, shared, size)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "item_id", "shared", "size"])

    return run


def _blocks(items: DataFrame):
    """The items in lists of at most BLOCK_BYTES, by id."""
    block, held = [], 0
    for row in items.orderBy("id", "text").toLocalIterator():
        size = 64 + len((row["text"] or "").encode())
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row["id"], row["text"]))
        held += size
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, shared, size, containment) of each document and test item with containment of the item in the
    document at or above the limit, over distinct word shingles.

    Items and documents without words (null, empty) match nothing; an item of fewer words than a shingle is found
    only in a document that has the same words and no more, never inside a longer one. Rows that repeat an id are reported once. Documents stream past an index of the items, block by block, so
    neither side is shuffled.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in _blocks(items.select(F.col(item_key).cast("bigint").alias("id"), F.col(text).alias("text"))):
        index = ContainmentIndex(block, width, containment)
        part = rows.mapInArrow(_matches(index), "doc_id bigint, item_id bigint, shared bigint, size bigint")
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, shared bigint, size bigint")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", "size")).alias("m"))
    return best.select("doc_id", "item_id", "m.shared", "m.size", (F.col("m.shared") / F.col("m.size")).alias("containment"))


def _clean(index: ContainmentIndex, text: int):
    def run(batches):
        for batch in batches:
            keep = [not index.search(t.as_py()) for t in batch.column(text)]
            yield batch.filter(pa.array(keep))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, all columns, that contain no test item."""
    text_batches(docs.sparkSession)
    for block in _blocks(items.select(F.col(item_key).cast("bigint").alias("id"), F.col(text).alias("text"))):
        index = ContainmentIndex(block, width, containment)
        docs = docs.mapInArrow(_clean(index, docs.columns.index(text)), docs.schema)
    return docs
