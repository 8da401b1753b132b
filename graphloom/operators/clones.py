"""Duplicate detection: similar units, ranked pairs, repeated token runs, groups."""

from __future__ import annotations

import collections
import hashlib
import itertools
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import forget, release_shuffles, settled

#: The largest difference of each metric at which a pair may still be a copy.
DELTAS = {
    "arcs": 10, "decisions": 2, "loops": 2, "exits": 2, "nodes": 4, "avg_nesting": 2, "indep_path": 10, "messpass": 2, "throw": 2, "spawn": 1,
    "funcalls": 5, "unique_funcalls": 2, "avg_complexity_of_decs": 5, "var_binds": 4, "funexpr": 2, "records": 3, "unused_matching": 5,
    "guarded_clauses": 4, "dirty_expressions": 2, "infix_ops": 5, "tles": 5, "avg_length_of_var_names": 3, "eloc": 5, "vol_of_comment": 10,
    "num_of_comment": 5, "macs": 2, "funcls": 1, "funcls_guards": 4, "tokens": 50, "name": 0,
}
MIN_LENGTH, MIN_NUMBER, DIFF_LIMIT, MAX_RANK = 32, 2, 0.1, 5
#: Measures whose cells close_classes joins by; each makes three rows of one.
CELLS = 3
#: Buckets in which similar_by_grams counts hashes of grams, and classes whose keys are broadcast at most.
BUCKETS, BROADCAST = 1 << 18, 1 << 20
#: Classes in a list of postings from which neighbours there may be of a crowd, their meetings by the grams of the smaller,
#: classes in a chunk of a crowd, and chunks of one at most (beyond, chunks grow).
CROWD, OFTEN, CHUNK, CHUNKS = 8, 0.015, 128, 16
#: Grams that a pair must share among the first ones of its sets, where these are enough for that.
LEAST = 3
#: Links of a component for each task that searches it for cliques, and such tasks at most.
SHARE, SHARES = 4096, 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def normalised(text: Column) -> Column:
    """Lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def exact_groups(units: DataFrame, least: int = MIN_NUMBER) -> DataFrame:
    """(digest, members, first) of normalised texts that `least` units(id, text) or more have."""
    rows = units.select("id", F.md5(normalised(F.col("text"))).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("members"), F.min("id").alias("first")).where(F.col("members") >= least)


def _gram_counts(batches):
    """(bucket, rows): how many hashes of lists lie in each of BUCKETS, of a task's batches together."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "rows"])


def _sets(batches, each):
    """Batches of columns from (id, list of hashes): each(row, n, grams) makes columns of the sets of a few lists, grams
    sorted and distinct by row, n their numbers."""
    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        flat, n = batch.column(1).flatten().to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((flat, row))
        flat, row = flat[order], row[order]
        new = np.r_[True, (np.diff(row) > 0) | (flat[1:] != flat[:-1])][: len(flat)]
        flat, row = flat[new], row[new]
        n = np.bincount(row, minlength=batch.num_rows)
        ends = np.cumsum(n)
        keys = [hashlib.blake2b(flat[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends.tolist(), n.tolist())]
        keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        keep = pa.array(n > 0)
        columns = {"id": batch.column(0), "cls": pa.array(keys[:, 0].copy()), "other": pa.array(keys[:, 1].copy()), "n": pa.array(n.astype(np.int32))}
        yield pa.RecordBatch.from_pydict(columns | each(row, n, flat)).filter(keep)


def _lists(n: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values))


def _whole(batches):
    yield from _sets(batches, lambda row, n, grams: {"grams": _lists(n, grams)})


def _needed(n, similarity: float):
    """What two sets of n grams together must share."""
    return np.ceil(n * (similarity / 2) - 1e-9).astype(np.int64)


def _among(nx, ny, similarity: float):
    """How many grams, LEAST at most, two sets must share among as many first ones that the sets have so many."""
    kept = [_needed(nx + ny, similarity) - np.ceil(n * similarity / (2 - similarity) - 1e-9).astype(np.int64) + 1 for n in (nx, ny)]
    return np.clip(np.minimum(*kept), 1, LEAST)


def _rarest(counts: np.ndarray, similarity: float):
    """Of each set the first grams in the order of their bucket's count and value, as many as a match cannot all lack, and
    its odd sketch: as many bits as grams at least, a power of 2, each the parity of the grams whose hash falls on it."""

    def each(row, n, grams):
        order = np.lexsort((grams, counts[grams & (BUCKETS - 1)], row))
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
        # The share of a set that a match must hold is s / (2 - s) of it at least.
        most = np.where(n > 0, n - np.ceil(n * similarity / (2 - similarity) - 1e-9).astype(np.int64) + 1, 0)
        bits = np.int64(1) << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
        start = np.cumsum(bits) - bits
        odd = np.bincount(start[row] + ((grams >> 24) & (bits[row] - 1)), minlength=int(bits.sum())) & 1
        packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
        sketch = [packed[x // 8 : (x + m) // 8] for x, m in zip(start.tolist(), bits.tolist())]
        return {"grams": _lists(most, grams[order][k <= most[row]]), "sketch": pa.array(sketch, pa.binary())}

    return lambda batches: _sets(batches, each)


def _postings(batches):
    """Lists of (cls, n, k), by n and cls, of the grams that several classes have, from rows (gram, cls, n, k) in that order."""
    rest = None
    for table in _then_none(batches):
        if table is None and rest is None:
            return
        rows = rest if table is None else [table.column(i).to_numpy() for i in range(4)]
        if table is not None and rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        gram, cls = rows[:2]
        if not len(gram):
            continue
        end = len(gram) if table is None else int(np.searchsorted(gram, gram[-1]))
        rest = [x[end:].copy() for x in rows]
        own = np.r_[True, (gram[1:end] != gram[: end - 1]) | (cls[1:end] != cls[: end - 1])][:end]  # one row of a class's members
        gram, cls, n, k = (x[:end][own] for x in rows)
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
        size = np.diff(np.r_[first, len(gram)])
        some = np.repeat(size > 1, size)
        columns = {"cls": _lists(size[size > 1], cls[some]), "n": _lists(size[size > 1], n[some]), "k": _lists(size[size > 1], k[some])}
        yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=5000)


def _then_none(batches):
    yield from batches
    yield None


def _meetings(similarity: float, crowds: tuple[np.ndarray, np.ndarray] | None):
    """Pairs x < y of classes that meet in lists of _postings(), (x, y, nx, ny, met, kx, ky): how often, and where last.

    Without crowds, neighbours in the lists of CROWD or more; else all in lists that are not of one crowd. Two sets that must
    share t grams share l of the first n - t + l of each, and of these pairs only such meetings count (_among()).
    """

    def counted(cls, n, k, found):
        both = np.concatenate(found, axis=1)
        x, y = np.where(cls[both[0]] < cls[both[1]], both, both[::-1])
        order = np.lexsort((cls[y], cls[x]))
        x, y = x[order], y[order]
        new = np.flatnonzero(np.r_[True, (cls[x][1:] != cls[x][:-1]) | (cls[y][1:] != cls[y][:-1])][: len(x)])
        met = np.diff(np.r_[new, len(x)])
        last = [np.maximum.reduceat(v, new) if len(new) else v for v in (k[x], k[y])]
        out = [cls[x[new]], cls[y[new]], n[x[new]], n[y[new]], met, *last]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["x", "y", "nx", "ny", "met", "kx", "ky"])

    def near(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column(0)).to_numpy()
            cls, n, k = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in range(3))
            end = np.repeat(np.cumsum(size), size)
            crowd = cls
            if crowds is None:
                end = np.where(np.repeat(size, size) < CROWD, 0, end)
            elif len(crowds[0]):
                at = np.minimum(np.searchsorted(crowds[0], cls), len(crowds[0]) - 1)
                crowd = np.where(crowds[0][at] == cls, crowds[1][at], cls)
            live, found = np.arange(len(cls)), []
            for step in range(1, int(size.max(initial=1))):
                live = live[live + step < end[live]]
                live = live[n[live] * (2 - similarity) / similarity >= n[live + step] - 1e-9]  # lists are in the order of n
                if not len(live) or crowds is None and step > 1:
                    break
                x, y = live, live + step
                if crowds is not None:
                    t, least = _needed(n[x] + n[y], similarity), _among(n[x], n[y], similarity)
                    some = (k[x] <= n[x] - t + least) & (k[y] <= n[y] - t + least) & (crowd[x] != crowd[y])
                    x, y = x[some], y[some]
                found.append(np.stack([x, y]))
                if sum(f.shape[1] for f in found) > 1 << 19:
                    yield counted(cls, n, k, found)
                    found = []
            if found:
                yield counted(cls, n, k, found)

    return near


def _unlike(similarity: float):
    """Leaves out pairs whose odd sketches differ by more bits than matching sets by grams. The longer one is folded."""

    def kept(batches):
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), (pc.add(batch.column("nx"), batch.column("ny"))).to_pylist()):
                bits = 4 * max(len(x), len(y))
                p, q = int.from_bytes(x, "little"), int.from_bytes(y, "little")
                while bits >= 8 * min(len(x), len(y)):
                    if len(x) > len(y):
                        p = p >> bits ^ p & (1 << bits) - 1
                    else:
                        q = q >> bits ^ q & (1 << bits) - 1
                    bits //= 2
                keep.append((p ^ q).bit_count() <= n - 2 * int(_needed(n, similarity)))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return kept


def _roots(pairs) -> dict:
    """The first node of each one's component of pairs, by a union of sets."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _links(batches):
    """A link (a, b) of each node with the first of its component in a task's batches together."""
    batches = list(batches)
    roots = _roots((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    found = [(a, b) for a, b in roots.items() if a != b]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, batches[0].column(0).type) for x in zip(*found)], ["a", "b"])


def _block_pairs(similarity: float):
    """All similar pairs of a block's sets: of one chunk, or of two with each other."""

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        grams, ids, members = frame["grams"].tolist(), frame["id"].to_numpy(), frame["members"].to_numpy()
        n, chunk = np.array([len(g) for g in grams]), frame["chunk"].to_numpy()
        one = np.flatnonzero(chunk == chunk.min())
        two = one if (chunk == chunk.min()).all() else np.flatnonzero(chunk != chunk.min())
        row, flat = np.repeat(np.arange(len(n)), n), np.concatenate(grams)
        _, flat, count = np.unique(flat, return_inverse=True, return_counts=True)
        row, flat = row[count[flat] > 1], (np.cumsum(count > 1) - 1)[flat[count[flat] > 1]]
        order = np.argsort(flat, kind="stable")
        row, flat = row[order], flat[order]
        shared = np.zeros((len(one), len(two)), np.float32)  # whole numbers below 2^24 are exact
        for low in range(0, int(flat.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(flat, [low, low + 4096])
            held = np.zeros((len(n), 4096), np.float32)
            held[row[a:b], flat[a:b] - low] = 1
            shared += held[one] @ held[two].T
        score = 2 * shared.astype(np.float64) / (n[one][:, None] + n[two][None, :])
        x, y = np.nonzero(score >= similarity - 1e-12)
        if two is one:
            x, y = x[x < y], y[x < y]
        score, x, y = score[x, y], one[x], two[y]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        return pd.DataFrame({"a": ids[x], "members_a": members[x], "b": ids[y], "members_b": members[y], "score": score})

    return pairs


def similar_by_grams(units: DataFrame, similarity: float = 1 - DIFF_LIMIT) -> DataFrame:
    """(a, members_a, b, members_b, score): pairs of classes of units(id, text) whose sets of word pairs have a
    Dice-Sorensen similarity at or above `similarity`. Units of equal sets are one class, named by its least id, a < b;
    a class of several units is also paired with itself. Units without words are left out.

    A pair of sets of sizes m <= n needs shared >= s (m + n) / 2, so n is at most m (2 - s) / s, and the pair shares one of
    the first grams of each in any order that is the same for all, those beyond which too few are left. Sets are of 64-bit
    hashes of grams, and the order puts first those in whose bucket of hashes few grams lie, so that no count of single
    grams is dealt out. Only first grams are joined: how many of them two sets share, and where the last ones stand, bounds
    what they can share in all, and so do the sets' sketches. Whole sets are compared where that is enough.

    In a large group of near copies nearly all pairs would meet, in many grams each. So classes that meet again and again
    as neighbours in long lists are a crowd, whose sets are compared with each other in blocks; only pairs not of one crowd
    are found by grams. Which classes are in a crowd changes no result.
    """
    spark, w, kind = units.sparkSession, F.col("w"), units.schema["id"].dataType.simpleString()
    pairs_of = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.xxhash64(x, y))
    hashes = F.when(F.size(w) > 1, pairs_of).otherwise(F.transform(w, lambda x: F.xxhash64(x)))
    of = lambda rows: rows.select("id", words(F.lower("text")).alias("w")).select("id", hashes.alias("grams"))
    schema = f"id {kind}, cls bigint, other bigint, n int, grams array<bigint>"
    found = of(units).select("grams").mapInArrow(_gram_counts, "bucket bigint, rows bigint").groupBy("bucket").agg(F.sum("rows").alias("rows")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["rows"].to_numpy(np.int64)
    every = settled(of(units).mapInArrow(_rarest(counts, similarity), f"{schema}, sketch binary"))
    classes = every.groupBy("cls", "other").agg(F.min("id").alias("id"), F.count("*").alias("members"), F.first("sketch").alias("sketch"))
    classes = settled(classes.select("id", "members", "cls", "sketch"))
    release_shuffles(spark)
    first = every.select("cls", "n", F.posexplode("grams").alias("k", "gram")).select("gram", "cls", "n", (F.col("k") + 1).alias("k"))
    first = first.repartition("gram").sortWithinPartitions("gram", "n", "cls")
    lists = settled(first.mapInArrow(_postings, "cls array<bigint>, n array<int>, k array<int>"))
    forget(every)
    release_shuffles(spark)
    meeting = "x bigint, y bigint, nx bigint, ny bigint, met bigint, kx bigint, ky bigint"
    nx, ny, by = F.col("nx"), F.col("ny"), ("x", "y", "nx", "ny")
    often = lists.mapInArrow(_meetings(similarity, None), meeting).groupBy(*by).agg(F.sum("met").alias("met"))
    often = often.where(F.col("met") >= F.least(nx, ny) * OFTEN).select("x", "y").toPandas()
    crowds = sorted(_roots(zip(often["x"].tolist(), often["y"].tolist())).items())
    node, crowd = (np.array([c[i] for c in crowds], np.int64) for i in (0, 1))
    met = lists.mapInArrow(_meetings(similarity, (node, crowd)), meeting).groupBy(*by).agg(F.sum("met").alias("met"), F.max("kx").alias("kx"), F.max("ky").alias("ky"))
    # Of the two last first grams one comes first in the order: up to it all that is shared is known, beyond it nothing is.
    t = F.ceil((nx + ny) * (similarity / 2) - 1e-9)
    least = F.greatest(F.lit(1), F.least(F.lit(LEAST), *[t - F.ceil(n * similarity / (2 - similarity) - 1e-9) + 1 for n in (nx, ny)]))
    beyond = F.greatest(F.least(t - least, ny - F.col("ky")), F.least(t - least, nx - F.col("kx")))
    pairs = settled(met.where((F.col("met") >= least) & (F.col("met") + beyond >= t)).select("x", "y", "nx", "ny"))
    forget(lists)
    sx, sy = (classes.select(F.col("cls").alias(c), F.col("sketch").alias(f"s{c}")) for c in "xy")
    pairs = settled(pairs.join(sx, "x").join(sy, "y").select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(_unlike(similarity), "x bigint, y bigint"))
    release_shuffles(spark)
    _, at, size = np.unique(crowd, return_inverse=True, return_counts=True)
    chunks = np.minimum(-(-size // CHUNK), CHUNKS)[at]
    places = spark.createDataFrame(pd.DataFrame({"cls": node, "crowd": crowd, "chunks": chunks.astype(np.int32)}), "cls bigint, crowd bigint, chunks int")
    asked = pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).union(places.select("cls")).distinct().join(classes.drop("sketch"), "cls")
    asked = settled(asked.select("cls", "id", "members"))
    if asked.count() <= BROADCAST:
        asked = F.broadcast(asked)
    sets = of(units.join(asked.select("id"), "id", "left_semi")).mapInArrow(_whole, schema)
    sets = settled(sets.join(asked, ["cls", "id"]).select("cls", "id", "members", "grams"))
    release_shuffles(spark)
    one, two = (sets.select(F.col("cls").alias(c), F.struct("id", "members").alias(f"own_{c}"), F.col("grams").alias(f"g{c}")) for c in "xy")
    n = F.size("gx") + F.size("gy")
    both = pairs.join(one, "x").join(two, "y").select("own_x", "own_y", (F.size(F.array_intersect("gx", "gy")) * 2 / n).alias("score"))
    both = both.where(F.col("score") >= similarity - 1e-12).select(F.least("own_x", "own_y").alias("p"), F.greatest("own_x", "own_y").alias("q"), "score").where("p.id < q.id")
    out = both.select(F.col("p.id").alias("a"), F.col("p.members").alias("members_a"), F.col("q.id").alias("b"), F.col("q.members").alias("members_b"), "score")
    placed = sets.join(F.broadcast(places) if len(node) <= BROADCAST else places, "cls").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("crowd", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "id", "members", "grams")
    close = placed.groupBy("crowd", "i", "j").applyInPandas(_block_pairs(similarity), f"a {kind}, members_a bigint, b {kind}, members_b bigint, score double")
    return out.union(close).union(_own_pairs(classes))


def _own_pairs(classes: DataFrame) -> DataFrame:
    """Classes(id, members) of several units as pairs of the class with itself."""
    n = F.col("members")
    return classes.where("members > 1").select(F.col("id").alias("a"), n.alias("members_a"), F.col("id").alias("b"), n.alias("members_b"), F.lit(1.0).alias("score"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similar_by_edits(units: DataFrame, similarity: float = 1 - DIFF_LIMIT) -> DataFrame:
    """(a, members_a, b, members_b, score): pairs of classes of units(id, text) with an edit similarity at or above
    `similarity`, which is over 0.5. Units of equal texts (null counts as empty) are one class, named by its least id,
    a < b; a class of several units is also paired with itself.

    Texts of lengths m <= n may differ by t = (1 - s) n edits. Cut the shorter into t + 1 pieces: one is untouched, and
    stands in the longer near its place, for piece i off by at most i on the left and t - i on the right. So both texts
    meet under (m, n, i, piece), and only those that meet are compared.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("similarity must be over 0.5")
    texts = units.select("id", F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("members"))
    texts = settled(texts.withColumn("n", F.length("text")))
    text, own = F.col("text"), F.col("n")
    edits = lambda n: F.floor(n * (1 - similarity) + 1e-9).cast("int")
    start = lambda m, i, t: F.floor(m * i / (t + 1)).cast("int")
    key = lambda m, n, i, piece: F.xxhash64(m, n, i, piece)
    span = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<int>"))

    def piece(i, n):
        at = start(own, i, edits(n))
        return key(own, n, i, F.substr(text, at + 1, start(own, i + 1, edits(n)) - at))

    def places(i, m):
        t, at = edits(own), start(m, i, edits(own))
        size, shift = start(m, i + 1, t) - at, own - m
        first = F.greatest(F.lit(0), at - i, at + shift - (t - i))
        last = F.least(own - size, at + i, at + shift + (t - i))
        return F.transform(span(first, last), lambda p: key(m, own, i, F.substr(text, p + 1, size)))

    longest = F.floor(own / similarity + 1e-9).cast("int")
    kept = F.flatten(F.transform(span(own, longest), lambda n: F.transform(F.sequence(F.lit(0), edits(n)), lambda i: piece(i, n))))
    asked = F.flatten(F.transform(span(own - edits(own), own), lambda m: F.flatten(F.transform(F.sequence(F.lit(0), edits(own)), lambda i: places(i, m)))))
    short = texts.where("n > 0").select(F.col("id").alias("x"), F.explode(F.array_distinct(kept)).alias("key"))
    long = texts.where("n > 0").select(F.col("id").alias("y"), F.explode(F.array_distinct(asked)).alias("key"))
    met = short.join(long, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    a = texts.select(F.col("id").alias("a"), F.col("members").alias("members_a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("members").alias("members_b"), F.col("text").alias("tb"))
    pairs = met.join(a, "a").join(b, "b").select("a", "members_a", "b", "members_b", edit_similarity(F.col("ta"), F.col("tb")).alias("score"))
    return pairs.where(F.col("score") >= similarity - 1e-12).union(_own_pairs(texts))


def close_classes(units: DataFrame, block: list[str], deltas: dict[str, int]) -> DataFrame:
    """Pairs of classes of units(id, block columns, whole-number measures) of one block whose measures differ by at most
    their delta each: (block, a, members_a, b, members_b, and each measure m as m1 and m2). Units with equal block and
    measures are one class, named by its least id; a class meets itself if it has several units, others once, a < b.

    The first CELLS measures are cut into cells one wider than the delta, so near classes lie in neighbouring cells; only
    those meet, and the other measures are compared there. Put the measures of most values first.
    Units with a null in a block column or measure are left out.
    """
    names = list(deltas)
    classes = settled(units.dropna(subset=[*block, *names]).groupBy(*block, *names).agg(F.min("id").alias("id"), F.count("*").alias("members")))
    cell = lambda m: F.floor(F.col(m) / (deltas[m] + 1))
    a = classes.select(*block, F.col("id").alias("a"), F.col("members").alias("members_a"), *[F.col(m).alias(f"{m}1") for m in names], *[cell(m).alias(f"{m}_cell") for m in names[:CELLS]])
    b = classes.select(*block, F.col("id").alias("b"), F.col("members").alias("members_b"), *[F.col(m).alias(f"{m}2") for m in names], *[cell(m).alias(f"{m}_cell") for m in names[:CELLS]])
    for m in names[:CELLS]:
        b = b.withColumn(f"{m}_cell", F.explode(F.array(*[F.col(f"{m}_cell") + k for k in (-1, 0, 1)])))
    near = (F.col("a") < F.col("b")) | (F.col("a") == F.col("b")) & (F.col("members_a") > 1)
    for m in names:
        near = near & (F.abs(F.col(f"{m}1") - F.col(f"{m}2")) <= deltas[m])
    return a.join(b, [*block, *[f"{m}_cell" for m in names[:CELLS]]]).where(near).drop(*[f"{m}_cell" for m in names[:CELLS]])


def ranked(pairs: DataFrame, categories: list[tuple[str, str, int]]) -> DataFrame:
    """pairs with rank. categories names two columns and a delta each: a pair is promising in one if they are equal,
    possible within the delta, else impossible. Rank 1: promising in all; 2: in all but one, the rest possible; 3: in half;
    4: in one; 5: possible in all; null: impossible in one."""
    equal = sum((F.col(a).eqNullSafe(F.col(b)).cast("int") for a, b, _ in categories), F.lit(0))
    possible = F.lit(True)
    for a, b, delta in categories:
        possible = possible & F.coalesce(F.abs(F.col(a) - F.col(b)) <= delta, F.lit(False))
    n = len(categories)
    rank = F.when(~possible, None).when(equal == n, 1).when(equal >= n - 1, 2).when(equal * 2 >= n, 3).when(equal >= 1, 4).otherwise(5)
    return pairs.withColumn("rank", rank)


def _windows(units: DataFrame, length: int) -> DataFrame:
    """(id, at, p, q): a 128-bit hash of each run of `length` words of units(id, text) by its place, from 1. Hashes of runs
    are made from those of two runs of half the length, a word more where that is odd, under one sort by place."""
    order = Window.partitionBy("id").orderBy("at")
    rows = units.select("id", words(F.col("text")).alias("w")).where(F.size("w") >= length).select("id", F.posexplode("w").alias("at", "word"))
    rows = rows.select("id", F.col("at") + 1, F.xxhash64("word"), F.xxhash64(F.lit(1), "word")).toDF("id", "at", "one_p", "one_q")
    rows, have = rows.withColumns({"p": F.col("one_p"), "q": F.col("one_q")}), 1

    def joined(p: str, q: str) -> DataFrame:
        ahead = rows.withColumns({"np": F.lead(p, have).over(order), "nq": F.lead(q, have).over(order)})
        whole = F.col("np").isNotNull() & F.col("p").isNotNull()
        return ahead.withColumns({"p": F.when(whole, F.xxhash64("p", "np")), "q": F.when(whole, F.xxhash64("nq", "q", F.lit(1)))})

    for bit in f"{length:b}"[1:]:
        rows, have = joined("p", "q"), 2 * have
        if bit == "1":
            rows, have = joined("one_p", "one_q"), have + 1
    return rows.where("p is not null").select("id", "at", "p", "q")


def token_runs(units: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """(first, first_start, id, start, tokens): runs of at least `length` words that stand in units(id, text) earlier.

    Each window of `length` words is linked with its first occurrence, by unit and place; links that go on side by side
    are one run. Two units that share a run are so linked with a third or each other, without a row for every pair.
    """
    rows = settled(_windows(units, length))
    first = rows.groupBy("p", "q").agg(F.min(F.struct("id", "at")).alias("f"), F.count("*").alias("k")).where("k > 1").select("p", "q", "f")
    meet = rows.join(first, ["p", "q"]).where((F.col("id") != F.col("f.id")) | (F.col("at") != F.col("f.at")))
    meet = meet.select(F.col("f.id").alias("first"), "id", "at", (F.col("at") - F.col("f.at")).alias("d"))
    island = meet.withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy("first", "id", "d").orderBy("at")))
    out = island.groupBy("first", "id", "d", "g").agg(F.min("at").alias("start"), (F.count("*") + length - 1).alias("tokens"))
    return out.select("first", (F.col("start") - F.col("d")).alias("first_start"), "id", "start", "tokens")


def first_links(units: DataFrame) -> DataFrame:
    """(parent_a, i, parent_b, j, score): each of units(parent, at, text) with the first unit of equal normalised text, by
    parent and place, unless it is that one. Units without words are left out."""
    rows = units.select("parent", "at", F.sha2(normalised(F.col("text")), 256).alias("digest"), (normalised(F.col("text")) == "").alias("bare")).where("not bare")
    first = rows.groupBy("digest").agg(F.min(F.struct("parent", "at")).alias("f"), F.count("*").alias("k")).where("k > 1").select("digest", "f")
    meet = rows.join(first, "digest").where((F.col("parent") != F.col("f.parent")) | (F.col("at") != F.col("f.at")))
    return meet.select(F.col("f.parent").alias("parent_a"), F.col("f.at").alias("i"), F.col("parent").alias("parent_b"), F.col("at").alias("j"), F.lit(1.0).alias("score"))


def diagonal_runs(scores: DataFrame, limit: float = 1 - DIFF_LIMIT, gap: int = 0) -> DataFrame:
    """(parent_a, start_a, parent_b, start_b, units): runs of similar pairs on one diagonal of two parents' units, with
    at most `gap` dissimilar pairs in a row inside. scores has (parent_a, i, parent_b, j, score)."""
    good = scores.where(F.col("score") >= limit).withColumn("d", F.col("i") - F.col("j"))
    order = Window.partitionBy("parent_a", "parent_b", "d").orderBy("i")
    new = F.coalesce(F.col("i") - F.lag("i").over(order) > gap + 1, F.lit(True)).cast("int")
    good = good.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    out = good.groupBy("parent_a", "parent_b", "d", "run").agg(F.min("i").alias("start_a"), (F.max("i") - F.min("i") + 1).alias("units"))
    return out.select("parent_a", "start_a", "parent_b", (F.col("start_a") - F.col("d")).alias("start_b"), "units")


def _packed(batches):
    """(component, node, its neighbours packed, their number): sorted, as differences where they are whole numbers."""
    for batch in batches:
        near = [pickle.dumps(sorted(x)) if isinstance(x[0], str) else np.diff(np.sort(np.array(x, np.int64)), prepend=0).tobytes() for x in batch.column(2).to_pylist()]
        packed = pa.array([zlib.compress(x, 1) for x in near], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pc.list_value_length(batch.column(2))], ["component", "node", "near", "links"])


def _matrix(nodes: list, near: list[bytes]) -> tuple[list, list[int]]:
    """All nodes in order and of each a whole number whose bits are its neighbours, from packed ones on one side of a link."""
    near = [zlib.decompress(x) for x in near]
    near = [pickle.loads(x) for x in near] if isinstance(nodes[0], str) else [np.cumsum(np.frombuffer(x, np.int64)) for x in near]  # noqa: S301
    every, at = np.unique(np.concatenate([np.array(nodes), *near]), return_inverse=True)
    bits = np.zeros((len(every), -(-len(every) // 8)), np.uint8)
    ends = len(nodes) + np.cumsum([0, *map(len, near)])
    for x, low, high in zip(at[: len(nodes)].tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        y = at[low:high]
        bits[y, x >> 3] |= np.uint8(1 << (x & 7))
        np.bitwise_or.at(bits[x], y >> 3, np.left_shift(1, y & 7).astype(np.uint8))
    return every.tolist(), [int.from_bytes(x.tobytes(), "little") for x in bits]


def _places(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _branches(near: list[int], free: int, done: int, chosen: tuple):
    """The states that follow one of a search for maximal cliques: by each free node that is no neighbour of a pivot."""
    n, pivot, most = free.bit_count(), -1, -1
    for v in itertools.chain(_places(done), _places(free)):
        if (k := (near[v] & free).bit_count()) > most:
            pivot, most = v, k
            if k >= n - (free >> v & 1):
                break
    for v in _places(free & ~near[pivot]):
        yield free & near[v], done & near[v], (*chosen, v)
        free ^= 1 << v
        done |= 1 << v


def _cliques(near: list[int], share: int = 0, shares: int = 1) -> list[tuple]:
    """The maximal cliques of two nodes or more, or one of `shares` shares of them: every share goes through the same first
    states, breadth first, and then each takes its own of those that are open."""
    first, out, steps = collections.deque([((1 << len(near)) - 1, 0, ())]), [], 0
    while first and shares > 1 and len(first) < 16 * shares and steps < 64 * shares:
        free, done, chosen = first.popleft()
        steps += 1
        if free:
            first.extend(_branches(near, free, done, chosen))
        elif not done and steps % shares == share:
            out.append(chosen)
    stack = [x for i, x in enumerate(first) if i % shares == share]
    while stack:
        free, done, chosen = stack.pop()
        if free:
            stack.extend(_branches(near, free, done, chosen))
        elif not done:
            out.append(chosen)
    return [c for c in out if len(c) > 1]


def clique_groups(pairs: DataFrame) -> DataFrame:
    """(group_id, member): the maximal cliques of pairs(a, b), in any order and number; groups may overlap.

    A component's links, packed, go to a task, or to several that divide the search among them, so no triangles are listed.
    Forests of the links are joined on the driver: a row for each node and task that reads links.
    """
    spark, kind = pairs.sparkSession, pairs.schema["a"].dataType.simpleString()
    edges = settled(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release_shuffles(spark)
    forest = edges.mapInArrow(_links, edges.schema).coalesce(8).mapInArrow(_links, edges.schema).toPandas()
    roots = _roots(zip(forest["a"].tolist(), forest["b"].tolist()))
    number = {root: i for i, root in enumerate(sorted(set(roots.values())))}
    parts = spark.createDataFrame(pd.DataFrame({"a": list(roots), "component": [number[x] for x in roots.values()]}), f"a {kind}, component bigint")
    parts = F.broadcast(parts) if len(roots) <= BROADCAST else parts
    near = edges.join(parts, "a").groupBy("component", "a").agg(F.collect_list("b").alias("near"))
    near = settled(near.mapInArrow(_packed, f"component bigint, node {kind}, near binary, links int"))
    release_shuffles(spark)
    links = near.agg(F.coalesce(F.sum("links"), F.lit(0))).head()[0]
    shares = near.groupBy("component").agg(F.least(F.ceil(F.sum("links") / SHARE), F.lit(SHARES)).cast("int").alias("shares"))
    tasks = near.join(shares, "component").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def groups(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, bits = _matrix(frame["node"].tolist(), frame["near"].tolist())
        found = [[nodes[v] for v in sorted(c)] for c in _cliques(bits, int(frame["share"].iloc[0]), int(frame["shares"].iloc[0]))]
        return pd.DataFrame({"group_id": ["-".join(map(str, g)) for g in found], "members": found}, dtype=object)

    # A number of its own, since packed links are few bytes and the names of large cliques many.
    tasks = tasks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-links // SHARE)), "component", "share")
    found = tasks.groupBy("component", "share").applyInPandas(groups, f"group_id string, members array<{kind}>")
    return found.select("group_id", F.explode("members").alias("member"))


def merged_short(units: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(parent, tokens): the parents of units(parent, tokens) below `least` tokens each that reach it together, a
    separator between two counted as one."""
    short = units.where(F.col("tokens") < least).groupBy("parent").agg((F.sum("tokens") + F.count("*") - 1).alias("tokens"))
    return short.where(F.col("tokens") >= least)


def without_contained(runs: DataFrame, group: list[str], start: str, length: str) -> DataFrame:
    """runs less those that lie inside a longer run, or one of equal length that starts where they do and was kept, of the
    same group columns."""
    end = F.col(start) + F.col(length)
    order = Window.partitionBy(*group).orderBy(F.col(start), end.desc())
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < end)).drop("_before")


def consistent(pairs: DataFrame, names_a: str, names_b: str) -> DataFrame:
    """The pairs whose lists of names, place by place, map one to one: the same binding in both. Lists of different
    lengths do not."""
    both = F.arrays_zip(F.col(names_a).alias("x"), F.col(names_b).alias("y"))
    sizes = F.size(F.array_distinct(F.col(names_a))), F.size(F.array_distinct(F.col(names_b))), F.size(F.array_distinct(both))
    return pairs.where((F.size(names_a) == F.size(names_b)) & (sizes[0] == sizes[2]) & (sizes[1] == sizes[2]))


def clone_matrix(units: DataFrame, limit: float = 1 - DIFF_LIMIT, gap: int = 0, measure: str = "dice") -> DataFrame:
    """Runs of similar units at neighbouring places of two parents, from units(id, parent, at, text): diagonal_runs() of
    the pairs that `measure` (dice, edits) finds at `limit` or above, all members of two classes linked through the first."""
    find = {"dice": similar_by_grams, "edits": similar_by_edits}[measure]
    pairs = find(units.select("id", "text"), limit)
    at = lambda s, i: units.select(F.col("id").alias(s), F.col("parent").alias(f"parent_{s}"), F.col("at").alias(i))
    rows = pairs.where("a <> b").join(at("a", "i"), "a").join(at("b", "j"), "b").select("parent_a", "i", "parent_b", "j", "score")
    return diagonal_runs(rows.union(first_links(units.select("parent", "at", "text"))).distinct(), limit, gap)
