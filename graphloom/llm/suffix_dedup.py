"""Removal of byte strings that repeat across documents, by suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._shared import Scratch, text_batches
from graphloom.llm.suffix_sort import repeated_windows

#: Bytes of the strings whose hash picks a window's anchor.
GRAM = 20
#: Pieces of one anchor that a task sorts together. More are divided among anchors of longer strings.
CHUNK = 4096
#: Bytes sorted in one suffix array, and bytes of text that are hashed at once.
BLOCK, SLICE = 300_000, 1 << 19

#: A range or piece packs its place and its number of windows, below 2^SHIFT, in one long.
SHIFT = 12
_SIZES = (1 << SHIFT) - 1

_LOW = np.uint64((1 << 20) - 1)
_MOD = 1 << 64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict[int, tuple] = {}


def _table(k: int):
    if k not in _tables:
        values = [int.from_bytes(hashlib.blake2b(bytes([k, b]), digest_size=8).digest(), "big") | 1 for b in range(256)]
        n = SLICE + 4096

        def powers(base):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        _tables[k] = (np.array(values, np.uint64), powers(_BASES[k]), powers(pow(_BASES[k], -1, _MOD)))
    return _tables[k]


def _prefixes(data: np.ndarray, k: int) -> np.ndarray:
    values, up, _ = _table(k)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchored_pieces(data: np.ndarray, valid: np.ndarray, window: int, gram: int):
    """Divides the windows of data among anchors: (gram hash, digest, first window, windows) of each piece.

    A window's anchor is its gram of least hash, the leftmost if equal, so equal windows have equal anchors. Windows in
    a row with one anchor are a piece: the bytes from its first window's start to its last one's end. valid marks the
    starts of windows that count. Pieces of equal digest (and gram hash) are equal, windows and all.
    """
    n, w = len(data), window - gram + 1
    if n < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    grams = n - gram + 1
    sums = _prefixes(data, 0)
    hashes = _mix((sums[gram:] - sums[:grams]) * _table(0)[2][:grams])
    keys = (hashes & ~_LOW) | np.arange(grams, dtype=np.uint64)
    rows = np.full(-(-grams // w) * w, np.uint64(_MOD - 1))
    rows[:grams] = keys
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = grams - w + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    change = np.flatnonzero((least[1:] != least[:-1]) | (valid[1:count] != valid[: count - 1])) + 1
    start = np.r_[0, change]
    size = np.diff(np.r_[start, count])
    use = valid[start]
    start, size = start[use], size[use]
    anchor = (least[start] & _LOW).astype(np.int64)
    sums = _prefixes(data, 1)
    end = start + size - 1 + window
    digest = _mix((sums[end] - sums[start]) * _table(1)[2][start] + (size * 256 + anchor - start).astype(np.uint64))
    return hashes[anchor], digest, start, size


def _occurrences(window: int, gram: int):
    """(h, g, doc, at, first): a row per piece; at holds start and windows; first is false if its document has it earlier."""

    def of_block(texts, docs, offsets):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        valid = np.zeros(len(data), bool)
        for b, s in zip(begin.tolist(), sizes.tolist()):
            if s >= window:
                valid[b : b + s - window + 1] = True
        h, g, start, size = anchored_pieces(data, valid, window, gram)
        which = np.searchsorted(begin, start, "right") - 1
        return h, g, which, docs[which], start - begin[which] + offsets[which], size

    def emit(h, g, row, doc, at, size):
        order = np.lexsort((at, g, h, row))
        a, b = order[1:], order[:-1]
        first = np.ones(len(order), bool)
        first[a] = (h[a] != h[b]) | (g[a] != g[b]) | (row[a] != row[b])
        columns = [h.view(np.int64), g.view(np.int64), doc, at << SHIFT | size, first]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "doc", "at", "first"])

    def run(batches):
        texts, docs, held = [], [], 0

        def flush():
            return emit(*of_block(texts, np.array(docs, np.int64), np.zeros(len(docs), np.int64)))

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                size = len(raw := text.as_buffer()) if text.is_valid else 0
                if size < window:
                    continue
                if size > SLICE // 2:  # a long text, in slices that share window - 1 bytes
                    parts = []
                    for s in range(0, size - window + 1, SLICE // 2):
                        part = bytes(raw[s : s + SLICE // 2 + window - 1])
                        parts.append(of_block([part], np.array([doc.as_py()]), np.array([s])))
                    yield emit(*(np.concatenate(c) for c in zip(*parts)))
                    continue
                if held + size > SLICE:
                    yield flush()
                    texts, docs, held = [], [], 0
                texts.append(bytes(raw))
                docs.append(doc.as_py())
                held += size
        if texts:
            yield flush()

    return run


def _slices(window: int):
    """Cuts the listed pieces out of each text, which starts at `base` in its document."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            held = 0
            columns = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)
            for doc, base, text, pieces in zip(*columns):
                raw, doc, base = bytes(text.as_buffer()), doc.as_py(), base.as_py()
                for p in pieces.as_py():
                    start, size = (p["at"] >> SHIFT) - base, p["at"] & _SIZES
                    row = (p["h"], p["n"], doc, p["at"], raw[start : start + size - 1 + window])
                    for column, x in zip(out, row):
                        column.append(x)
                    held += len(row[-1])
                if held > 1 << 22:
                    yield _piece_batch(out)
                    out, held = [[] for _ in range(5)], 0
            yield _piece_batch(out)

    return run


def _piece_batch(columns):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "n", "doc", "at", "piece"])


def _parts(sizes: np.ndarray):
    """(first, end) of pieces in a row whose bytes the tables of powers cover."""
    begin = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.diff(begin // (SLICE // 2))) + 1
    return zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(sizes)].tolist())


def _divided(window: int, gram: int):
    """(h, g, doc, up, at): divides pieces (doc, at, piece) among anchors of `gram` bytes; up is the divided piece's at."""

    def run(batches):
        for batch in batches:
            docs, ups, pieces = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            sizes = np.array([len(p) for p in pieces], np.int64)
            for a, b in _parts(sizes) if pieces else ():
                begin = np.cumsum(sizes[a:b]) - sizes[a:b]
                valid = np.zeros(int(sizes[a:b].sum()), bool)
                for x, n in zip(begin.tolist(), (ups[a:b] & _SIZES).tolist()):
                    valid[x : x + n] = True
                h, g, start, size = anchored_pieces(np.frombuffer(b"".join(pieces[a:b]), np.uint8), valid, window, gram)
                which = np.searchsorted(begin, start, "right") - 1
                up = ups[a:b][which]
                at = ((up >> SHIFT) + start - begin[which]) << SHIFT | size
                columns = [h.view(np.int64), g.view(np.int64), docs[a:b][which], up, at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "doc", "up", "at"])

    return run


def alike_runs(pieces: list[bytes], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, windows) of the runs of windows whose hash another window of the pieces has. Equal windows
    have equal hashes, so no others can be equal."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    hashes = []
    for a, b in _parts(sizes):
        data = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
        own = starts[a:b]
        begin = np.cumsum(sizes[a:b]) - sizes[a:b]
        at = np.arange(own.sum()) + np.repeat(begin - np.cumsum(own) + own, own)
        sums = _prefixes(data, 1)
        hashes.append(_mix((sums[at + window] - sums[at]) * _table(1)[2][at]))
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes)
    equal = np.diff(hashes[order].view(np.int64)) == 0
    mark = np.zeros(len(hashes), bool)
    mark[order[1:][equal]] = True
    mark[order[:-1][equal]] = True
    ends = np.cumsum(starts)
    opens, closes = np.r_[True, ~mark[:-1]], np.r_[~mark[1:], True]
    opens[ends - starts] = True
    closes[ends - 1] = True
    first, last = np.flatnonzero(mark & opens), np.flatnonzero(mark & closes)
    piece = np.searchsorted(ends, first, "right")
    return piece, first - (ends - starts)[piece], last - first + 1


def _sorted_ranges(window: int):
    """Suffix-sorts pieces, all of an anchor in one array, and yields the windows that stand earlier too. Windows whose hash
    no other has are left out of the array."""

    def ranges(docs, ats, pieces):
        which, first, starts = alike_runs(pieces, np.array([a & _SIZES for a in ats], np.int64), window)
        runs = list(zip(which.tolist(), first.tolist(), starts.tolist()))
        docs, places = [docs[k] for k, _, _ in runs], [(ats[k] >> SHIFT) + s for k, s, _ in runs]
        pieces = [pieces[k][s : s + n - 1 + window] for k, s, n in runs]
        flags = repeated_windows(pieces, starts, list(zip(docs, places)), window)
        out_doc, out_at = [], []
        for doc, place, flag in zip(docs, places, flags):
            if flag.any():
                edges = np.flatnonzero(np.diff(np.r_[0, flag.view(np.int8), 0]))
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    out_doc.append(doc)
                    out_at.append((place + s) << SHIFT | (e - s))
        return pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_at, pa.int64())], ["doc", "at"])

    def run(batches):
        import gc

        gc.disable()  # lists of numbers only: nothing to find, much to walk
        try:
            docs, ats, pieces, held, key = [], [], [], 0, None
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(4)]
                for h, doc, at, piece in zip(*columns):
                    if held > BLOCK and h != key:
                        yield ranges(docs, ats, pieces)
                        docs, ats, pieces, held = [], [], [], 0
                    key = h
                    docs.append(doc)
                    ats.append(at)
                    pieces.append(piece)
                    held += len(piece)
            if pieces:
                yield ranges(docs, ats, pieces)
        finally:
            docs = ats = pieces = columns = None  # noqa: F841
            gc.enable()  # the worker goes on to other tasks
            gc.collect()
            pa.default_memory_pool().release_unused()

    return run


def _cut(window: int, as_text: bool):
    """Applies the ranges (second column) to the text (first); other columns stay, with n_bytes, n_removed, n_spans, kept."""

    def run(batches):
        for batch in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            out = [[] for _ in range(4)]
            for text, ranges in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                raw = bytes(text.as_buffer()) if text.is_valid else b""
                kept, removed, spans = raw, 0, 0
                if ranges.is_valid and len(raw):
                    at = np.sort(ranges.values.to_numpy())
                    begin, end = at >> SHIFT, (at >> SHIFT) + (at & _SIZES) - 1 + window
                    reach = np.maximum.accumulate(end)
                    new = np.r_[True, begin[1:] > reach[:-1]]
                    starts, ends = begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
                    removed, spans = int((ends - starts).sum()), len(starts)
                    keep = zip(np.r_[0, ends].tolist(), np.r_[starts, len(raw)].tolist())
                    kept = b"".join([raw[s:e] for s, e in keep])
                out[0].append(len(raw))
                out[1].append(removed)
                out[2].append(spans)
                out[3].append(kept.decode("utf-8", "ignore") if as_text else kept)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            columns = [*batch.columns[2:], *(pa.array(c, k) for c, k in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[2:], "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated_ranges(scratch: Scratch, docs: DataFrame, window: int = 100, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(doc, at) ranges that cover each window which also starts earlier; docs has (doc, text).

    1. Every window goes to an anchor in it that its bytes alone decide, so equal windows share anchors, and windows in
       a row with one anchor form a piece. Copies of a piece count once: all but the first are ranges as they are.
    2. The different pieces of an anchor can still share windows. They are suffix-sorted together; equal windows are
       neighbours, and all but the earliest are ranges.
    3. The pieces of an anchor with more than `chunk` (a line that very many texts hold) are divided again, among anchors
       of longer strings, until none has so many or the strings are whole windows, which leave copies only. So work grows
       with the pieces and not with the square of an anchor's.
    Nothing else is compared, and no anchor that stands once leaves step 1.
    """
    if not gram <= window < gram + _SIZES:
        raise ValueError(f"window must be from {gram} to {gram + _SIZES - 1} bytes")
    pieces = docs.mapInArrow(_occurrences(window, gram), "h bigint, g bigint, doc bigint, at bigint, first boolean")
    pieces = scratch.keep(pieces, "pieces")
    inner = scratch.keep(pieces.where("not first").select("doc", "at"), "inner")
    once = pieces.where("first").drop("first")
    anchors = once.groupBy("h").agg(F.min("doc").alias("doc0"), F.max("doc").alias("doc1"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    anchors = anchors.where("doc0 < doc1 or g0 <> g1").select("h", "doc0", (F.col("g0") != F.col("g1")).alias("mixed"))
    shared = once.join(anchors, "h").where("mixed or doc > doc0").select("h", "g", "doc", "at", "mixed")
    shared = scratch.keep(shared, "shared")
    scratch.drop(pieces)
    scratch.release_shuffles()
    mixed = shared.where("mixed").drop("mixed")
    classes = mixed.groupBy("h", "g").agg(F.min("doc").alias("doc0"))
    judged = mixed.join(classes, ["h", "g"])
    judged = scratch.keep(judged.select("h", "g", "doc", "at", (F.col("doc") > F.col("doc0")).alias("copy")), "judged")
    copies = inner.union(shared.where("not mixed").select("doc", "at")).union(judged.where("copy").select("doc", "at"))
    copies = scratch.keep(copies, "copies")
    scratch.drop(shared)
    scratch.release_shuffles()
    leads = judged.where("not copy")
    counts = leads.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # A document's pieces cover each of its bytes a few times at most, so their list is no longer than its text.
    listed = leads.join(counts, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "n", "at")).alias("pieces"))
    cut = docs.join(listed, "doc").select("doc", F.lit(0).cast("bigint").alias("base"), "text", "pieces")
    cut = scratch.keep(cut.mapInArrow(_slices(window), _PIECES), "cut")
    scratch.drop(judged)
    scratch.release_shuffles()
    out = copies.union(_found(scratch, cut, window, chunk))
    for longer in _longer(window, gram):
        many = cut.where(F.col("n") > chunk).select("doc", "at", "piece")
        if many.isEmpty():
            break
        copies, cut = _divide(scratch, many, window, longer)
        out = out.union(copies).union(_found(scratch, cut, window, chunk))
    return out


_PIECES = "h bigint, n bigint, doc bigint, at bigint, piece binary"


def _longer(window: int, gram: int) -> list[int]:
    """Bytes of the strings that pick anchors after the first, the window last."""
    spare = window - gram
    return sorted({window - spare // 2, window - spare // 8, window})


def _found(scratch: Scratch, cut: DataFrame, window: int, chunk: int) -> DataFrame:
    """The ranges within anchors of at most `chunk` pieces."""
    some = cut.where(F.col("n") <= chunk).select("h", "doc", "at", "piece").repartition("h").sortWithinPartitions("h")
    found = scratch.keep(some.mapInArrow(_sorted_ranges(window), "doc bigint, at bigint"), "ranges")
    scratch.release_shuffles()
    return found


def _divide(scratch: Scratch, many: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Divides pieces many(doc, at, piece) among anchors of `gram` bytes: the ranges of copies, and the different pieces of
    each anchor that has several."""
    parts = scratch.keep(many.mapInArrow(_divided(window, gram), "h bigint, g bigint, doc bigint, up bigint, at bigint"), "parts")
    several = parts.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select("h")
    parts_ = scratch.keep(parts.join(several, "h"), "several")
    first = parts_.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"))
    judged = parts_.join(first, ["h", "g"]).withColumn("copy", F.struct("doc", "at") > F.col("first")).drop("first")
    judged = scratch.keep(judged, "divided")
    scratch.drop(parts)
    scratch.drop(parts_)
    leads = judged.where("not copy")
    counts = leads.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    listed = leads.join(counts, "h").groupBy("doc", "up").agg(F.collect_list(F.struct("h", "n", "at")).alias("pieces"))
    whole = many.withColumnRenamed("at", "up").join(listed, ["doc", "up"])
    cut = whole.select("doc", F.shiftright("up", SHIFT).alias("base"), "piece", "pieces").mapInArrow(_slices(window), _PIECES)
    cut = scratch.keep(cut, "cut")
    scratch.release_shuffles()
    return judged.where("copy").select("doc", "at"), cut


def _placed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows(doc, text, row) with the place of (id, text) among all in place of the id, which repeats or is null."""
    rows = rows.withColumn("own", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = rows.select("doc", "own").distinct().orderBy(F.col("doc").asc_nulls_last(), "own")
    order = scratch.keep(order.withColumn("place", F.monotonically_increasing_id()), "places")
    r, o = rows.alias("r"), order.alias("o")
    both = r.join(o, F.col("r.doc").eqNullSafe(F.col("o.doc")) & (F.col("r.own") == F.col("o.own")))
    return scratch.keep(both.select(F.col("place").alias("doc"), "text", "row"), "rows")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 100, as_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) of each row of docs; row is a struct of the columns `carry`, the key if not
    given, so their names clash with nothing.

    Removes each byte covered by a string of `window` bytes that also starts earlier: in a document of smaller id, or
    earlier in the same one. Overlaps count; strings are judged on the input. Null texts are empty; very long ones are
    hashed in slices. A null id is the largest. Different texts of one id are documents of their own, in the order of a
    digest; rows of one id and one text are one document and are cut alike. kept is binary, or a string without
    characters that a cut has split if as_text.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "suffix")
    row = F.struct(*(F.col(c) for c in carry or [key])).alias("row")
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"), row)
    if not rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").isEmpty():
        rows = _placed(scratch, rows)
    ranges = repeated_ranges(scratch, rows.select("doc", "text"), window)
    ranges = ranges.groupBy("doc").agg(F.collect_list("at").alias("ranges"))
    rows = rows.join(ranges, "doc", "left").select("text", "ranges", "row")
    schema = T.StructType([rows.schema["row"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])
    return rows.mapInArrow(_cut(window, as_text), schema.add("kept", T.StringType() if as_text else T.BinaryType()))
