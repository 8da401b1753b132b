"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import text_batches

#: Labelled rows that a model is fitted on, at most: those of least hash of their id.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 250, 120, 0.15, 4.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_neighbours", "upper", "digit",
    "space", "mark", "symbol", "pipe", "bang", "high", "line_length", "distinct_lines", "sentence_ends", "capital_words", "symbol_words",
)

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58], _HIGH[128:] = True, True, True, True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:?'\"()-")] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _MARK)
_SYMBOL_BYTES = bytes(np.flatnonzero(_SYMBOL & (np.arange(256) > 32)).tolist())
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH, _LOWER]).astype(np.float64).T


def features(text: bytes) -> list[float]:
    """FEATURES of a whole text; shares are of its bytes, words or lines, 0 for an empty text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, space, mark, symbol, high, lower = (counts @ _CLASSES / max(n, 1)).tolist()
    found = text.split()
    m = len(found)
    seen: dict[bytes, int] = {}
    for w in found:
        seen[w] = seen.get(w, 0) + 1
    lengths = list(map(len, found))
    again = sum(map(bytes.__eq__, found, found[1:]))
    lines = text.split(b"\n")
    k = max(m, 1)
    # Words that end with a symbol, or are one, as marked by the byte class.
    ends = sum(w[-1] in _SYMBOL_BYTES for w in found)
    capital = sum(map(bytes.istitle, found))
    return [
        float(np.log1p(n)), float(np.log1p(m)), sum(lengths) / k, sum(x > 12 for x in lengths) / k, len(seen) / k ** 0.8 if m else 0.0,
        max(seen.values(), default=0) / k, again / k, upper / max(upper + lower, 1e-9), digit, space, mark, symbol,
        counts[124] / k, counts[33] / k, high, float(np.log1p(n / len(lines))), len(set(lines)) / len(lines),
        (counts[46] + counts[63]) / k, capital / k, ends / k,
    ]


class AdditiveModel:
    """Per-feature lookup tables and tables of feature pairs; a score is a sum of entries, so bins add up vectorised.

    Fitted by cyclic boosting: each round visits every feature in turn and fits a shallow tree (at most three splits) on
    its bins to the logistic loss's gradients, adding it, shrunk, to the feature's table. Pairs with the most gain left
    are then boosted the same way on coarse two-dimensional bins, one split on each side.
    """

    def __init__(self, bias: float = 0.0):
        self.bias = bias
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if not self.edges:
            return out
        b = self.bins(x)
        for f, table in enumerate(self.tables):
            out += table[b[:, f]]
        for f, g, table in self.pairs:
            out += table[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _steps(grad: np.ndarray, hess: np.ndarray, splits: int) -> np.ndarray:
    """A tree of `splits` splits on ordered bins, grown by best gain; its leaf value for each bin."""
    leaves = [(0, len(grad))]
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]

    def best(s, e):
        k = np.arange(s + 1, e)
        gl, hl, gt, ht = g[k] - g[s], h[k] - h[s], g[e] - g[s], h[e] - h[s]
        gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
        at = int(np.argmax(gain))
        return float(gain[at]), int(k[at])

    for _ in range(splits):
        options = [(*best(s, e), i) for i, (s, e) in enumerate(leaves) if e - s > 1]
        if not options or max(options)[0] <= 1e-9:
            break
        _, k, i = max(options)
        s, e = leaves[i]
        leaves[i : i + 1] = [(s, k), (k, e)]
    out = np.zeros(len(grad))
    for s, e in leaves:
        out[s:e] = (g[e] - g[s]) / (h[e] - h[s] + SMOOTH)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """A model of P(y = 1). Without rows, or with one label only, its score is the smoothed share of 1."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) < 4 or y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.minimum(np.arange(len(cuts) + 1) * PAIR_BINS // (len(cuts) + 1), PAIR_BINS - 1))
    b = model.bins(x)
    raw = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            grad, hess = slopes()
            step = RATE * _steps(np.bincount(b[:, f], grad, len(table)), np.bincount(b[:, f], hess, len(table)), 3)
            table += step
            raw += step[b[:, f]]
    grad, hess = slopes()
    coarse = np.stack([model.coarse[f][b[:, f]] for f in range(x.shape[1])], 1)
    gains = []
    for f in range(x.shape[1]):
        for g in range(f):
            cell = coarse[:, f] * PAIR_BINS + coarse[:, g]
            gr, he = np.bincount(cell, grad, PAIR_BINS**2), np.bincount(cell, hess, PAIR_BINS**2)
            gains.append((float((gr**2 / (he + SMOOTH)).sum()), f, g))
    for _, f, g in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((f, g, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for f, g, table in model.pairs:
            grad, hess = slopes()
            cell = coarse[:, f] * PAIR_BINS + coarse[:, g]
            gr = np.bincount(cell, grad, PAIR_BINS**2).reshape(PAIR_BINS, -1)
            he = np.bincount(cell, hess, PAIR_BINS**2).reshape(PAIR_BINS, -1)
            cut = _best_row_cut(gr, he)
            step = np.empty_like(gr)
            step[:cut] = _steps(gr[:cut].sum(0), he[:cut].sum(0), 1)
            step[cut:] = _steps(gr[cut:].sum(0), he[cut:].sum(0), 1)
            step *= RATE
            table += step
            raw += step[coarse[:, f], coarse[:, g]]
    return model


def _best_row_cut(gr: np.ndarray, he: np.ndarray) -> int:
    best = (-1.0, 1)
    for cut in range(1, len(gr)):
        gain = sum(float((v * v * (h + SMOOTH)).sum()) for v, h in ((_steps(gr[r].sum(0), he[r].sum(0), 1), he[r].sum(0)) for r in (slice(cut), slice(cut, None))))
        best = max(best, (gain, -cut), key=lambda x: (x[0], x[1])) if best[0] >= 0 else (gain, -cut)
    return -best[1]


def held_out(key) -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text has the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _as_bytes(x) -> bytes:
    return bytes(x.as_buffer()) if x.is_valid else b""


def _feature_rows(batches):
    for batch in batches:
        rows = [features(_as_bytes(t)) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def _scores(model: AdditiveModel):
    def run(batches):
        for batch in batches:
            x = np.array([features(_as_bytes(t)) for t in batch.column(1).cast(pa.binary())]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["id", "score"])

    return run


def _accepts(model: AdditiveModel, text: int, threshold: float):
    def run(batches):
        for batch in batches:
            x = np.array([features(_as_bytes(t)) for t in batch.column(text).cast(pa.binary())]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> AdditiveModel:
    """Learns `label` (0 or 1) from texts alone, on labelled rows that are not held out, at most `rows` of them.

    Rows without a label or an id are left out. An id with several labels counts by their mean, 1 from a half on; of rows
    that repeat an id the least text counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64(key), key).limit(rows)
    sample = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(known), key)
    sample = sample.groupBy(key).agg(F.min("_y").alias("_y"), F.min(F.coalesce("_text", F.lit(""))).alias("_text")).select("_y", "_text")
    got = sample.mapInArrow(_feature_rows, "y int, x array<double>").toArrow()  # at most `rows` short vectors
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums must not depend on it
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row; null texts are empty."""
    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_scores(model), f"id {kind}, score double")


def accepted(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least `threshold`."""
    text_batches(docs.sparkSession)
    return docs.mapInArrow(_accepts(model, docs.columns.index(text), threshold), docs.schema)
