"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text falls into a bin; the model is a lookup table per feature and one per chosen
pair of features. Training goes round the features again and again and fits a shallow tree on the
bins to what is left unexplained (a Newton step of the log loss), adding a small part of it to that
feature's table; then the same for the pairs with the largest remaining interaction. A score is the
logistic function of the sum of the tables' entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.llm.common import runs, share, small_batches, strings, text_of, views, word_hashes

#: Labelled rows that train the model, at most (about: taken by hash of the id).
TRAIN_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, SMOOTH = 120, 0.1, 1.0
FEATURES = (
    "log_words", "mean_word", "upper", "digit", "mark", "pipe", "symbol", "exclaim", "full_stop", "comma", "other_bytes",
    "distinct_words", "repeated_next", "top_word", "distinct_pairs", "log_lines", "mean_line", "repeated_lines", "short_lines",
)

_KINDS = np.zeros(256, dtype=np.int64)
for _place, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#$%&*@^~<>{}[]\\=+", b"!?", b".", b",;:", bytes(range(128, 256)), b"abcdefghijklmnopqrstuvwxyz", b" \t\n\r\x0b\x0c"), start=1
):
    _KINDS[list(_chars)] = _place


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, from its whole text; an empty text has zeros."""
    texts = strings(column)
    data, offsets = views(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for low, high in runs(offsets):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        words, begin = word_hashes(part, at)
        lines = np.flatnonzero(part == 10)
        for i in range(high - low):
            own, piece = words[begin[i] : begin[i + 1]], part[at[i] : at[i + 1]]
            if not len(own):
                continue
            kind = np.bincount(_KINDS[piece], minlength=11)
            letters, dense = max(1, kind[1] + kind[9] + kind[8]), len(piece) - kind[10]
            _, times = np.unique(own, return_counts=True)
            pairs = own[:-1] * np.uint64(3) + own[1:]
            cuts = lines[np.searchsorted(lines, at[i]) : np.searchsorted(lines, at[i + 1])] - at[i]
            row_words = np.diff(np.r_[0, cuts + 1, len(piece)]) - 1
            whole = texts[low + i].as_py().split("\n") if len(cuts) else []
            marks = dense - kind[1] - kind[2] - kind[8] - kind[9]
            out[low + i] = (
                np.log1p(len(own)), dense / len(own), kind[1] / letters, kind[2] / dense, marks / dense, kind[3] / len(own), kind[4] / dense,
                kind[5] / len(own), kind[6] / len(own), kind[7] / len(own), kind[8] / dense,
                len(times) / len(own), (own[1:] == own[:-1]).mean() if len(own) > 1 else 0, times.max() / len(own),
                len(np.unique(pairs)) / len(pairs) if len(pairs) else 1, np.log1p(len(cuts)), len(piece) / (len(cuts) + 1),
                1 - len(set(whole)) / len(whole) if whole else 0, (row_words < 40).mean(),
            )
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of two levels over ordered bins: the Newton step of each bin's leaf."""

    def best_cut(low: int, high: int) -> tuple[float, int]:
        g, h = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
        gain = g[:-1] ** 2 / (h[:-1] + SMOOTH) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + SMOOTH)
        k = int(gain.argmax())
        return float(gain[k] - g[-1] ** 2 / (h[-1] + SMOOTH)), low + k + 1

    leaves = [(0, len(gradient))]
    for _ in range(3):
        cuts = [(*best_cut(a, b), (a, b)) for a, b in leaves if b - a > 1]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, at, (a, b) = max(cuts)
        leaves.remove((a, b))
        leaves += [(a, at), (at, b)]
    out = np.zeros(len(gradient))
    for a, b in leaves:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + SMOOTH)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each axis of a pair's grid: its gain and the four leaves' steps."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    whole_g, whole_h = g[-1, -1], h[-1, -1]
    a_g, a_h = g[:-1, :-1], h[:-1, :-1]
    b_g, b_h = g[:-1, -1:] - a_g, h[:-1, -1:] - a_h
    c_g, c_h = g[-1:, :-1] - a_g, h[-1:, :-1] - a_h
    d_g, d_h = whole_g - a_g - b_g - c_g, whole_h - a_h - b_h - c_h
    gain = sum(x**2 / (y + SMOOTH) for x, y in ((a_g, a_h), (b_g, b_h), (c_g, c_h), (d_g, d_h)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(gradient)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + SMOOTH)
    return float(gain[i, j]), out


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, f], "right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit tables to rows of features and labels 0 and 1."""
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Model(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    edge = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.cuts = [edge(x[:, f], BINS) for f in range(x.shape[1])]
    model.coarse = [edge(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, own in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(own, g, n), np.bincount(own, h, n))
            model.tables[f] += step
            total += step[own]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        n, m = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(coarse[i] * m + coarse[j], v, n * m).reshape(n, m)

    g, h = slopes()
    able = [(i, j) for i, j in combinations(range(x.shape[1]), 2) if len(model.coarse[i]) and len(model.coarse[j])]
    chosen = sorted(able, key=lambda p: (-_quadrants(grid(*p, g), grid(*p, h))[0], p))[:PAIRS]
    model.pairs = {p: np.zeros((len(model.coarse[p[0]]) + 1, len(model.coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(ROUNDS // 2):
        for p in chosen:
            g, h = slopes()
            step = RATE * _quadrants(grid(*p, g), grid(*p, h))[1]
            model.pairs[p] += step
            total += step[coarse[p[0]], coarse[p[1]]]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from the whole texts of about ``rows`` labelled documents at most; None if there are none.

    ``labels`` has (doc_id, quality); values other than 0 and 1 are left out, of several labels of one
    document the smallest counts. The features of the sample come to the driver.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(share("doc_id") < F.lit(min(1.0, rows / max(1, known.count()))))
    # the sample's size is bounded above
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("text"))
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int64()), pa.array(list(found), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"],
            )

    seen = sample.mapInArrow(measure, "doc_id bigint, quality bigint, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if seen.empty:
        return None
    return fit(np.array(seen["x"].tolist()), seen["quality"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, with ``score`` in [0, 1]: how likely label 1 is.

    Null and empty texts are scored by their features, all zero. Without a model every score is 0.5.
    """
    rows = docs.select(*keep, text_of().alias("_text"))
    if model is None:
        return rows.select(*keep, F.lit(0.5).alias("score"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(features(batch.column("_text")))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(found)], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, score double")
