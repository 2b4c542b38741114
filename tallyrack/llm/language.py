"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts (three bytes at most) with counts of the bytes that
followed. A text's code length under a language is exact: at each byte the longest known context
codes it, or pays for an escape (method C, with exclusion of the bytes already ruled out) and
leaves it to the next shorter context; below the empty context all 256 bytes are equally likely.
The counts are frozen after training, so the length of a (context, byte) pair is a constant:
it is worked out once for every pair met and then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyrack.llm.common import bounded_sample, runs, small_batches, strings, text_of, views

ORDER = 3
#: Training rows of each language, at most (about: they are taken by hash).
TRAIN_ROWS = 1000
UNKNOWN = "und"
#: Pairs of context and byte that a worker remembers, about.
MOST_PAIRS = 1 << 21
_PAD = b" " * ORDER


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it, as one number; every text starts after three spaces."""
    n = len(offsets) - 1
    shifted = offsets + ORDER * np.arange(n + 1)
    room = np.full(len(data) + ORDER * n, _PAD[0], dtype=np.uint8)
    body = np.ones(len(room), dtype=bool)
    for j in range(ORDER):
        body[shifted[:-1] + j] = False
    room[body] = data
    wide = room.astype(np.uint32)
    keys = np.zeros(len(room), dtype=np.uint32)
    keys[ORDER:] = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    return keys[body], offsets


@dataclass
class ContextTree:
    """``nodes[k]`` maps a context of ``k`` bytes to the counts of the next bytes."""

    nodes: list[dict[int, dict[int, int]]] = field(default_factory=lambda: [{} for _ in range(ORDER + 1)])
    room: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def add(self, key: int, count: int) -> None:
        symbol, context = key & 255, key >> 8
        for k in range(ORDER + 1):
            node = self.nodes[k].setdefault(context & ((1 << (8 * k)) - 1), {})
            node[symbol] = node.get(symbol, 0) + count

    def _left(self, k: int, context: int, above: dict[int, int] | None, at: tuple[int, int]) -> tuple[int, int]:
        """Total count and number of a node's bytes that no longer context has ruled out."""
        if at not in self.room:
            node = self.nodes[k][context]
            counts = [c for s, c in node.items() if above is None or s not in above]
            self.room[at] = sum(counts), len(counts)
        return self.room[at]

    def bits(self, key: int) -> float:
        """Exact code length of the last byte after the first three."""
        symbol, long = key & 255, key >> 8
        above, at, total = None, (ORDER + 1, long), 0.0
        for k in range(ORDER, -1, -1):
            context = long & ((1 << (8 * k)) - 1)
            node = self.nodes[k].get(context)
            if node is None:
                continue
            n, distinct = self._left(k, context, above, (at[0] * 8 + k, at[1]))
            if distinct:
                if symbol in node:
                    return total - math.log2(node[symbol] / (n + distinct))
                total -= math.log2(distinct / (n + distinct))
            above, at = node, (k, context)
        return total + math.log2(256 - len(above or ()))


@dataclass
class Model:
    languages: list[str]
    trees: list[ContextTree]
    keys: np.ndarray
    costs: np.ndarray

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text under every language."""
        keys, offsets = _keys(data, offsets)
        at, new = self._find(keys)
        if new.any():
            if len(self.keys) > MOST_PAIRS:  # back to the pairs of the training texts
                self.keys, self.costs = self.core
                at, new = self._find(keys)
            self._learn(np.unique(keys[new]))
            at, _ = self._find(keys)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            for j in range(len(self.languages)):
                out[full, j] = np.add.reduceat(self.costs[:, j][at], offsets[full], dtype=np.float64)
        return out

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair stands among those known, and which are not known."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] != keys

    def _learn(self, keys: np.ndarray) -> None:
        """Work out the lengths of pairs not met so far."""
        costs = np.array([[t.bits(int(k)) for t in self.trees] for k in keys], dtype=np.float32).reshape(len(keys), len(self.trees))
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.costs = all_keys[order], np.concatenate([self.costs, costs])[order]

    def __post_init__(self) -> None:
        self.core = self.keys, self.costs


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learn the context trees from the whole texts of ``rows`` rows of each language at most.

    ``docs`` has (doc_id, text, lang); rows with a null lang teach nothing. Counting runs on
    Spark; what comes to the driver is one row per (language, context, byte) of that sample.
    None if there is nothing to learn from.
    """
    small_batches(docs.sparkSession)
    sample = bounded_sample(docs.select("doc_id", text_of().alias("text"), "lang"), "doc_id", "lang", rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = strings(batch.column("text"), lower=True)
            for lang in sorted(set(langs)):
                data, offsets = views(texts.take(pa.array(np.flatnonzero(langs == lang))))
                for low, high in runs(offsets):
                    part = data[offsets[low] : offsets[high]]
                    keys, n = np.unique(_keys(part, offsets[low : high + 1] - offsets[low])[0], return_counts=True)
                    yield pa.record_batch(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "key", "n"],
                    )

    counts = sample.mapInArrow(count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    found = counts.orderBy("lang", "key").toPandas()
    if found.empty:
        return None
    languages = sorted(found["lang"].unique())
    trees = []
    for lang in languages:
        tree = ContextTree()
        for key, n in found.loc[found["lang"] == lang, ["key", "n"]].itertuples(index=False):
            tree.add(int(key), int(n))
        trees.append(tree)
    model = Model(languages, trees, np.zeros(0, np.uint32), np.zeros((0, len(languages)), np.float32))
    model._learn(np.unique(found["key"].to_numpy()).astype(np.uint32))
    model.core = model.keys, model.costs
    return model


def has_letter(column: Column) -> Column:
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, with ``lang_pred``, ``score`` and ``bits_per_byte``.

    The score is the share of the best language in the likelihood of the text (equal priors), so
    0 to 1; ties go to the smaller name. A text that is null, empty or without a letter is
    ``und`` with score 0; so is every text if there is no model. Whole texts are scored.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, text_of().alias("_text"), has_letter(F.col("text")).alias("_letter"))
    fields = [f for f in docs.select(*keep).schema]
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())]
    schema = StructType([*fields, *added])  # the names may hold anything
    if model is None:
        return rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.languages, dtype=object)
        for batch in batches:
            data, offsets = views(strings(batch.column("_text"), lower=True))
            parts = [np.zeros((0, len(names)))]
            for low, high in runs(offsets):
                if high == low + 1:  # one long text: its bits are added up piece by piece
                    parts.append(_long(own, data[offsets[low] : offsets[high]]))
                else:
                    parts.append(own.lengths(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
            bits = np.concatenate(parts)
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
            least = bits[np.arange(len(bits)), best][:, None]
            likely = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
            letter = np.array(batch.column("_letter").to_pylist(), dtype=bool)
            size = np.maximum(np.diff(offsets), 1)
            out = [batch.column(i) for i in range(len(fields))]
            out.append(pa.array(np.where(letter, names[best], UNKNOWN) if len(bits) else [], pa.string()))
            out.append(pa.array(np.where(letter, likely, 0.0)))
            out.append(pa.array(np.where(letter, least[:, 0] / size, 0.0)))
            yield pa.record_batch(out, names=[f.name for f in fields] + ["lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(score, schema)


def _long(model: Model, data: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """One text, in pieces that begin with the three bytes before them."""
    total = np.zeros((1, len(model.languages)))
    for low in range(0, len(data), most):
        total += model.lengths(data[low : low + most], np.array([0, min(most, len(data) - low)]))
        if low:  # the first three bytes of this piece again, after the bytes that do stand there
            near = data[low - ORDER : low + ORDER]
            odd = model.lengths(data[low : low + ORDER], np.array([0, len(near) - ORDER]))
            real = model.lengths(near, np.array([0, len(near)])) - model.lengths(near[:ORDER], np.array([0, ORDER]))
            total += real - odd
    return total
