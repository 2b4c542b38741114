"""What the operators share: tables, written stages, samples with a bound, words as hashes in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.session import checkpoint_dir

#: Text bytes that one numpy pass holds; a longer text is cut between words.
CHUNK = 1 << 20
#: White space between words, as in ``[\x20\x09-\x0D]``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, kept when executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of fewer rows, so that long texts don't pile up in one batch of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def share(*key: str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, key: str, stratum: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each stratum at most, always the same ones: those of the smallest hashes of ``key``.

    The strata are counted first (one row each goes to the driver); nulls are left out.
    """
    counts = df.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()
    part = F.lit(0.0)
    for value, n in counts:
        part = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, rows / n))).otherwise(part)
    return df.filter(F.col(stratum).isNotNull() & (share(key) < part))


def strings(column: pa.Array, lower: bool = False) -> pa.Array:
    column = pc.fill_null(column.cast(pa.string()), "")
    return pc.utf8_lower(column) if lower else column


def views(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one entry more at the end)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), at * 0
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most`` bytes of text together, or one row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(step: np.uint64) -> np.ndarray:
        out = np.full(n, step, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_STEP), of(_BACK)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = word[edge]  # a text's first byte doesn't go on with the text before
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    size = 1 << max(20, int(len(data)).bit_length())
    power, back = _powers(size)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=total[1:])
    return mix((total[end + 1] - total[start]) * back[start]), np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (one entry more at the end).

    A word is a maximal run of bytes that aren't white space. A long text is cut between words,
    so that memory beyond the hashes stays near ``CHUNK``; a word longer than that is taken whole.
    """
    if len(data) <= 2 * CHUNK or len(offsets) != 2:
        return _hash_words(data, offsets)
    parts, low = [], 0
    while low < len(data):
        high = min(len(data), low + CHUNK)
        if high < len(data):
            gap = np.flatnonzero(_SPACE[data[low:high]])
            if len(gap):
                high = low + int(gap[-1]) + 1
            else:
                far = np.flatnonzero(_SPACE[data[high:]])
                high = high + int(far[0]) + 1 if len(far) else len(data)
        parts.append(_hash_words(data[low:high], np.array([0, high - low]))[0])
        low = high
    words = np.concatenate(parts)
    return words, np.array([0, len(words)])


_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * _PLACES[j]
    return mix(total)
