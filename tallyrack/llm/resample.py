"""Importance resampling towards a target distribution, drawn by distributed quickselect.

Features are words and pairs of neighbour words, hashed into ``BUCKETS`` buckets. What a bucket gains is the
log-ratio of its share in the target texts to its share in all documents; a document's weight is the
mean gain of its features, read from one array. Weight plus Gumbel noise that the id fixes is the
score, so that the highest scores are a sample without replacement in proportion to the weights.

The k best are found without sorting all rows: random pivot keys, exact counts of the rows before, at and
after each, and on with the part that holds the k-th, until a pivot is it. Only the winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.llm.common import CHUNK, runs, small_batches, strings, text_of, views, written
from tallyrack.operators.numbering import number_rows

BUCKETS = 10_000
#: Documents of fewer words are not drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Pivots of one round.
PIVOTS = 15

_WORD = np.zeros(256, dtype=bool)
_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
#: Bytes of a second word up to which checksums are combined by table.
_SHORT = 64


def _shifts() -> np.ndarray:
    """``[n, k, b]``: what byte k of a CRC-32, being b, becomes after n zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    out = np.empty((_SHORT + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_SHORT):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ table[out[n] & np.uint32(255)]
    return out


_SHIFTS = _shifts()


def _joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts one after the other, from those of both and the second's size (``_SHORT`` at most)."""
    out = second.copy()
    for k in range(4):
        out ^= _SHIFTS[size, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of every word; a word ends where its text does."""
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, and the text it stands in. ``data``: their UTF-8 bytes in lower case."""
    start, end = _spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end + 1 - start
    owner = np.searchsorted(offsets, start, "right") - 1
    # equal words once
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    plain = data[_WORD[data]]
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(plain)]).dictionary_encode()
    kind = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    alone = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    before = np.fromiter((zlib.crc32(b" ", c) for c in alone.tolist()), dtype=np.uint32, count=len(words))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = kind[pair], kind[pair + 1]
    both = _joined(before[left], alone[right], np.minimum(size[pair + 1], _SHORT))
    for i in np.flatnonzero(size[pair + 1] > _SHORT):
        both[i] = zlib.crc32(words[right[i]], int(before[left[i]]))
    return np.concatenate([alone[kind], both]).astype(np.int64) % BUCKETS, np.concatenate([owner, owner[pair]])


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of one long text, in parts cut between words; the pair across a cut comes with the next part."""
    low, word = 0, None
    while low < len(data):
        high = min(len(data), low + CHUNK)
        if high < len(data):
            gap = np.flatnonzero(~_WORD[data[low:high]])
            if len(gap):
                high = low + int(gap[-1]) + 1
            else:
                far = np.flatnonzero(~_WORD[data[high:]])
                high = high + int(far[0]) + 1 if len(far) else len(data)
        part = data[low:high]
        start, end = _spans(part, np.array([0, len(part)]))
        if len(start):
            if word is not None:
                yield np.array([zlib.crc32(word + b" " + part[start[0] : end[0] + 1].tobytes()) % BUCKETS])
            word = part[start[-1] : end[-1] + 1].tobytes()
        yield features(part, np.array([0, len(part)]))[0]
        low = high


def parts(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, numbers of the texts) of all features of the texts, part by part."""
    data, offsets = views(texts)
    for low, high in runs(offsets, CHUNK):
        part = _lower(data[offsets[low] : offsets[high]])
        if len(part) > 2 * CHUNK:
            for bucket in _long(part):
                yield bucket, np.full(len(bucket), low)
        else:
            bucket, owner = features(part, offsets[low : high + 1] - offsets[low])
            yield bucket, owner + low


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all rows of ``text`` by bucket. ``BUCKETS`` rows at most leave each task or reach the driver."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for bucket, _ in parts(strings(batch.column(0))):
                total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    sums = texts.select(text_of().alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: 1000 times the log-ratio of smoothed shares, floored."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from the id, in thousandths; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row; texts without a word weigh 0."""
    small_batches(docs.sparkSession)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            total = np.zeros(batch.num_rows)
            for bucket, owner in parts(strings(batch.column(1))):
                n += np.bincount(owner, minlength=len(n))
                total += np.bincount(owner, weights=gain[bucket], minlength=len(n))  # whole numbers: exact
            weight = total.astype(np.int64) // np.maximum(n, 1)
            columns = [batch.column(0), pa.array(n), pa.array((n + 1) // 2), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "n_words", "weight"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features bigint, n_words bigint, weight bigint"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(weigh, schema)


def kth_key(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) of the composite keys, which must be distinct; None if there are fewer.

    Each round takes ``pivots`` rows at random of those still in question, and counts in one pass
    how many keys lie before each. The part that holds the k-th is about ``pivots`` times smaller.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    at = F.struct(*key)

    def fixed(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for v, c in zip(values, key)])

    low: tuple | None = None
    high: tuple | None = None
    turn = 0
    while k > 0:
        left = rows
        if low is not None:  # the plain bound on the first column reaches the scan
            left = left.filter((F.col(key[0]) >= low[0]) & (at > fixed(low)))
        if high is not None:
            left = left.filter((F.col(key[0]) <= high[0]) & (at < fixed(high)))
        chosen = sorted(tuple(r) for r in left.orderBy(F.xxhash64(*key, F.lit(turn))).limit(pivots).select(*key).collect())
        if not chosen:
            return None
        tally = left.agg(*[F.count_if(at < fixed(p)).alias(f"n{i}") for i, p in enumerate(chosen)], F.count("*").alias("n")).first()
        before = [tally[i] for i in range(len(chosen))]
        if k > tally["n"]:
            return None
        hit = [p for p, n in zip(chosen, before) if n == k - 1]
        if hit:
            return hit[0]
        smaller = [i for i, n in enumerate(before) if n < k - 1]
        if len(smaller) < len(chosen):
            high = chosen[len(smaller)]
        if smaller:
            low, k = chosen[smaller[-1]], k - before[smaller[-1]] - 1
        turn += 1
    return None


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every row of ``docs`` (doc_id, text).

    ``target`` has texts in ``text``. Of the N rows with ``least_words`` words or more the
    floor(percent * N / 100) with the highest scores are ranked from 1, ties by the smaller
    doc_id (nulls last), then fewer features; the others' rank is null. Rows that repeat are rows of their
    own. Null texts are empty. An empty ``target`` makes rare features gain.
    """
    columns = docs.select("doc_id", "text")
    gain = gains(bucket_counts(columns.select("text")), bucket_counts(target.select("text")))
    scored = weighed(columns, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # a key for each row: the score downwards, the id, and what tells equal ids apart
    key = ["down", "none", "id", "n_features", "row"]
    rows = written(
        scored.withColumn("down", -F.col("score"))
        .withColumn("none", F.col("doc_id").isNull())
        .withColumn("id", F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)))
        .withColumn("row", F.monotonically_increasing_id())
    )
    plain = ["doc_id", "n_features", "n_words", "weight", "score"]
    able = rows.filter(F.col("n_words") >= least_words)
    last = kth_key(able, key, able.count() * percent // 100)
    none = F.lit(None).cast("bigint").alias("rank")
    if last is None:
        return rows.select(*plain, none)
    bound = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(last, key)])
    won = (F.col("n_words") >= least_words) & (F.struct(*key) <= bound)
    ranked = number_rows(rows.filter(won), key).select(*plain, (F.col("position") + 1).alias("rank"))
    return ranked.unionByName(rows.filter(~won).select(*plain, none))
