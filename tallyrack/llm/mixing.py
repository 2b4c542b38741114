"""Mixing sources to target weights: blocks of words, multinomial shards, pseudorandom index permutations.

Each source is a stream of words: its documents in an order that a hash gives. The stream is cut
into blocks of ``BLOCK`` words (the last may be shorter); a source whose target is under ``LEAST`` such blocks
gets shorter ones, so that rounding to whole blocks leaves it near its target too. The mix is a list of shards with a fixed
number of slots. A shard draws how many of its slots each source fills from a multinomial
distribution; the draws of a source, counted on through all shards, walk through a pseudorandom
permutation of its block indexes, again and again if the source is repeated. Draws beyond a
source's quota go to the sources that drew too few, so that each source ends at its target.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.llm.common import mix, written

#: Blocks that a source's target should have at least.
LEAST = 64
#: Words in a block, slots in a shard, most passes through a source, weights by rank of the source.
BLOCK = 256
SLOTS = 4096
MOST = 3
WEIGHTS = (5, 2, 1)
#: Rows of one bucket of a source's stream, on average.
BUCKET = 1000
SEED = 20240617


def words_of(text: Column) -> Column:
    """Number of runs between ASCII white space; 0 for null."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    inner = F.trim(plain)
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def targets(sizes: dict[str | None, int], most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Words each source should give: shares of all words by weight, at most ``most`` times its size.

    Weights go round by the sources' code-point order, null last. What a capped source leaves is
    shared among the others by weight, until none is above its cap. An empty source gets 0.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while len(capped) < len(order):
        left = total - sum(capped.values())
        base = sum(weight[s] for s in order if s not in capped)
        above = [s for s in order if s not in capped and left * weight[s] / base > most * sizes[s]]
        if not above:
            return {s: capped.get(s, left * weight[s] / base) for s in order}
        capped |= {s: float(most * sizes[s]) for s in above}
    return capped


def block_words(target: float) -> int:
    """Words in a block of a source with that target."""
    return max(1, min(BLOCK, int(target // LEAST)))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in the pseudorandom permutation of 0..n-1 that ``key`` names.

    A Feistel network over the next power of four, walked on until the value falls below n.
    """
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k + np.uint64(turn << 40)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def stream(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, start): where each document begins in its source's stream.

    The running sums go in two steps: within buckets of a source, cut by the hash that orders the
    stream, and over the buckets. So a source that holds most rows is spread over many tasks.
    """
    # a repeated row is put after the first one
    rows = written(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("text", F.lit(SEED)).alias("tie")))
    buckets = max(1, rows.count() // BUCKET)
    place = F.xxhash64("doc_id", F.lit(SEED))
    bucket = F.floor((F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))) * buckets)
    rows = rows.withColumn("place", place).withColumn("place", F.shiftrightunsigned("place", 1)).withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("from"),
        F.sum("words").over(Window.partitionBy("source")).alias("source_size"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "source", "size", "source_size", (F.col("from") + F.col("inside")).alias("start")
    )


def slots(plan: list[tuple[int, int, float]], spark, seed: int = SEED) -> DataFrame:
    """(shard, sid, block): the block each slot of the mix takes; ``plan`` has (sid, size, target).

    A shard's draws depend on the seed and the shard's number only. Per (shard, source) there is
    one row until the slots are laid out.
    """
    known = []
    for sid, size, target in plan:
        blocks = -(-size // block_words(target))
        known.append((sid, blocks, round(blocks * target / size) if size else 0))
    quota = sum(k[2] for k in known)
    schema = "shard bigint, sid bigint, block bigint"
    if not quota:
        return spark.createDataFrame([], schema)
    shards = -(-quota // SLOTS)
    chance = np.array([k[2] for k in known]) / quota

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, sid, n = [], [], []
            for i in batch.column("id").to_pylist():
                drawn = np.random.default_rng([seed, i]).multinomial(min(SLOTS, quota - i * SLOTS), chance)
                for k, count in zip(known, drawn):
                    shard.append(i), sid.append(k[0]), n.append(int(count))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (shard, sid, n)], names=["shard", "sid", "n"])

    drawn = spark.range(0, shards, numPartitions=max(1, shards // 64)).mapInArrow(draw, "shard bigint, sid bigint, n bigint")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    caps = spark.createDataFrame(known, "sid bigint, blocks bigint, quota bigint")
    drawn = written(drawn.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(caps), "sid"))
    kept = drawn.withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("at"))))
    # draws over quota, and the sources short of theirs, side by side on one line of numbers
    short = {r["sid"]: r["quota"] - r["drawn"] for r in drawn.groupBy("sid", "quota").agg(F.sum("n").alias("drawn")).collect()}
    gaps, at = [], 0
    for sid, blocks, goal in known:
        if short[sid] > 0:
            gaps.append((sid, blocks, goal - short[sid], at, at + short[sid]))
            at += short[sid]
    run = Window.orderBy("shard", "sid").rowsBetween(Window.unboundedPreceding, -1)
    over = kept.filter("n > own").select("shard", "sid", (F.col("n") - F.col("own")).alias("n"))
    # one row for each shard and source over quota
    over = over.withColumn("lo", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n")).drop("sid", "n")
    # one entry for each source short of its quota: a literal that every row looks through
    names = ("sid", "blocks", "first", "g_lo", "g_hi")
    line = F.from_json(F.lit(json.dumps([dict(zip(names, map(int, g))) for g in gaps])), "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>")
    met = F.filter(line, lambda g: (F.col("lo") < g["g_hi"]) & (F.col("hi") > g["g_lo"]))
    moved = over.select("shard", "lo", "hi", F.inline(met)).select(
        "shard", "sid", "blocks",
        (F.col("first") + F.greatest("lo", "g_lo") - F.col("g_lo")).alias("at"),
        (F.least("hi", "g_hi") - F.greatest("lo", "g_lo")).alias("own"),
    )
    laid = kept.filter("own > 0").select("shard", "sid", "blocks", "at", "own").unionByName(moved)
    each = laid.select("shard", "sid", "blocks", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("own") - 1)).alias("k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "blocks", "k"))
            key = mix(sid.astype(np.uint64) + np.uint64(seed))
            yield pa.record_batch([batch.column("shard"), batch.column("sid"), pa.array(permuted(k % n, n, key))], names=["shard", "sid", "block"])

    return each.mapInArrow(place, schema)


def plan_of(placed: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> list[tuple[int, str | None, int, float]]:
    """(sid, source, size, target) of each source; one row each goes to the driver."""
    sizes = {r["source"]: r["source_size"] for r in placed.groupBy("source").agg(F.max("source_size").alias("source_size")).collect()}
    return [(i, s, sizes[s], t) for i, (s, t) in enumerate(targets(sizes, most, weights).items())]


def _numbered(placed: DataFrame, plan: list[tuple[int, str | None, int, float]]) -> DataFrame:
    known = placed.sparkSession.createDataFrame([(i, s, t, block_words(t)) for i, s, _, t in plan], "sid bigint, s string, target double, block_words bigint")
    return placed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def segments(numbered: DataFrame) -> DataFrame:
    """(sid, block, doc_id, doc_start, words): the words [doc_start, doc_start + words) of the document that a block holds."""
    words = F.col("block_words")
    first, last = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
    rows = numbered.filter("size > 0").select("sid", "doc_id", "start", "size", words, F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest("start", F.col("block") * words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * words)
    return rows.select("sid", "block", "doc_id", (low - F.col("start")).alias("doc_start"), (high - low).alias("words"))


def mix_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix as (shard, sid, block, doc_id, doc_start, words), and per document its accounts.

    The accounts are doc_id, size, source_size, target and taken, one row for each row of
    ``docs``. Null texts have size 0 and give nothing; a null source is a source of its own. Reruns
    give the same rows. No document is taken more than three times, as no block is.
    """
    placed = written(stream(docs.select("doc_id", "source", "text")))
    plan = plan_of(placed)
    numbered = _numbered(placed, plan)
    drawn = written(slots([(i, size, t) for i, _, size, t in plan], docs.sparkSession))
    parts = segments(numbered)
    mixed = drawn.join(parts, ["sid", "block"])
    times = drawn.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # a document's part of the stream names it even if its id is null or repeated
    taken = (
        segments(numbered.withColumn("doc_id", F.col("start")))
        .join(times, ["sid", "block"])
        .groupBy("sid", F.col("doc_id").alias("start"))
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    full = numbered.filter("size > 0").join(taken, ["sid", "start"], "left")
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    empty = numbered.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return mixed, full.select(columns).union(empty.select(columns))
