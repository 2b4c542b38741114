"""Similarity join on word n-gram sets: MinHash bands find candidates, full sets decide.

Equal sets are one class, and only one member of a class is compared. Signatures have ``BANDS``
bands of ``ROWS`` rows; two sets of Jaccard similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS, which is over 1 - 4e-7 at s = 0.8.

The members of a band's bucket don't form pairs. Each bucket has a leader, its smallest id, and
all its members go to the leader's group; members of one group that meet again in another group
are compared in the group of the smallest leader they share. So every candidate pair is compared
once, inside a task, and only counts and a spanning forest of the links leave the task. A large
group is cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.llm.common import gram_hashes, mix, runs, small_batches, strings, text_of, views, word_hashes, written

GRAM = 5
BANDS = 28
ROWS = 4
#: Members and text bytes of one block of a group.
BLOCK_MEMBERS = 192
BLOCK_BYTES = 4 << 20

_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def gram_sets(column: pa.Array, n: int = GRAM) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of every text, sorted: words in lower case between white space.

    A text of fewer than ``n`` words, but one at least, has one gram: all its words.
    """
    data, offsets = views(strings(column, lower=True))
    for low, high in runs(offsets):
        words, at = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        grams = gram_hashes(words, n)
        for i in range(high - low):
            count = at[i + 1] - at[i]
            if count >= n:
                yield np.unique(grams[at[i] : at[i + 1] - n + 1])
            elif count:
                yield gram_hashes(words[at[i] : at[i + 1]], int(count)) + np.uint64(count)
            else:
                yield np.zeros(0, dtype=np.uint64)


def signatures(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band hashes of consecutive non-empty sets; ``ends`` are the sets' first places."""
    least = np.empty((BANDS * ROWS, len(ends)), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        least[k] = np.minimum.reduceat((grams ^ _SEEDS[0, k]) * _SEEDS[1, k], ends)
    bands = (least.reshape(BANDS, ROWS, -1) * _PLACE[:, :, None]).sum(axis=1, dtype=np.uint64)
    return mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None]).T


def digest(grams: np.ndarray) -> bytes:
    """160 bits that tell one set of gram hashes from another."""
    return b"".join(x.sum(dtype=np.uint64).tobytes() for x in (mix(grams), mix(grams ^ _SEEDS[0, 0]))) + len(grams).to_bytes(4, "little")


def sketches(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """(doc_id, digest, n_grams, n_bytes, bands) of every row; no digest and no bands for a text without a word."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column("doc_id"), strings(batch.column("text"))
            lengths = np.diff(views(size)[1])
            held, done, room = [], 0, 0
            for s in gram_sets(size, n):
                held.append(s)
                room += len(s)
                if room > 1 << 17 or done + len(held) == batch.num_rows:
                    yield _sketched(ids.slice(done, len(held)), held, lengths[done : done + len(held)])
                    done, held, room = done + len(held), [], 0

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(sketch, "doc_id bigint, digest binary, n_grams bigint, n_bytes bigint, bands array<bigint>")


def _sketched(ids: pa.Array, sets: list[np.ndarray], lengths: np.ndarray) -> pa.RecordBatch:
    counts = np.array([len(s) for s in sets])
    full = np.flatnonzero(counts)
    digests: list[bytes | None] = [None] * len(sets)
    bands: list[np.ndarray | None] = [None] * len(sets)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(counts[full]) - counts[full]
        found = signatures(flat, begin).view(np.int64)
        for j, i in enumerate(full):
            digests[i], bands[i] = digest(sets[i]), found[j]
    return pa.record_batch(
        [ids, pa.array(digests, pa.binary()), pa.array(counts), pa.array(lengths), pa.array(bands, pa.list_(pa.int64()))],
        names=["doc_id", "digest", "n_grams", "n_bytes", "bands"],
    )


def ngram_join(docs: DataFrame, n: int = GRAM, jaccard: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, group_id.

    ``class_id`` is the smallest doc_id with the same n-gram set, ``n_links`` the number of other
    documents at similarity ``jaccard`` (a fraction) or more, copies counted one by one, and
    ``group_id`` the smallest doc_id that links lead to. A text without a word (null, empty, white
    space) has no links and is a class of its own. Rows with a null doc_id are left out; rows
    that repeat a doc_id are one document, and the row with the larger set digest stands for it.
    """
    found = written(sketches(docs.filter(F.col("doc_id").isNotNull()), n))
    own = found.select("doc_id", "digest", "n_grams", "n_bytes").groupBy("doc_id").agg(F.max("digest").alias("digest"))
    classes = written(
        own.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    )
    met = _meetings(found, classes)
    links = written(_verified(docs, classes, met, n, jaccard))
    roots = components(links.filter("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")).distinct())
    counted = (
        classes.join(links.groupBy("class_id").agg(F.sum("n_links").alias("n_links")), "class_id", "left")
        .join(roots, "class_id", "left")
        .select(
            "digest",
            "class_id",
            "class_size",
            (F.coalesce("n_links", F.lit(0)) + F.col("class_size") - 1).alias("n_links"),
            F.coalesce("group_id", "class_id").alias("group_id"),
        )
    )
    return own.join(counted, "digest", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )


def _meetings(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, class_size, digest, led) of every class that shares a bucket; ``led`` has its leaders and the block it has in each group."""
    same = (found.doc_id == classes.class_id) & (found.digest == classes.digest)
    # written, as are the small sides below: a join with a written table can be split where a key is hot
    heads = written(found.join(classes, same).select("class_id", "class_size", found.digest, "n_bytes", "bands"))
    banded = heads.select("class_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("last")).filter("leader < last")
    met = banded.join(written(shared.drop("last")), "band").groupBy("class_id", "leader").agg(F.lit(1).alias("one")).drop("one")
    led = met.join(heads.drop("bands"), "class_id")
    led = written(led)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
    large = written(led.groupBy("leader").agg(blocks.alias("blocks")).filter("blocks > 1"))
    placed = led.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("class_id", "leader"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block)
    return placed.groupBy("class_id", "class_size", "digest").agg(F.collect_list(F.struct("leader", "block", "blocks")).alias("led"))


def _verified(docs: DataFrame, classes: DataFrame, met: DataFrame, n: int, jaccard: tuple[int, int]) -> DataFrame:
    """(class_id, n_links, root) for every class and meeting in which it has links."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("class_id"), text_of().alias("text"))
    rows = (
        texts.join(met.hint("merge"), "class_id")  # its size follows the input's, so one plan at every size
        .withColumn("leaders", F.array_sort(F.col("led.leader")))
        .withColumn("at", F.explode("led"))
        .select("class_id", "class_size", "digest", "leaders", "text", "at.*")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("leader", "i", "j", "block", "class_id", "class_size", "leaders", "digest", "text")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _meeting_rows(batches, n):
            out = _compare(key, members, jaccard)
            if out is not None:
                yield out

    keys = ["leader", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "class_id")
    return dealt.mapInArrow(verify, "class_id bigint, n_links bigint, root bigint")


def _meeting_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of one meeting after another; only their gram sets are kept."""
    key, members = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("leader", "i", "j", "block", "class_id", "class_size", "leaders", "digest")]
        for row, grams in zip(zip(*cols), gram_sets(batch.column("text"), n)):
            if row[:3] != key:
                if len(members) > 1:
                    yield key, members
                key, members = row[:3], []
            if (not members or members[-1][1] != row[4]) and digest(grams) == row[7]:  # else a row that repeats the id
                members.append((*row[3:7], grams))
    if len(members) > 1:
        yield key, members


def _together(lists: list[np.ndarray], counts: np.ndarray | None = None) -> np.ndarray:
    """How many values each two lists of distinct values share."""
    m = len(lists)
    out = np.zeros((m, m), dtype=np.float32)
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1  # values that one list alone has don't matter
    keep = times[place] > 1
    owner, place = owner[keep], rank[place[keep]]
    width = max(1, (1 << 20) // m)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (low, low + width))
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[a:b], place[a:b] - low] = 1
        out += part @ part.T
    return out


def _compare(key: tuple, members: list[tuple], jaccard: tuple[int, int]) -> pa.RecordBatch | None:
    leader, i, j = key
    block, ids, sizes = (np.array([r[k] for r in members]) for k in (0, 1, 2))
    grams = [r[4] for r in members]
    n = np.array([len(g) for g in grams], dtype=np.int64)
    inter = _together(grams).astype(np.int64)
    up, down = jaccard
    ok = inter * (up + down) >= up * (n[:, None] + n[None, :])
    np.fill_diagonal(ok, False)
    if i != j:
        ok &= block[:, None] != block[None, :]
    if ok.any():
        sooner = [np.array([x for x in r[3] if x < leader], dtype=np.int64) for r in members]
        if any(len(x) for x in sooner):
            ok &= _together(sooner) == 0  # those meet with a smaller leader too
    if not ok.any():
        return None
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before = root
        root = np.minimum(before, np.where(ok, before[None, :], np.iinfo(np.int64).max).min(axis=1))
    has = ok.any(axis=1)
    links = (ok * sizes[None, :]).sum(axis=1)
    return pa.record_batch([pa.array(ids[has]), pa.array(links[has]), pa.array(root[has])], names=["class_id", "n_links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(class_id, group_id): the smallest node of each node's component, for the nodes of ``edges`` (a, b).

    Rounds of large-star and small-star steps until the edges stay as they are; the number of
    rounds follows the logarithm of the longest chain. Every round is a written table.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a")).agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now a > b holds in every edge
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("class_id"), F.col("b").alias("group_id"))
        state = seen
