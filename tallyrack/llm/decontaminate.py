"""Benchmark decontamination: word pairs as seeds find passages, Smith-Waterman alignment scores them.

Words are runs between white space, in lower case. The benchmark is taken in blocks of a bounded
number of words, and every block meets all documents:

1. the corpus counts of the block's word pairs are taken over all documents (partly summed per task);
2. an item's pairs of neighbour words are seeds, but for some of its commonest (see ``seeds``); a text
   holds a pair where the two words stand next to each other or with one word between them;
3. a document's seed hits give stretches of its words, and each stretch with enough of an item's
   seeds is aligned with it, word by word, with gaps.

No alignment that counts is lost, for a share of 0.5 or more (``joints`` has the proof), and a stretch
reaches as far around its hits as such an alignment can. Copies of an item anywhere in a text, and
however many, are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.llm.common import _PLACES, gram_hashes, mix, runs, small_batches, strings, text_of, views, word_hashes

GRAM = 2
#: So many seeds in a row are never all left out.
WINDOW = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of one block of benchmark items: the bound of what is broadcast (8 bytes a word and seed).
BLOCK_WORDS = 1 << 20
#: Share of an item's best possible score that makes a document contaminated, and words of an item that may be edited at all.
SHARE = 0.5
LEAST_WORDS = 8


@dataclass
class Block:
    """Items of the benchmark: word hashes, and the word pairs with item and place, sorted by hash."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _block(rows: list) -> Block:
    ids, words, grams, item, place = [], [], [], [], []
    for row in rows:
        data, offsets = views(strings(pa.array([row["text"]], pa.string()), lower=True))
        found, _ = word_hashes(data, offsets)
        n = min(GRAM, len(found))
        if n:
            own = gram_hashes(found, n)
            grams.append(own)
            item.append(np.full(len(own), len(ids)))
            place.append(np.arange(len(own)))
            ids.append(row["item_id"])
            words.append(found)
    if not ids:
        return Block([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    flat, item, place = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
    order = np.argsort(flat, kind="stable")
    return Block(ids, words, flat[order], item[order], place[order])


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark, item by item, in blocks of up to ``most`` words (a single item may have more).

    Items with a null item_id or without a word are left out. One block at a time is on the driver.
    """
    held, words = [], 0
    rows = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", text_of().alias("text")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        size = len(row["text"].split())
        if held and words + size > most:
            yield _block(held)
            held, words = [], 0
        held.append(row)
        words += size
    if held:
        yield _block(held)


def _grams(words: np.ndarray, shortest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words from first to last, hashes by place): pairs of neighbours, pairs around a word, single words if sought."""
    if shortest < GRAM:
        yield 1, gram_hashes(words, 1)
    yield 2, gram_hashes(words, GRAM)
    if len(words) > 2:
        yield 3, mix(words[:-2] * _PLACES[0] + words[2:] * _PLACES[1])


def _hits(column: pa.Array, sought: np.ndarray, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, its words, places of its pairs that are in ``sought``, their hashes), once for each row with any.

    ``sought`` is sorted. ``shortest`` is the number of words in the shortest item: an item of one
    word is sought as that word.
    """
    data, offsets = views(strings(column, lower=True))
    bits = _bitmap(sought)
    for low, high in runs(offsets):
        words, at = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        places, hashes = [], []
        for n, grams in _grams(words, shortest):
            maybe = np.flatnonzero(bits[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
            held = grams[maybe]
            real = sought[np.minimum(np.searchsorted(sought, held), len(sought) - 1)] == held
            maybe, held = maybe[real], held[real]
            inside = maybe + n <= at[np.searchsorted(at, maybe, "right")]
            places.append(maybe[inside]), hashes.append(held[inside])
        place, found = np.concatenate(places), np.concatenate(hashes)
        if len(place):
            order = np.argsort(place, kind="stable")
            place, found = place[order], found[order]
            doc = np.searchsorted(at, place, "right") - 1
            cut = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]
            for a, b in zip(cut[:-1], cut[1:]):
                d = int(doc[a])
                yield low + d, words[at[d] : at[d + 1]], place[a:b] - at[d], found[a:b]


BITS = 22


def _bitmap(sought: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITS, dtype=bool)
    bits[(sought >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return bits


def gram_counts(docs: DataFrame, block: Block) -> DataFrame:
    """(gram, n): how often each word pair of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((np.unique(block.grams), min(len(w) for w in block.words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, shortest = shared.value
        total = np.zeros(len(sought), dtype=np.int64)
        for batch in batches:
            for _, _, _, grams in _hits(batch.column("text"), sought, shortest):
                np.add.at(total, np.searchsorted(sought, grams), 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(sought[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    small_batches(docs.sparkSession)
    return docs.select(text_of().alias("text")).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def joints(size: int, share: float = SHARE) -> int:
    """Pairs of neighbour words of an item of ``size`` words that every alignment that counts holds.

    Let u of the L words be unmatched and the alignment cost E: 2 (L - u) - E >= 2 share L. Between
    the L - u matched words are L - u - 1 joints. A joint keeps its pair unless it skips a word of
    the item (u joints at most, which cost 1 or more) or has two or more words of the text too many
    (which cost 2 or more). The most joints are lost at u = 2/3 (1 - share) L, each skipping one
    word: u + u = 4/3 (1 - share) L.
    """
    return max(0, math.ceil(size - 1 - 4 / 3 * (1 - share) * size - 1e-9))


def seeds(block: Block, counts: dict[int, int], share: float = SHARE) -> np.ndarray:
    """Which of the block's word pairs are seeds.

    Of the pairs of an item that any alignment holds at least (``joints``), up to half as many are left out,
    the commonest in the corpus first; the others stay, so that an alignment keeps the other half.
    """
    seed = np.ones(len(block.grams), dtype=bool)
    order = np.lexsort((block.place, block.item))
    often = np.array([counts.get(int(g), 0) for g in block.grams[order].view(np.int64)])
    begin = np.flatnonzero(np.r_[True, np.diff(block.item[order]) > 0])
    for low, high in zip(begin, np.r_[begin[1:], len(order)]):
        spare = joints(len(block.words[block.item[order[low]]]), share) // 2
        own = np.ones(high - low, dtype=bool)
        for k in np.argsort(-often[low:high], kind="stable"):
            if not spare:
                break
            own[k] = False
            near = own[max(0, k - WINDOW + 1) : k + WINDOW]
            if any(not near[j : j + WINDOW].any() for j in range(len(near) - WINDOW + 1)):
                own[k] = True
            else:
                spare -= 1
        seed[order[low:high]] = own
    return seed


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: score, words of the item matched, first and last + 1 word of the text.

    Smith-Waterman with match 2, mismatch -1 and gap -1 a word. Row by row; a gap inside a row is
    a running maximum. Matched words and the start travel with the best way to each cell.
    """
    m = len(text)
    column = np.arange(m + 1)
    score, matched, start = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), column.copy()
    best = (0, 0, 0, 0)
    for word in item:
        same = text == word
        step = score[:-1] + np.where(same, MATCH, MISMATCH)
        drop = score[1:] + GAP
        diagonal = step >= drop
        cell = np.maximum(np.where(diagonal, step, drop), 0)
        hit = np.where(diagonal, matched[:-1] + same, matched[1:])
        begin = np.where(diagonal, start[:-1], start[1:])
        fresh = cell == 0
        hit, begin = np.where(fresh, 0, hit), np.where(fresh, column[1:], begin)
        # gaps along the row: each cell may come from the best cell before it, a gap a word
        level = cell - GAP * column[1:]
        source = np.maximum.accumulate(np.where(level == np.maximum.accumulate(level), np.arange(m), 0))
        run = level[source] + GAP * column[1:]
        far = run > cell
        cell, hit, begin = np.where(far, run, cell), np.where(far, hit[source], hit), np.where(far, begin[source], begin)
        score = np.r_[0, cell]
        matched, start = np.r_[0, hit], np.r_[0, begin]
        top = int(cell.argmax()) if m else 0
        if m and cell[top] > best[0]:
            best = (int(cell[top]), int(hit[top]), int(begin[top]), top + 1)
    return best


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, score, share, n_matched, first_word, last_word) of every document with a copy of an item.

    A row tells the best alignment of the pair: ``share`` is its score over the item's best
    possible one, the words of the text are counted from 0 and the end is exclusive. A pair
    counts if its share is ``share`` or more; an item of fewer than ``least`` words counts where it
    stands word for word, anywhere in the text, and one of a single word only as the whole text.
    Null and empty texts match nothing; rows with a null doc_id are left out; of rows that repeat a
    doc_id, the pair's best alignment counts. An empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    parts = [_of_block(spark, docs, b, share, least) for b in blocks(benchmark) if b.ids]
    schema = "doc_id bigint, item_id bigint, score bigint, share double, n_matched bigint, first_word bigint, last_word bigint"
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for other in parts[1:]:
        found = found.union(other)
    best = F.max(F.struct("score", "share", "n_matched", (-F.col("first_word")).alias("back"), "last_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", "best.share", "best.n_matched", (-F.col("best.back")).alias("first_word"), "best.last_word"
    )


def _of_block(spark: SparkSession, docs: DataFrame, block: Block, share: float, least: int) -> DataFrame:
    # as many rows as the block has distinct n-grams
    counts = {r["gram"]: r["n"] for r in gram_counts(docs, block).collect()}
    seed = seeds(block, counts, share)
    own = Block(block.ids, block.words, block.grams[seed], block.item[seed], block.place[seed])
    left_out = np.bincount(block.item[~seed], minlength=len(block.ids))
    need = np.array([max(1, joints(len(w), share) - n) for w, n in zip(block.words, left_out)])
    shared = spark.sparkContext.broadcast((own, need, np.unique(own.grams), min(len(w) for w in own.words)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, need, sought, shortest = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for row, words, places, grams in _hits(batch.column("text"), sought, shortest):
                for item, low, high in _stretches(bench, need, places, grams, len(words), share):
                    goal = MATCH * len(bench.words[item])
                    if MATCH * np.isin(bench.words[item], words[low:high]).sum() < share * goal:
                        continue  # no alignment can score enough
                    score, matched, first, last = align(bench.words[item], words[low:high])
                    short = len(bench.words[item]) < least
                    if score >= share * goal and (not short or score == goal and (goal > MATCH or len(words) == 1)):
                        rows.append((ids[row].as_py(), bench.ids[item], score, score / goal, matched, low + first, low + last))
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 3)],
                names=["doc_id", "item_id", "score", "share", "n_matched", "first_word", "last_word"],
            )

    schema = "doc_id bigint, item_id bigint, score bigint, share double, n_matched bigint, first_word bigint, last_word bigint"
    return docs.mapInArrow(find, schema)


def _stretches(bench: Block, need: np.ndarray, places: np.ndarray, grams: np.ndarray, size: int, share: float) -> Iterator[tuple[int, int, int]]:
    """(item, first, last) word ranges around a document's hits; ranges of one item that overlap become one.

    Ranges with hits of fewer seeds than the item's ``need`` are left out.
    """
    low = np.searchsorted(bench.grams, grams, "left")
    times = np.searchsorted(bench.grams, grams, "right") - low
    entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, item, place = np.repeat(places, times), bench.item[entry], bench.place[entry]
    kinds, which = np.unique(item, return_inverse=True)
    some = (np.bincount(np.unique(which * (int(place.max()) + 1) + place) // (int(place.max()) + 1), minlength=len(kinds)) >= need[kinds])[which]
    at, item, place = at[some], item[some], place[some]
    if not len(at):
        return
    length = np.array([len(bench.words[i]) for i in item])
    # words of the text that an alignment of the least score can have too many
    reach = np.ceil(MATCH * (1 - share) * length).astype(np.int64)
    first = np.maximum(0, at - place - reach)
    last = np.minimum(size, at - place + length + reach)
    order = np.lexsort((first, item))
    item, place, first, last = item[order], place[order], first[order], last[order]
    # ranges side by side, one item after the other
    base = item * (size + 1)
    far = np.maximum.accumulate(base + last)
    begin = np.flatnonzero(np.r_[True, base[1:] + first[1:] > far[:-1]])
    for a, b in zip(begin, np.r_[begin[1:], len(item)]):
        if len(np.unique(place[a:b])) >= need[item[a]]:
            yield int(item[a]), int(first[a]), int(last[a:b].max())
