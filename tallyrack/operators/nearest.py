"""Best items per user by inner product, in blocks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.operators.ranking import TOP_K, top_k

#: Rows of one side in one block at most; items of short vectors up to ``_SHORT`` times as many. A task holds one block
#: of users and one of items; each user is sent once per block of items and the other way round, so larger blocks shuffle less.
BLOCK_ROWS = 65_536
#: Numbers in a vector for which ``BLOCK_ROWS`` items fill a block, and how much larger a block of shorter ones may be.
_LONG, _SHORT = 64, 4
#: Blocks of all items, unless they would exceed their size, and blocks of users against blocks of items: what is sent
#: then grows with the rows only. A side is cut into no blocks smaller than ``_FEW`` rows unless asked to.
_ITEM_BLOCKS, _PAIRS, _FEW = 4, 48, 8192
#: Scores from which a step gets a task per block: below, adaptive execution puts blocks together.
_MANY = 1_000_000_000
#: Scores held at once inside a task, and items they are of at most.
_SCORES, _WIDE = 1_000_000, 512
#: The place of no item.
_NOWHERE = np.iinfo(np.int32).max
#: Cells of the approximate method at most: keeps the centre matrix small.
MAX_CELLS = 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column -> matrix with one row per entry."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def _set(flags: np.ndarray) -> np.ndarray:
    """Where few flags are set, as positions in the flat array: eight are looked at together."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


class _Best:
    """The ``k`` best items so far of each user of a block, best first; ties by the item's place.

    Scores are made some users and some columns at a time, in single precision and with what that may be off, and
    only those that may come before the kth best so far, and reach the user's ``least`` score, are made again in
    double precision: most scores cost a multiplication and one look at the largest of their row. Vectors
    that single precision can't hold are scored in double precision at once.
    """

    def __init__(
        self, users: np.ndarray, items: np.ndarray, k: int, digits: int | None, own: np.ndarray | None, least: np.ndarray
    ):
        self.users, self.items, self.digits, self.own, self.least = users, items, digits, own, least
        self.k = min(k, len(items))
        self.scores = np.full((len(users), self.k), -np.inf)
        self.places = np.full((len(users), self.k), _NOWHERE, np.int32)
        self.buffer = np.zeros(0)
        largest = [np.abs(x).max(initial=0.0) for x in (users, items)]
        if all(x == 0 or 1e-100 < x < 1e100 for x in largest):
            scales = [2.0 ** -math.frexp(x)[1] for x in largest]  # to numbers of 1 at most
            self.left, self.right = ((x * scale).astype(np.float32) for x, scale in zip((users, items), scales))
            longest = np.sqrt((items**2).sum(axis=1)).max(initial=0.0) * scales[1]
            lengths = np.sqrt((users**2).sum(axis=1)) * scales[0]
            self.off = (users.shape[1] + 8) * 2.0**-23 * lengths * longest + 2.0**-100
            self.scale = scales[0] * scales[1]
        else:
            self.left, self.right, self.off, self.scale = users, items, np.zeros(len(users)), 1.0
        self.right = np.ascontiguousarray(self.right.T)
        self.floor = np.empty(len(users), self.left.dtype)
        self._raise(slice(None))

    def _raise(self, rows: slice | np.ndarray) -> None:
        need = np.maximum(self.least[rows], self.scores[rows, -1])
        self.floor[rows] = _before_rounding(need, self.digits) * self.scale - self.off[rows]

    def add(self, first: int, last: int, places: np.ndarray, who: np.ndarray | None = None) -> None:
        """Score the items from ``first`` up to ``last`` for all users or the rows ``who``, which ascend."""
        rows = np.arange(len(self.users)) if who is None else who
        wide = min(last - first, _WIDE)
        step = max(1, _SCORES // max(wide, 1))
        if len(self.buffer) < min(step, len(rows)) * wide:
            self.buffer = np.empty(min(step, len(rows)) * wide, self.left.dtype)
        for start in range(0, len(rows), step):
            mine = rows[start : start + step]
            users, found, waiting = self.left[mine], [], 0
            for at in range(first, last, _WIDE):
                end = min(last, at + _WIDE)
                scores = self.buffer[: len(mine) * (end - at)].reshape(len(mine), end - at)
                with np.errstate(invalid="ignore", over="ignore"):
                    np.matmul(users, self.right[:, at:end], out=scores)
                    floor = self.floor[mine]
                    if at == first and end - at > self.k + 1 and not np.isfinite(floor).all():
                        floor = np.maximum(floor, self._beaten(mine, scores))
                    busy = np.flatnonzero(~(scores.max(axis=1) < floor))
                for new in self._reaching(mine, busy, scores, floor, at, places) if len(busy) else ():
                    found.append(new)
                    waiting += len(new[0])
                    if 4 * waiting >= self.k * len(mine):
                        self._keep(found)
                        found, waiting = [], 0
            if waiting:
                self._keep(found)

    def _beaten(self, mine: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """A floor that ``k`` of these scores reach: one more than that, as a user's own row may not count."""
        known = np.where(np.isnan(scores), -np.inf, scores)
        kth = np.partition(known, -(self.k + 1), axis=1)[:, -(self.k + 1)]
        kth = (kth - self.off[mine]) / self.scale
        return (_before_rounding(kth, self.digits) * self.scale - self.off[mine]).astype(scores.dtype)

    def _reaching(
        self, mine: np.ndarray, busy: np.ndarray, scores: np.ndarray, floor: np.ndarray, at: int, places: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(row, score, place)`` of the scores that come before a user's kth best."""
        some = scores if len(busy) == len(scores) else scores[busy]
        hits = _set(some >= floor[busy, None])  # a score that is no number ranks nowhere
        step = max(1, _SCORES // max(1, self.users.shape[1]))
        for start in range(0, len(hits), step):
            part, cols = np.divmod(hits[start : start + step], scores.shape[1])
            rows, cols = mine[busy[part]], cols + at
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.einsum("ij,ij->i", self.users[rows], self.items[cols])
                if self.digits is not None:
                    values = np.round(values, self.digits) + 0.0  # no negative zeros
            place, last = places[cols], self.scores[rows, -1]
            good = (values > last) | ((values == last) & (place < self.places[rows, -1]) & (values > -np.inf))
            good &= values >= self.least[rows]
            if self.own is not None:
                good &= place != self.own[rows]
            if good.any():
                yield rows[good], values[good], place[good]

    def _keep(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        rows, values, places = (np.concatenate(part) for part in zip(*found))
        who, which, counts = np.unique(rows, return_inverse=True, return_counts=True)
        which = np.concatenate([np.repeat(np.arange(len(who)), self.k), which])
        values = np.concatenate([self.scores[who].reshape(-1), values])
        places = np.concatenate([self.places[who].reshape(-1), places])
        order = np.lexsort((places, -values, which))
        starts = np.cumsum(counts + self.k) - (counts + self.k)
        kept = order[starts[:, None] + np.arange(self.k)]
        self.scores[who], self.places[who] = values[kept], places[kept]
        self._raise(who)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, place, score)``, each user's best first."""
        rows, rank = np.nonzero(self.scores > -np.inf)
        return rows, self.places[rows, rank], self.scores[rows, rank]


def _best_of(
    users: np.ndarray, items: np.ndarray, k: int, digits: int | None, own: np.ndarray | None, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, score)`` of each user's ``k`` best items that reach the user's ``least`` score; ties by column.

    The items are mixed first: ids that rise with the scores would make each item better than all before.
    """
    mixed = np.random.default_rng(0).permutation(len(items)).astype(np.int32)
    best = _Best(users, items[mixed], k, digits, own, least)
    best.add(0, len(items), mixed)
    return best.found()


def _before_rounding(bound: np.ndarray, digits: int | None) -> np.ndarray:
    """What a score must reach at least for its rounded value to reach the bound."""
    if digits is None:
        return bound
    known = np.isfinite(bound)
    return np.where(known, bound - 10.0**-digits - 1e-12 * np.abs(np.where(known, bound, 0.0)), bound)


def _best_in_block(
    users: pa.Table, items: pa.Table, k: int, digits: int | None, exclude_self: bool
) -> pa.Table:
    """Best ``k`` items of the block for each user of the block; ties by item id."""
    items = items.sort_by("item_id")
    own = None
    if exclude_self:
        place = {item: i for i, item in enumerate(items["item_id"].to_pylist())}
        own = np.array([place.get(user, -1) for user in users["user_id"].to_pylist()])
    least = np.full(users.num_rows, -np.inf)
    rows, cols, values = _best_of(_matrix(users["vector"]), _matrix(items["vector"]), k, digits, own, least)
    return pa.table(
        {
            "user_id": users["user_id"].take(pa.array(rows)),
            "item_id": items["item_id"].take(pa.array(cols)),
            "score": pa.array(values, pa.float64()),
        }
    )


def _best_in_cells(
    users: pa.Table, items: pa.Table, k: int, digits: int | None, exclude_self: bool
) -> pa.Table:
    """Best ``k`` items for each user among the items of the cells (``at``) whose bits are set in its ``cells``."""
    items = items.sort_by([("at", "ascending"), ("item_id", "ascending")])
    by_id = pc.sort_indices(items["item_id"]).to_numpy()
    place_of = np.empty(len(by_id), np.int32)
    place_of[by_id] = np.arange(len(by_id), dtype=np.int32)
    numbers, starts = np.unique(items["at"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], items.num_rows)
    asked = np.frombuffer(b"".join(users["cells"].to_pylist()), np.uint8).reshape(users.num_rows, -1).T.copy()
    own = None
    if exclude_self:
        place = dict(zip(items["item_id"].to_pylist(), place_of.tolist()))
        own = np.array([place.get(user, -1) for user in users["user_id"].to_pylist()])
    best = _Best(_matrix(users["vector"]), _matrix(items["vector"]), k, digits, own, users["least"].to_numpy())
    for number, start, end in zip(numbers, starts, ends):
        who = np.flatnonzero(asked[number >> 3] & (1 << (number & 7)))
        if len(who):
            best.add(start, end, place_of, who)
    rows, places, values = best.found()
    return pa.table(
        {
            "user_id": users["user_id"].take(pa.array(rows)),
            "item_id": items["item_id"].take(pa.array(by_id[places])),
            "score": pa.array(values, pa.float64()),
        }
    )


def _item_block(rows: int, dim: int, block_rows: int) -> int:
    """Items of one block, of ``rows`` in all."""
    most = BLOCK_ROWS * min(_SHORT, max(1, _LONG // max(1, dim)))
    return max(min(block_rows, _FEW), min(most, math.ceil(rows / _ITEM_BLOCKS)))


def _best_per_cell(
    users: DataFrame, items: DataFrame, k: int, block_rows: int, digits: int | None, exclude_self: bool
) -> DataFrame:
    """Score the users of each cell against its items, in blocks.

    A cell is cut into as many user parts and item parts as its row counts need, so a cell
    with a third of all rows is just more blocks. A block emits ``k`` rows per user. Blocks of ``block_rows``
    grow up to ``BLOCK_ROWS`` where there would be many of them. A cell may stand for
    several: then items have the number of theirs in ``at``, users a bit for each they ask for in ``cells``, and the
    score that counts for them in ``least``.
    """
    user_extra, item_extra = ([c for c in names if c in df.columns] for df, names in ((users, ("cells", "least")), (items, ("at",))))
    best = _best_in_cells if item_extra else _best_in_block

    def counted(side: DataFrame):
        # one row per cell: MAX_CELLS at most
        return {r.cell: r for r in side.groupBy("cell").agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim")).collect()}

    user_counts, item_counts = counted(users), counted(items)
    total = sum(i.rows for i in item_counts.values())
    both = [(cell, u.rows, item_counts[cell]) for cell, u in user_counts.items() if cell in item_counts]
    cut = [(cell, rows, math.ceil(i.rows / _item_block(total, i.dim, block_rows))) for cell, rows, i in both]
    few = min(block_rows, _FEW)
    size = max(few, min(BLOCK_ROWS, math.ceil(sum(rows * i_parts for _, rows, i_parts in cut) / _PAIRS)))
    sizes = [(cell, math.ceil(rows / size), i_parts) for cell, rows, i_parts in cut]
    scores = sum(rows * i.rows for _, rows, i in both)
    cell_type = users.schema["cell"].dataType.simpleString()
    parts = F.broadcast(users.sparkSession.createDataFrame(sizes, f"cell {cell_type}, u_parts int, i_parts int"))

    def part(key: str, parts_column: str):
        return F.pmod(F.xxhash64(key), F.col(parts_column)).cast("int")

    def every(parts_column: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts_column) - 1))

    block = ["cell", "u_part", "i_part"]
    user_blocks = (
        users.join(parts, "cell")
        .withColumn("u_part", part("user_id", "u_parts"))
        .select("user_id", "vector", *user_extra, "cell", "u_part", every("i_parts").alias("i_part"))
    )
    item_blocks = (
        items.join(parts, "cell")
        .withColumn("i_part", part("item_id", "i_parts"))
        .select("item_id", "vector", *item_extra, "cell", "i_part", every("u_parts").alias("u_part"))
    )
    if scores >= _MANY:  # a block is seconds of work, however few its bytes
        tasks = 2 * sum(u_parts * i_parts for _, u_parts, i_parts in sizes)
        user_blocks, item_blocks = (side.repartition(tasks, *block) for side in (user_blocks, item_blocks))
    schema = T.StructType(
        [
            T.StructField("user_id", users.schema["user_id"].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return best(left, right, k, digits, exclude_self)
        fields = [("user_id", left.schema.field("user_id").type), ("item_id", right.schema.field("item_id").type)]
        return pa.schema([*fields, ("score", pa.float64())]).empty_table()

    return user_blocks.groupBy(*block).cogroup(item_blocks.groupBy(*block)).applyInArrow(score, schema)


def learn_cells(items: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """Centres of the item vectors by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be in 1..{MAX_CELLS}")
    data = items.select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=cells, seed=seed).fit(data)
    return np.array(model.clusterCenters(), dtype=np.float64)


def _assigner(centres: np.ndarray, probes: int, id_name: str) -> Callable:
    """Rows -> one row per (id, cell) of the ``probes`` closest centres."""
    half_norms = 0.5 * (centres**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            # the nearest centre has the largest x.c - |c|^2 / 2
            closeness = _matrix(table["vector"]) @ centres.T - half_norms
            best = np.argsort(-closeness, axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
            repeated = table.take(rows)
            cell = pa.array(best.reshape(-1).astype(np.int32))
            for out in repeated.select([id_name, "vector"]).append_column("cell", cell).to_batches():
                yield out

    return assign


def _to_cells(df: DataFrame, id_name: str, centres: np.ndarray, probes: int) -> DataFrame:
    schema = T.StructType(
        [df.schema[id_name], df.schema["vector"], T.StructField("cell", T.IntegerType())]
    )
    return df.mapInArrow(_assigner(centres, probes, id_name), schema)


def nearest_items(
    users: DataFrame,
    items: DataFrame,
    k: int = TOP_K,
    method: str = "exact",
    cells: int | None = None,
    probes: int = 8,
    exclude_self: bool = False,
    digits: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = 0,
    spread: float | None = None,
) -> DataFrame:
    """``(user_id, rank, item_id, score)`` of the ``k`` items with the largest inner product.

    ``users(user_id, embedding)``, ``items(item_id, embedding)``. ``exact`` scores every item
    for every user, block against block. ``bounded`` gives the same rows but scores only the cells that
    may hold one of them, or fewer with a ``spread`` (``bounded.search``). ``cells`` groups items around k-means
    centres (256 by default) and scores only the ``probes`` closest cells of a user: less work, some items
    may be missed.
    ``digits`` rounds scores before they are ranked. A user meets the items whose vectors have the
    length of their own (with ``cells``: only vectors of the most frequent item length are used;
    ``ingest.check_dims`` gives the others). A score that is no number ranks nowhere.
    """
    if method == "bounded":
        from tallyrack.operators.bounded import search

        return search(users, items, k, cells, spread, exclude_self, digits, block_rows, seed).found
    users = users.where(F.col("embedding").isNotNull()).select("user_id", F.col("embedding").alias("vector"))
    vectors = items.where(F.col("embedding").isNotNull())
    named = vectors.select("item_id", F.col("embedding").alias("vector"))
    if method == "exact":
        # vectors of different lengths never meet
        user_cells = users.withColumn("cell", F.size("vector"))
        item_cells = named.withColumn("cell", F.size("vector"))
    elif method == "cells":
        usual = vectors.agg(F.mode(F.size("embedding"), True)).first()[0]
        right = F.size("vector") == F.lit(usual)
        users, named = users.where(right), named.where(right)
        centres = learn_cells(vectors.where(F.size("embedding") == F.lit(usual)), 256 if cells is None else cells, seed)
        user_cells = _to_cells(users, "user_id", centres, min(probes, len(centres)))
        item_cells = _to_cells(named, "item_id", centres, 1)
    else:
        raise ValueError(f"unknown method: {method}")
    found = _best_per_cell(user_cells, item_cells, k, block_rows, digits, exclude_self)
    return top_k(found, k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact top-K that the approximate result has."""
    hit = approximate.select("user_id", "item_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["user_id", "item_id"], "left").agg(
        F.count("*").alias("wanted"),
        F.count("hit").alias("found"),
        (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"),
    )


def pair_score(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Inner product of given (user, item) pairs; null when a vector is missing."""
    from tallyrack.functions.vectors import dot_batch
    from tallyrack.operators.skew import adaptive_join, salted_join

    user_side = users.select("user_id", F.col("embedding").alias("user_vector"))
    item_side = items.select("item_id", F.col("embedding").alias("item_vector"))
    both = salted_join(pairs, user_side, "user_id")
    both = adaptive_join(both, item_side, "item_id")
    score = dot_batch(F.col("user_vector"), F.col("item_vector"))
    return both.withColumn("score", score).drop("user_vector", "item_vector")
