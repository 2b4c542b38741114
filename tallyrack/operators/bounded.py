"""Best items per user by inner product, leaving out the cells that a bound rules out.

The largest inner product is made a smallest distance by one more coordinate: with ``M`` the
longest item, an item ``x`` becomes ``(x, sqrt(M^2 - |x|^2))``, so all items lie on one sphere and a
user ``u`` becomes ``(u, 0)``. Cells of the items there gather equal directions and equal lengths. A first pass
scores a user's most promising cells and gives the score a further item must reach; the second
sends the user only to the cells that may hold such an item. Neighbouring cells travel in one group, so a
user is sent once per group and not once per cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.operators.nearest import _FEW, BLOCK_ROWS, MAX_CELLS, _best_per_cell, _item_block, _matrix, _set
from tallyrack.operators.ranking import TOP_K, top_k
from tallyrack.operators.skew import adaptive_join
from tallyrack.session import cut_lineage

#: Items the centres are learned from at most; every item is placed in a cell.
FIT_ROWS = 1_000_000
#: Flags of cells held at once inside a task, and bounds.
_FLAGS, _BOUNDS = 2_000_000, 131_072
#: Groups of the first pass, in which most users ask for one cell and so go to one group anyway.
_FIRST_GROUPS = 48
#: Distances to centres from which rows are dealt out to all cores first: few bytes of vectors are much work.
_MANY = 100_000_000
#: Rounds in which centres move to the middle of their items.
_ROUNDS = 10


class Search(NamedTuple):
    """A search's lists and what it scored: cells per user, items per cell."""

    found: DataFrame
    probed: DataFrame
    cell_rows: DataFrame


class _Cells(NamedTuple):
    """What a bound needs of every cell that has items, by number. One row per cell: ``MAX_CELLS`` at most."""

    numbers: np.ndarray
    centres: np.ndarray
    rows: np.ndarray
    reach: np.ndarray  # how far an item may lie from its centre
    typical: np.ndarray  # how far along one direction it usually does
    longest: np.ndarray
    order: np.ndarray  # the cells group by group: neighbouring cells together
    starts: np.ndarray  # where each group begins there, and where the last ends


def _all_numbers(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))


def _finite(vector: str) -> Column:
    return F.forall(vector, lambda x: F.abs(x) < float("inf"))


def _square(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _learn(items: DataFrame, n: int, dim: int, longest: float, cells: int | None, seed: int) -> np.ndarray:
    """Centres of the lifted items, by k-means from some of them. Users have no last coordinate."""
    wanted = min(MAX_CELLS, math.ceil(2 * math.sqrt(n))) if cells is None else cells
    if not 1 <= wanted <= MAX_CELLS:
        raise ValueError(f"cells must be in 1..{MAX_CELLS}")
    lift = F.sqrt(F.greatest(F.lit(longest) - _square("vector"), F.lit(0.0)))
    lifted = items.select(F.concat(F.col("vector").cast("array<double>"), F.array(lift)).alias("vector"))
    if n > FIT_ROWS:
        lifted = lifted.sample(FIT_ROWS / n, seed)
    lifted = cut_lineage(lifted.distinct())  # a centre each; read in every round
    drawn = lifted.orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(wanted).toArrow()
    if drawn.num_rows < 2:
        return np.zeros((1, dim + 1))
    centres = _matrix(drawn["vector"])
    for _ in range(_ROUNDS):
        sums = lifted.mapInArrow(_adder(centres), "cell int, rows bigint, total array<double>")
        each = sums.select("cell", "rows", F.posexplode("total").alias("at", "total"))
        found = each.groupBy("cell", "at").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).toArrow()
        at = found["cell"].to_numpy(), found["at"].to_numpy()
        moved = centres.copy()
        moved[at] = found["total"].to_numpy() / found["rows"].to_numpy()
        if np.allclose(moved, centres, rtol=0, atol=1e-4 * math.sqrt(longest)):
            return moved
        centres = moved
    return centres


def _adder(centres: np.ndarray) -> Callable:
    """Lifted items -> how many are nearest to each centre, and their sum. A nearly nearest centre will do."""
    half_norms = (0.5 * (centres**2).sum(axis=1)).astype(np.float32)
    turned = np.ascontiguousarray(centres.T.astype(np.float32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        step = max(1, 2 * _BOUNDS // len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.chunked_array([batch["vector"]]))
            near = [np.argmax(x[i : i + step].astype(np.float32) @ turned - half_norms, axis=1) for i in range(0, len(x), step)]
            cell = np.concatenate(near)
            order = np.argsort(cell, kind="stable")
            some, starts, counts = np.unique(cell[order], return_index=True, return_counts=True)
            total[some] += np.add.reduceat(x[order], starts, axis=0)
            rows[some] += counts
        some = np.flatnonzero(rows)
        sums = pa.array(list(total[some]), pa.list_(pa.float64()))
        yield pa.record_batch({"cell": pa.array(some.astype(np.int32)), "rows": pa.array(rows[some]), "total": sums})

    return add


def _placer(centres: np.ndarray, longest: float) -> Callable:
    """Items -> their cell, the distance to its centre and their own length."""
    half_norms = 0.5 * (centres**2).sum(axis=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            x = _matrix(table["vector"])
            squares = (x**2).sum(axis=1)
            lift = np.sqrt(np.maximum(longest - squares, 0.0))
            cell = np.empty(len(x), np.int32)
            away = np.empty(len(x))
            step = max(1, _BOUNDS // len(centres))
            for start in range(0, len(x), step):
                part = slice(start, start + step)
                lifted = np.column_stack([x[part], lift[part]])
                cell[part] = np.argmax(lifted @ centres.T - half_norms, axis=1)
                # users have no last coordinate, so only the others count in a bound
                away[part] = np.sqrt(((x[part] - centres[cell[part], :-1]) ** 2).sum(axis=1))
            table = table.append_column("cell", pa.array(cell)).append_column("away", pa.array(away))
            yield from table.append_column("length", pa.array(np.sqrt(squares))).to_batches()

    return place


def _groups(centres: np.ndarray, rows: np.ndarray, block_rows: int) -> np.ndarray:
    """Cells -> their group: cut along the widest coordinate until a group fits a block or is one cell.

    The cut leaves whole blocks on its first side, so that groups are nearly full and there are few of them.
    """
    group, found, left = np.zeros(len(rows), np.int32), 0, [np.arange(len(rows))]
    while left:
        cells = left.pop()
        if len(cells) == 1 or rows[cells].sum() <= block_rows:
            group[cells] = found
            found += 1
        else:
            widest = np.argmax(np.ptp(centres[cells], axis=0))
            cells = cells[np.argsort(centres[cells, widest], kind="stable")]
            blocks = math.ceil(rows[cells].sum() / block_rows)
            cut = np.searchsorted(np.cumsum(rows[cells]), blocks // 2 * block_rows, side="right")
            cut = min(max(cut, 1), len(cells) - 1)
            left += [cells[:cut], cells[cut:]]
    return group


def _measure(placed: DataFrame, centres: np.ndarray, block_rows: int) -> tuple[_Cells, _Cells]:
    """The cells in small groups for the first pass, and in groups of a block of items."""
    measured = (
        placed.where("cell >= 0")
        .groupBy("cell")
        .agg(
            F.count("*").alias("rows"),
            F.max("away").alias("reach"),
            F.sqrt(F.avg(F.col("away") * F.col("away"))).alias("typical"),
            F.max("length").alias("longest"),
        )
        .orderBy("cell")
        .collect()  # one row per cell
    )
    numbers, rows = (np.array([r[c] for r in measured], np.int64) for c in ("cell", "rows"))
    reach, typical, longest = (np.array([r[c] for r in measured], np.float64) for c in ("reach", "typical", "longest"))
    dim = centres.shape[1] - 1
    centres, typical = centres[numbers, :-1], typical / math.sqrt(dim)
    block = _item_block(rows.sum(), dim, block_rows)

    def grouped(size: int) -> _Cells:
        group = _groups(centres, rows, size)
        order = np.argsort(group, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(group)))
        return _Cells(numbers, centres, rows, reach, typical, longest, order, starts)

    return grouped(max(min(block_rows, _FEW), min(block, math.ceil(rows.sum() / _FIRST_GROUPS)))), grouped(block)


def _chooser(cells: _Cells, k: int, spread: float | None, slack: float, again: bool) -> Callable:
    """Users -> flags of the cells of the first pass, or with ``again`` of those that their ``floor`` asks for."""
    reach = cells.reach if spread is None else np.minimum(cells.reach, spread * cells.typical)
    beside = 1e-9 * (cells.longest + cells.reach)
    promising = np.column_stack([cells.centres, 2 * cells.typical]).T.copy()
    reaching = np.column_stack([cells.centres, reach + beside]).T.copy()

    def choose(users: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
        length = np.sqrt((users**2).sum(axis=1))[:, None]
        users = np.column_stack([users, length])
        promise = users @ promising
        first = np.zeros(promise.shape, bool)
        top = promise.argmax(axis=1)
        first[np.arange(len(top)), top] = True
        small = np.flatnonzero(cells.rows[top] < k + 1)
        if len(small):
            # one more than k, as a user's own row may not count; that many cells hold so many rows
            part = promise[small]
            most = min(k + 1, part.shape[1])
            order = np.argpartition(-part, most - 1, axis=1)[:, :most]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(part, order, axis=1), axis=1, kind="stable"), axis=1)
            before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
            some = np.zeros(part.shape, bool)
            np.put_along_axis(some, order, before < k + 1, axis=1)
            first[small] = some
        if not again:
            return first
        need = (floor - slack - 1e-9)[:, None]
        asked = users @ reaching >= need
        asked &= length * (cells.longest + beside) >= need
        asked &= ~first
        return asked

    return choose


def _chosen(cells: _Cells, choose: Callable, make: Callable) -> Callable:
    """Batches of users -> what ``make`` makes of some of them, the flags of their cells and their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, little = (max(1, most // len(cells.rows)) for most in (_FLAGS, _BOUNDS))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                table = pa.Table.from_batches([batch.slice(start, step)])
                x, floor = _matrix(table["vector"]), np.full(table.num_rows, -np.inf)
                if "floor" in table.column_names:
                    floor = table["floor"].fill_null(-np.inf).to_numpy()
                flags = [choose(x[i : i + little], floor[i : i + little]) for i in range(0, len(x), little)]
                yield from make(table, np.concatenate(flags), floor).to_batches()

    return run


def _bits(flags: np.ndarray) -> list[bytes]:
    """Rows of flags -> a bit each."""
    return [row.tobytes() for row in np.packbits(flags, axis=1, bitorder="little")]


def _sent(users: DataFrame, cells: _Cells, choose: Callable) -> DataFrame:
    """Users -> a row per group of cells, with a bit in ``cells`` for each that they ask for in it."""

    def make(table: pa.Table, flags: np.ndarray, floor: np.ndarray) -> pa.Table:
        rows, group, bits, by_group = [], [], [], flags[:, cells.order]
        for number, (start, end) in enumerate(zip(cells.starts[:-1], cells.starts[1:])):
            who = np.flatnonzero(by_group[:, start:end].any(axis=1))
            rows.append(who)
            group.append(np.full(len(who), number, np.int32))
            bits += _bits(by_group[who, start:end])
        rows = np.concatenate(rows)
        out = table.select(["user_id", "vector"]).take(pa.array(rows)).append_column("cells", pa.array(bits, pa.binary()))
        return out.append_column("cell", pa.array(np.concatenate(group))).append_column("least", pa.array(floor[rows]))

    fields = [users.schema["user_id"], users.schema["vector"], T.StructField("cells", T.BinaryType())]
    fields += [T.StructField("cell", T.IntegerType()), T.StructField("least", T.DoubleType())]
    return users.mapInArrow(_chosen(cells, choose, make), T.StructType(fields))


def _named(users: DataFrame, cells: _Cells, choose: Callable) -> DataFrame:
    """Users -> ``(user_id, cells)``, the numbers of the cells that they ask for."""

    def make(table: pa.Table, flags: np.ndarray, floor: np.ndarray) -> pa.Table:
        named = cells.numbers[_set(flags) % flags.shape[1]]
        ends = np.append(0, np.cumsum(flags.sum(axis=1)))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(named.astype(np.int32)))
        return table.select(["user_id"]).append_column("cells", lists)

    fields = [users.schema["user_id"], T.StructField("cells", T.ArrayType(T.IntegerType()))]
    return users.mapInArrow(_chosen(cells, choose, make), T.StructType(fields))


def search(
    users: DataFrame,
    items: DataFrame,
    k: int = TOP_K,
    cells: int | None = None,
    spread: float | None = None,
    exclude_self: bool = False,
    digits: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = 0,
) -> Search:
    """The ``k`` best items of each user, with what was scored for them.

    ``users(user_id, embedding)``, ``items(item_id, embedding)``; rows as ``nearest_items(method="exact")``
    gives them, ties too. ``cells`` (by default twice the root of the number of items, 4,096 at most) are
    learned from at most ``FIT_ROWS`` items and take all of them in. With a ``spread`` a cell counts as no
    wider than that many times its usual extent along one direction: fewer cells are
    scored and some items may be missed. Vectors of another length than most items have, and infinite ones,
    meet all of theirs. Null vectors and vectors with a null or NaN take no part, as their
    scores are no numbers.
    """
    users = users.select("user_id", F.col("embedding").alias("vector")).where(_all_numbers("vector"))
    items = items.select("item_id", F.col("embedding").alias("vector")).where(_all_numbers("vector"))
    sizes = items.where(_finite("vector")).groupBy(F.size("vector").alias("size"))
    usual = sizes.agg(F.count("*").alias("n"), F.max(_square("vector")).alias("longest")).orderBy(F.desc("n"), "size").first()
    dim, n, longest = usual if usual else (-1, 0, 0.0)
    in_cells = _finite("vector") & (F.size("vector") == dim) & (F.size("vector") > 0)
    apart = (-1 - F.size("vector")).alias("cell")  # a number that no cell has, the same for equal lengths
    rest = items.where(~in_cells).select("item_id", "vector", apart)
    everyone = users.select("user_id", "vector", apart)
    if n == 0 or dim == 0:
        found = top_k(_best_per_cell(everyone, rest, k, block_rows, digits, exclude_self), k)
        return Search(found, everyone.select("user_id", "cell"), rest.groupBy("cell").agg(F.count("*").alias("rows")))

    indexed = items.where(in_cells)
    centres = _learn(indexed, n, dim, longest, cells, seed)
    plain = users.where(in_cells)
    if n * len(centres) >= _MANY:
        tasks = 2 * users.sparkSession.sparkContext.defaultParallelism
        indexed, plain = indexed.repartition(tasks), plain.repartition(tasks)
    fields = [T.StructField("cell", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("away", "length"))]
    placed = indexed.mapInArrow(_placer(centres, longest), T.StructType([*indexed.schema.fields, *fields]))
    placed = cut_lineage(placed.unionByName(rest, allowMissingColumns=True))  # read three times
    cells_first, cells_more = _measure(placed, centres, block_rows)

    def grouped(cells: _Cells) -> DataFrame:
        """A row per cell: its group, and its bit there."""
        spans = enumerate(zip(cells.starts[:-1], cells.starts[1:]))
        bits = [(int(cells.numbers[cells.order[i]]), number, int(i - start)) for number, (start, end) in spans for i in range(start, end)]
        return F.broadcast(users.sparkSession.createDataFrame(bits, "cell int, grouped int, bit int"))

    def scored(sent: DataFrame, cells: _Cells) -> DataFrame:
        item_cells = placed.join(grouped(cells), "cell", "left").select(
            "item_id", "vector", F.coalesce("bit", F.lit(0)).alias("at"), F.coalesce("grouped", "cell").alias("cell")
        )
        return _best_per_cell(sent, item_cells, k, block_rows, digits, exclude_self)

    slack = 0.0 if digits is None else 10.0**-digits
    infinite = users.where(~_finite("vector") & (F.size("vector") == dim))
    any_score = F.lit(float("-inf")).alias("least")
    full = [(number, *_bits(np.ones((1, size), bool))) for number, size in enumerate(np.diff(cells_first.starts))]
    whole = F.broadcast(users.sparkSession.createDataFrame(full, "cell int, cells binary"))  # one row per group
    everywhere = infinite.crossJoin(whole).select("user_id", "vector", "cells", "cell", any_score)
    outside = everyone.select("user_id", "vector", F.lit(b"\x01").alias("cells"), "cell", any_score)
    choose_first = _chooser(cells_first, k, spread, slack, False)
    first = _sent(plain, cells_first, choose_first).unionByName(outside).unionByName(everywhere)
    best = cut_lineage(top_k(scored(first, cells_first), k))  # k rows per user; read twice
    floors = best.where(F.col("rank") == k).select("user_id", F.col("score").alias("floor"))
    asked = adaptive_join(plain, floors, "user_id")
    choose_more = _chooser(cells_more, k, spread, slack, True)
    more = _sent(asked, cells_more, choose_more)
    found = top_k(best.drop("rank").unionByName(scored(more, cells_more)), k)
    named = _named(plain, cells_first, choose_first).unionByName(_named(asked, cells_more, choose_more))
    probed = named.select("user_id", F.explode("cells").alias("cell")).unionByName(everyone.select("user_id", "cell"))
    probed = probed.unionByName(infinite.crossJoin(grouped(cells_first)).select("user_id", "cell"))
    return Search(found, probed, placed.groupBy("cell").agg(F.count("*").alias("rows")))


def share_scored(done: Search, users: DataFrame, items: DataFrame) -> DataFrame:
    """``(pairs, scored, share)``: how many of all (user, item) pairs a search had to score."""
    per_cell = done.probed.groupBy("cell").agg(F.count("*").alias("users"))
    scored = per_cell.join(done.cell_rows, "cell").agg(F.coalesce(F.sum(F.col("users") * F.col("rows")), F.lit(0)).alias("scored"))
    sides = users.agg(F.count("*").alias("u")).crossJoin(items.agg(F.count("*").alias("i")))  # two single rows
    return sides.crossJoin(scored).select(
        (F.col("u") * F.col("i")).alias("pairs"),
        "scored",
        (F.col("scored") / F.greatest(F.col("u") * F.col("i"), F.lit(1))).alias("share"),
    )
