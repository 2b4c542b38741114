"""Model jobs: training set, factor vectors, tower and cross-network inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.functions.hashing import fnv1a_bucket
from tallyrack.functions.vectors import or_zeros, pad
from tallyrack.operators.asof import DAY, asof_join, running_sums
from tallyrack.operators.numbering import number_rows
from tallyrack.operators.skew import salted_join

# Layer sizes of the served models.
ID_DIM, CATEGORY_DIM, PRICE_DIM, HIDDEN, EMBED_DIM = 64, 32, 32, 256, 128
CONTEXT_DIM = 32
NORM_EPS = 1e-5
#: Dense weights travel with the tasks, so their size is limited.
MAX_PARAM_BYTES = 256 << 20

POSITIVE = ("click", "purchase")
NEGATIVE = ("view",)


# Dense layers ----------------------------------------------------------------


@dataclass(frozen=True)
class Dense:
    """Weights of one layer: ``x @ w + b``, then optional ReLU and layer norm."""

    w: np.ndarray
    b: np.ndarray
    relu: bool = False
    gamma: np.ndarray | None = None
    beta: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.w + self.b
        if self.relu:
            y = np.maximum(y, 0.0)
        if self.gamma is not None:
            centred = y - y.mean(axis=1, keepdims=True)
            y = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + NORM_EPS)
            y = y * self.gamma + self.beta
        return y


@dataclass(frozen=True)
class Tower:
    """Dense part of a tower. Id vectors are a table and are joined, not held here."""

    layers: tuple[Dense, ...]
    categories: np.ndarray
    price: Dense | None = None


@dataclass(frozen=True)
class Cross:
    """One cross layer: several gated experts, or a single matrix without a gate."""

    experts: np.ndarray  # (experts, dim, dim)
    bias: np.ndarray
    gate: np.ndarray | None = None  # (dim, experts)

    def __call__(self, x0: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.gate is None:
            mixed = x @ self.experts[0]
        else:
            logits = x @ self.gate
            weight = np.exp(logits - logits.max(axis=1, keepdims=True))
            weight /= weight.sum(axis=1, keepdims=True)
            mixed = sum(weight[:, [e]] * (x @ m) for e, m in enumerate(self.experts))
        return x0 * mixed + self.bias + x


@dataclass(frozen=True)
class CrossNetwork:
    """Cross layers beside dense layers, then one output."""

    cross: tuple[Cross, ...]
    deep: tuple[Dense, ...]
    out: Dense
    dims: tuple[int, int, int] = (EMBED_DIM, EMBED_DIM, CONTEXT_DIM)
    sigmoid: bool = True

    def __call__(self, x0: np.ndarray) -> np.ndarray:
        crossed = x0
        for layer in self.cross:
            crossed = layer(x0, crossed)
        deep = x0
        for layer in self.deep:
            deep = layer(deep)
        score = self.out(np.concatenate([crossed, deep], axis=1))[:, 0]
        return 1.0 / (1.0 + np.exp(-score)) if self.sigmoid else score


def _check_size(*arrays: np.ndarray | None) -> None:
    total = sum(a.nbytes for a in arrays if a is not None)
    if total > MAX_PARAM_BYTES:
        raise ValueError(f"dense weights of {total} bytes exceed {MAX_PARAM_BYTES}")


def _random_dense(rng, n_in: int, n_out: int, relu: bool = False, norm: bool = False) -> Dense:
    edge = 1.0 / np.sqrt(n_in)
    return Dense(
        rng.uniform(-edge, edge, (n_in, n_out)),
        rng.uniform(-edge, edge, n_out),
        relu,
        np.ones(n_out) if norm else None,
        np.zeros(n_out) if norm else None,
    )


def new_tower(n_categories: int, with_price: bool, seed: int, id_dim: int = ID_DIM, dim: int = EMBED_DIM) -> Tower:
    """Untrained tower weights of the given sizes."""
    rng = np.random.default_rng(seed)
    width = id_dim + CATEGORY_DIM + (PRICE_DIM if with_price else 0)
    return Tower(
        (_random_dense(rng, width, HIDDEN, relu=True), _random_dense(rng, HIDDEN, dim, norm=True)),
        rng.standard_normal((n_categories, CATEGORY_DIM)),
        _random_dense(rng, 1, PRICE_DIM) if with_price else None,
    )


def new_cross_network(
    dims: tuple[int, int, int] = (EMBED_DIM, EMBED_DIM, CONTEXT_DIM),
    cross_layers: int = 2,
    deep: tuple[int, ...] = (256, 128),
    experts: int | None = None,
    deep_norm: bool = False,
    sigmoid: bool = True,
    seed: int = 0,
) -> CrossNetwork:
    """Untrained ranking weights. The defaults are the serving shape."""
    rng = np.random.default_rng(seed)
    n = sum(dims)
    cross = tuple(
        Cross(
            rng.standard_normal((experts or 1, n, n)) * 0.01,
            np.zeros(n),
            rng.uniform(-0.1, 0.1, (n, experts)) if experts else None,
        )
        for _ in range(cross_layers)
    )
    sizes = [n, *deep]
    layers = tuple(_random_dense(rng, a, b, relu=True, norm=deep_norm) for a, b in zip(sizes, sizes[1:]))
    return CrossNetwork(cross, layers, _random_dense(rng, n + sizes[-1], 1), dims, sigmoid)


# Batch inference -------------------------------------------------------------


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(array), dim)


def _list_column(matrix: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).reshape(-1)))


def _category_rows(index: pa.Array, categories: np.ndarray) -> np.ndarray:
    """Vectors of categories; a missing one, or one that the table doesn't have, counts as zeros."""
    at = pc.fill_null(index, -1).to_numpy(zero_copy_only=False)
    known = (at >= 0) & (at < len(categories))
    return np.where(known[:, None], categories[np.where(known, at, 0)], 0.0)


def _mean_categories(histories: pa.Array, categories: np.ndarray) -> np.ndarray:
    starts = np.asarray(histories.offsets)
    sums = np.add.reduceat(_category_rows(histories.flatten(), categories), starts[:-1] - starts[0], axis=0)
    return sums / np.diff(starts)[:, None]


def _tower_job(df: DataFrame, id_name: str, inputs: list[str], forward) -> DataFrame:
    """Run ``forward(columns) -> matrix`` on Arrow batches; row identity is kept."""
    schema = T.StructType([df.schema[id_name], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = forward({name: batch.column(name) for name in inputs})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_name), _list_column(out)], names=[id_name, "embedding"]
                )

    return df.select(id_name, *inputs).mapInArrow(run, schema)


def with_id_vectors(df: DataFrame, id_vectors: DataFrame, key: str, dim: int = ID_DIM) -> DataFrame:
    """Join the id-embedding table ``(key, id_vector)``; unknown ids get zeros."""
    joined = salted_join(df, id_vectors.select(key, "id_vector"), key)
    return joined.withColumn("id_vector", or_zeros(F.col("id_vector"), dim))


def embed_users(df: DataFrame, tower: Tower, hist_len: int = 5, id_dim: int = ID_DIM) -> DataFrame:
    """``(user_id, id_vector, category_hist)`` -> ``(user_id, embedding)``.

    Histories are padded with category 0 to ``hist_len``; longer ones are kept whole. Category
    0 is a real category of the mean, so the length is fixed rather than set per batch. A null entry, or
    a category that the tower does not know, adds zeros to the mean.
    """
    _check_size(tower.categories, *[layer.w for layer in tower.layers])
    padded = df.withColumn("category_hist", pad(F.coalesce(F.col("category_hist").cast("array<int>"), F.array().cast("array<int>")), max(hist_len, 1)))

    def forward(c: dict) -> np.ndarray:
        pooled = _mean_categories(c["category_hist"], tower.categories)
        x = np.concatenate([_matrix(c["id_vector"], id_dim), pooled], axis=1)
        for layer in tower.layers:
            x = layer(x)
        return x

    return _tower_job(padded, "user_id", ["id_vector", "category_hist"], forward)


def embed_items(df: DataFrame, tower: Tower, id_dim: int = ID_DIM) -> DataFrame:
    """``(item_id, id_vector, category_idx, price)`` -> ``(item_id, embedding)``.

    A null category, or one that the tower does not know, counts as a vector of zeros.
    """
    _check_size(tower.categories, *[layer.w for layer in tower.layers])

    def forward(c: dict) -> np.ndarray:
        price = c["price"].to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
        category = _category_rows(c["category_idx"], tower.categories)
        x = np.concatenate([_matrix(c["id_vector"], id_dim), category, tower.price(price)], axis=1)
        for layer in tower.layers:
            x = layer(x)
        return x

    typed = df.withColumn("category_idx", F.col("category_idx").cast("int")).withColumn(
        "price", F.col("price").cast("double")
    )
    return _tower_job(typed, "item_id", ["id_vector", "category_idx", "price"], forward)


def dcn_score(df: DataFrame, net: CrossNetwork) -> DataFrame:
    """Add ``model_score`` from ``user_vector, item_vector, context``.

    A row whose vectors do not have the expected lengths gets a null score.
    """
    _check_size(*[layer.experts for layer in net.cross], *[layer.w for layer in net.deep])
    names, dims = ["user_vector", "item_vector", "context"], net.dims
    ok = F.lit(True)
    for name, dim in zip(names, dims):
        ok = ok & (F.coalesce(F.size(name), F.lit(-1)) == dim)
    tagged = df.withColumn("_ok", ok)
    columns = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField("model_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            good = batch.column("_ok").to_numpy(zero_copy_only=False).astype(bool)
            scores = np.full(batch.num_rows, np.nan)
            if good.any():
                rows = batch.filter(pa.array(good))
                x0 = np.concatenate([_matrix(rows.column(n), d) for n, d in zip(names, dims)], axis=1)
                scores[good] = net(x0)
            kept = [batch.column(c) for c in columns]
            out = pa.array(scores, pa.float64(), mask=~good)
            yield pa.RecordBatch.from_arrays([*kept, out], names=[*columns, "model_score"])

    return tagged.mapInArrow(run, schema)


def model_ranker(users: DataFrame, items: DataFrame, net: CrossNetwork):
    """Ranker for the request cascade: candidates -> candidates with ``model_score``.

    The context vector is zero, as in the served model until context features exist.
    """
    from tallyrack.functions.vectors import zeros
    from tallyrack.operators.candidates import attach_vectors

    def rank(candidates: DataFrame) -> DataFrame:
        ready = attach_vectors(candidates, users, items, net.dims[0])
        ready = ready.withColumn("context", zeros(net.dims[2]))
        return dcn_score(ready, net).drop("user_vector", "item_vector", "context")

    return rank


# Training --------------------------------------------------------------------


def training_set(events: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Labelled interactions with user and item features: click or purchase 1, view 0."""
    label = F.when(F.col("event_type").isin(*POSITIVE), 1.0).when(F.col("event_type").isin(*NEGATIVE), 0.0)
    labelled = events.select("event_id", "user_id", "item_id", label.alias("label")).where(
        F.col("label").isNotNull()
    )
    with_users = salted_join(labelled, users, "user_id")
    return salted_join(with_users, items, "item_id", hot_from=labelled)


def training_set_as_of(events: DataFrame, width_seconds: int = DAY) -> DataFrame:
    """Labelled interactions with the features as they stood before each: nothing of the event itself or after it.

    ``total_clicks``, ``total_views`` of the user, ``click_count``, ``ctr`` of the item, over all events of
    earlier instants; 0 where there are none. Events without a user, item or instant count zeros.
    """
    def n(event_type: str) -> Column:
        return F.count_if(F.col("event_type") == event_type)

    users = running_sums(events, "user_id", {"total_clicks": n("click"), "total_views": n("view")}, width_seconds=width_seconds)
    items = running_sums(events, "item_id", {"click_count": n("click"), "view_count": n("view")}, width_seconds=width_seconds)
    label = F.when(F.col("event_type").isin(*POSITIVE), 1.0).when(F.col("event_type").isin(*NEGATIVE), 0.0)
    labelled = events.select("event_id", "user_id", "item_id", "ts", label.alias("label")).where(F.col("label").isNotNull())
    known = asof_join(labelled, users, "user_id", ["total_clicks", "total_views"], width_seconds=width_seconds)
    known = asof_join(known, items, "item_id", ["click_count", "view_count"], width_seconds=width_seconds)
    known = known.na.fill(0, ["total_clicks", "total_views", "click_count", "view_count"])
    return known.withColumn("ctr", F.col("click_count") / F.greatest("view_count", F.lit(1))).drop("view_count")


def is_training(key: Column, share: int = 80) -> Column:
    """Repeatable split: true for ``share`` percent of the keys."""
    return fnv1a_bucket(key) < share


def split(df: DataFrame, key: str, share: int = 80) -> tuple[DataFrame, DataFrame]:
    return df.where(is_training(F.col(key), share)), df.where(~is_training(F.col(key), share))


def learn_vectors(
    strengths: DataFrame, rank: int = 16, iterations: int = 5, alpha: float = 10.0, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Implicit-feedback factors of ``(user_id, item_id, strength)``.

    Returns ``(user_id, embedding)`` and ``(item_id, embedding)``. Ids are replaced by dense
    numbers for the solver and put back afterwards.
    """
    from pyspark.ml.recommendation import ALS

    from tallyrack.session import checkpoint_dir

    checkpoint_dir(strengths.sparkSession)
    users = number_rows(strengths.select("user_id").distinct(), ["user_id"], "u")
    items = number_rows(strengths.select("item_id").distinct(), ["item_id"], "i")
    ready = salted_join(strengths, users, "user_id", "inner")
    ready = salted_join(ready, items, "item_id", "inner", hot_from=strengths)
    als = ALS(
        rank=rank, maxIter=iterations, implicitPrefs=True, alpha=alpha, seed=seed,
        userCol="u", itemCol="i", ratingCol="strength", checkpointInterval=2,
    )
    model = als.fit(ready.select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("strength").cast("float")))

    def named(factors: DataFrame, ids: DataFrame, number: str, name: str) -> DataFrame:
        vectors = factors.select(F.col("id").cast("bigint").alias(number), F.col("features").alias("embedding"))
        return ids.join(vectors, number).select(name, "embedding")

    return named(model.userFactors, users, "u", "user_id"), named(model.itemFactors, items, "i", "item_id")


def bce(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy on logits."""
    x, y = F.col(logit), F.col(label)
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return df.agg(F.avg(loss).alias("loss"), F.count("*").alias("rows"))


# Parameter table -------------------------------------------------------------


def save_params(spark, path: str, arrays: dict[str, np.ndarray]) -> None:
    """Store named weight arrays as rows ``(name, shape, data)``."""
    rows = [(n, [int(s) for s in a.shape], [float(v) for v in a.reshape(-1)]) for n, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.mode(
        "overwrite"
    ).parquet(path)


def load_params(spark, path: str) -> dict[str, np.ndarray]:
    """Read stored weights, after checking their total size."""
    table = spark.read.parquet(path)
    size = table.agg(F.sum(F.size("data") * 8)).first()[0] or 0
    if size > MAX_PARAM_BYTES:
        raise ValueError(f"dense weights of {size} bytes exceed {MAX_PARAM_BYTES}")
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in table.collect()}
