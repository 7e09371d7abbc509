"""Factor tables, and what all factor models share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.vectors import has_nan
from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions
from tastegrid.operators.topk import check_lists, score_top
from tastegrid.sources import store

#: Bytes of a factor matrix up to which it is held by the driver and broadcast.
BROADCAST_BYTES = 256 << 20
FACTORS = "id bigint, features array<float>"


class ModelFitError(Exception):
    """A fit ended in factors that are not numbers."""


def seeded(seed: int, salt: int, n: int, k: int) -> np.ndarray:
    """n x k numbers in [0, 1); each depends on the seed and its place alone."""
    return seeded_rows(seed, salt, np.arange(n), k)


def seeded_rows(seed: int, salt: int, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows `ids` of seeded."""
    with np.errstate(over="ignore"):
        places = (ids.astype(np.uint64)[:, None] * np.uint64(k) + np.arange(k, dtype=np.uint64)).ravel()
    return _uniform(places, seed, salt).reshape(len(ids), k)


def seeded_draws(seed: int, salt: int, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """counts[i] numbers in [0, 1) for each of ids, one after the other; each depends on the seed, the id and its place alone."""
    ends = np.cumsum(counts)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    with np.errstate(over="ignore"):
        # Mixed once more, so that ids and places do not run into each other.
        own = _mixed(ids.astype(np.uint64) + np.uint64(1))
        return _uniform(np.repeat(own, counts) + place.astype(np.uint64), seed, salt)


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = z * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def _uniform(places: np.ndarray, seed: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = _mixed(places + np.uint64((seed * 0x9E3779B97F4A7C15 + salt * 0xD1B54A32D192ED03) & (1 << 64) - 1))
    return (z >> np.uint64(11)).astype(np.float64) / (1 << 53)


def seeded_normal(seed: int, salt: int, n: int, k: int) -> np.ndarray:
    return seeded_normal_rows(seed, salt, np.arange(n), k)


def seeded_normal_rows(seed: int, salt: int, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows `ids` of seeded_normal."""
    u, v = seeded_rows(seed, salt, ids, k), seeded_rows(seed, salt + 1, ids, k)
    return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)


def to_df(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A matrix as a factor table; the row's number is the id."""
    m = np.ascontiguousarray(matrix, np.float32)
    features = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(m), dtype=np.int64)), "features": features}), FACTORS)


def to_matrix(df: DataFrame, n: int, k: int) -> np.ndarray:
    """A factor table below BROADCAST_BYTES as a matrix; ids without a row are zero."""
    if n * k * 4 > BROADCAST_BYTES:
        raise ValueError("the factor table is too large for one machine")
    out = np.zeros((n, k), np.float32)
    table = df.select("id", "features").toArrow()
    if table.num_rows:
        ids = table.column("id").to_numpy()
        out[ids] = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def gramian(factors: DataFrame, k: int) -> np.ndarray:
    """The sum of the outer products of all factors: k x k, added up in the partitions first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, k)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    # k * k sums, whatever the number of factors.
    rows = factors.select("features").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(k * k)
    for r in rows:
        out[r["cell"]] = r["value"]
    return out.reshape(k, k)


def ensure_finite(factors: DataFrame) -> None:
    if not factors.where(has_nan(F.col("features"))).isEmpty():
        raise ModelFitError("NaN in the factors")


def segments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal ids begins, and the ids."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return starts, ids[starts]


def by_user(x: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Entries hash-partitioned by user and in order within a partition."""
    columns = columns or [USER, ITEM, WEIGHT]
    return x.select(*columns).repartition(USER).sortWithinPartitions(USER, ITEM)


def whole_groups(kernel: Callable, most: int = 200_000) -> Callable:
    """A function on Arrow batches that calls kernel(columns) on rows of whole users, about `most` at a time; rows come in order of the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([_column(c) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                if cut:
                    yield from kernel([c[:cut] for c in columns])
                held, n = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if n:
            yield from kernel([np.concatenate(c) for c in zip(*held)])

    return run


def group_rows(k: int, size: int = 8 << 20) -> int:
    """Rows of k numbers, ids and weights that a kernel is given at a time: about `size` bytes, however few the factors."""
    return max(1000, size // (8 * (k + 4)))


def _column(c: pa.Array) -> np.ndarray:
    if pa.types.is_list(c.type):
        flat = np.asarray(c.flatten().to_numpy(zero_copy_only=False))
        return flat.reshape(len(c), -1)
    return np.asarray(c.to_numpy(zero_copy_only=False))


def factor_batch(ids: np.ndarray, x: np.ndarray, kind: type = np.float32) -> pa.RecordBatch:
    m = np.ascontiguousarray(x, kind)
    features = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)), features], ["id", "features"])


class FactorModel:
    """Queries on user and item factors (id, features)."""

    kind = "factors"
    can_recalculate = False

    def __init__(self):
        self.user_factors: DataFrame | None = None
        self.item_factors: DataFrame | None = None
        self.digits: int | None = None

    def _fitted(self) -> tuple[DataFrame, DataFrame]:
        if self.user_factors is None or self.item_factors is None:
            raise ValueError("the model is not fitted")
        return self.user_factors, self.item_factors

    def recalculate_users(self, x: Interactions) -> DataFrame:
        raise NotImplementedError(f"{self.kind} cannot recalculate users")

    def recalculate_items(self, x: Interactions) -> DataFrame:
        raise NotImplementedError(f"{self.kind} cannot recalculate items")

    def recommend(
        self,
        users: DataFrame | None,
        x: Interactions | None = None,
        N: int = 10,
        filter_already_liked_items: bool = True,
        recalculate_user: bool = False,
        allow: DataFrame | None = None,
        deny: DataFrame | None = None,
    ) -> DataFrame:
        """user_id, rank, item_id, score.  users (user_id): whom to serve, all if None; x: their histories."""
        own, items = self._fitted()
        check_lists(allow, deny, items)
        if (filter_already_liked_items or recalculate_user) and x is None:
            raise ValueError("histories are needed to filter or to recalculate")
        if recalculate_user:
            history = x if users is None else x.with_df(x.df.join(users.select(USER).distinct(), USER, "left_semi"))
            own = self.recalculate_users(history)
        queries = own if users is None else own.join(users.select(F.col(USER).alias("id")).distinct(), "id", "left_semi")
        liked = None
        if filter_already_liked_items:
            liked = x.df.join(queries.select(F.col("id").alias(USER)), USER, "left_semi").select(F.col(USER).alias("query_id"), F.col(ITEM).alias("id"))
        top = score_top(queries, items, N, liked=liked, allow=allow, deny=deny, digits=self.digits)
        return top.select(F.col("query_id").alias(USER), "rank", F.col("id").alias(ITEM), "score")

    def rank_items(self, users: DataFrame, items: DataFrame) -> DataFrame:
        """The given items in order for each user."""
        return self.recommend(users, None, max(1, items.select("id").distinct().count()), filter_already_liked_items=False, allow=items)

    def similar_items(self, items: DataFrame, N: int = 10, recalculate_item: bool = False, item_users: Interactions | None = None, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
        """query_id, rank, id, score by cosine, the item itself included; items: id."""
        _, own = self._fitted()
        check_lists(allow, deny, own)
        source = self.recalculate_items(item_users) if recalculate_item else own
        queries = source.join(items.select("id").distinct(), "id", "left_semi")
        return score_top(queries, own, N, cosine=True, allow=allow, deny=deny, digits=self.digits)

    def similar_users(self, users: DataFrame, N: int = 10, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
        """query_id, rank, id, score by cosine; users: id."""
        own, _ = self._fitted()
        check_lists(allow, deny, own)
        return score_top(own.join(users.select("id").distinct(), "id", "left_semi"), own, N, cosine=True, allow=allow, deny=deny, digits=self.digits)

    def parameters(self) -> dict:
        return {}

    def save(self, path: str, half: bool = False) -> None:
        """Write the model; with half its factors are stored in 16 bits a component."""
        users, items = self._fitted()
        if half:
            from tastegrid.operators.half import pack

            users, items = pack(users), pack(items)
        store.save(path, self.kind, self.parameters(), {"user_factors": users, "item_factors": items})

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        parameters, tables = store.load(spark, path, cls.kind)
        out = cls(**parameters)
        users, items = tables["user_factors"], tables["item_factors"]
        if "half" in users.columns:
            from tastegrid.operators.half import unpack

            users, items = unpack(users), unpack(items)
        out.user_factors, out.item_factors = users, items
        return out


def upsert(factors: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Replace and add rows; ids up to the largest that have none get zeros."""
    kept = factors.join(new.select("id"), "id", "left_anti").select("id", "features")
    both = kept.unionByName(new.select("id", "features"))
    most = both.agg(F.max("id")).first()[0]
    if most is None:
        return both
    gaps = factors.sparkSession.range(most + 1).join(both.select("id"), "id", "left_anti")
    return both.unionByName(gaps.select("id", F.array_repeat(F.lit(0.0).cast("float"), k).alias("features")))
