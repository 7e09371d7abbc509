"""Alternating least squares on confidences.

A half-step solves, for each user, (Y'Y + reg I + sum (|c| - 1) y y') x = sum c y
over c > 0.  While the other side's factors are below a checked size they are
broadcast, and entries, hash-partitioned and sorted by user once, stream through
a kernel that works on many users at a time.  Beyond it the entries are joined
with the factors, users of very many entries are salted, and the normal
equations, which add up, are summed before they are solved.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.vectors import dot
from tastegrid.functions.weighting import scale
from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions
from tastegrid.operators import factors as fx
from tastegrid.operators.factors import FACTORS, FactorModel
from tastegrid.sources.checkpoints import stash

#: Entries of a user from which on its normal equations are summed in parts.
HOT_USER = 50_000
#: Entries that the broadcast kernel works on at once.
CACHED_ENTRIES = 4096
#: Contributions that an explanation holds at once.
MOST_FOUND = 20_000


def _normal(y: np.ndarray, c: np.ndarray, starts: np.ndarray, yty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each user's matrix and right side; starts: where the users' entries begin."""
    ends = np.r_[starts[1:], len(c)]
    a = np.empty((len(starts), *yty.shape))
    b = np.empty((len(starts), len(yty)))
    extra, liked = np.abs(c) - 1, np.where(c > 0, c, 0)
    for u, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        own = y[s:e]
        a[u] = yty + own.T @ (own * extra[s:e, None])
        b[u] = liked[s:e] @ own
    return a, b


def solve_cholesky(y: np.ndarray, c: np.ndarray, starts: np.ndarray, yty: np.ndarray, x0: np.ndarray | None = None, steps: int = 0) -> np.ndarray:
    out = np.empty((len(starts), len(yty)))
    ends = np.r_[starts[1:], len(c)]
    for at in range(0, len(starts), 512):
        own = starts[at : at + 512]
        lo, hi = own[0], ends[min(at + 511, len(starts) - 1)]
        a, b = _normal(y[lo:hi], c[lo:hi], own - lo, yty)
        out[at : at + len(own)] = solve_dense(a, b)
    return out


def solve_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError as e:
        raise ValueError("a user's equations are singular; raise the regularization") from e


def solve_cg(y: np.ndarray, c: np.ndarray, starts: np.ndarray, yty: np.ndarray, x0: np.ndarray, steps: int = 3) -> np.ndarray:
    """Conjugate gradients for all users at once, from x0; users whose residual is tiny stay put."""
    counts = np.diff(np.r_[starts, len(c)])
    seg = np.repeat(np.arange(len(starts)), counts)
    extra, liked = np.abs(c) - 1, np.where(c > 0, c, 0)

    def add(w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(y * w[:, None], starts, axis=0)

    def times(v: np.ndarray) -> np.ndarray:
        return v @ yty + add(extra * np.einsum("ij,ij->i", y, v[seg]))

    x = x0.astype(y.dtype, copy=True)
    r = add(liked) - times(x)
    p, rr = r.copy(), np.einsum("ij,ij->i", r, r)
    for _ in range(steps):
        live = rr > 1e-20
        if not live.any():
            break
        ap = times(p)
        alpha = np.where(live, rr / np.where(live, np.einsum("ij,ij->i", p, ap), 1), 0)
        x += alpha[:, None] * p
        r -= alpha[:, None] * ap
        now = np.einsum("ij,ij->i", r, r)
        p = r + np.where(live, now / np.where(live, rr, 1), 0)[:, None] * p
        rr = np.where(live, now, rr)
    return x


def half_step_broadcast(entries: DataFrame, y: np.ndarray, x: np.ndarray | None, reg: float, cg_steps: int | None, dtype: str = "float32") -> DataFrame:
    """New factors of the users in entries, which are partitioned and sorted by user; y and x are broadcast."""
    kind = np.float64 if dtype == "float64" else np.float32
    yty = y.astype(np.float64).T @ y.astype(np.float64) + reg * np.eye(y.shape[1])
    sc = entries.sparkSession.sparkContext
    shared_y, shared_x, width = sc.broadcast(y), sc.broadcast(x) if cg_steps else None, y.shape[1]

    def kernel(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        user, item, c = columns
        starts, ids = fx.segments(user)
        c, out = c.astype(kind if cg_steps else np.float64), np.empty((len(ids), width), kind)
        # A few thousand entries at a time stay in the processor's cache, which is several times faster.
        cuts = np.unique(np.r_[0, np.searchsorted(starts, np.arange(CACHED_ENTRIES, len(c), CACHED_ENTRIES)), len(ids)])
        for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
            lo, hi = starts[a], starts[z] if z < len(ids) else len(c)
            rows = shared_y.value[item[lo:hi]]
            if cg_steps:
                x0 = shared_x.value
                before = np.zeros((z - a, width), kind)
                known = ids[a:z] < len(x0)
                before[known] = x0[ids[a:z][known]]
                out[a:z] = solve_cg(rows.astype(kind, copy=False), c[lo:hi], starts[a:z] - lo, yty.astype(kind), before, cg_steps)
            else:
                out[a:z] = solve_cholesky(rows.astype(np.float64), c[lo:hi], starts[a:z] - lo, yty)
        yield fx.factor_batch(ids, out, kind)

    schema = FACTORS.replace("float", "double") if dtype == "float64" else FACTORS
    return entries.mapInArrow(fx.whole_groups(kernel, fx.group_rows(y.shape[1])), schema)


#: Bytes of users' matrices that a kernel of the shuffled half-step holds at a time.
MATRIX_BYTES = 32 << 20


def cg_dense(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """Conjugate-gradient steps from x on users' whole normal equations; the same iterates as solve_cg's."""
    x = x.astype(np.float64)
    r = b - np.einsum("uij,uj->ui", a, x)
    p, rr = r.copy(), np.einsum("ui,ui->u", r, r)
    for _ in range(steps):
        live = rr >= 1e-20
        if not live.any():
            break
        ap = np.einsum("uij,uj->ui", a, p)
        step = np.where(live, rr / np.where(live, np.einsum("ui,ui->u", p, ap), 1.0), 0.0)[:, None]
        x, r = x + step * p, r - step * ap
        now = np.einsum("ui,ui->u", r, r)
        p = np.where(live[:, None], r + (now / np.where(live, rr, 1.0))[:, None] * p, p)
        rr = np.where(live, now, rr)
    return x


def half_step_shuffle(entries: DataFrame, y: DataFrame, k: int, reg: float, x: DataFrame | None = None, cg_steps: int | None = None, dtype: str = "float32") -> DataFrame:
    """New factors of the users in entries by joins, from x by cg_steps conjugate-gradient steps, or by Cholesky.

    Users with over HOT_USER entries are summed in salted parts; the others are solved where their entries meet, and
    only their factors go on.
    """
    kind = np.float64 if dtype == "float64" else np.float32
    schema = FACTORS.replace("float", "double") if dtype == "float64" else FACTORS
    yty = fx.gramian(y, k) + reg * np.eye(k)
    counts = entries.groupBy(USER).agg(F.ceil(F.count("*") / HOT_USER).cast("long").alias("parts"))
    joined = entries.join(y.withColumnRenamed("id", ITEM), ITEM).join(counts, USER)
    joined = joined.select(USER, F.pmod(F.xxhash64(ITEM), F.col("parts")).alias("salt"), "parts", WEIGHT, "features")
    if cg_steps is not None and x is not None:
        # A user's last factors go with its first part, as a row of part -1.
        last = x.join(counts.withColumnRenamed(USER, "id"), "id")
        joined = joined.unionByName(last.select(F.col("id").alias(USER), F.lit(0).cast("long").alias("salt"), F.lit(-1).cast("long").alias("parts"), F.lit(0.0).alias(WEIGHT), F.col("features").cast(y.schema["features"].dataType).alias("features")))
    zero, group = np.zeros((k, k)), max(1, MATRIX_BYTES // (k * k * 8))

    def solved(a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        return cg_dense(a, b, before, cg_steps) if cg_steps is not None else solve_dense(a, b)

    def batch(users: np.ndarray, done: bool, flat: np.ndarray) -> pa.RecordBatch:
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(np.ascontiguousarray(flat, np.float64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(users.astype(np.int64)), pa.array([done] * len(flat)), values], [USER, "done", "sums"])

    def partial(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        user, salt, parts, c, rows = columns
        starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (salt[1:] != salt[:-1])])
        for at in range(0, len(starts), group):
            own = starts[at : at + group]
            lo, hi = own[0], starts[at + group] if at + group < len(starts) else len(user)
            is_x, ids, part = parts[lo:hi] < 0, user[own], np.searchsorted(own, np.arange(lo, hi), side="right") - 1
            before = np.zeros((len(own), k))
            before[part[is_x]] = rows[lo:hi][is_x]
            real = ~is_x
            # Parts that hold nothing but last factors have no entries of their own.
            begin = np.searchsorted(part[real], np.arange(len(own)))
            a, b = _normal(rows[lo:hi][real].astype(np.float64), c[lo:hi][real], begin, zero)
            one = np.zeros(len(own), bool)
            one[part[real]] = parts[lo:hi][real] == 1
            if one.any():
                yield batch(ids[one], True, solved(a[one] + yty, b[one], before[one]))
            if not one.all():
                many = ~one
                yield batch(ids[many], False, np.concatenate([a[many].reshape(many.sum(), -1), b[many], before[many]], axis=1))

    def final(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        user, sums = columns
        starts, ids = fx.segments(user)
        total = np.add.reduceat(sums, starts, axis=0)
        a, b = total[:, : k * k].reshape(-1, k, k) + yty, total[:, k * k : k * k + k]
        yield fx.factor_batch(ids, solved(a, b, total[:, k * k + k :]), kind)

    by_part = joined.repartition(USER, "salt").sortWithinPartitions(USER, "salt")
    sums = stash(by_part.mapInArrow(fx.whole_groups(partial, fx.group_rows(k)), f"{USER} bigint, done boolean, sums array<double>"), "als-sums")
    whole = sums.where("done").select(F.col(USER).alias("id"), F.col("sums").cast(schema.split(" ")[-1]).alias("features"))
    rest = sums.where("not done").select(USER, "sums").repartition(USER).sortWithinPartitions(USER)
    return whole.unionByName(rest.mapInArrow(fx.whole_groups(final, max(8, MATRIX_BYTES // (k * k * 8))), schema))


def loss_parts(entries: DataFrame, y: np.ndarray, x: np.ndarray) -> tuple[float, float, int]:
    """(sum over entries of (|c| - 1) s^2 - 2 c s where c > 0, sum of |c|, number of entries), s the score."""
    sc = entries.sparkSession.sparkContext
    shared = sc.broadcast((x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = 0.0
        n = 0
        x_, y_ = shared.value
        for batch in batches:
            user, item, c = (fx._column(col) for col in batch.columns)
            s = np.einsum("ij,ij->i", x_[user].astype(np.float64), y_[item].astype(np.float64))
            a += float(((np.abs(c) - 1) * s * s - 2 * np.where(c > 0, c, 0) * s).sum())
            b += float(np.abs(c).sum())
            n += len(c)
        yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([n], pa.int64())], ["a", "b", "n"])

    r = entries.select(USER, ITEM, WEIGHT).mapInArrow(run, "a double, b double, n bigint").agg(F.sum("a"), F.sum("b"), F.sum("n")).first()
    return r[0] or 0.0, r[1] or 0.0, r[2] or 0


def training_loss(entries: DataFrame, y: np.ndarray, x: np.ndarray, reg: float) -> float:
    """The mean weighted squared error with its penalty."""
    y64, x64 = y.astype(np.float64), x.astype(np.float64)
    a, b, n = loss_parts(entries, y, x)
    every = float(np.einsum("ij,jk,ik->", x64, y64.T @ y64, x64, optimize=True))
    total = every + a + b + reg * ((x64**2).sum() + (y64**2).sum())
    return float(total / (b + len(x) * len(y) - n))


def training_loss_shuffle(entries: DataFrame, y: DataFrame, x: DataFrame, reg: float, k: int, n_users: int, n_items: int) -> float:
    """training_loss by joins; factors without a row are zero."""
    scored = entries.join(x.select(F.col("id").alias(USER), F.col("features").alias("f")), USER, "left").join(y.select(F.col("id").alias(ITEM), F.col("features").alias("g")), ITEM, "left")
    s, c = F.coalesce(dot(F.col("f"), F.col("g")), F.lit(0.0)), F.col(WEIGHT)
    beyond = (F.abs(c) - 1) * s * s - 2 * F.greatest(c, F.lit(0.0)) * s
    a, b, n = scored.agg(F.sum(beyond), F.sum(F.abs(c)), F.count("*")).first()
    xx, yy = fx.gramian(x, k), fx.gramian(y, k)
    total = float((xx * yy).sum()) + (a or 0.0) + (b or 0.0) + reg * (np.trace(xx) + np.trace(yy))
    return float(total / ((b or 0.0) + n_users * n_items - n))


class AlternatingLeastSquares(FactorModel):
    """Matrix factorisation of one-class feedback.

    solver: "cg" (cg_steps conjugate-gradient steps from the last factors),
    "cholesky", or "mllib" (Spark's own ALS: weights below 1 are not expressible,
    weights of exactly 1 count as unseen, and it scales the regularization by a
    user's entries).
    """

    kind = "als"

    def __init__(self, factors: int = 100, regularization: float = 0.01, alpha: float = 1.0, iterations: int = 15, solver: str = "cg", cg_steps: int = 3, calculate_training_loss: bool = False, random_state: int | None = None, dtype: str = "float32"):
        super().__init__()
        if dtype not in ("float32", "float64"):
            raise ValueError("factors are float32 or float64")
        if solver not in ("cg", "cholesky", "mllib"):
            raise ValueError(f"no solver {solver!r}")
        self.factors, self.regularization, self.alpha, self.iterations = factors, regularization, alpha, iterations
        self.solver, self.cg_steps, self.calculate_training_loss = solver, cg_steps, calculate_training_loss
        self.random_state, self.dtype = random_state, dtype
        self.loss: float | None = None

    def parameters(self) -> dict:
        return {k: getattr(self, k) for k in ("factors", "regularization", "alpha", "iterations", "solver", "cg_steps", "calculate_training_loss", "random_state", "dtype")}

    def _small(self, n: int) -> bool:
        return n * self.factors * 4 <= fx.BROADCAST_BYTES

    def fit(self, x: Interactions, callback: Callable | None = None) -> "AlternatingLeastSquares":
        """Fit; callback(iteration, seconds, loss or None).  Factors of an earlier fit are the start."""
        if self.solver == "mllib":
            return self._fit_mllib(x)
        n_users, n_items = x.n_users, x.n_items
        if not (self._small(n_users) and self._small(n_items)):
            return self._fit_shuffle(x, callback)
        seed = 0 if self.random_state is None else self.random_state
        scaled = scale(x, self.alpha)
        users, items = fx.by_user(scaled.df).persist(), fx.by_user(scaled.transposed().df).persist()
        try:
            p = self._start(self.user_factors, seed, 1, n_users)
            q = self._start(self.item_factors, seed, 2, n_items)
            cg = self.cg_steps if self.solver == "cg" else None
            spark = x.df.sparkSession
            for i in range(self.iterations):
                began = time.time()
                p = fx.to_matrix(half_step_broadcast(users, q, p, self.regularization, cg, self.dtype), n_users, self.factors)
                q = fx.to_matrix(half_step_broadcast(items, p, q, self.regularization, cg, self.dtype), n_items, self.factors)
                self.loss = training_loss(users, q, p, self.regularization) if self.calculate_training_loss else None
                if callback:
                    callback(i, time.time() - began, self.loss)
            if not (np.isfinite(p).all() and np.isfinite(q).all()):
                raise fx.ModelFitError("NaN in the factors")
            self.user_factors, self.item_factors = fx.to_df(spark, p), fx.to_df(spark, q)
        finally:
            users.unpersist()
            items.unpersist()
        return self

    def _start(self, known: DataFrame | None, seed: int, salt: int, n: int) -> np.ndarray:
        if known is not None:
            return fx.to_matrix(known, n, self.factors)
        return (fx.seeded(seed, salt, n, self.factors) * 0.01).astype(np.float32)

    def _seeded(self, spark, seed: int, salt: int, n: int) -> DataFrame:
        """The start of `_start` as a table, made where its rows are."""
        k = self.factors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                yield fx.factor_batch(ids, fx.seeded_rows(seed, salt, ids, k) * 0.01)

        return spark.range(n).mapInArrow(run, FACTORS)

    def _fit_shuffle(self, x: Interactions, callback: Callable | None) -> "AlternatingLeastSquares":
        """The same fit with neither side on one machine: joins, and each half-step written to the shared folder."""
        spark, k, seed = x.df.sparkSession, self.factors, self.random_state or 0
        scaled = scale(x, self.alpha)
        users, items = stash(scaled.df, "als-users"), stash(scaled.transposed().df, "als-items")
        cg = self.cg_steps if self.solver == "cg" else None
        p = self.user_factors if self.user_factors is not None else self._seeded(spark, seed, 1, x.n_users)
        q = self.item_factors if self.item_factors is not None else self._seeded(spark, seed, 2, x.n_items)
        for i in range(self.iterations):
            began = time.time()
            p = stash(half_step_shuffle(users, q, k, self.regularization, p, cg, self.dtype), "als-factors")
            q = stash(half_step_shuffle(items, p, k, self.regularization, q, cg, self.dtype), "als-factors")
            self.loss = training_loss_shuffle(users, q, p, self.regularization, k, x.n_users, x.n_items) if self.calculate_training_loss else None
            if callback:
                callback(i, time.time() - began, self.loss)
        floats = F.col("features").cast("array<float>").alias("features")
        self.user_factors, self.item_factors = upsert_all(p.select("id", floats), x.n_users, k), upsert_all(q.select("id", floats), x.n_items, k)
        fx.ensure_finite(self.user_factors)
        fx.ensure_finite(self.item_factors)
        return self

    def _fit_mllib(self, x: Interactions) -> "AlternatingLeastSquares":
        from pyspark.ml.recommendation import ALS

        # There a confidence is 1 + alpha r.
        r = scale(x, self.alpha).df.withColumn("r", F.when(F.col(WEIGHT) >= 0, F.col(WEIGHT) - 1).otherwise(F.col(WEIGHT) + 1)).where("r <> 0")
        als = ALS(rank=self.factors, maxIter=self.iterations, regParam=self.regularization, implicitPrefs=True, alpha=1.0, userCol=USER, itemCol=ITEM, ratingCol="r", seed=self.random_state or 0)
        model = als.fit(r.select(F.col(USER).cast("int"), F.col(ITEM).cast("int"), F.col("r").cast("float")))
        self.user_factors, self.item_factors = (f.select(F.col("id").cast("long").alias("id"), "features") for f in (model.userFactors, model.itemFactors))
        return self

    def _solve(self, x: Interactions, other: DataFrame, n: int) -> DataFrame:
        # An id that the model has no factors for tells nothing.
        entries = fx.by_user(scale(x, self.alpha).df.where(F.col(ITEM) < n))
        if self._small(n):
            found = half_step_broadcast(entries, fx.to_matrix(other, n, self.factors), None, self.regularization, None, self.dtype)
            return found.withColumn("features", F.col("features").cast("array<float>"))
        return half_step_shuffle(entries, other, self.factors, self.regularization)

    def recalculate_users(self, x: Interactions) -> DataFrame:
        """Factors of the users in x from the item factors, by Cholesky; the model stays as it is."""
        _, items = self._fitted()
        return self._solve(x, items, (items.agg(F.max("id")).first()[0] or 0) + 1)

    def recalculate_items(self, x: Interactions) -> DataFrame:
        """Factors of the items in x (users and items as in fit) from the user factors."""
        users, _ = self._fitted()
        return self._solve(x.transposed(), users, (users.agg(F.max("id")).first()[0] or 0) + 1)

    def partial_fit_users(self, x: Interactions) -> "AlternatingLeastSquares":
        """Replace or add the users in x; ids in between get zeros."""
        self.user_factors = stash(fx.upsert(self._fitted()[0], self.recalculate_users(x), self.factors), "als-factors")
        return self

    def partial_fit_items(self, x: Interactions) -> "AlternatingLeastSquares":
        self.item_factors = stash(fx.upsert(self._fitted()[1], self.recalculate_items(x), self.factors), "als-factors")
        return self

    def explain(self, pairs: DataFrame, x: Interactions, N: int = 10) -> DataFrame:
        """Why items are recommended: user_id, item_id, rank, other_item, contribution, total.

        pairs: user_id, item_id.  Each liked entry of the user contributes; entries below zero do not.
        """
        _, items = self._fitted()
        k = self.factors
        yty = fx.gramian(items, k) + self.regularization * np.eye(k)
        asked = pairs.select(USER, ITEM).distinct()
        # A user's entries and the items asked for, each with its factors, meet where the user's equations are solved.
        entries = scale(x, self.alpha).df.join(asked.select(USER).distinct(), USER, "left_semi")
        factors = items.select(F.col("id").alias(ITEM), F.col("features").cast("array<double>").alias("features"))
        own = entries.join(factors, ITEM).select(USER, F.lit(0).alias("asked"), ITEM, WEIGHT, "features")
        # Items that very many users ask for, of which there are few, have a copy of their factors for each part of those users.
        hot = F.broadcast(asked.groupBy(ITEM).agg(F.count("*").alias("n")).where(F.col("n") > HOT_USER).select(ITEM, F.ceil(F.col("n") / HOT_USER).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        copies = factors.join(hot, ITEM, "left").select(ITEM, F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "features")
        wanted = asked.join(hot, ITEM, "left").select(USER, ITEM, F.pmod(F.xxhash64(USER), parts).cast("int").alias("salt")).join(copies, [ITEM, "salt"])
        rows = own.unionByName(wanted.select(USER, F.lit(1).alias("asked"), ITEM, F.lit(0.0).alias(WEIGHT), "features"))
        by = rows.repartition(USER).sortWithinPartitions(USER, "asked", ITEM)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        names = [USER, ITEM, "rank", "other_item", "contribution", "total"]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

        def kernel(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            user, wanted, item, c, y = columns
            starts, ids = fx.segments(user)
            out = []
            for u, s, e in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(user)]):
                m = s + int(np.searchsorted(wanted[s:e], 1))
                if m == s:
                    continue
                own, liked = item[s:m], c[s:m] > 0
                a, _ = _normal(y[s:m], c[s:m], np.array([0]), yty)
                # One factorisation serves all items asked for.
                solved = np.linalg.solve(a[0], y[m:e].T)
                scores = (y[s:m] @ solved) * np.where(liked, c[s:m], 0)[:, None]
                for j in range(e - m):
                    best = np.lexsort((-own, -scores[:, j]))
                    best = best[liked[best]][:N]
                    total = float(scores[:, j].sum())
                    out += [(u, int(item[m + j]), r + 1, int(own[p]), float(scores[p, j]), total) for r, p in enumerate(best)]
                    if len(out) >= MOST_FOUND:
                        yield packed(out)
                        out = []
            yield packed(out)

        return by.mapInArrow(fx.whole_groups(kernel, fx.group_rows(k)), f"{USER} bigint, {ITEM} bigint, rank int, other_item bigint, contribution double, total double")


def upsert_all(factors: DataFrame, n: int, k: int) -> DataFrame:
    """The factors with rows of zeros for all ids below n that have none."""
    gaps = factors.sparkSession.range(n).join(factors.select("id"), "id", "left_anti")
    return factors.select("id", "features").unionByName(gaps.select("id", F.array_repeat(F.lit(0.0).cast("float"), k).alias("features")))
