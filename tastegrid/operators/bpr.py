"""Bayesian personalised ranking by stochastic gradients on rotating blocks.

Users and items are dealt into as many blocks; items anew in every epoch.  An
epoch has a turn for each shift r: the task of user block b works on item block
b + r, so the tasks of a turn share neither users nor items and change their
factors in place, and after all turns each entry has had its block's turn once.
A sample's other item is drawn by popularity from the same item block, which
holds all that its user likes of that block; as blocks are dealt anew, every
pair of items meets in some epoch.  Factors are rows in the shared folder: the
driver holds none, and a task those of its two blocks.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.interactions import ITEM, USER, Interactions
from tastegrid.operators import factors as fx
from tastegrid.operators.als import upsert_all
from tastegrid.operators.factors import FactorModel
from tastegrid.sources.checkpoints import discard, stash

#: Samples that are updated together within a task.
MINI_BATCH = 512
#: Bytes of factors, and entries, of a block.
BLOCK_BYTES, BLOCK_ENTRIES = 64 << 20, 2_000_000
#: Epochs of one task where all is one block, so nothing has to be dealt anew between them; more would be lost with an executor.
EPOCHS_AT_ONCE = 10
ENTRY, USERS, ITEMS, TALLY = 0, 1, 2, 3
ROWS = "kind int, id bigint, n bigint, features array<float>"


def terms(xu: np.ndarray, yi: np.ndarray, yj: np.ndarray, rate: float, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each sample adds to its user, its liked and its other item, and whether it was ranked rightly.

    The last column of xu is the constant 1 and stays; that of yi and yj is the item's bias.
    """
    score = np.einsum("ij,ij->i", xu, yi - yj)
    z = (1 / (1 + np.exp(np.clip(score, -30, 30))))[:, None]
    dx = rate * (z * (yi - yj) - reg * xu)
    dx[:, -1] = 0
    return dx, rate * (z * xu - reg * yi), rate * (-z * xu - reg * yj), score > 0


def sgd(x: np.ndarray, y: np.ndarray, users: np.ndarray, liked: np.ndarray, other: np.ndarray, rate: float, reg: float) -> int:
    """One pass over the samples in mini-batches; x and y change in place.  Returns how many were ranked rightly."""
    correct = 0
    for at in range(0, len(users), MINI_BATCH):
        u, i, j = users[at : at + MINI_BATCH], liked[at : at + MINI_BATCH], other[at : at + MINI_BATCH]
        du, di, dj, right = terms(x[u], y[i], y[j], rate, reg)
        correct += int(right.sum())
        np.add.at(x, u, du)
        np.add.at(y, i, di)
        np.add.at(y, j, dj)
    return correct


def unliked(user: np.ndarray, item: np.ndarray, at: np.ndarray, other: np.ndarray, n_items: int) -> np.ndarray:
    """Which of the samples' other items their users do not like; entries come in order of user and item, at: the samples' entries."""
    keys = user.astype(np.int64) * n_items + item
    wanted = user[at].astype(np.int64) * n_items + other
    found = np.searchsorted(keys, wanted)
    return ~((found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == wanted))


def _turn(width: int, rate: float, reg: float, verify: bool, seeds: list[int]) -> Callable:
    """Samples one block's entries and updates its factors, once for each seed; rows (block, kind, id, n, features) come in order of block, kind, id and n."""

    def update(block: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        kind, ids, n = (table.column(c).to_numpy() for c in ("kind", "id", "n"))
        flat = np.array(table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, width)
        users, items, pops = ids[kind == USERS], ids[kind == ITEMS], n[kind == ITEMS]
        x, y = flat[: len(users)].copy(), flat[len(users) :].copy()
        user, item = np.searchsorted(users, ids[kind == ENTRY]), np.searchsorted(items, n[kind == ENTRY])
        tally = np.zeros((len(seeds), 2))
        for epoch, seed in enumerate(seeds if len(user) and len(items) else []):
            rng, ends = np.random.default_rng([seed, block]), np.cumsum(pops)
            at = rng.integers(0, len(user), len(user))
            other = np.searchsorted(ends, rng.integers(0, ends[-1], len(at)), side="right")
            keep = unliked(user, item, at, other, len(items)) if verify else np.ones(len(at), bool)
            correct = sgd(x, y, user[at][keep], item[at][keep], other[keep], rate, reg)
            tally[epoch] = correct, len(at) - keep.sum()
        for k, i, count, m in ((USERS, users, n[kind == USERS], x), (ITEMS, items, pops, y), (TALLY, np.arange(len(seeds)), np.full(len(seeds), block), tally)):
            base = fx.factor_batch(i, m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), base.column(0), pa.array(count.astype(np.int64)), base.column(1)], ["kind", "id", "n", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            own = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            starts, found = fx.segments(own)
            for s, e, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], found.tolist()):
                if b != block and rows:
                    yield from update(block, rows)
                    rows = []
                block = b
                rows.append(batch.slice(s, e - s))
        if rows:
            yield from update(block, rows)

    return run


class BayesianPersonalizedRanking(FactorModel):
    """Factors of k + 1 columns: the last holds the item's bias, and 1 for users.

    blocks: of users and of items; by default as many as keep a block below BLOCK_BYTES and BLOCK_ENTRIES.
    """

    kind = "bpr"

    def __init__(self, factors: int = 100, learning_rate: float = 0.01, regularization: float = 0.01, iterations: int = 100, verify_negative_samples: bool = True, random_state: int | None = None, blocks: int | None = None):
        super().__init__()
        self.factors, self.learning_rate, self.regularization, self.iterations = factors, learning_rate, regularization, iterations
        self.verify_negative_samples, self.random_state, self.blocks = verify_negative_samples, random_state, blocks

    def parameters(self) -> dict:
        return {k: getattr(self, k) for k in ("factors", "learning_rate", "regularization", "iterations", "verify_negative_samples", "random_state", "blocks")}

    def _start(self, counts: DataFrame, kind: int, seed: int) -> DataFrame:
        """kind, id, n and the first factors of the ids that have entries."""
        k = self.factors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
                m = (fx.seeded_rows(seed, kind, ids, k + 1) - 0.5) / k
                if kind == USERS:
                    m[:, k] = 1
                base = fx.factor_batch(ids, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), base.column(0), batch.column(1), base.column(1)], ["kind", "id", "n", "features"])

        return counts.mapInArrow(run, ROWS)

    def fit(self, interactions: Interactions, callback: Callable | None = None) -> "BayesianPersonalizedRanking":
        """Fit on the pattern of the entries; callback(epoch, seconds, correct, skipped)."""
        n_users, n_items, k = interactions.n_users, interactions.n_items, self.factors
        seed = 0 if self.random_state is None else self.random_state
        entries = stash(interactions.df.select(USER, ITEM), "bpr-entries")
        size = max(n_users, n_items) * (k + 1) * 4
        blocks = self.blocks or max(1, math.ceil(size / BLOCK_BYTES), math.ceil(entries.count() / BLOCK_ENTRIES))
        sides = [entries.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")) for c in (USER, ITEM)]
        factors = stash(self._start(sides[0], USERS, seed).unionByName(self._start(sides[1], ITEMS, seed)), "bpr-factors")
        step = EPOCHS_AT_ONCE if blocks == 1 else 1
        for first in range(0, self.iterations, step):
            began, epochs = time.time(), range(first, min(first + step, self.iterations))
            factors, counts = self._epochs(entries, factors, blocks, [seed + 7919 * (e + 1) for e in epochs])
            for epoch, (correct, skipped) in zip(epochs, counts):
                if callback:
                    callback(epoch, (time.time() - began) / len(epochs), correct, skipped)
        users, items = (factors.where(F.col("kind") == c).select("id", "features") for c in (USERS, ITEMS))
        fx.ensure_finite(factors.where(F.col("kind") != TALLY))
        one = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when(i == k, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
        cold = interactions.df.sparkSession.range(n_users).join(users.select("id"), "id", "left_anti").select("id", one.alias("features"))
        self.user_factors, self.item_factors = users.unionByName(cold), upsert_all(items, n_items, k + 1)
        return self

    def _epochs(self, entries: DataFrame, factors: DataFrame, blocks: int, seeds: list[int]) -> tuple[DataFrame, list[tuple[int, int]]]:
        """factors after a turn for each shift of the blocks, and the counts of each epoch; several epochs only with one block."""
        seed = seeds[0]

        def dealt(c: str, salt: int):
            return F.pmod(F.xxhash64(F.lit(salt), c), F.lit(blocks)).cast("int")

        nothing = F.array().cast("array<float>")
        shifted = entries.withColumns({"block": dealt(USER, 0), "shift": F.pmod(dealt(ITEM, seed) - dealt(USER, 0), F.lit(blocks))})
        if blocks > 1:
            shifted = stash(shifted.repartition("shift", "block"), "bpr-entries")
        counts = np.zeros((len(seeds), 2))
        for shift in range(blocks):
            own = shifted.where(F.col("shift") == shift).select("block", F.lit(ENTRY).alias("kind"), F.col(USER).alias("id"), F.col(ITEM).alias("n"), nothing.alias("features"))
            block = F.when(F.col("kind") == USERS, dealt("id", 0)).otherwise(F.pmod(dealt("id", seed) - shift, F.lit(blocks)))
            held = factors.where(F.col("kind") != TALLY).select(block.alias("block"), "kind", "id", "n", "features")
            rows = own.unionByName(held).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "id", "n")
            turn = _turn(self.factors + 1, self.learning_rate, self.regularization, self.verify_negative_samples, [x + shift for x in seeds])
            old, factors = factors, stash(rows.mapInArrow(turn, ROWS), "bpr-factors")
            discard(old)
            # A row for each block and epoch.
            for r in factors.where(F.col("kind") == TALLY).select("id", "features").collect():
                counts[r["id"]] += r["features"]
        if blocks > 1:
            discard(shifted)
        return factors, [(int(a), int(b)) for a, b in counts]


def step(samples: DataFrame, users: DataFrame, items: DataFrame, rate: float, reg: float) -> tuple[DataFrame, DataFrame]:
    """One synchronous step over given samples (user_id, item_id, other): the users' and the items' new factors (id, features as doubles).

    The updates of `sgd` taken all at once: samples meet the factors by joins, and what they add is summed by id.
    """
    wide = samples.join(users.select(F.col("id").alias(USER), F.col("features").alias("x")), USER)
    wide = wide.join(items.select(F.col("id").alias(ITEM), F.col("features").alias("yi")), ITEM).join(items.select(F.col("id").alias("other"), F.col("features").alias("yj")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                user, item, other = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(3))
                x, yi, yj = (fx._column(batch.column(c)).astype(np.float64) for c in (3, 4, 5))
                du, di, dj, _ = terms(x, yi, yj, rate, reg)
                for kind, ids, d in ((USERS, user, du), (ITEMS, item, di), (ITEMS, other, dj)):
                    base = fx.factor_batch(ids, d, np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), base.column(0), base.column(1)], ["kind", "id", "change"])

    changes = wide.select(USER, ITEM, "other", "x", "yi", "yj").mapInArrow(run, "kind int, id bigint, change array<double>")
    # A sum for each place, side by side: one row for each id and partition.
    known = users.select(F.size("features").alias("n")).first()
    places = [F.sum(F.get("change", i)) for i in range(known["n"] if known else 1)]
    added = stash(changes.groupBy("kind", "id").agg(F.array(*places).alias("change")), "bpr-step")

    def after(factors: DataFrame, kind: int) -> DataFrame:
        moved = factors.join(added.where(F.col("kind") == kind).drop("kind"), "id", "left")
        return moved.select("id", F.when(F.col("change").isNull(), F.col("features").cast("array<double>")).otherwise(F.zip_with("features", "change", lambda a, b: a + b)).alias("features"))

    return after(users, USERS), after(items, ITEMS)
