"""Logistic matrix factorisation by alternating Adagrad steps.

A half-step reads the other side's factors and writes its own rows.  Own ids and
the other side's are dealt into blocks; a task works on one pair of blocks, with
the entries between them, and gives the sum of each id's gradient over it; the
sums meet by id, where the Adagrad step is taken.  Negatives come by a table of
two levels: how many of an id's fall on each block follows the blocks' shares of
all entries, and within a block they are drawn by popularity.  Ids of very many
entries are spread over several blocks, as gradients add up.  Factors are rows
in the shared folder: the driver holds none, and a task those of two blocks.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions
from tastegrid.operators import factors as fx
from tastegrid.operators.factors import FactorModel
from tastegrid.sources.checkpoints import discard, stash

#: Users whose gradients are taken at once.
CACHED_USERS = 16
#: Bytes of factors of a block, its entries with their negatives, and entries of an id from which on it is spread.
BLOCK_BYTES, BLOCK_ENTRIES, HOT_ID = 64 << 20, 40_000_000, 50_000
ENTRY, OWN, OTHER = 0, 1, 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


def _add(out: np.ndarray, seg: np.ndarray, values: np.ndarray) -> None:
    """Add each run of equal seg, which comes in order, to its row of out."""
    if len(seg):
        starts, ids = fx.segments(seg)
        out[ids] += np.add.reduceat(values, starts, axis=0)


def gradient(x: np.ndarray, y: np.ndarray, c: np.ndarray, seg: np.ndarray, y_neg: np.ndarray, seg_neg: np.ndarray, reg: float) -> np.ndarray:
    """The gradient of each row of x from its entries (y, c, seg) and its negative samples."""
    s = sigmoid(np.einsum("ij,ij->i", x[seg], y))
    out = -reg * x
    _add(out, seg, (c * (1 - s))[:, None] * y)
    if len(seg_neg):
        s = sigmoid(np.einsum("ij,ij->i", x[seg_neg], y_neg))
        _add(out, seg_neg, -s[:, None] * y_neg)
    return out


def adagrad(x: np.ndarray, squares: np.ndarray, g: np.ndarray, rate: float, pinned: int) -> tuple[np.ndarray, np.ndarray]:
    """New factors and sums of squared gradients; the column `pinned` of the factors is 1."""
    squares = squares + g * g
    x = x + rate / np.sqrt(1e-6 + squares) * g
    x[:, pinned] = 1
    return x, squares


def _cells(width: int, blocks: int, seed: int) -> Callable:
    """Sums of gradients of one pair of blocks: rows (cell, kind, id, n, c, features) come in order of cell, kind, id and n.

    Entries hold the other's id in n and the weight in c; own rows the number of their negatives in n and their part in c; the other's rows their popularity in n.
    """

    def sums(cell: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        kind, ids, n, c = (table.column(x).to_numpy() for x in ("kind", "id", "n", "c"))
        flat = np.asarray(table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
        own, other = ids[kind == OWN], ids[kind == OTHER]
        x, y = flat[: len(own)], flat[len(own) :]
        part, n_neg, ends = c[kind == OWN].astype(np.int64), n[kind == OWN], np.cumsum(n[kind == OTHER])
        seg, item, c = np.searchsorted(own, ids[kind == ENTRY]), np.searchsorted(other, n[kind == ENTRY]), c[kind == ENTRY]
        salt = 11 + cell % blocks
        # Some users at a time, so that their negatives stay in the processor's cache.
        for a in range(0, len(own), CACHED_USERS):
            z = min(a + CACHED_USERS, len(own))
            e = np.searchsorted(seg, [a, z])
            # Draws depend on the id, its part and the other side's block, not on how rows are dealt.
            chosen = np.searchsorted(ends, np.floor(fx.seeded_draws(seed, salt, own[a:z] + (part[a:z] << 40), n_neg[a:z]) * ends[-1]), side="right") if len(ends) else np.zeros(0, int)
            seg_neg = np.repeat(np.arange(z - a), n_neg[a:z]) if len(ends) else chosen
            g = gradient(x[a:z], y[item[e[0] : e[1]]], c[e[0] : e[1]], seg[e[0] : e[1]] - a, y[chosen], seg_neg, 0.0)
            yield fx.factor_batch(own[a:z], g, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            mine = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            begins, found = fx.segments(mine)
            for s, e, b in zip(begins.tolist(), [*begins[1:].tolist(), len(mine)], found.tolist()):
                if b != cell and rows:
                    yield from sums(cell, rows)
                    rows = []
                cell = b
                rows.append(batch.slice(s, e - s))
        if rows:
            yield from sums(cell, rows)

    return run


def _update(width: int, rate: float, reg: float, pinned: int) -> Callable:
    """Adagrad on whole ids: rows (id, kind, n, values), of which OWN ones hold factors and squares, the others gradients and zeros."""

    def kernel(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, kind, n, values = columns
        starts, found = fx.segments(ids)
        own = kind == OWN
        # An id's own row comes first.
        x, squares = values[own][:, :width], values[own][:, width:]
        g = np.add.reduceat(np.where(own[:, None], 0, values), starts, axis=0)[:, :width] - reg * x
        base = fx.factor_batch(found, np.concatenate(adagrad(x, squares, g, rate, pinned), axis=1), np.float64)
        yield pa.RecordBatch.from_arrays([base.column(0), pa.array(n[own].astype(np.int64)), base.column(1)], ["id", "n", "features"])

    return fx.whole_groups(kernel, max(64, (32 << 20) // (16 * width)))


SIDE = "id bigint, n bigint, features array<double>"


class LogisticMatrixFactorization(FactorModel):
    """Factors of k + 2 columns: users end in (1, bias), items in (bias, 1).

    A user of n entries gets min(number of items, n * neg_prop) negative samples,
    by popularity; neg_cap lowers the first.  blocks: of the side that is read; by
    default as many as keep a block below BLOCK_BYTES.
    """

    kind = "lmf"

    def __init__(self, factors: int = 30, learning_rate: float = 1.0, regularization: float = 0.6, iterations: int = 30, neg_prop: int = 30, random_state: int | None = None, neg_cap: int | None = None, blocks: int | None = None):
        super().__init__()
        self.factors, self.learning_rate, self.regularization, self.iterations = factors, learning_rate, regularization, iterations
        self.neg_prop, self.random_state, self.neg_cap, self.blocks = neg_prop, random_state, neg_cap, blocks

    def parameters(self) -> dict:
        return {k: getattr(self, k) for k in ("factors", "learning_rate", "regularization", "iterations", "neg_prop", "random_state", "neg_cap", "blocks")}

    def _start(self, counts: DataFrame, seed: int, side: int) -> DataFrame:
        """id, n and features, with the sums of squares after them, of the ids that have entries."""
        k = self.factors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
                m = fx.seeded_normal_rows(seed, 2 * side + 1, ids, k + 2)
                m[:, k + side] = 1
                base = fx.factor_batch(ids, np.concatenate([m, np.zeros_like(m)], axis=1), np.float64)
                yield pa.RecordBatch.from_arrays([base.column(0), batch.column(1), base.column(1)], ["id", "n", "features"])

        return counts.mapInArrow(run, SIDE)

    def fit(self, interactions: Interactions, callback: Callable | None = None) -> "LogisticMatrixFactorization":
        """Fit with the weights as confidences; callback(epoch, seconds)."""
        sizes, k = (interactions.n_users, interactions.n_items), self.factors
        seed = 0 if self.random_state is None else self.random_state
        entries = stash(interactions.df.select(USER, ITEM, WEIGHT), "lmf-entries")
        n = entries.count()
        sides = []
        for side, column in enumerate((USER, ITEM)):
            counts = entries.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
            sides.append(stash(self._start(counts, seed, side), "lmf-factors"))
        for epoch in range(self.iterations):
            began = time.time()
            for side in (0, 1):
                new = self._half(entries, sides[side], sides[1 - side], side, sizes, n, seed + 7919 * (2 * epoch + side + 1))
                old, sides[side] = sides[side], stash(new, "lmf-factors")
                discard(old)
            if callback:
                callback(epoch, time.time() - began)
        out = []
        for side, rows in enumerate(sides):
            found = rows.select("id", F.slice("features", 1, k + 2).cast("array<float>").alias("features"))
            fx.ensure_finite(found)
            bare = F.transform(F.sequence(F.lit(0), F.lit(k + 1)), lambda i: F.when(i == k + side, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
            cold = entries.sparkSession.range(sizes[side]).join(found.select("id"), "id", "left_anti").select("id", bare.alias("features"))
            out.append(found.unionByName(cold))
        self.user_factors, self.item_factors = out
        return self

    def _half(self, entries: DataFrame, own: DataFrame, other: DataFrame, side: int, sizes: tuple[int, int], n: int, seed: int) -> DataFrame:
        """The new rows of one side."""
        width = self.factors + 2
        mine, theirs = (USER, ITEM) if side == 0 else (ITEM, USER)
        blocks = self.blocks or max(1, math.ceil(sizes[1 - side] * width * 8 / BLOCK_BYTES))
        parallel = entries.sparkSession.sparkContext.defaultParallelism
        rows = self.blocks or max(parallel, math.ceil(sizes[side] * width * 8 / BLOCK_BYTES), math.ceil(n * (self.neg_prop + 1) / blocks / BLOCK_ENTRIES))
        other_block = F.pmod(F.xxhash64("other"), F.lit(blocks)).cast("int")
        # Shares of all entries: a number for each block.
        shares = np.ones(blocks)
        for r in [] if blocks == 1 else other.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect():
            shares[r["b"]] = r["n"]
        shares = shares / max(shares.sum(), 1)
        cap, prop = sizes[1 - side] if self.neg_cap is None else min(sizes[1 - side], self.neg_cap), self.neg_prop

        def row_of(part):
            return F.pmod(F.xxhash64("id", part), F.lit(rows)).cast("int")

        def parts(count):
            return F.ceil(count / HOT_ID).cast("int")

        nothing = F.array().cast("array<double>")
        hot = own.where(F.col("n") > HOT_ID).select("id", parts(F.col("n")).alias("parts"))
        e = entries.select(F.col(mine).alias("id"), F.col(theirs).alias("other"), F.col(WEIGHT).alias("c")).join(hot, "id", "left")
        part = F.coalesce(F.pmod(F.xxhash64("other"), F.col("parts")), F.lit(0)).cast("int")
        e = e.withColumn("part", part).select((row_of("part") * blocks + other_block).alias("cell"), F.lit(ENTRY).alias("kind"), "id", F.col("other").alias("n"), "c", nothing.alias("features"))

        def quotas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each part of an id, once for each block, with the negatives that fall on it."""
            for batch in batches:
                ids, row, first, count, n_parts = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(5))
                total = np.minimum(cap, count * prop)
                # What does not divide goes to the first parts.
                quota = total // n_parts + (first < total % n_parts)
                drawn = quota[:, None] if blocks == 1 else np.array([np.random.default_rng([seed, i, p]).multinomial(q, shares) for i, p, q in zip(ids.tolist(), first.tolist(), quota.tolist())]).reshape(-1, blocks)
                pick = np.repeat(np.arange(len(ids)), blocks)
                yield pa.RecordBatch.from_arrays([pa.array((row.astype(np.int64)[:, None] * blocks + np.arange(blocks)).ravel()), pa.array(np.full(len(pick), OWN, np.int32)), pa.array(ids[pick]), pa.array(drawn.ravel().astype(np.int64)), pa.array(first[pick].astype(np.float64)), batch.column(5).take(pa.array(pick))], ["cell", "kind", "id", "n", "c", "features"])

        factors = F.slice("features", 1, width).alias("features")
        spread = own.select("id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts(F.col("n"))) - 1)).alias("part"), "n", F.greatest(F.lit(1), parts(F.col("n"))).alias("n_parts"), factors)
        # Parts of an id that meet in one cell stay apart there, and their gradients add up.
        placed = spread.select("id", row_of("part").alias("row"), "part", "n", "n_parts", "features")
        x = placed.mapInArrow(quotas, "cell bigint, kind int, id bigint, n bigint, c double, features array<double>")
        y = other.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), "id", "n", factors)
        y = y.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        y = y.select((F.col("row") * blocks + F.col("b")).cast("bigint").alias("cell"), F.lit(OTHER).alias("kind"), "id", "n", F.lit(0.0).alias("c"), "features")
        every = e.withColumn("cell", F.col("cell").cast("bigint")).unionByName(x).unionByName(y)
        dealt = every.repartitionById(rows * blocks, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "id", "n")
        sums = dealt.mapInArrow(_cells(width, blocks, seed), "id bigint, features array<double>")
        zeros = F.array_repeat(F.lit(0.0), width)
        gradients = sums.select("id", F.lit(OTHER).alias("kind"), F.lit(0).cast("bigint").alias("n"), F.concat("features", zeros).alias("features"))
        met = own.select("id", F.lit(OWN).alias("kind"), "n", "features").unionByName(gradients)
        by_id = met.repartition("id").sortWithinPartitions("id", "kind")
        return by_id.mapInArrow(_update(width, self.learning_rate, self.regularization, self.factors + side), SIDE)


def step(samples: DataFrame, own: DataFrame, other: DataFrame, rate: float, reg: float, pinned: int) -> DataFrame:
    """One Adagrad step, from sums of zero, over given samples: id, features and squares (doubles) of the ids in samples.

    samples: id, other and c, the weight; a null weight marks a negative.
    """
    rows = samples.join(other.select(F.col("id").alias("other"), F.col("features").alias("y")), "other").join(own.select("id", F.col("features").alias("x")), "id")
    rows = rows.select("id", F.col("c").isNull().cast("int").alias("negative"), F.coalesce("c", F.lit(0.0)).alias("c"), "x", "y")

    def kernel(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, negative, c, x, y = columns
        starts, found = fx.segments(ids)
        seg, neg, x, y = np.searchsorted(found, ids), negative.astype(bool), x[starts].astype(np.float64), y.astype(np.float64)
        g = gradient(x, y[~neg], c[~neg], seg[~neg], y[neg], seg[neg], reg)
        moved, squares = adagrad(x, np.zeros_like(x), g, rate, pinned)
        a, b = fx.factor_batch(found, moved, np.float64), fx.factor_batch(found, squares, np.float64)
        yield pa.RecordBatch.from_arrays([*a.columns, b.column(1)], ["id", "features", "squares"])

    return rows.repartition("id").sortWithinPartitions("id", "negative").mapInArrow(fx.whole_groups(kernel), "id bigint, features array<double>, squares array<double>")
