"""A forest of random-projection trees over vectors.

All trees grow together, level by level: a node of more than leaf_size vectors
is split at the median of its vectors' products with a random direction, so the
halves are even and a tree is as deep as log2(n / leaf_size).  Equal vectors are
parted by a hash of their ids, so no leaf exceeds leaf_size.  A tree is a table
of splits, (tree, node, threshold), and a leaf is a key, (tree, node); the
vectors themselves stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators import factors as fx
from tastegrid.operators.topk import only, score_pairs, without
from tastegrid.sources.checkpoints import discard, stash

#: Levels beyond log2(n / leaf_size) that uneven medians may take.
SPARE_LEVELS = 8
#: Share of a vector's length by which its products are moved at random, to part equal vectors.
JITTER = 1e-5


def _projections(trees: int, levels: int, seed: int):
    """For each vector a row for each tree, with the products for all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
            if directions is None:
                directions = fx.seeded_normal(seed, 31, x.shape[1], trees * levels)
            p = x @ directions
            length = np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
            p = (p + JITTER * length * fx.seeded_rows(seed, 37, ids, trees * levels)).reshape(-1, levels)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * levels), pa.array(p.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, trees)), values], ["tree", "id", "p"])

    return run


class ForestIndex:
    """trees: how many; leaf_size: vectors of a leaf at most; probes: leaves of each tree that a search looks into."""

    def __init__(self, trees: int = 16, leaf_size: int = 64, probes: int = 1, seed: int = 0):
        if trees < 1 or leaf_size < 1 or probes < 1:
            raise ValueError("trees, leaf_size and probes must be at least 1")
        self.trees, self.leaf_size, self.probes, self.seed = trees, leaf_size, probes, seed

    def build(self, vectors: DataFrame) -> "ForestIndex":
        """vectors: id (distinct), features.  Writes leaves (tree, node, id) and splits (tree, node, level, threshold)."""
        self.vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<float>").alias("features"))
        n = self.vectors.count()
        self.levels = max(0, math.ceil(math.log2(max(n, 1) / self.leaf_size))) + SPARE_LEVELS
        rows = stash(self._rows(self.vectors), "forest")
        splits = []
        for level in range(self.levels):
            p = F.get("p", level)
            found = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), F.percentile_approx(p, 0.5, 10_000).cast("double").alias("threshold"))
            found = stash(found.where(F.col("n") > self.leaf_size).select("tree", "node", F.lit(level).alias("level"), "threshold"), "forest-splits")
            if found.isEmpty():
                break
            splits.append(found)
            # Few nodes at first, so Spark broadcasts them; many even ones later, which it shuffles.
            moved = rows.join(found.drop("level"), ["tree", "node"], "left")
            node = F.when(F.col("threshold").isNull(), F.col("node")).otherwise(2 * F.col("node") + (p > F.col("threshold")).cast("long"))
            old, rows = rows, stash(moved.select("tree", "id", node.alias("node"), "p"), "forest")
            discard(old)
        self.splits = splits
        self.leaves = stash(rows.select("tree", "node", "id"), "forest-leaves")
        discard(rows)
        return self

    def _rows(self, vectors: DataFrame) -> DataFrame:
        placed = vectors.mapInArrow(_projections(self.trees, self.levels, self.seed), "tree int, id bigint, p array<float>")
        return placed.select("tree", "id", F.lit(1).cast("bigint").alias("node"), "p")

    def visit(self, queries: DataFrame, trees: int | None = None) -> DataFrame:
        """query_id, tree and node of the leaves that a search looks into, in the first `trees` trees.

        Going down, a query follows both sides of a split; of the nodes of a tree those are kept that it crossed the
        least distance for, `probes` in number.
        """
        own = queries.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<float>").alias("features"))
        at = self._rows(own).withColumn("crossed", F.lit(0.0))
        if trees is not None:
            at = at.where(F.col("tree") < trees)
        best = Window.partitionBy("id", "tree").orderBy("crossed", "node")
        for level, found in enumerate(self.splits):
            p = F.get("p", level).cast("double")
            near = F.struct((2 * F.col("node") + (p > F.col("threshold")).cast("long")).alias("node"), F.col("crossed").alias("crossed"))
            far = F.struct((2 * F.col("node") + (p <= F.col("threshold")).cast("long")).alias("node"), F.greatest("crossed", F.abs(p - F.col("threshold"))).alias("crossed"))
            stays = F.struct("node", "crossed")
            ways = F.when(F.col("threshold").isNull(), F.array(stays)).otherwise(F.array(near, far) if self.probes > 1 else F.array(near))
            at = at.join(found.drop("level"), ["tree", "node"], "left").select("tree", "id", "p", F.inline(ways))
            if self.probes > 1:
                at = at.withColumn("place", F.row_number().over(best)).where(F.col("place") <= self.probes).drop("place")
        return at.select(F.col("id").alias("query_id"), "tree", "node")

    def candidates(self, queries: DataFrame, trees: int | None = None) -> DataFrame:
        """query_id and id of the vectors in the visited leaves, each pair once."""
        return self.visit(queries, trees).join(self.leaves, ["tree", "node"]).select("query_id", "id").distinct()

    def search(self, queries: DataFrame, k: int, liked: DataFrame | None = None, allow: DataFrame | None = None, deny: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        """query_id, rank, id, score by inner product; filters hold before the k best are taken."""
        pairs = without(only(self.candidates(queries), "id", allow), "id", deny)
        if liked is not None:
            pairs = pairs.join(liked.select("query_id", "id"), ["query_id", "id"], "left_anti")
        return score_pairs(queries, self.vectors, pairs, k, digits)
