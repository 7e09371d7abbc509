"""A neighbour graph over vectors, searched by a beam along its edges.

Building: the leaves of a random-projection forest give each vector its first
neighbours; then, in rounds, vectors that share a neighbour are compared (a join
of edges with edges at the vertex between them) and each keeps its best.
Searching: each query starts in its leaf of one tree; every round joins the best
vertices that it has not followed yet with their edges, scores what is new, and
keeps the `width` best, until all of them have been followed.  All rounds are
joins over all queries at once, written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators import factors as fx
from tastegrid.operators.forest import ForestIndex
from tastegrid.operators.topk import only, rank_top, score_pairs, without
from tastegrid.sources.checkpoints import discard, stash


def _compare(degree: int):
    """For rows (group, id, features): the `degree` best others of each id in its group, as id, other, score.  Groups are bounded."""

    def kernel(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        group, ids, x = columns
        starts, _ = fx.segments(group)
        left, right, scores = [], [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            if e - s < 2:
                continue
            own, v = ids[s:e], x[s:e].astype(np.float64)
            product = v @ v.T
            np.fill_diagonal(product, -np.inf)
            n = min(degree, e - s - 1)
            best = np.argpartition(-product, n - 1, axis=1)[:, :n]
            left.append(np.repeat(own, n))
            right.append(own[best].ravel())
            scores.append(np.take_along_axis(product, best, 1).ravel())
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (left, right, scores)], ["id", "other", "score"])

    return fx.whole_groups(kernel, 20_000)


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The `degree` best edges of each vertex: id, other, score.  A pair met in several groups may differ in the last digits of its score."""
    return rank_top(edges.groupBy("id", "other").agg(F.max("score").alias("score")), "id", "other", degree).drop("rank")


class GraphIndex:
    """degree: edges of a vertex in either direction; pool: edges that it keeps while the graph is built; entries: vertices a search starts with.

    width: vertices that a search keeps; step: of these, how many it follows in a round.
    """

    def __init__(self, degree: int = 12, width: int = 14, step: int = 2, rounds: int = 3, pool: int | None = None, entries: int = 16, trees: int = 10, leaf_size: int = 48, seed: int = 0):
        self.degree, self.width, self.step, self.rounds = degree, width, step, rounds
        self.pool, self.entries = pool or 2 * degree, entries
        self.forest = ForestIndex(trees, leaf_size, seed=seed)

    def build(self, vectors: DataFrame) -> "GraphIndex":
        """vectors: id (distinct), features.  Writes the graph: id and edges (array of ids)."""
        self.forest.build(vectors)
        self.vectors = self.forest.vectors
        # A leaf is a group; its node's number and its tree's make one key.
        groups = self.forest.leaves.select((F.col("node") * self.forest.trees + F.col("tree")).alias("group"), "id")
        edges = stash(_best(self._compared(groups), self.pool), "graph-edges")
        for _ in range(self.rounds):
            old = edges
            edges = stash(_best(edges.unionByName(self._compared(self._meetings(edges))), self.pool), "graph-edges")
            discard(old)
        both = self._both_ways(_best(edges, self.degree), self.degree)
        # Two vertices may have found each other: a set.
        self.graph = stash(both.groupBy("id").agg(F.collect_set("other").alias("edges")), "graph")
        discard(edges)
        return self

    def _both_ways(self, edges: DataFrame, most: int) -> DataFrame:
        """Edges, and for each vertex the `most` best of those that lead to it."""
        back = edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "score")
        return edges.select("id", "other").unionByName(rank_top(back, "id", "other", most).select("id", "other"))

    def _meetings(self, edges: DataFrame) -> DataFrame:
        """Each vertex with its neighbours of either direction: 2 pool + 1 members at most."""
        both = self._both_ways(edges, self.pool).distinct().select(F.col("id").alias("group"), F.col("other").alias("id"))
        return both.unionByName(edges.select(F.col("id").alias("group"), "id").distinct())

    def _compared(self, groups: DataFrame) -> DataFrame:
        rows = groups.join(self.vectors, "id").select("group", "id", "features")
        return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_compare(self.pool), "id bigint, other bigint, score double")

    def _scored(self, state: DataFrame, fresh: DataFrame) -> DataFrame:
        """query_id and met, the (score, id) of each of its fresh ids."""
        asked = state.select(F.col("query_id").alias("id"), "features")
        found = score_pairs(asked, self.vectors, fresh, None)
        return found.groupBy("query_id").agg(F.collect_list(F.struct("score", "id")).alias("met"))

    def walk(self, queries: DataFrame) -> DataFrame:
        """query_id, features, beam (array of (score, id, open), best first) and seen (ids compared), when no query has an open vertex left."""
        asked = queries.select(F.col("id").cast("long").alias("query_id"), F.col("features").cast("array<float>").alias("features")).dropDuplicates(["query_id"])
        none = F.array().cast("array<struct<score: double, id: bigint, open: boolean>>")
        state = stash(asked.select("query_id", "features", none.alias("beam"), F.array().cast("array<bigint>").alias("seen")), "graph-state")
        leaf = self.forest.candidates(asked.withColumnRenamed("query_id", "id"), 1)
        some = Window.partitionBy("query_id").orderBy(F.xxhash64("query_id", "id"), "id")
        fresh = leaf.withColumn("place", F.row_number().over(some)).where(F.col("place") <= self.entries).select("query_id", "id")
        complete = []
        while True:
            met = self._scored(state, fresh)
            beam = F.concat("beam", F.transform(F.coalesce("met", F.array().cast("array<struct<score: double, id: bigint>>")), lambda m: F.struct(m["score"], m["id"], F.lit(True).alias("open"))))
            beam = F.slice(F.sort_array(beam, asc=False), 1, self.width)
            seen = F.concat("seen", F.transform(F.coalesce("met", F.array().cast("array<struct<score: double, id: bigint>>")), lambda m: m["id"]))
            after = state.join(met, "query_id", "left").select("query_id", "features", beam.alias("beam"), seen.alias("seen"))
            # Of the open vertices the best are followed now.
            follow = F.slice(F.transform(F.filter("beam", lambda b: b["open"]), lambda b: b["id"]), 1, self.step)
            after = after.withColumn("follow", follow)
            closed = F.transform("beam", lambda b: F.struct(b["score"], b["id"], (b["open"] & ~F.array_contains("follow", b["id"])).alias("open")))
            state = stash(after.withColumn("beam", closed), "graph-state")
            # Each round's table holds the queries that were still going, so all stay until the walk's result is read.
            complete.append(state.where(F.size("follow") == 0).select("query_id", "features", "beam", "seen"))
            going = state.where(F.size("follow") > 0)
            if going.isEmpty():
                break
            steps = going.select("query_id", F.explode("follow").alias("id")).join(self.graph, "id")
            reached = steps.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("reached"))
            fresh = going.join(reached, "query_id").select("query_id", F.explode(F.array_except("reached", "seen")).alias("id"))
            state = going.select("query_id", "features", "beam", "seen")
        out = complete[0]
        for c in complete[1:]:
            out = out.unionByName(c)
        return out

    def search(self, queries: DataFrame, k: int, liked: DataFrame | None = None, allow: DataFrame | None = None, deny: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        """query_id, rank, id, score by inner product.

        Filters hold before the k best are taken, of all vectors that the walk has compared.
        """
        walked = self.walk(queries)
        if k <= self.width and liked is None and allow is None and deny is None:
            found = walked.select("query_id", F.inline("beam"))
            return rank_top(found, "query_id", "id", k, digits=digits).select("query_id", "rank", "id", "score")
        pairs = without(only(walked.select("query_id", F.explode("seen").alias("id")), "id", allow), "id", deny)
        if liked is not None:
            pairs = pairs.join(liked.select("query_id", "id"), ["query_id", "id"], "left_anti")
        return score_pairs(queries, self.vectors, pairs, k, digits)

    def compared(self, queries: DataFrame) -> DataFrame:
        """query_id and n, the vectors that a search compares it with."""
        return self.walk(queries).select("query_id", F.size("seen").cast("long").alias("n"))
