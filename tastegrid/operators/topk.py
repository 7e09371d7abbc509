"""Top-k: ranked selection, masks and exact scoring of factors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.vectors import norm, safe_norm
from tastegrid.sources.checkpoints import stash

#: Factors in one block of a blocked product, and bytes up to which the blocks of the items are broadcast.
BLOCK_ROWS = 8192
BROADCAST_BYTES = 64 << 20
#: Items of a leaf at most, leaves that a query looks into first, bounds held at once (of few queries every leaf costs as much as of many), and candidates held before they are trimmed.
LEAF, FIRST_LEAVES, MOST_BOUNDS, MOST_FOUND = 512, 6, 42_000_000, 2_000_000


def rank_top(df: DataFrame, query: str, item: str, k: int, score: str = "score", digits: int | None = None) -> DataFrame:
    """The k best items of each query in a total order: score, then item, both descending; adds rank from 1."""
    if digits is not None:
        df = df.withColumn(score, F.round(score, digits))
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item).desc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def without(df: DataFrame, item: str, deny: DataFrame | None) -> DataFrame:
    """Rows whose item is not in deny (id)."""
    return df if deny is None else df.join(deny.select(F.col("id").alias(item)).distinct(), item, "left_anti")


def only(df: DataFrame, item: str, allow: DataFrame | None) -> DataFrame:
    """Rows whose item is in allow (id)."""
    return df if allow is None else df.join(allow.select(F.col("id").alias(item)).distinct(), item, "left_semi")


def check_lists(allow: DataFrame | None, deny: DataFrame | None, known: DataFrame | None = None) -> None:
    """Allow- and deny-lists exclude each other; unknown ids in an allow-list are an error."""
    if allow is not None and deny is not None:
        raise ValueError("an allow-list and a deny-list exclude each other")
    if allow is not None and known is not None and not allow.select("id").join(known.select("id"), "id", "left_anti").isEmpty():
        raise IndexError("the allow-list holds unknown ids")


def _pack(with_liked: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                data = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(ids), -1)
                columns = [pa.array([ids.tobytes()]), pa.array([data.tobytes()])]
                names = ["ids", "data"]
                if with_liked:
                    liked = part.column(2)
                    counts = np.array([0 if x is None else len(x) for x in liked.to_pylist()], np.int64)
                    flat = np.asarray(liked.flatten().to_numpy(zero_copy_only=False), np.int64)
                    columns += [pa.array([counts.tobytes()]), pa.array([flat.tobytes()])]
                    names += ["counts", "liked"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _product(k: int, cosine: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # One pair of blocks at a time is taken out of the batch.
                r = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                q, i = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["q_data"], np.float32).reshape(len(q), -1).astype(np.float64)
                y = np.frombuffer(r["data"], np.float32).reshape(len(i), -1).astype(np.float64)
                if cosine:
                    lengths = [np.linalg.norm(m, axis=1) for m in (x, y)]
                    x, y = (m / np.where(n == 0, 1e-10, n)[:, None] for m, n in zip((x, y), lengths))
                order = np.argsort(i)
                i, y = i[order], y[order]
                liked = np.frombuffer(r["liked"], np.int64)
                ends = np.cumsum(np.frombuffer(r["counts"], np.int64))
                for at in range(0, len(q), 256):
                    scores = x[at : at + 256] @ y.T
                    for row in range(len(scores)):
                        own = liked[ends[at + row - 1] if at + row else 0 : ends[at + row]]
                        if len(own):
                            found = np.searchsorted(i, own)
                            hit = found < len(i)
                            hit[hit] = i[found[hit]] == own[hit]
                            scores[row, found[hit]] = -np.inf
                    n = min(k, scores.shape[1])
                    best = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.tile(np.arange(n), (len(scores), 1))
                    least = np.take_along_axis(scores, best, 1).min(axis=1)
                    rows, columns = [], []
                    for row in range(len(scores)):
                        # All items tied with the last one are looked at, so that ties go by id.
                        c = np.flatnonzero(scores[row] >= least[row]) if np.isfinite(least[row]) else np.flatnonzero(np.isfinite(scores[row]))
                        c = c[np.lexsort((-i[c], -scores[row, c]))][:k]
                        rows.append(np.full(len(c), row))
                        columns.append(c)
                    rows_, columns_ = np.concatenate(rows), np.concatenate(columns)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[at + rows_]), pa.array(i[columns_]), pa.array(scores[rows_, columns_])], ["query_id", "id", "score"]
                    )

    return run


class _Leaves:
    """Items sorted into leaves of near vectors, each with bounds on its products; an index of BROADCAST_BYTES at most."""

    def __init__(self, ids: np.ndarray, y: np.ndarray):
        groups, ready = [np.argsort(ids)], []
        while groups:
            g = groups.pop()
            if len(g) <= LEAF:
                ready.append(g)
                continue
            own = y[g, int(np.argmax(np.ptp(y[g], axis=0)))]
            order = np.argpartition(own, len(g) // 2)
            groups += [g[order[len(g) // 2 :]], g[order[: len(g) // 2]]]
        order = np.concatenate(ready)
        self.ids, self.y = ids[order], y[order]
        self.ends = np.cumsum([len(g) for g in ready])
        self.starts = self.ends - [len(g) for g in ready]
        self.sorted = np.argsort(self.ids)
        boxes = [(m.min(axis=0), m.max(axis=0), m.mean(axis=0, dtype=np.float64)) for m in (self.y[s:e] for s, e in zip(self.starts, self.ends))]
        low, high, self.mean = (np.array(x, np.float64) for x in zip(*boxes))
        self.middle, self.half = (low + high) / 2, (high - low) / 2
        self.radius = np.array([np.linalg.norm(self.y[s:e] - c, axis=1).max() for s, e, c in zip(self.starts, self.ends, self.mean)])
        #: For products in single precision, which are sought first; factors are in it already, and only unit vectors are held twice.
        self.near = self.y.astype(np.float32, copy=False)
        self.length = np.array([np.linalg.norm(self.y[s:e].astype(np.float64), axis=1).max() for s, e in zip(self.starts, self.ends)])

    def slack(self) -> float:
        """What a product in single precision may be off by, as a share of the two lengths."""
        return (self.y.shape[1] + 8) * 2.0**-23

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """What the product of each query with any item of each leaf cannot exceed, in single precision."""
        own, x = np.linalg.norm(x, axis=1)[:, None].astype(np.float32), x.astype(np.float32)
        middle, half, mean = (m.T.astype(np.float32) for m in (self.middle, self.half, self.mean))
        radius = self.radius.astype(np.float32)
        # Rounding of these sums.
        rounding = np.float32(8 * self.slack() * (self.length.max() + self.radius.max()))
        out = np.empty((len(x), len(self.starts)), np.float32)
        for at in range(0, len(x), 1024):
            rows = slice(at, at + 1024)
            np.minimum(x[rows] @ middle + np.abs(x[rows]) @ half, x[rows] @ mean + own[rows] * radius, out=out[rows])
            out[rows] += own[rows] * rounding + np.float32(1e-30)
        return out


def _trimmed(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best and those within `margin` of the k-th; of equal scores the k greatest ids."""
    order = np.lexsort((-i, -s, q))
    q, i, s = q[order], i[order], s[order]
    place = np.arange(len(q))
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, place, 0)) if len(q) else place
    equal = np.maximum.accumulate(np.where(new | np.r_[True, s[1:] != s[:-1]], place, 0)) if len(q) else place
    size = np.diff(np.r_[np.flatnonzero(new), len(q)])
    last = np.repeat(np.flatnonzero(new) + np.minimum(size, k) - 1, size)
    keep = (place - equal < k) & ((place - start < k) | (s >= s[last] - margin))
    return q[keep], i[keep], s[keep]


def _searched(index, k: int, cosine: bool, margin: float) -> Callable:
    """The best of a broadcast index of items for rows (id, features, liked): leaves whose bound is below a query's k-th score so far are left out."""

    def search(x: np.ndarray, lq: np.ndarray, lp: np.ndarray, t: _Leaves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds, n = t.bounds(x), len(t.starts)
        cut = np.searchsorted(lp, np.r_[t.starts, t.ends[-1:]])
        where = np.full(len(x), -1)
        near, own = x.astype(np.float32), np.linalg.norm(x, axis=1)

        def scores(leaf: int, rows: np.ndarray) -> np.ndarray:
            s = near[rows] @ t.near[t.starts[leaf] : t.ends[leaf]].T
            mine = slice(cut[leaf], cut[leaf + 1])
            if cut[leaf] < cut[leaf + 1]:
                where[rows] = np.arange(len(rows))
                at = where[lq[mine]]
                s[at[at >= 0], (lp[mine] - t.starts[leaf])[at >= 0]] = -np.inf
                where[rows] = -1
            return s

        # A query's k-th score of its likeliest leaves is no more than that of all.
        least = np.full(len(x), -np.inf)
        first = min(n, FIRST_LEAVES)
        if n > 1:
            likely = np.argpartition(bounds, n - first, axis=1)[:, n - first :] if first < n else np.tile(np.arange(n), (len(x), 1))
            best = np.full((len(x), first * k if k < LEAF else 0), -np.inf)
            for c in range(first if k < LEAF else 0):
                order = np.argsort(likely[:, c], kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(likely[order, c])) + 1):
                    leaf = int(likely[rows[0], c])
                    s = scores(leaf, rows)
                    m = min(k, s.shape[1])
                    # Of single precision the least that the product can be.
                    best[rows, c * k : c * k + m] = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m :] - (t.slack() * t.length[leaf] * own[rows])[:, None]
            if best.shape[1]:
                least = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        found, held = [none], 0
        # The leaves that a query's k-th score does not rule out, leaf by leaf.
        leaf_of, row_of = np.nonzero((bounds >= (least - margin - 1e-6 * np.abs(np.where(np.isfinite(least), least, 0)))[:, None]).T)
        ends = np.searchsorted(leaf_of, np.arange(n + 1))
        for leaf in np.argsort(-bounds.mean(axis=0)):
            rows = row_of[ends[leaf] : ends[leaf + 1]]
            rows = rows[bounds[rows, leaf] >= least[rows] - margin - 1e-6 * np.abs(np.where(np.isfinite(least[rows]), least[rows], 0))]
            if not len(rows):
                continue
            s = scores(int(leaf), rows)
            known = np.where(np.isfinite(least[rows]), least[rows], 0)
            enough = least[rows] - margin - 1e-9 * (1 + np.abs(known))
            # Whatever its rounding may hide is kept; liked items, at -inf, are not.
            floor = np.maximum(enough - t.slack() * t.length[leaf] * own[rows], np.finfo(np.float32).min)
            r, c = np.nonzero(s >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
            if cut[leaf] < cut[leaf + 1]:
                finite = np.isfinite(s[r, c])
                r, c = r[finite], c[finite]
            exact = np.einsum("ij,ij->i", x[rows[r]], t.y[t.starts[leaf] + c].astype(np.float64))
            keep = exact >= enough[r]
            r, c, exact = r[keep], c[keep], exact[keep]
            found.append((rows[r], t.ids[t.starts[leaf] + c], exact))
            held += len(r)
            if held >= MOST_FOUND:
                found = [_trimmed(*(np.concatenate(f) for f in zip(*found)), k, margin)]
                q, _, s = found[0]
                held = len(q) - MOST_FOUND // 2 if len(q) > MOST_FOUND // 2 else 0
                # Queries that have k items know a better k-th score now.
                starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                full = np.diff(np.r_[starts, len(q)]) >= k
                least[q[starts[full]]] = np.maximum(least[q[starts[full]]], s[starts[full] + k - 1])
        return _trimmed(*(np.concatenate(f) for f in zip(*found)), k, margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = index.value
        sorted_ids = t.ids[t.sorted]
        step = max(256, min(10_000, MOST_BOUNDS // len(t.starts)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False))
                x = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(ids), -1).astype(np.float64)
                if cosine:
                    x /= np.where((n := np.linalg.norm(x, axis=1)) == 0, 1e-10, n)[:, None]
                liked = np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.int64)
                lq = np.repeat(np.arange(len(ids)), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                place = np.minimum(np.searchsorted(sorted_ids, liked), len(sorted_ids) - 1)
                known = sorted_ids[place] == liked
                lp, lq = t.sorted[place[known]], lq[known]
                order = np.argsort(lp, kind="stable")
                q, i, s = search(x, lq[order], lp[order], t)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], ["query_id", "id", "score"])

    return run


def _best_of(asked: DataFrame, items: DataFrame, k: int, cosine: bool, margin: float) -> DataFrame:
    """query_id, id and score of at least each query's k best of the items, of which there are BROADCAST_BYTES at most."""
    schema = "query_id bigint, id bigint, score double"
    found = items.select("id", "features").toArrow()
    if not found.num_rows:
        return asked.sparkSession.createDataFrame([], schema)
    y = found.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
    if cosine:
        y = y.astype(np.float64)
        y /= np.where((n := np.linalg.norm(y, axis=1)) == 0, 1e-10, n)[:, None]
    index = asked.sparkSession.sparkContext.broadcast(_Leaves(found.column("id").to_numpy(), y))
    return asked.select("id", "features", "liked").mapInArrow(_searched(index, k, cosine, margin), schema)


def _asked(queries: DataFrame, liked: DataFrame | None) -> DataFrame:
    """id, features and liked (the ids to leave out) of each query; queries without liked ids may be asked for twice, and count once."""
    own = queries.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<float>").alias("features"))
    none = F.array().cast("array<bigint>")
    if liked is None:
        return own.dropDuplicates(["id"]).withColumn("liked", none)
    left_out = liked.groupBy(F.col("query_id").alias("id")).agg(F.collect_list("id").alias("liked"))
    return own.join(left_out, "id", "left").select("id", "features", F.coalesce("liked", none).alias("liked"))


QUERY_BLOCK, ITEM_BLOCK = "ids binary, data binary, counts binary, liked binary", "ids binary, data binary"


def _items_bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.size("features") * 4 + 8)).first()[0] or 0


def scan_depths(asked: DataFrame, best: DataFrame, k: int, lengths: list[float], slack: float) -> DataFrame:
    """asked with depth: how many item blocks, in order of their longest vectors' lengths, may still hold one of a query's k best.

    best: what is known so far (query_id, score).  A product is at most the product of the lengths, so a query that has
    k items is done with the blocks for which that stays below its k-th score by more than `slack`.
    """
    known = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    rows = asked.join(known, "id", "left").select("id", "features", "liked", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    # From the shortest on: how many lengths are below what the query needs.
    ascending = np.array(lengths[::-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            own, least = np.linalg.norm(x, axis=1), np.asarray(batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False))
            needed = (least - slack - 1e-6 * np.abs(np.where(np.isfinite(least), least, 0))) / np.maximum(own, 1e-300)
            needed = np.where(least > 0, needed, -np.inf)
            depth = len(ascending) - np.searchsorted(ascending, needed, side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(depth.astype(np.int32))], ["id", "features", "liked", "depth"])

    return rows.mapInArrow(run, "id bigint, features array<float>, liked array<bigint>, depth int")


def _item_blocks(items: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """Blocks of items (place, ids, data), longest vectors first, and the greatest length in each: one number for each block."""
    spread = items.withColumn("length", norm(F.col("features"))).repartitionByRange(max(1, math.ceil(n / BLOCK_ROWS)), F.col("length").desc())
    packed = spread.select("id", "features").mapInArrow(_pack(False), ITEM_BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = stash(packed, "item-blocks")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r["data"], np.float32).astype(np.float64).reshape(len(r["ids"]) // 8, -1)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([float(np.linalg.norm(m, axis=1).max())])], ["block", "length"])

    lengths = sorted(((r["length"], r["block"]) for r in blocks.mapInArrow(longest, "block bigint, length double").collect()), reverse=True)
    places = items.sparkSession.createDataFrame([(b, p + 1) for p, (_, b) in enumerate(lengths)] or [(-1, 0)], "block long, place int")
    return blocks.join(F.broadcast(places), "block").select("place", "ids", "data"), [x for x, _ in lengths]


def score_top(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    cosine: bool = False,
    liked: DataFrame | None = None,
    allow: DataFrame | None = None,
    deny: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """The k best items of each query by inner product, or by cosine.

    queries, items: id, features.  liked: (query_id, id) pairs to leave out.
    Lists are applied before the product, liked pairs inside it, and each block
    gives its k best, so results are whole: query_id, rank, id, score, in the
    order score, id descending; fewer rows where there are fewer items.

    The longest items, BROADCAST_BYTES of them at most, are broadcast to all queries
    in leaves of near vectors, of which a query takes those that its k-th score so
    far does not rule out.  Where there are more, the others form
    blocks in order of length; a query is then sent, by a shuffle on block numbers,
    to the blocks that its k-th score so far does not rule out.
    """
    items = without(only(items, "id", allow), "id", deny).select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<float>").alias("features"))
    asked = _asked(queries, liked)
    size = _items_bytes(items)
    product, schema = _product(k, cosine), "query_id bigint, id bigint, score double"
    # Scores that are equal when rounded are told apart by id.
    margin = 0.0 if digits is None else 10.0**-digits
    if size <= BROADCAST_BYTES:
        return rank_top(_best_of(asked, items, k, cosine, margin), "query_id", "id", k, digits=digits).select("query_id", "rank", "id", "score")
    if cosine:
        # All of one length then; those of no length keep their zeros.
        items, asked = (t.withColumn("features", F.transform("features", lambda v: (v / safe_norm(F.col("features"))).cast("float"))) for t in (items, asked))
    items, asked = stash(items, "scored-items"), stash(asked, "scored-queries")
    n = items.count()
    cut = items.agg(F.percentile_approx(norm(F.col("features")), 1 - BROADCAST_BYTES / size * 0.9, 100_000)).first()[0]
    head, tail = (items.where(w) for w in (norm(F.col("features")) > cut, norm(F.col("features")) <= cut))
    if _items_bytes(head) > BROADCAST_BYTES:
        head, tail = items.limit(0), items
    first = _best_of(asked, head, k, cosine, 0.0)
    best = stash(rank_top(first, "query_id", "id", k).drop("rank"), "scored-first")
    blocks, lengths = _item_blocks(tail, n)
    deep = scan_depths(asked, best, k, lengths, margin).where("depth > 0")
    # Queries of like depth share a block, which goes to each item block of that depth; salts give every core a part.
    salts = max(1, math.ceil(2 * items.sparkSession.sparkContext.defaultParallelism / max(1, len(lengths))))
    sorted_ = deep.repartitionByRange("depth").sortWithinPartitions("depth")
    q = sorted_.mapInArrow(_pack_depths, f"{QUERY_BLOCK}, depth int").select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "counts", "liked", "depth")
    q = q.select("q_ids", "q_data", "counts", "liked", F.pmod(F.xxhash64("q_ids"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("place"))
    i = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = q.join(i, ["place", "salt"]).select("q_ids", "q_data", "counts", "liked", "ids", "data")
    every = best.unionByName(met.mapInArrow(product, schema))
    return rank_top(every, "query_id", "id", k, digits=digits).select("query_id", "rank", "id", "score")


def _pack_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries of one depth; rows come in order of depth."""
    for batch in batches:
        depth = np.asarray(batch.column(3).to_numpy(zero_copy_only=False))
        cuts = np.r_[np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]), len(depth)] if len(depth) else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            for packed in _pack(True)(iter([batch.slice(int(s), int(e - s))])):
                yield pa.RecordBatch.from_arrays([*packed.columns, pa.array([int(depth[s])], pa.int32())], [*packed.schema.names, "depth"])


def score_pairs(queries: DataFrame, items: DataFrame, pairs: DataFrame, k: int | None, digits: int | None = None) -> DataFrame:
    """The k best of the given pairs (query_id, id) of each query by inner product, all if k is None: query_id, rank (not if k is None), id, score.

    A pair carries its item's vector only; a query's vector comes once, ahead of its pairs.
    """
    vector = F.col("features").cast("array<float>").alias("features")
    heads = queries.select(F.col("id").cast("long").alias("query_id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), vector).dropDuplicates(["query_id"])
    tails = pairs.join(items.select(F.col("id").cast("long").alias("id"), vector), "id").select("query_id", F.lit(1).alias("kind"), "id", "features")
    rows = heads.unionByName(tails).repartition("query_id").sortWithinPartitions("query_id", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            query, kind, ids = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(3))
            m = np.asarray(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
            # Which query's row each row follows; those before the first belong to the last batch's.
            own = np.cumsum(kind == 0)
            known = m[kind == 0] if x is None else np.concatenate([x[None], m[kind == 0]])
            own = own - (x is None)
            at = np.r_[[] if x is None else [at], query[kind == 0]]
            pair = (kind == 1) & (at[own] == query)
            scores = np.einsum("ij,ij->i", known[own[pair]], m[pair])
            x, at = known[-1], at[-1]
            yield pa.RecordBatch.from_arrays([pa.array(query[pair]), pa.array(ids[pair]), pa.array(scores)], ["query_id", "id", "score"])

    scored = rows.mapInArrow(run, "query_id bigint, id bigint, score double")
    if k is None:
        return scored
    return rank_top(scored, "query_id", "id", k, digits=digits).select("query_id", "rank", "id", "score")
