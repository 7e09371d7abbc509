"""Item-item nearest neighbours by a block-sparse product.

Items are dealt into blocks.  A user's entries become one row for each block
that they touch; these rows, of which a user has no more than there are blocks,
meet by user and go to the cell of their two blocks; a cell's task adds up the
products of all users in one dense square and gives each item's best of that
square.  So a user of very many items is spread over all cells, pairs are summed
before anything else is shuffled, and only the best of each square is ranked.
Where users make fewer pairs than the squares have places, each item's row is
summed from its users' lists instead, without squares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.functions import weighting
from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions
from tastegrid.operators import factors as fx
from tastegrid.operators.sparse import product_top, ranked_product
from tastegrid.operators.topk import check_lists, only, rank_top, without
from tastegrid.sources import store
from tastegrid.sources.checkpoints import discard, kept_at, release, stash, stash_in_passes

#: Items of a block at most, and pairs that are multiplied at once.
BLOCK_ITEMS, MOST_PAIRS = 2048, 2_000_000
#: Places of the squares that cost as much as one pair of a sparse row.
PLACES_PER_PAIR = 8
#: The score of an item that only an allow-list has named.
LEAST_SCORE = -1.7976931348623157e308
PAIRS = "item bigint, neighbour bigint, score double"


def _squares(blocks: int, width: int, k: int | None, margin: float) -> Callable:
    """Products summed in the square of each cell; rows (cell, a, v, b, w: the entries of a user in the cell's two blocks) come in order of cell.

    Gives, for each item, all that share a user with it, or what may be among its k best: those whose sum is less than `margin` below the k-th.
    """

    def add(total: np.ndarray, met: np.ndarray, batch: pa.RecordBatch) -> None:
        lists = [batch.column(c) for c in range(1, 5)]
        a, v, b, w = (np.asarray(x.flatten().to_numpy(zero_copy_only=False)) for x in lists)
        la, lb = (np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), np.int64) for x in (lists[0], lists[2]))
        # Entry p of a meets the `reps` entries of b of its row, from `first` on.
        reps, first = np.repeat(lb, la), np.repeat(np.cumsum(lb) - lb, la)
        cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(reps), np.arange(MOST_PAIRS, reps.sum(), MOST_PAIRS)), len(reps)])
        for s, e in zip(cuts.tolist(), cuts[1:].tolist()):
            n = reps[s:e]
            right = np.arange(n.sum()) + np.repeat(first[s:e] - np.cumsum(n) + n, n)
            place = np.repeat(a[s:e] // blocks * width, n) + b[right] // blocks
            np.add.at(total, place, np.repeat(v[s:e], n) * w[right])
            met[place] = True

    def best(cell: int, total: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = divmod(cell, blocks)
        scores = np.where(met, total, -np.inf).reshape(width, width)
        # Off the diagonal a square also holds the other block's items, in its columns.
        for m, own, other in ((scores, i, j), (scores.T, j, i))[: 1 + (i != j)]:
            for at in range(0, width, 256):
                part = m[at : at + 256]
                keep = np.isfinite(part)
                if k is not None and k < width:
                    keep &= part >= np.partition(part, width - k, axis=1)[:, width - k, None] - margin
                r, c = np.nonzero(keep)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array((at + r) * blocks + own), pa.array(c * blocks + other), pa.array(part[r, c])], ["item", "neighbour", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, total, met = None, np.zeros(width * width), np.zeros(width * width, bool)
        for batch in batches:
            own = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            starts, found = fx.segments(own)
            for s, e, c in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], found.tolist()):
                if c != cell:
                    if cell is not None:
                        yield from best(cell, total, met)
                    cell = c
                    total[:], met[:] = 0, False
                add(total, met, batch.slice(s, e - s))
        if cell is not None:
            yield from best(cell, total, met)

    return run


def _stored(x: Interactions) -> tuple[Interactions, bool]:
    """Interactions in a stash, their shape fixed, and whether they were in one already."""
    given = hasattr(x.df, "stashed_at")
    stored = x.df if given else stash(x.df, "interactions")
    if not given:
        release(x.df.sparkSession)
    shape = Interactions(stored, x.users, x.items)
    return Interactions(stored, shape.n_users, shape.n_items), given


def _rows_of_users(x: Interactions) -> DataFrame:
    """The rows of users, stashed."""
    rows = stash(x.rows(), "rows-of-users")
    release(x.df.sparkSession)
    return rows


def _products(x: Interactions, rows: DataFrame, k: int | None, digits: int | None = None, stored: bool = False) -> DataFrame:
    """item, neighbour and score of items that share a user, with k the k best of each item, in a stash if `stored`.  rows: those of users, stashed."""
    n = max(1, x.n_items)
    pairs = rows.agg(F.sum(F.size("items").cast("double") ** 2)).first()[0] or 0.0
    if pairs * PLACES_PER_PAIR >= n * n:
        entries = rows.select(USER, F.explode(F.arrays_zip(F.col("items").alias(ITEM), F.col("weights").alias(WEIGHT))).alias("x")).select(USER, f"x.{ITEM}", f"x.{WEIGHT}")
        # Sums that are equal when rounded are told apart later: all of them are kept.
        found = _dense(x.with_df(entries), n, k, 0.0 if digits is None else 10.0**-digits)
        if k is not None:
            found = rank_top(found, "item", "neighbour", k, digits=digits).drop("rank")
        return stash(found, "similarity") if stored else found
    products = rows.select(F.col(USER).alias("m"), F.col("items").alias("a"), F.col("weights").alias("v"), F.col("items").alias("b"), F.col("weights").alias("w"))
    found = product_top(products, squares=True, stored=stored) if k is None else ranked_product(products, k, digits, squares=True, stored=stored)
    return kept_at(found.select(F.col("a").alias("item"), F.col("b").alias("neighbour"), "score"), found)


def _dense(x: Interactions, n: int, k: int | None, margin: float) -> DataFrame:
    spark = x.df.sparkSession
    # Cells enough for all cores, and no square too large for a task.
    blocks = min(n, max(math.ceil(n / BLOCK_ITEMS), math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    width = math.ceil(n / blocks)
    block = F.pmod(F.col(ITEM), F.lit(blocks)).cast("int")
    packed = x.df.groupBy(USER, block.alias("block")).agg(F.collect_list(F.struct(ITEM, WEIGHT)).alias("x"))
    packed = packed.select(USER, "block", F.col(f"x.{ITEM}").alias("items"), F.col(f"x.{WEIGHT}").alias("weights"))
    a = packed.select(USER, F.col("block").alias("i"), F.col("items").alias("a"), F.col("weights").alias("v"))
    b = packed.select(USER, F.col("block").alias("j"), F.col("items").alias("b"), F.col("weights").alias("w"))
    met = a.join(b, USER).where("i <= j").select((F.col("i") * blocks + F.col("j")).alias("cell"), "a", "v", "b", "w")
    dealt = met.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_squares(blocks, width, k, margin), PAIRS)


def all_pairs(x: Interactions) -> DataFrame:
    """item, neighbour and score, the inner product of the two items' vectors, for items that share a user."""
    return _products(x, _rows_of_users(x), None)


def all_pairs_knn(x: Interactions, k: int = 100, digits: int | None = None) -> DataFrame:
    """The k best neighbours of each item, itself included: item, neighbour, score."""
    return _products(x, _rows_of_users(x), k, digits)


class ItemItemRecommender:
    """Neighbours by the inner product of unweighted item vectors."""

    kind = "item_item"

    def __init__(self, K: int = 20, digits: int | None = None):
        self.K, self.digits = K, digits
        self.similarity: DataFrame | None = None

    def item_part(self, x: Interactions) -> Column | None:
        """What an entry (weight; liked, the entries of its user) adds to the `total` of its item; none where weights need no totals."""
        return None

    def weighed(self, x: Interactions, mean: float) -> Column:
        """The weight of an entry, from its weight, its user's `liked` and its item's `total`, of which `mean` is the mean over all items."""
        return F.col(WEIGHT)

    def rows(self, x: Interactions) -> DataFrame:
        """The weighed rows of users, stashed; x is in a stash.

        Totals of items are summed first, then entries meet them: nothing but totals is stored between, and both are done for
        some users at a time.
        """
        n, totals, mean, part = x.df.count(), None, 0.0, self.item_part(x)

        def liked(df: DataFrame) -> DataFrame:
            return df.withColumn("liked", F.count("*").over(Window.partitionBy(USER)))

        if part is not None:
            parts = stash_in_passes([x.df], USER, lambda df: liked(df).groupBy(ITEM).agg(F.sum(part).alias("total")), "parts-of-items", n)
            totals = stash(parts.groupBy(ITEM).agg(F.sum("total").alias("total")), "totals-of-items")
            discard(parts)
            mean = (totals.agg(F.sum("total")).first()[0] or 0.0) / max(x.n_items, 1)

        def run(df: DataFrame) -> DataFrame:
            own = liked(df if totals is None else df.join(totals, ITEM))
            return x.with_df(own.select(USER, ITEM, self.weighed(x, mean).alias(WEIGHT))).rows()

        rows = stash_in_passes([x.df], USER, run, "rows-of-users", n)
        if totals is not None:
            discard(totals)
        return rows

    def fit(self, x: Interactions, callback=None, discard_interactions: bool = False) -> "ItemItemRecommender":
        """discard_interactions: x.df is a stash that nothing else will read; it goes once the rows of users are written."""
        if callback is not None:
            raise NotImplementedError("neighbour models have no iterations to call back from")
        x, given = _stored(x)
        rows = self.rows(x)
        if discard_interactions or not given:
            discard(x.df)
        # Written once: every use of a lazy table would join all pairs again.
        self.similarity = _products(x, rows, self.K, self.digits, stored=True)
        discard(rows)
        release(x.df.sparkSession)
        return self

    def _fitted(self) -> DataFrame:
        if self.similarity is None:
            raise ValueError("the model is not fitted")
        return self.similarity

    def recommend(
        self,
        users: DataFrame | None,
        x: Interactions,
        N: int = 10,
        filter_already_liked_items: bool = True,
        allow: DataFrame | None = None,
        deny: DataFrame | None = None,
        backfill: bool = False,
        discard_interactions: bool = False,
        discard_model: bool = False,
    ) -> DataFrame:
        """user_id, rank, item_id, score: the sum of the user's weights times the similarity of their items.

        users (user_id): whom to serve, all if None.  x: their histories; with discard_interactions x.df is a stash that
        nothing else will read, which goes once its entries have met the neighbours (not with backfill); so does, with discard_model, what the model was
        fitted to, and it is not fitted any more.  With backfill, a user gets all items of the
        allow-list, whatever N: those without a score come last, with the least score there is.
        """
        check_lists(allow, deny)
        if backfill:
            if allow is None:
                raise ValueError("only an allow-list can be filled up")
            every = x.df.select(USER).distinct() if users is None else users
            return self._filled(every, self.recommend(users, x, 1 << 30, filter_already_liked_items, allow), allow)
        x, given = _stored(x)
        n = x.df.count() + self._fitted().count()
        own = x.df if users is None else x.df.join(users.select(USER).distinct(), USER, "left_semi")
        s = without(only(self._fitted(), "neighbour", allow), "neighbour", deny)

        def meet(own: DataFrame, s: DataFrame) -> DataFrame:
            # An item's users meet its neighbours once; items without neighbours are left, as they too are liked.
            near = s.groupBy("m").agg(F.collect_list(F.struct("neighbour", "score")).alias("y"))
            users_of = own.groupBy("m").agg(F.collect_list(F.struct(USER, WEIGHT)).alias("x"))
            return users_of.join(near, "m", "left").select("m", F.col(f"x.{USER}").alias("a"), F.col(f"x.{WEIGHT}").alias("v"), *[F.coalesce(F.col(f"y.{c}"), F.array().cast(f"array<{t}>")).alias(d) for c, t, d in (("neighbour", "bigint", "b"), ("score", "double", "w"))])

        met = stash_in_passes([own.withColumnRenamed(ITEM, "m"), s.withColumnRenamed("item", "m")], "m", meet, "items-with-users", n)
        if discard_interactions or not given:
            discard(x.df)
        if discard_model and hasattr(self.similarity, "stashed_at"):
            discard(self.similarity)
            self.similarity = None
        best = ranked_product(met, N, self.digits, leave_out=filter_already_liked_items)
        return best.select(F.col("a").alias(USER), "rank", F.col("b").alias(ITEM), "score")

    def _filled(self, users: DataFrame, given: DataFrame, allow: DataFrame) -> DataFrame:
        """Every allowed item for every user; the result has as many rows as there are such pairs."""
        wanted = allow.select(F.col("id").alias(ITEM)).distinct()
        every = users.select(USER).distinct().crossJoin(wanted)
        padded = every.join(given.drop("rank"), [USER, ITEM], "left").withColumn("score", F.coalesce("score", F.lit(LEAST_SCORE)))
        return rank_top(padded, USER, ITEM, 1 << 30).select(USER, "rank", ITEM, "score")

    def rank_items(self, users: DataFrame, x: Interactions, items: DataFrame) -> DataFrame:
        """All the given items in order for each user, those without a common user last, with the least score."""
        return self.recommend(users, x, filter_already_liked_items=False, allow=items, backfill=True)

    def similar_items(self, items: DataFrame, N: int = 10, allow: DataFrame | None = None, deny: DataFrame | None = None, backfill: bool = False) -> DataFrame:
        """query_id, rank, id, score for items (id); unknown items have no rows.

        With backfill the N best of the allow-list are taken of all its items, those without a similarity last, with the
        least score there is.
        """
        check_lists(allow, deny)
        if backfill:
            if allow is None:
                raise ValueError("only an allow-list can be filled up")
            known = self._fitted().select(F.col("item").alias(USER)).distinct().join(items.select(F.col("id").alias(USER)).distinct(), USER, "left_semi")
            given = self._fitted().select(F.col("item").alias(USER), F.col("neighbour").alias(ITEM), "score", F.lit(0).alias("rank"))
            filled = self._filled(known, given, allow).where(F.col("rank") <= N)
            return filled.select(F.col(USER).alias("query_id"), "rank", F.col(ITEM).alias("id"), "score")
        own = self._fitted().join(items.select(F.col("id").alias("item")).distinct(), "item", "left_semi")
        own = without(only(own, "neighbour", allow), "neighbour", deny)
        ranked = stash_in_passes([own], "item", lambda df: rank_top(df, "item", "neighbour", N), "similar-items", self._fitted().count())
        return ranked.select(F.col("item").alias("query_id"), "rank", F.col("neighbour").alias("id"), "score")

    def similar_users(self, *args, **kwargs):
        raise NotImplementedError("neighbour models hold no user vectors")

    def parameters(self) -> dict:
        return {"K": self.K, "digits": self.digits}

    def save(self, path: str) -> None:
        store.save(path, self.kind, self.parameters(), {"similarity": self._fitted()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ItemItemRecommender":
        parameters, tables = store.load(spark, path, cls.kind)
        out = cls(**parameters)
        out.similarity = tables["similarity"]
        return out


class CosineRecommender(ItemItemRecommender):
    """Neighbours by cosine."""

    kind = "cosine"

    def item_part(self, x: Interactions) -> Column:
        return F.col(WEIGHT) * F.col(WEIGHT)

    def weighed(self, x: Interactions, mean: float) -> Column:
        return F.coalesce(F.try_divide(F.col(WEIGHT), F.sqrt("total")), F.lit(0.0))


class TFIDFRecommender(ItemItemRecommender):
    """Neighbours by cosine of TF-IDF weighted item vectors."""

    kind = "tfidf"

    def item_part(self, x: Interactions) -> Column:
        return weighting.tfidf_value(x.n_items, "liked") ** 2

    def weighed(self, x: Interactions, mean: float) -> Column:
        return F.coalesce(F.try_divide(weighting.tfidf_value(x.n_items, "liked"), F.sqrt("total")), F.lit(0.0))


class BM25Recommender(ItemItemRecommender):
    """Neighbours by the inner product of BM25 weighted item vectors."""

    kind = "bm25"

    def __init__(self, K: int = 20, K1: float = 1.2, B: float = 0.75, digits: int | None = None):
        super().__init__(K, digits)
        self.K1, self.B = K1, B

    def item_part(self, x: Interactions) -> Column:
        return F.col(WEIGHT)

    def weighed(self, x: Interactions, mean: float) -> Column:
        return weighting.bm25_value(x.n_items, self.K1, self.B, "liked", "total", F.lit(mean))

    def parameters(self) -> dict:
        return super().parameters() | {"K1": self.K1, "B": self.B}
