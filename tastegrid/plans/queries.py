"""The registered queries, one for each operator of the library."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions import weighting
from tastegrid.functions.vectors import dot, has_nan, hash_uniform, norm, safe_norm
from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions, encode_labels, join_labels
from tastegrid.operators import ann, bpr, evaluation, forest, graph, half, knn, lmf, topk
from tastegrid.operators import factors as fx
from tastegrid.operators.als import AlternatingLeastSquares, half_step_broadcast, half_step_shuffle, training_loss
from tastegrid.operators.bpr import BayesianPersonalizedRanking
from tastegrid.operators.lmf import LogisticMatrixFactorization
from tastegrid.plans.tables import cp, cp_stored, embeddings, ev, item_factors, table, user_factors
from tastegrid.sources.checkpoints import discard, kept_at, shared_dir, stash_in_passes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K, N, FACTORS, DIGITS = 20, 10, 8, 6
ALPHA, REG = 2.0, 0.5


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


def _ids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


DENIED, ALLOWED = tuple(range(0, 50, 5)), tuple(range(1, 300, 3))


@query
def interactions_cp(spark, d):
    return cp(spark, d).df


@query
def interactions_ev(spark, d):
    return ev(spark, d).df


@query
def csr_rows(spark, d):
    rows = ev(spark, d).rows()
    return rows.select(USER, F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query
def transposed_item_sizes(spark, d):
    x = cp(spark, d).transposed()
    return x.df.groupBy(USER).agg(F.count("*").alias("n"), F.sum(WEIGHT).alias("total"))


@query
def item_popularity(spark, d):
    return cp(spark, d).df.groupBy(ITEM).agg(F.count("*").alias("n_users"))


@query
def empty_users(spark, d):
    """Ids of the shape without any interaction."""
    x = cp(spark, d)
    return spark.range(x.n_users).select(F.col("id").alias(USER)).join(x.df, USER, "left_anti")


@query
def tfidf_weight(spark, d):
    return rounded(weighting.tfidf(cp(spark, d)).df, WEIGHT)


@query
def bm25_weight(spark, d):
    return rounded(weighting.bm25(cp(spark, d)).df, WEIGHT)


@query
def l2_normalize(spark, d):
    return rounded(weighting.normalize(cp(spark, d)).df, WEIGHT)


@query
def alpha_scale(spark, d):
    return weighting.scale(cp(spark, d), ALPHA).df


@query
def binarize_threshold(spark, d):
    return weighting.binarize(cp(spark, d), 25).df


@query
def knn_all_pairs(spark, d):
    return rounded(knn.all_pairs(ev(spark, d)), "score")


def _knn(kind, digits=DIGITS):
    return kind(K=K, digits=digits)


def _fitted(kind, spark, d) -> knn.ItemItemRecommender:
    return _knn(kind).fit(cp_stored(spark, d), discard_interactions=True)


@query
def knn_raw(spark, d):
    return _fitted(knn.ItemItemRecommender, spark, d).similarity


@query
def knn_cosine(spark, d):
    return _fitted(knn.CosineRecommender, spark, d).similarity


@query
def knn_tfidf(spark, d):
    return _fitted(knn.TFIDFRecommender, spark, d).similarity


@query
def knn_bm25(spark, d):
    return _fitted(knn.BM25Recommender, spark, d).similarity


def _bm25(spark, d) -> tuple[knn.BM25Recommender, Interactions]:
    # Written once: the fit and the recommendations would each join the tables again.
    x = cp_stored(spark, d)
    return _knn(knn.BM25Recommender).fit(x), x


@query
def knn_recommend(spark, d):
    model, x = _bm25(spark, d)
    return ranked(model.recommend(None, x, N, discard_interactions=True, discard_model=True))


@query
def knn_recommend_keep_liked(spark, d):
    model, x = _bm25(spark, d)
    return ranked(model.recommend(None, x, N, filter_already_liked_items=False, discard_interactions=True, discard_model=True))


@query
def knn_recommend_deny(spark, d):
    model, x = _bm25(spark, d)
    return ranked(model.recommend(None, x, N, deny=_ids(spark, *DENIED), discard_interactions=True, discard_model=True))


@query
def knn_recommend_allow(spark, d):
    model, x = _bm25(spark, d)
    return ranked(model.recommend(None, x, N, allow=_ids(spark, *ALLOWED), discard_interactions=True, discard_model=True))


@query
def knn_similar_items(spark, d):
    model = _fitted(knn.CosineRecommender, spark, d)
    every = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return ranked(model.similar_items(every, N))


@query
def train_split(spark, d):
    return evaluation.train_test_split(cp(spark, d), 0.8, 5)[0].df


@query
def test_split(spark, d):
    return evaluation.train_test_split(cp(spark, d), 0.8, 5)[1].df


@query
def leave_k_out_train(spark, d):
    return evaluation.leave_k_out_split(cp(spark, d), 3, 0.0, 7)[0].df


@query
def leave_k_out_test(spark, d):
    return evaluation.leave_k_out_split(cp(spark, d), 3, 0.0, 7)[1].df


@query
def train_only_users(spark, d):
    return evaluation.choose(cp(spark, d).df, USER, 0.25, 7)


@query
def leave_k_out_train_only(spark, d):
    return evaluation.leave_k_out_split(cp(spark, d), 2, 0.25, 7)[1].df


def _metrics(spark, d) -> DataFrame:
    x = cp_stored(spark, d)
    # Which entries are held out depends on those of their user alone; each is marked once, for both parts.
    marked = stash_in_passes([x.df], USER, lambda df: evaluation.leave_k_out_marks(x.with_df(df), 3, 0.0, 7), "split", x.df.count())
    discard(x.df)
    train, test = evaluation.parted(x, marked)
    train = train.with_df(kept_at(train.df, marked))
    model = knn.TFIDFRecommender(K=K, digits=DIGITS).fit(train)
    return evaluation.ranking_metrics_at_k(model, train, test, N)


@query
def precision_at_k(spark, d):
    return rounded(_metrics(spark, d).select("precision"), "precision")


@query
def map_at_k(spark, d):
    return rounded(_metrics(spark, d).select("map"), "map")


@query
def ndcg_at_k(spark, d):
    return rounded(_metrics(spark, d).select("ndcg"), "ndcg")


@query
def auc_at_k(spark, d):
    return rounded(_metrics(spark, d).select("auc"), "auc")


@query
def factor_norms(spark, d):
    e = embeddings(spark, d)
    return e.select("id", F.round(safe_norm(F.col("features")), DIGITS).alias("norm"))


@query
def nan_check(spark, d):
    return embeddings(spark, d).agg(F.max(has_nan(F.col("features"))).alias("has_nan"))


@query
def gramian(spark, d):
    m = fx.gramian(item_factors(spark, d, FACTORS), FACTORS)
    rows = [(i, j, float(m[i, j])) for i in range(FACTORS) for j in range(FACTORS)]
    return rounded(spark.createDataFrame(rows, "i long, j long, value double"), "value")


class _Fixed(fx.FactorModel):
    """A model of given factors."""

    def __init__(self, users: DataFrame, items: DataFrame):
        super().__init__()
        self.user_factors, self.item_factors, self.digits = users, items, DIGITS


def _fixed(spark, d, k: int = FACTORS) -> _Fixed:
    return _Fixed(user_factors(spark, d, k), item_factors(spark, d, k))


@query
def mf_recommend(spark, d):
    return ranked(_fixed(spark, d).recommend(None, cp(spark, d), N))


@query
def mf_recommend_all(spark, d):
    return ranked(_fixed(spark, d).recommend(None, None, N, filter_already_liked_items=False))


@query
def mf_recommend_allow(spark, d):
    return ranked(_fixed(spark, d).recommend(None, cp(spark, d), N, allow=_ids(spark, *range(1, 150, 3))))


@query
def mf_recommend_deny(spark, d):
    return ranked(_fixed(spark, d).recommend(None, cp(spark, d), N, deny=_ids(spark, *DENIED)))


@query
def mf_rank_items(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias(USER))
    return ranked(_fixed(spark, d).rank_items(users, _ids(spark, 1, 2, 3, 4, 5, 6)))


@query
def mf_similar_items(spark, d):
    e = embeddings(spark, d)
    return ranked(_Fixed(e, e).similar_items(e.select("id"), N))


@query
def mf_similar_items_deny(spark, d):
    e = embeddings(spark, d)
    return ranked(_Fixed(e, e).similar_items(e.select("id"), N, deny=_ids(spark, *DENIED)))


@query
def mf_similar_users(spark, d):
    model = _fixed(spark, d)
    return ranked(model.similar_users(model.user_factors.select("id"), N))


@query
def topk_inner_product(spark, d):
    e = embeddings(spark, d)
    return ranked(topk.score_top(e, e, 16, digits=DIGITS))


@query
def topk_half_precision(spark, d):
    """The best by inner product, found in 16 bits and ranked in full precision."""
    e = embeddings(spark, d)
    return ranked(half.score_top_half(e, half.pack(e), e, 16, digits=DIGITS))


@query
def mips_augment(spark, d):
    a = ann.augment_inner_product(item_factors(spark, d, FACTORS))
    return a.select("id", F.round(F.element_at("features", -1), DIGITS).alias("extra"), F.round(norm(F.col("features")), DIGITS).alias("norm"))


#: Cells of ten that the search by given centroids looks into; recall is tested.
IVF_PROBES = 8


def _ivf(spark, d) -> tuple[ann.IVFIndex, DataFrame]:
    e = table(spark, d, "embeddings")
    cells = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.round(F.avg(F.col("col").cast("double")), 9).alias("v"))
    cells = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"))
    vectors = embeddings(spark, d)
    return ann.IVFIndex(nlist=10, nprobe=IVF_PROBES).build(vectors, cells.select(F.col("label").alias("cell"), "centroid")), vectors


@query
def ivf_assign(spark, d):
    index, _ = _ivf(spark, d)
    return index.cells.select("id", F.col("cell").cast("long").alias("cell"))


@query
def ivf_search(spark, d):
    index, vectors = _ivf(spark, d)
    return ranked(index.search(vectors, N, digits=DIGITS))


@query
def als_normal_equations_k2(spark, d):
    """Each user's matrix and right side at two factors, summed by SQL expressions."""
    y = item_factors(spark, d, 2).select(F.col("id").alias(ITEM), F.get("features", 0).cast("double").alias("y1"), F.get("features", 1).cast("double").alias("y2"))
    g = y.agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("y1", "y1"), ("y1", "y2"), ("y2", "y2"))])
    c = F.abs(F.col(WEIGHT)) - 1
    own = weighting.scale(cp(spark, d), ALPHA).df.join(y, ITEM).groupBy(USER).agg(
        F.sum(c * F.col("y1") * F.col("y1")).alias("a"),
        F.sum(c * F.col("y1") * F.col("y2")).alias("b"),
        F.sum(c * F.col("y2") * F.col("y2")).alias("d"),
        F.sum(F.when(F.col(WEIGHT) > 0, F.col(WEIGHT)).otherwise(0.0) * F.col("y1")).alias("p"),
        F.sum(F.when(F.col(WEIGHT) > 0, F.col(WEIGHT)).otherwise(0.0) * F.col("y2")).alias("q"),
    )
    full = own.crossJoin(F.broadcast(g)).select(USER, (F.col("a") + F.col("y1y1") + REG).alias("a"), (F.col("b") + F.col("y1y2")).alias("b"), (F.col("d") + F.col("y2y2") + REG).alias("d"), "p", "q")
    return rounded(full, "a", "b", "d", "p", "q")


def _pair(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias(USER), *[F.round(F.get("features", i).cast("double"), DIGITS).alias(f"x{i + 1}") for i in (0, 1)])


def _y2(spark, d, x: Interactions) -> np.ndarray:
    return fx.to_matrix(item_factors(spark, d, 2), x.n_items, 2)


@query
def als_half_step_k2(spark, d):
    """The half-step of the fitting kernel, by Cholesky."""
    x = cp(spark, d)
    return _pair(half_step_broadcast(fx.by_user(weighting.scale(x, ALPHA).df), _y2(spark, d, x), None, REG, None, "float64"))


@query
def als_half_step_cg_k2(spark, d):
    """Two conjugate-gradient steps solve two factors exactly."""
    x = cp(spark, d)
    zero = np.zeros((x.n_users, 2))
    return _pair(half_step_broadcast(fx.by_user(weighting.scale(x, ALPHA).df), _y2(spark, d, x), zero, REG, 3, "float64"))


@query
def als_loss_k2(spark, d):
    x = cp(spark, d)
    p = fx.to_matrix(user_factors(spark, d, 2), x.n_users, 2)
    return spark.createDataFrame([(round(training_loss(x.df, _y2(spark, d, x), p, REG), DIGITS),)], "loss double")


def _als_fixed(spark, d) -> AlternatingLeastSquares:
    model = AlternatingLeastSquares(factors=2, regularization=REG, alpha=ALPHA, dtype="float64")
    model.user_factors, model.item_factors = user_factors(spark, d, 2), item_factors(spark, d, 2)
    return model


@query
def als_explain_k2(spark, d):
    """Every user's contributions to part 1."""
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias(USER), F.lit(1).cast("long").alias(ITEM))
    found = _als_fixed(spark, d).explain(pairs, cp(spark, d), N).where(F.abs("contribution") >= 0)
    return rounded(ranked(found).drop("rank"), "contribution", "total")


@query
def als_explain_entries_k2(spark, d):
    """For every user and each of its parts, the three parts that contribute most."""
    x = cp(spark, d)
    return rounded(ranked(_als_fixed(spark, d).explain(x.df.select(USER, ITEM), x, 3)), "contribution", "total")


@query
def bpr_negative_verify(spark, d):
    """Sampled (user, other item) pairs that the user does not like."""
    x = ev(spark, d)
    other = (hash_uniform(3, F.col(USER), F.col(ITEM)) * 100).cast("long")
    sampled = x.df.select(USER, ITEM, other.alias("other"))
    return sampled.join(x.df.select(USER, F.col(ITEM).alias("other")), [USER, "other"], "left_anti").select(USER, ITEM, "other")


@query
def bpr_scores(spark, d):
    """What a BPR step takes from each entry and a sampled other item: 1 / (1 + exp(x (yi - yj)))."""
    u, i = user_factors(spark, d, FACTORS), item_factors(spark, d, FACTORS)
    x = cp(spark, d)
    other = (hash_uniform(3, F.col(USER), F.col(ITEM)) * x.n_items).cast("long")
    s = x.df.select(USER, ITEM, other.alias("other"))
    s = s.join(u.select(F.col("id").alias(USER), F.col("features").alias("x")), USER)
    s = s.join(i.select(F.col("id").alias(ITEM), F.col("features").alias("yi")), ITEM)
    s = s.join(i.select(F.col("id").alias("other"), F.col("features").alias("yj")), "other")
    z = 1 / (1 + F.exp(dot(F.col("x"), F.col("yi")) - dot(F.col("x"), F.col("yj"))))
    return s.select(USER, ITEM, "other", F.round(z, DIGITS).alias("z"))


RATE = 0.05


def _drawn(x: Interactions) -> DataFrame:
    """The entries, each with another item by hash."""
    other = (hash_uniform(3, F.col(USER), F.col(ITEM)) * x.n_items).cast("long")
    return x.df.select(USER, ITEM, other.alias("other"), WEIGHT)


def _placed(factors: DataFrame, *cells) -> DataFrame:
    """Factors whose places are as given: a number is a constant, a text the place in the old ones."""
    return factors.select("id", F.array(*[F.get("features", int(c)).cast("double") if isinstance(c, str) else F.lit(float(c)) for c in cells]).alias("features"))


def _bpr_step(spark, d) -> tuple[DataFrame, DataFrame]:
    """One step of the fitting kernel over an entry and another item each, at two factors and a bias."""
    users = _placed(user_factors(spark, d, 2), "0", "1", 1)
    return bpr.step(_drawn(cp(spark, d)).drop(WEIGHT), users, item_factors(spark, d, 3), RATE, REG)


def _cells(df: DataFrame, key: str, *names: str) -> DataFrame:
    return df.select(F.col("id").alias(key), *[F.round(F.get("features", i), DIGITS).alias(n) for i, n in enumerate(names)])


@query
def bpr_step_users_k2(spark, d):
    return _cells(_bpr_step(spark, d)[0], USER, "x1", "x2", "one")


@query
def bpr_step_items_k2(spark, d):
    return _cells(_bpr_step(spark, d)[1], ITEM, "y1", "y2", "bias")


@query
def lmf_step_k2(spark, d):
    """One Adagrad step of the fitting kernel, at two factors and biases: every entry, and for each one negative by hash."""
    drawn = _drawn(cp(spark, d))
    samples = drawn.select(F.col(USER).alias("id"), F.col(ITEM).alias("other"), F.col(WEIGHT).alias("c")).unionByName(
        drawn.select(F.col(USER).alias("id"), "other", F.lit(None).cast("double").alias("c"))
    )
    users, items = _placed(user_factors(spark, d, 4), "0", "1", 1, "3"), _placed(item_factors(spark, d, 4), "0", "1", "2", 1)
    return _cells(lmf.step(samples, users, items, RATE, REG, 2), USER, "x1", "x2", "one", "bias")


@query
def lmf_positive_gradient(spark, d):
    """The part of the logistic gradient that comes from the entries, at two factors."""
    u, i = user_factors(spark, d, 2), item_factors(spark, d, 2)
    s = cp(spark, d).df.join(u.select(F.col("id").alias(USER), F.col("features").alias("x")), USER).join(i.select(F.col("id").alias(ITEM), F.col("features").alias("y")), ITEM)
    w = F.col(WEIGHT) * (1 - 1 / (1 + F.exp(-dot(F.col("x"), F.col("y")))))
    return rounded(s.groupBy(USER).agg(*[F.sum(w * F.get("y", k).cast("double")).alias(f"g{k + 1}") for k in (0, 1)]), "g1", "g2")


@query
def dictionary_encode(spark, d):
    return encode_labels(table(spark, d, "part"), "p_name", "code")


@query
def label_join(spark, d):
    model, x = _bm25(spark, d)
    names = table(spark, d, "part").select(F.col("p_partkey").alias(ITEM), F.col("p_name").alias("label"))
    return ranked(join_labels(model.recommend(None, x, 3, discard_interactions=True, discard_model=True), names, ITEM, "label"))


@query
def factor_upsert(spark, d):
    """Factors of which a third are replaced and to which new ids are added."""
    old, k = item_factors(spark, d, 2), 2
    new = old.where("id % 3 = 0").select("id", F.transform("features", lambda v: (v + 1).cast("float")).alias("features"))
    extra = new.agg(F.max("id").alias("m")).select((F.col("m") + 10).alias("id"), F.array(F.lit(0.5).cast("float"), F.lit(0.25).cast("float")).alias("features"))
    out = fx.upsert(old, new.unionByName(extra), k)
    return out.select("id", *[F.round(F.get("features", j).cast("double"), 5).alias(f"f{j + 1}") for j in (0, 1)])


@query
def model_round_trip(spark, d):
    """A neighbour model saved and loaded."""
    import uuid

    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    _fitted(knn.CosineRecommender, spark, d).save(path)
    return knn.CosineRecommender.load(spark, path).similarity


# Queries that SQL cannot express: iterative fits, and indexes with learnt parts.


def _checker(spark, d, model) -> DataFrame:
    x = ev(spark, d)
    return ranked(model.fit(x).recommend(None, x, N))


@query
def als_fit(spark, d):
    return _checker(spark, d, AlternatingLeastSquares(factors=16, iterations=5, random_state=1))


@query
def als_fit_shuffle(spark, d):
    """One half-step without a broadcast, at two factors; the same result as als_half_step_k2."""
    x = cp(spark, d)
    found = half_step_shuffle(weighting.scale(x, ALPHA).df, item_factors(spark, d, 2), 2, REG)
    return found.select(F.col("id").alias(USER), *[F.round(F.get("features", i).cast("double"), 4).alias(f"x{i + 1}") for i in (0, 1)])


@query
def fold_in_users(spark, d):
    """Users recalculated from their interactions, to the precision of stored factors."""
    model = _als_fixed(spark, d)
    found = model.recalculate_users(cp(spark, d))
    return found.select(F.col("id").alias(USER), *[(F.round(F.get("features", i).cast("double"), 3) + 0.0).alias(f"x{i + 1}") for i in (0, 1)])


@query
def bpr_fit(spark, d):
    return _checker(spark, d, BayesianPersonalizedRanking(factors=8, iterations=3, random_state=1))


@query
def lmf_fit(spark, d):
    return _checker(spark, d, LogisticMatrixFactorization(factors=8, iterations=2, random_state=1))


@query
def lsh_search(spark, d):
    e = embeddings(spark, d)
    return ranked(ann.LSHIndex(tables=16, bucket=1.0, radius=2.0).build(e).search(e, N, digits=DIGITS))


@query
def ivf_kmeans_search(spark, d):
    e = embeddings(spark, d)
    return ranked(ann.IVFIndex(nlist=16, nprobe=13).build(e).search(e, N, digits=DIGITS))


def _asked(vectors: DataFrame) -> DataFrame:
    """The queries of a search: every vector whose id is divisible by 50."""
    return vectors.where("id % 50 = 0")


@query
def forest_search(spark, d):
    e = embeddings(spark, d)
    return ranked(forest.ForestIndex(trees=24, leaf_size=64, probes=2).build(e).search(_asked(e), N, digits=DIGITS))


@query
def graph_search(spark, d):
    e = embeddings(spark, d)
    return ranked(graph.GraphIndex().build(e).search(_asked(e), N, digits=DIGITS))
