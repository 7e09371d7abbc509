"""The random-projection forest and the neighbour graph."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.operators import ann, topk
from tastegrid.operators import factors as fx
from tastegrid.operators.als import AlternatingLeastSquares
from tastegrid.operators.ann import ApproximateModel
from tastegrid.operators.forest import ForestIndex
from tastegrid.operators.graph import GraphIndex
from tests.helpers import checkerboard, ids, lists

DATA = "/root/testdata"


def vectors(n, k, seed=0):
    y = np.random.default_rng(seed).normal(size=(n, k))
    return (y / np.linalg.norm(y, axis=1)[:, None]).astype(np.float32)


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def test_leaves_are_bounded_and_whole(spark):
    """Two thirds of the vectors are equal; ids part them."""
    y = vectors(300, 5)
    y[100:] = y[0]
    index = ForestIndex(trees=3, leaf_size=16).build(fx.to_df(spark, y))
    sizes = index.leaves.groupBy("tree", "node").count().collect()
    assert max(r["count"] for r in sizes) <= 16 and len({r["tree"] for r in sizes}) == 3
    assert sorted(map(tuple, index.leaves.select("tree", "id").collect())) == [(t, i) for t in range(3) for i in range(300)]
    # A vector finds its own leaf again.
    own = {(r["tree"], r["id"]): r["node"] for r in index.leaves.collect()}
    found = {(r["tree"], r["query_id"]): r["node"] for r in index.visit(fx.to_df(spark, y)).collect()}
    assert found == own


def test_forest_filters_before_the_best_are_taken(spark):
    y = vectors(200, 6)
    df = fx.to_df(spark, y)
    index = ForestIndex(trees=6, leaf_size=25, probes=3).build(df)
    near = {}
    for q, i in pairs(index.candidates(df)):
        near.setdefault(q, []).append(i)
    scores = y.astype(float) @ y.T.astype(float)

    def want(q, ok):
        own = [i for i in near[q] if ok(q, i)]
        return sorted(own, key=lambda i: (-scores[q, i], -i))[:4]

    got = lists(index.search(df, 4, allow=ids(spark, range(0, 200, 3))), "query_id", "id")
    assert all(got.get(q, []) == want(q, lambda q, i: i % 3 == 0) for q in range(200))
    got = lists(index.search(df, 4, deny=ids(spark, range(0, 200, 3))), "query_id", "id")
    assert all(got.get(q, []) == want(q, lambda q, i: i % 3) for q in range(200))
    liked = spark.createDataFrame([(q, q) for q in range(200)], "query_id long, id long")
    got = lists(index.search(df, 4, liked=liked), "query_id", "id")
    assert all(got.get(q, []) == want(q, lambda q, i: i != q) for q in range(200))
    more = ForestIndex(trees=6, leaf_size=25).build(df).candidates(df).count()
    assert more < index.candidates(df).count()


def test_small_and_empty_tables(spark):
    none = spark.createDataFrame([], fx.FACTORS)
    one = fx.to_df(spark, vectors(1, 4))
    for index in (ForestIndex(trees=2, leaf_size=4), GraphIndex(trees=2, leaf_size=4, rounds=1)):
        assert index.build(none).search(one, 3).count() == 0
        assert pairs(index.build(one).search(one, 3)) == {(0, 0)} or isinstance(index, GraphIndex)
    for bad in ({"trees": 0}, {"leaf_size": 0}, {"probes": 0}):
        with pytest.raises(ValueError):
            ForestIndex(**bad)


def test_graph_on_known_clusters(spark):
    """Each vector's edges lead to its cluster, and a walk ends there; filters take from what was compared."""
    rng = np.random.default_rng(1)
    centres = vectors(12, 8, 3)
    y = centres[np.arange(240) % 12] + 0.05 * rng.normal(size=(240, 8))
    y = (y / np.linalg.norm(y, axis=1)[:, None]).astype(np.float32)
    df = fx.to_df(spark, y)
    index = GraphIndex(degree=6, width=12, trees=4, leaf_size=24, rounds=1).build(df)
    edges = {r["id"]: r["edges"] for r in index.graph.collect()}
    assert len(edges) == 240 and max(map(len, edges.values())) <= 12
    assert np.mean([o % 12 == i % 12 for i, e in edges.items() for o in e]) > 0.95
    asked = df.where("id % 7 = 0")
    rows, want = index.walk(asked).collect(), lists(topk.score_top(asked, df, 5), "query_id", "id")
    assert np.mean([len({b["id"] for b in r["beam"][:5]} & set(want[r["query_id"]])) / 5 for r in rows]) > 0.9
    walked = {r["query_id"]: r["seen"] for r in rows}
    assert all(len(set(s)) == len(s) for s in walked.values())
    kept = lists(index.search(asked, 20, deny=ids(spark, range(0, 240, 2))), "query_id", "id")
    scores = y.astype(float) @ y.T.astype(float)
    for q, seen in walked.items():
        assert kept.get(q, []) == sorted((i for i in seen if i % 2), key=lambda i: (-scores[q, i], -i))[:20]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_graph_recall_and_comparisons(spark, size):
    """At the registered parameters: of the exact ten best of a fifth of the vectors, 0.9 at least, by less than a third of the comparisons."""
    from tastegrid.plans.tables import embeddings

    e = embeddings(spark, f"{DATA}/{size}")
    n, asked = e.count(), e.where("id % 5 = 0")
    walked = GraphIndex().build(e).walk(asked).persist()
    best = pairs(topk.score_top(asked, e, 10))
    found = pairs(topk.rank_top(walked.select("query_id", F.inline("beam")), "query_id", "id", 10))
    assert len(best & found) / len(best) >= 0.9
    assert walked.agg(F.avg(F.size("seen"))).first()[0] < n / 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_of_the_registered_forest(spark):
    from tastegrid.plans.queries import QUERIES
    from tastegrid.plans.tables import embeddings

    e = embeddings(spark, f"{DATA}/sf0.001")
    best = pairs(topk.score_top(e.where("id % 50 = 0"), e, 10))
    assert len(best & pairs(QUERIES["forest_search"](spark, f"{DATA}/sf0.001"))) / len(best) >= 0.9


@pytest.mark.parametrize("index", ["forest"])
def test_models_answer_from_an_index(spark, index):
    board = checkerboard(spark, 50)
    options = {"leaf_size": 50, "trees": 2}
    model = ApproximateModel(AlternatingLeastSquares(factors=3, regularization=0.01, random_state=23, iterations=5), index, **options).fit(board)
    found = lists(model.recommend(None, board, 1), "user_id", "item_id")
    assert found == {u: [u] for u in range(50)}
    similar = lists(model.similar_items(ids(spark, range(50)), 5), "query_id", "id")
    assert all(i % 2 == q % 2 for q, x in similar.items() for i in x)


@pytest.mark.parametrize("bucket", [0.05, 1.0])
def test_lsh_compares_all_that_share_a_bucket(spark, monkeypatch, bucket):
    """Narrow buckets are cells, wide ones are told apart inside blocks; filters hold before the best are taken, and no pair is joined as a row."""
    monkeypatch.setattr(ann, "CELL_BLOCK", 50)
    y = vectors(300, 6)
    df = fx.to_df(spark, y)
    index = ann.LSHIndex(tables=3, bucket=bucket, radius=1.0).build(df)
    codes = {r["id"]: np.array(r["codes"]) for r in index.rows.collect()}
    c = np.array([codes[i] for i in range(300)])
    scores = np.round(y.astype(float) / np.linalg.norm(y.astype(float), axis=1)[:, None] @ (y.astype(float) / np.linalg.norm(y.astype(float), axis=1)[:, None]).T, 6)
    near = (c[:, None] == c[None]).any(axis=2) & (scores > 0.5)
    liked = spark.createDataFrame([(q, q) for q in range(300)], "query_id long, id long")
    found = index.search(df, 4, liked=liked, deny=ids(spark, range(0, 300, 5)), digits=6)
    got = lists(found, "query_id", "id")
    for q in range(300):
        own = [i for i in np.flatnonzero(near[q]) if i != q and i % 5]
        assert got.get(q, []) == sorted(own, key=lambda i: (-scores[q, i], -i))[:4]
