"""The same behaviour is asked of every model on the checkerboard."""

import os

import pytest

from tastegrid.interactions import Interactions
from tastegrid.operators import evaluation
from tastegrid.operators.als import AlternatingLeastSquares
from tastegrid.operators.ann import ApproximateModel
from tastegrid.operators.bpr import BayesianPersonalizedRanking
from tastegrid.operators.factors import FactorModel
from tastegrid.operators.knn import BM25Recommender, CosineRecommender, ItemItemRecommender, TFIDFRecommender
from tastegrid.operators.lmf import LogisticMatrixFactorization
from tests.helpers import checkerboard, ids, lists, of_rows

MODELS = {
    "als": lambda: AlternatingLeastSquares(factors=3, regularization=0.01, random_state=23, iterations=8),
    "als_cholesky": lambda: AlternatingLeastSquares(factors=3, regularization=0.01, random_state=23, iterations=5, solver="cholesky"),
    "bpr": lambda: BayesianPersonalizedRanking(factors=3, regularization=0, random_state=42, learning_rate=0.05, iterations=40),
    "lmf": lambda: LogisticMatrixFactorization(factors=3, regularization=0, random_state=43, iterations=15),
    "item": lambda: ItemItemRecommender(K=50, digits=9),
    "cosine": lambda: CosineRecommender(K=50, digits=9),
    "tfidf": lambda: TFIDFRecommender(K=50, digits=9),
    "bm25": lambda: BM25Recommender(K=50, digits=9),
    "ivf": lambda: ApproximateModel(AlternatingLeastSquares(factors=3, regularization=0.01, random_state=23, iterations=5), "ivf", nlist=1, nprobe=1),
}
FACTOR_MODELS = ["als", "als_cholesky", "bpr", "lmf"]


@pytest.fixture(scope="module")
def board(spark):
    x = checkerboard(spark, 50)
    return x.with_df(x.df.persist())


@pytest.fixture(scope="module")
def fitted(board):
    known = {}

    def get(name):
        if name not in known:
            known[name] = MODELS[name]().fit(board)
        return known[name]

    return get


@pytest.mark.parametrize("name", MODELS)
def test_recommend(spark, board, fitted, name):
    model = fitted(name)
    found = lists(model.recommend(None, board, 1), "user_id", "item_id")
    assert found == {u: [u] for u in range(50)}
    denied = lists(model.recommend(ids(spark, [0, 1], "user_id"), board, 10, deny=ids(spark, [0, 1])), "user_id", "item_id")
    assert not {0, 1} & {i for x in denied.values() for i in x}
    allowed = lists(model.recommend(ids(spark, [3], "user_id"), board, 10, filter_already_liked_items=False, allow=ids(spark, range(1, 21, 2))), "user_id", "item_id")
    assert set(allowed[3]) == set(range(1, 21, 2))
    liked = lists(model.recommend(ids(spark, [7], "user_id"), board, 5, filter_already_liked_items=False), "user_id", "item_id")
    assert len(liked[7]) == 5 and all(i % 2 for i in liked[7])


@pytest.mark.parametrize("name", MODELS)
def test_scores_do_not_grow(board, fitted, name):
    rows = fitted(name).recommend(None, board, 10, filter_already_liked_items=False).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["rank"])):
        assert r["score"] <= by.get(r["user_id"], 1e30)
        by[r["user_id"]] = r["score"]


@pytest.mark.parametrize("name", [m for m in MODELS if m not in ("item", "bm25")])
def test_similar_items(spark, fitted, name):
    found = lists(fitted(name).similar_items(ids(spark, range(50)), 10), "query_id", "id")
    scores = {(r["query_id"], r["rank"]): r["score"] for r in fitted(name).similar_items(ids(spark, range(50)), 1).collect()}
    assert all(abs(s - 1) < 1e-3 for s in scores.values())
    assert all(i % 2 == q % 2 for q, x in found.items() for i in x)
    denied = lists(fitted(name).similar_items(ids(spark, [2]), 10, deny=ids(spark, range(0, 50, 5))), "query_id", "id")
    assert not set(denied[2]) & set(range(0, 50, 5))
    allowed = lists(fitted(name).similar_items(ids(spark, [2]), 10, allow=ids(spark, range(0, 20, 2))), "query_id", "id")
    assert set(allowed[2]) == set(range(0, 20, 2))


@pytest.mark.parametrize("name", FACTOR_MODELS)
def test_similar_users(spark, fitted, name):
    found = lists(fitted(name).similar_users(ids(spark, range(50), "id"), 8), "query_id", "id")
    assert all(i % 2 == q % 2 for q, x in found.items() for i in x)
    denied = lists(fitted(name).similar_users(ids(spark, [4]), 8, deny=ids(spark, [4, 6])), "query_id", "id")
    assert not {4, 6} & set(denied[4])


@pytest.mark.parametrize("name", ["item", "cosine", "ivf"])
def test_no_similar_users(fitted, name):
    with pytest.raises(NotImplementedError):
        fitted(name).similar_users(None)


@pytest.mark.parametrize("name", MODELS)
def test_evaluation(spark, board, fitted, name):
    test = of_rows(spark, [(u, u, 1.0) for u in range(50)], 50, 50)
    m = evaluation.ranking_metrics_at_k(fitted(name), board, test, 1).first()
    assert (m["precision"], m["map"], m["ndcg"]) == (1, 1, 1)


@pytest.mark.parametrize("name", FACTOR_MODELS)
def test_lists_are_checked(spark, board, fitted, name):
    model, one = fitted(name), ids(spark, [0], "user_id")
    for bad in ([-1, -3], [51, 300]):
        with pytest.raises(IndexError):
            model.rank_items(one, ids(spark, bad))
    with pytest.raises(ValueError):
        model.recommend(one, board, 3, allow=ids(spark, [1]), deny=ids(spark, [2]))
    order = lists(model.rank_items(one, ids(spark, range(1, 7))), "user_id", "item_id")[0]
    assert sorted(order) == list(range(1, 7)) and {i % 2 for i in order[:3]} == {0}


def test_neighbours_rank_all_given_items(spark, board, fitted):
    order = lists(fitted("cosine").rank_items(ids(spark, [0], "user_id"), board, ids(spark, range(1, 7))), "user_id", "item_id")[0]
    assert sorted(order) == list(range(1, 7)) and {i % 2 for i in order[:3]} == {0}


@pytest.mark.parametrize("name", ["als", "cosine", "bm25", "tfidf", "bpr", "lmf"])
def test_save_and_load(spark, board, fitted, name, tmp_path):
    model = fitted(name)
    model.save(str(tmp_path / "m"))
    again = type(model).load(spark, str(tmp_path / "m"))
    assert again.parameters() == model.parameters()
    a, b = (sorted(map(tuple, m.recommend(None, board, 5).collect())) for m in (model, again))
    assert a == b
    with pytest.raises(ValueError):
        type(model)().save(str(tmp_path / "none"))


@pytest.mark.parametrize("name", ["als", "cosine"])
def test_empty_rows_and_columns(spark, name):
    x = checkerboard(spark, 50, without=(42, 49))
    found = lists(MODELS[name]().fit(x).similar_items(ids(spark, range(40)), 10), "query_id", "id")
    assert not any(42 in v for v in found.values())


def test_repeated_and_unordered_rows_are_summed(spark):
    x = of_rows(spark, [(1, 2, 1.0), (0, 1, 2.0), (1, 2, 3.0), (None, 1, 1.0), (0, None, 1.0), (3, 0, None)])
    assert sorted(map(tuple, x.df.collect())) == [(0, 1, 2.0), (1, 2, 4.0), (3, 0, 0.0)]
    assert (x.n_users, x.n_items) == (4, 3)


def test_callbacks(spark, board):
    seen = []
    MODELS["als_cholesky"]().fit(board, callback=lambda *a: seen.append(a))
    AlternatingLeastSquares(factors=2, iterations=2, calculate_training_loss=True, random_state=1).fit(board, callback=lambda *a: seen.append(a))
    BayesianPersonalizedRanking(factors=2, iterations=3, random_state=1).fit(board, callback=lambda *a: seen.append(a))
    LogisticMatrixFactorization(factors=2, iterations=2, random_state=1).fit(board, callback=lambda *a: seen.append(a))
    assert [len(a) for a in seen] == [3] * 7 + [4] * 3 + [2] * 2
    assert seen[5][2] > seen[6][2] > 0
    with pytest.raises(NotImplementedError):
        CosineRecommender().fit(board, callback=print)


def test_unfitted_and_unsupported(spark, board):
    for model in (AlternatingLeastSquares(), CosineRecommender()):
        with pytest.raises(ValueError):
            model.recommend(None, board)
    assert isinstance(MODELS["bpr"](), FactorModel)
    with pytest.raises(NotImplementedError):
        BayesianPersonalizedRanking().recalculate_users(board)
    with pytest.raises(ValueError):
        AlternatingLeastSquares(dtype="int8")


def test_empty_tables(spark):
    x = Interactions.of(spark.createDataFrame([], "user_id long, item_id long, weight double"), n_users=3, n_items=3)
    for model in (BayesianPersonalizedRanking(factors=2, iterations=1), AlternatingLeastSquares(factors=2, iterations=1), LogisticMatrixFactorization(factors=2, iterations=1)):
        assert model.fit(x).user_factors.count() == 3
    assert CosineRecommender().fit(x).similarity.count() == 0
    one = of_rows(spark, [(1, 1, 1.0)], 3, 3)
    assert BayesianPersonalizedRanking(factors=2, iterations=2).fit(one).item_factors.count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["ivf_search", "ivf_kmeans_search", "lsh_search"])
def test_recall_of_the_registered_indexes(spark, name):
    """Of the exact ten best of every vector of the embeddings table, at the registered parameters."""
    from tastegrid.operators import topk
    from tastegrid.plans.queries import QUERIES
    from tastegrid.plans.tables import embeddings

    d = "/root/testdata/sf0.001"
    e = embeddings(spark, d)
    best = {(r["query_id"], r["id"]) for r in topk.score_top(e, e, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in QUERIES[name](spark, d).collect()}
    assert len(best & found) / len(best) >= 0.9
