import numpy as np
import pytest

from tastegrid.functions.weighting import scale
from tastegrid.operators import als
from tastegrid.operators import factors as fx
from tastegrid.operators.als import AlternatingLeastSquares, half_step_broadcast, half_step_shuffle, solve_cg, solve_cholesky, training_loss
from tests.helpers import EXPLAIN, FACTORIZE, checkerboard, ids, lists, of_matrix, of_rows


def brute(c, y, reg, alpha=1.0):
    """Each row's solution from the whole matrix."""
    c = np.array(c, float) * alpha
    out = np.zeros((len(c), y.shape[1]))
    for u, row in enumerate(c):
        if not row.any():
            continue
        conf = np.where(row == 0, 1, abs(row))
        a = (y * conf[:, None]).T @ y + reg * np.eye(y.shape[1])
        out[u] = np.linalg.solve(a, (np.where(row > 0, row, 0)) @ y)
    return out


@pytest.mark.parametrize("solver", ["cg", "cholesky"])
@pytest.mark.parametrize("dtype", ["float32", "float64"])
def test_reconstruction(spark, solver, dtype):
    x = of_matrix(spark, FACTORIZE)
    m = AlternatingLeastSquares(factors=6, regularization=0, alpha=2.0, random_state=42, solver=solver, dtype=dtype, iterations=15)
    try:
        m.fit(x)
    except ValueError:
        pytest.fail("singular")
    p, q = fx.to_matrix(m.user_factors, 7, 6), fx.to_matrix(m.item_factors, 6, 6)
    assert np.allclose(p @ q.T, FACTORIZE, atol=2e-3)


def test_half_steps_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    c = rng.integers(-2, 4, (30, 12)) * (rng.random((30, 12)) < 0.4)
    c[5] = 0
    y = rng.normal(size=(12, 4)).astype(np.float32)
    x = of_matrix(spark, c.tolist())
    want = brute(c, y.astype(float), 0.1, 2.0)
    entries = scale(x, 2.0).df
    got = fx.to_matrix(half_step_broadcast(fx.by_user(entries), y, None, 0.1, None, "float64"), 30, 4)
    assert np.allclose(got, want, atol=1e-4)
    got = fx.to_matrix(half_step_shuffle(entries, fx.to_df(spark, y), 4, 0.1), 30, 4)
    assert np.allclose(got, want, atol=1e-4)


def test_hot_users_are_summed_in_parts(spark, monkeypatch):
    monkeypatch.setattr("tastegrid.operators.als.HOT_USER", 3)
    rng = np.random.default_rng(4)
    c = (rng.random((4, 20)) < 0.6).astype(int)
    y = rng.normal(size=(20, 3)).astype(np.float32)
    got = fx.to_matrix(half_step_shuffle(of_matrix(spark, c.tolist()).df, fx.to_df(spark, y), 3, 0.1), 4, 3)
    assert np.allclose(got, brute(c, y.astype(float), 0.1), atol=1e-4)


def test_shuffle_fit(spark, monkeypatch):
    x = checkerboard(spark, 20)
    monkeypatch.setattr(AlternatingLeastSquares, "_small", lambda self, n: False)
    m = AlternatingLeastSquares(factors=3, regularization=0.01, random_state=1, iterations=3, solver="cholesky").fit(x)
    assert lists(m.recommend(None, x, 1), "user_id", "item_id") == {u: [u] for u in range(20)}


@pytest.mark.parametrize("solver,dtype", [("cg", "float32"), ("cholesky", "float64")])
def test_shuffle_fit_is_the_same_fit(spark, monkeypatch, solver, dtype):
    """The same solver, start, precision and loss whichever way the factors take, with hot users and without."""
    x = checkerboard(spark, 20)
    options = {"factors": 3, "regularization": 0.1, "random_state": 1, "iterations": 3, "solver": solver, "dtype": dtype, "calculate_training_loss": True}
    want, got = [], []
    a = AlternatingLeastSquares(**options).fit(x, callback=lambda i, s, loss: want.append(loss))
    monkeypatch.setattr(AlternatingLeastSquares, "_small", lambda self, n: False)
    monkeypatch.setattr("tastegrid.operators.als.HOT_USER", 4)
    b = AlternatingLeastSquares(**options).fit(x, callback=lambda i, s, loss: got.append(loss))
    assert got == pytest.approx(want, abs=1e-4) and b.loss == got[-1]
    for f, g in ((a.user_factors, b.user_factors), (a.item_factors, b.item_factors)):
        assert np.allclose(fx.to_matrix(f, 20, 3), fx.to_matrix(g, 20, 3), atol=2e-3)


def test_unknown_items_tell_nothing(spark):
    x = checkerboard(spark, 20)
    m = AlternatingLeastSquares(factors=3, regularization=0.1, random_state=1, iterations=2).fit(x)
    own = of_rows(spark, [(0, 2, 1.0), (0, 4, 1.0)])
    more = of_rows(spark, [(0, 2, 1.0), (0, 4, 1.0), (0, 77, 1.0)])
    assert np.allclose(m.recalculate_users(own).first()["features"], m.recalculate_users(more).first()["features"], atol=1e-6)


def test_cg_stays_finite(spark):
    tri = [[0.0] * 12 for _ in range(12)]
    for b in (0, 6):
        for i in range(5):
            for j in range(i, 6):
                tri[b + i][b + j] = [2, 1.5, 1.333, 1.25, 1.2][i]
    m = AlternatingLeastSquares(factors=3, regularization=0.01, random_state=23, dtype="float64").fit(of_matrix(spark, tri))
    assert np.isfinite(fx.to_matrix(m.user_factors, 12, 3)).all()
    sparse = of_rows(spark, [(3, 7, 0.5), (40, 2, 0.9), (99, 1, 0.1)], 100, 100)
    m = AlternatingLeastSquares(factors=32, regularization=10, random_state=23, iterations=10).fit(sparse)
    assert np.isfinite(fx.to_matrix(m.item_factors, 100, 32)).all()


def test_more_factors_than_users(spark):
    x = of_rows(spark, [(i, i, 1.0) for i in range(10)], 10, 10)
    m = AlternatingLeastSquares(factors=15, regularization=0.01, random_state=1, iterations=10).fit(x)
    assert lists(m.recommend(ids(spark, [0], "user_id"), None, 1, filter_already_liked_items=False), "user_id", "item_id")[0] == [0]


def test_cg_equals_cholesky_when_it_ends():
    rng = np.random.default_rng(1)
    y, c, starts = rng.normal(size=(40, 3)), rng.random(40) * 3, np.array([0, 7, 9, 30])
    yty = y.T @ y + 0.1 * np.eye(3)
    assert np.allclose(solve_cg(y, c, starts, yty, np.zeros((4, 3)), 8), solve_cholesky(y, c, starts, yty))


def test_loss(spark):
    x = of_rows(spark, [(0, 0, 1.0)], 1, 2)
    p, q = np.array([[1.0]]), np.array([[0.0], [1.0]])
    assert training_loss(x.df, q, p, 0) == pytest.approx(1.0)
    assert training_loss(x.df, q, p, 1) == pytest.approx(2.0)
    rng = np.random.default_rng(0)
    c = rng.integers(-2, 4, (6, 5))
    p, q = rng.normal(size=(6, 2)), rng.normal(size=(5, 2))
    conf, want = np.where(c == 0, 1, abs(c)), (c > 0).astype(float)
    whole = (conf * (want - p @ q.T) ** 2).sum() + np.where(c < 0, abs(c), 0).sum() + 0.5 * ((p**2).sum() + (q**2).sum())
    assert training_loss(of_matrix(spark, c.tolist()).df, q, p, 0.5) == pytest.approx(whole / conf.sum())


def test_zero_iterations_with_loss(spark):
    m = AlternatingLeastSquares(factors=2, iterations=0, calculate_training_loss=True).fit(of_matrix(spark, [[1] * 10] * 10))
    assert m.loss is None


def test_explain(spark):
    x = of_matrix(spark, np.array(EXPLAIN).T.tolist())
    m = AlternatingLeastSquares(factors=4, regularization=20, alpha=2.0, random_state=23, iterations=30, solver="cholesky").fit(x)
    found = m.explain(spark.createDataFrame([(0, 0)], "user_id long, item_id long"), x, 10).orderBy("rank").collect()
    p, q = m.recalculate_users(x).where("id = 0").first()["features"], fx.to_matrix(m.item_factors, 7, 4)
    assert found[0]["total"] == pytest.approx(float(np.dot(p, q[0])), abs=1e-3)
    assert sum(r["contribution"] for r in found) == pytest.approx(found[0]["total"])
    assert {r["other_item"] for r in found} == {0, 2, 3, 4}
    scores = [r["contribution"] for r in found]
    assert scores == sorted(scores, reverse=True)


def test_incremental(spark):
    x = checkerboard(spark, 50)
    m = AlternatingLeastSquares(factors=2, regularization=0.001, random_state=23, iterations=6).fit(x)
    own = x.df.where("user_id = 1")

    def as_user(u):
        return x.with_df(own.selectExpr(f"cast({u} as long) user_id", "item_id", "weight"))

    m.partial_fit_users(as_user(0))
    top = m.recommend(ids(spark, [0], "user_id"), x, 1, filter_already_liked_items=False)
    assert lists(top, "user_id", "item_id")[0][0] % 2 == 1
    m.partial_fit_users(as_user(100))
    assert m.user_factors.count() == 101
    assert lists(m.recommend(ids(spark, [100], "user_id"), as_user(100), 1), "user_id", "item_id")[100] == [1]
    new = x.with_df(x.df.where("item_id = 1").selectExpr("user_id", "cast(100 as long) item_id", "weight"))
    m.partial_fit_items(new)
    assert set(lists(m.recommend(ids(spark, [1], "user_id"), x, 2), "user_id", "item_id")[1]) == {1, 100}


def test_recalculated_users_recommend_the_same(spark):
    x = checkerboard(spark, 50)
    m = AlternatingLeastSquares(factors=2, regularization=0.001, random_state=23, iterations=6).fit(x)
    a = lists(m.recommend(None, x, 1), "user_id", "item_id")
    assert a == lists(m.recommend(None, x, 1, recalculate_user=True), "user_id", "item_id")


def test_mllib_solver(spark):
    x = scale(checkerboard(spark, 20), 5.0)
    m = AlternatingLeastSquares(factors=3, regularization=0.01, random_state=1, iterations=5, solver="mllib").fit(x)
    # It scales the regularization by a user's entries, so not every top item need be the same.
    assert sum(v == [u] for u, v in lists(m.recommend(None, x, 1), "user_id", "item_id").items()) >= 16


def test_upsert_fills_gaps(spark):
    old = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, features array<float>")
    new = spark.createDataFrame([(1, [5.0]), (4, [6.0])], "id long, features array<float>")
    assert {r["id"]: r["features"] for r in fx.upsert(old, new, 1).collect()} == {0: [1.0], 1: [5.0], 2: [0.0], 3: [0.0], 4: [6.0]}


def test_nan_factors_are_an_error(spark):
    with pytest.raises(fx.ModelFitError):
        fx.ensure_finite(spark.createDataFrame([(0, [float("nan")])], "id long, features array<float>"))


def test_kernels_hold_few_rows_of_few_factors(spark, monkeypatch):
    """A kernel's rows are bounded by all their bytes, and an explanation's batches by their number."""
    monkeypatch.setattr(als, "MOST_FOUND", 5)
    monkeypatch.setattr(als, "HOT_USER", 3)
    assert fx.group_rows(2) * 8 * 6 <= 8 << 20 and fx.group_rows(10**9) == 1000
    x = of_matrix(spark, EXPLAIN)
    m = AlternatingLeastSquares(factors=3, regularization=0.1, iterations=2, random_state=3).fit(x)
    # Seven users ask for each item, in three parts.
    asked = spark.range(7).crossJoin(spark.range(6).toDF("item_id")).withColumnRenamed("id", "user_id")
    found = {tuple(r)[:4]: (r["contribution"], r["total"]) for r in m.explain(asked, x, 2).collect()}
    alone = {tuple(r)[:4]: (r["contribution"], r["total"]) for r in m.explain(asked.where("item_id = 4"), x, 2).collect()}
    assert len(found) == 7 * 6 * 2 and len(alone) == 7 * 2
    assert all(np.allclose(found[key], value) for key, value in alone.items())
    monkeypatch.setattr(als, "HOT_USER", 50_000)
    assert {tuple(r)[:4] for r in m.explain(asked, x, 2).collect()} == set(found)
