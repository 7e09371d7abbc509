"""BPR and LMF on blocks of users and items."""

import numpy as np
import pytest

from tastegrid.operators import bpr, lmf
from tastegrid.operators import factors as fx
from tastegrid.operators.bpr import BayesianPersonalizedRanking
from tastegrid.operators.lmf import LogisticMatrixFactorization
from tests.helpers import checkerboard, lists, of_rows


def matrix(df):
    return {r["id"]: np.array(r["features"]) for r in df.collect()}


def test_one_step_of_ranking_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(4, 3)), rng.normal(size=(6, 3))
    x[:, 2] = 1
    samples = [(0, 1, 2), (0, 1, 2), (1, 3, 0), (2, 0, 1)]
    want_x, want_y = x.copy(), y.copy()
    for u, i, j in samples:
        z = 1 / (1 + np.exp(x[u] @ (y[i] - y[j])))
        want_x[u, :2] += 0.1 * (z * (y[i] - y[j]) - 0.3 * x[u])[:2]
        want_y[i] += 0.1 * (z * x[u] - 0.3 * y[i])
        want_y[j] += 0.1 * (-z * x[u] - 0.3 * y[j])
    schema = "id bigint, features array<double>"
    frames = [spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(m)], schema) for m in (x, y)]
    users, items = bpr.step(spark.createDataFrame(samples, "user_id long, item_id long, other long"), *frames, 0.1, 0.3)
    assert all(np.allclose(v, want_x[k]) for k, v in matrix(users).items()) and all(np.allclose(v, want_y[k]) for k, v in matrix(items).items())
    # The fitting kernel takes the same step.
    u, i, j = np.array(samples).T
    bpr.sgd(x, y, u, i, j, 0.1, 0.3)
    assert np.allclose(x, want_x) and np.allclose(y, want_y)


def test_unliked():
    user, item = np.array([0, 0, 1, 3]), np.array([2, 5, 0, 1])
    at, other = np.array([0, 1, 2, 3, 3]), np.array([5, 4, 0, 0, 1])
    assert bpr.unliked(user, item, at, other, 6).tolist() == [False, True, False, True, False]


@pytest.mark.parametrize("blocks", [1, 3])
def test_turns_share_no_rows_and_cover_all_entries(spark, blocks, monkeypatch):
    """Every user and item is in one task of each turn, and as many samples are drawn as there are entries."""
    x = checkerboard(spark, 30)
    model = BayesianPersonalizedRanking(factors=2, iterations=1, random_state=3, blocks=blocks, verify_negative_samples=False)
    drawn = []
    model.fit(x, callback=lambda epoch, s, correct, skipped: drawn.append((correct, skipped)))
    users, items = matrix(model.user_factors), matrix(model.item_factors)
    assert sorted(users) == sorted(items) == list(range(30)) and drawn[0][1] == 0 and 0 < drawn[0][0] <= x.df.count()
    assert all(v[2] == 1 for v in users.values())
    start = fx.seeded_rows(3, bpr.USERS, np.arange(30), 3)
    assert all(not np.allclose(users[u][:2], (start[u, :2] - 0.5) / 2) for u in range(30))


@pytest.mark.parametrize("model", [lambda: BayesianPersonalizedRanking(factors=3, regularization=0, random_state=42, learning_rate=0.1, iterations=10, blocks=3), lambda: LogisticMatrixFactorization(factors=3, regularization=0, random_state=43, iterations=6, blocks=2)])
def test_several_blocks_learn_the_checkerboard(spark, model):
    x = checkerboard(spark, 40)
    x = x.with_df(x.df.persist())
    found = lists(model().fit(x).recommend(None, x, 1), "user_id", "item_id")
    assert np.mean([found[u] == [u] for u in range(40)]) > 0.9


def test_ids_without_entries(spark):
    x = of_rows(spark, [(1, 1, 2.0), (1, 2, 1.0), (3, 1, 1.0)], 6, 5)
    b, m = BayesianPersonalizedRanking(factors=2, iterations=1).fit(x), LogisticMatrixFactorization(factors=2, iterations=1).fit(x)
    assert matrix(b.user_factors)[0].tolist() == [0, 0, 1] and matrix(b.item_factors)[4].tolist() == [0, 0, 0]
    assert matrix(m.user_factors)[5].tolist() == [0, 0, 1, 0] and matrix(m.item_factors)[0].tolist() == [0, 0, 0, 1]
    assert all(len(matrix(t)) == n for t, n in ((b.user_factors, 6), (b.item_factors, 5), (m.user_factors, 6), (m.item_factors, 5)))


def test_a_hot_user_is_spread_and_its_gradients_add_up(spark, monkeypatch):
    """Without negatives a half-step is exact, however the entries are dealt."""
    rng = np.random.default_rng(2)
    rows = [(0, i, 1.0 + i % 3) for i in range(60)] + [(u, int(i), 1.0) for u in range(1, 8) for i in rng.choice(60, 9, replace=False)]
    x = of_rows(spark, rows, 8, 60)
    plain = matrix(LogisticMatrixFactorization(factors=3, iterations=1, neg_prop=0, random_state=1).fit(x).user_factors)
    monkeypatch.setattr(lmf, "HOT_ID", 7)
    spread = matrix(LogisticMatrixFactorization(factors=3, iterations=1, neg_prop=0, random_state=1, blocks=4).fit(x).user_factors)
    assert all(np.allclose(plain[u], spread[u], atol=1e-5) for u in range(8))
    y = fx.seeded_normal_rows(1, 3, np.arange(60), 5)
    y[:, 4] = 1
    start = fx.seeded_normal_rows(1, 1, np.arange(8), 5)
    start[:, 3] = 1
    own = [(i, w) for u, i, w in rows if u == 0]
    g = sum(w * (1 - 1 / (1 + np.exp(-start[0] @ y[i]))) * y[i] for i, w in own) - 0.6 * start[0]
    want = start[0] + g / np.sqrt(1e-6 + g * g)
    want[3] = 1
    assert np.allclose(plain[0], want, atol=1e-5)
