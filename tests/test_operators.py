import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastegrid.functions import weighting
from tastegrid.interactions import Interactions, encode_labels
from tastegrid.operators import ann, evaluation, knn, sparse, topk
from tastegrid.operators import factors as fx
from tastegrid.sources.checkpoints import stash
from tests.helpers import NEIGHBOURS, ids, lists, of_matrix, of_rows


def dense(x, n=7, m=6):
    out = np.zeros((n, m))
    for r in x.df.collect():
        out[r["user_id"], r["item_id"]] = r["weight"]
    return out


def test_weights_of_the_known_matrix(spark):
    x = of_matrix(spark, NEIGHBOURS)
    m = np.array(NEIGHBOURS, float)
    idf = np.log(len(m)) - np.log1p((m > 0).sum(axis=0))
    length = m.sum(axis=1, keepdims=True)
    pressed = 100 * (0.2 + 0.8 * length / length.mean())
    assert np.allclose(dense(weighting.tfidf(x)), np.sqrt(m) * idf, atol=1e-6)
    assert np.allclose(dense(weighting.bm25(x)), m * 101 / (pressed + m) * idf, atol=1e-6)
    assert np.allclose(dense(weighting.normalize(x)), m / np.linalg.norm(m, axis=1, keepdims=True), atol=1e-6)
    assert sorted(map(tuple, weighting.binarize(x, 8).df.collect())) == [(3, 0, 1.0), (6, 5, 1.0)]
    zero = of_rows(spark, [(0, 0, 0.0), (0, 1, -1.0), (1, 1, 0.0)])
    assert dense(weighting.normalize(zero), 2, 2).tolist() == [[0, -1], [0, 0]]
    assert weighting.drop_zeros(zero).df.count() == 1 and weighting.positive(zero).df.count() == 0


def test_neighbours_against_brute_force(spark):
    x = weighting.tfidf(of_matrix(spark, NEIGHBOURS))
    a = dense(x)
    full = a.T @ a
    got = {(r["item"], r["neighbour"]): r["score"] for r in knn.all_pairs_knn(x, 3).collect()}
    for i in range(6):
        best = sorted((j for j in range(6) if full[i, j]), key=lambda j: (-full[i, j], -j))[:3]
        assert {j for k, j in got if k == i} == set(best)
        assert all(got[i, j] == pytest.approx(full[i, j]) for j in best)


@pytest.mark.parametrize("k", [1, 4, 64, 300])
def test_top_against_sorting(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    rng = np.random.default_rng(0)
    y, q = rng.normal(size=(300, 5)).astype(np.float32), rng.normal(size=(9, 5)).astype(np.float32)
    y[10] = y[20] = y[30]
    scores = q.astype(float) @ y.T.astype(float)
    liked = spark.createDataFrame([(0, 30), (0, 5), (3, 7)], "query_id long, id long")
    scores[0, [30, 5]] = scores[3, 7] = -np.inf
    got = lists(topk.score_top(fx.to_df(spark, q), fx.to_df(spark, y), k, liked=liked), "query_id", "id")
    for i in range(9):
        want = [j for j in np.lexsort((-np.arange(300), -scores[i])) if np.isfinite(scores[i, j])][:k]
        assert got[i] == want


def test_gramian(spark):
    y = np.random.default_rng(0).normal(size=(50, 4)).astype(np.float32)
    assert np.allclose(fx.gramian(fx.to_df(spark, y), 4), y.T.astype(float) @ y, atol=1e-4)


def test_augmented_vectors_have_one_length(spark):
    y = np.random.default_rng(0).normal(size=(20, 3)).astype(np.float32)
    out = np.array([r["features"] for r in ann.augment_inner_product(fx.to_df(spark, y)).collect()])
    assert np.allclose(np.linalg.norm(out, axis=1), np.linalg.norm(y, axis=1).max())


@pytest.mark.parametrize("index", [lambda: ann.IVFIndex(nlist=8, nprobe=4), lambda: ann.LSHIndex(tables=10, bucket=1.5)])
def test_index_recall(spark, index):
    y = np.random.default_rng(0).normal(size=(200, 6))
    y = (y / np.linalg.norm(y, axis=1)[:, None]).astype(np.float32)
    df = fx.to_df(spark, y)
    got, want = (lists(t, "query_id", "id") for t in (index().build(df).search(df, 5), topk.score_top(df, df, 5)))
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) > 0.8


def test_split(spark):
    x = of_rows(spark, [(u, i, 1.0 + u) for u in range(30) for i in range(30) if (u * i) % 3], 30, 30)
    a, b = (evaluation.train_test_split(x, 0.8, 3) for _ in range(2))
    assert sorted(map(tuple, a[0].df.collect())) == sorted(map(tuple, b[0].df.collect()))
    assert sorted(map(tuple, a[0].df.union(a[1].df).collect())) == sorted(map(tuple, x.df.collect()))
    assert 0.7 < a[0].df.count() / x.df.count() < 0.9
    assert (a[0].n_users, a[1].n_items) == (30, 30)
    disliked = of_rows(spark, [(u, 0, -1.0) for u in range(50)])
    assert evaluation.train_test_split(disliked, 0.5)[1].df.count() == 0


def test_leave_k_out(spark):
    x = of_rows(spark, [(u, i, 1.0) for u in range(100) for i in range(u % 7 + 1)], 100, 7)
    train, test = evaluation.leave_k_out_split(x, 2, 0.0, 5)
    n = {}
    for r in test.df.collect():
        n[r["user_id"]] = n.get(r["user_id"], 0) + 1
    assert n == {u: 2 for u in range(100) if u % 7 + 1 > 3}
    assert sorted(map(tuple, train.df.union(test.df).collect())) == sorted(map(tuple, x.df.collect()))
    many = of_rows(spark, [(u, i, 1.0) for u in range(100) for i in range(5)], 100, 5)
    assert evaluation.leave_k_out_split(many, 1, 0.8, 5)[1].df.select("user_id").distinct().count() == 20
    for bad in ({"K": 0}, {"train_only_size": -1.0}, {"train_only_size": 1.0}):
        with pytest.raises(ValueError):
            evaluation.leave_k_out_split(x, **bad)


def test_metrics_of_one_user(spark):
    recs = spark.createDataFrame([(0, 1, 1), (0, 2, 5), (0, 3, 2)], "user_id long, rank int, item_id long")
    m = evaluation.ranking_metrics(recs, of_rows(spark, [(0, 1, 1.0), (0, 2, 1.0)]), 3, 10).first()
    assert (m["precision"], m["map"], m["ndcg"], m["auc"]) == pytest.approx((1, 0.833333, 0.919721, 0.9375), abs=1e-6)


def test_missing_recommendations_are_misses(spark):
    recs = spark.createDataFrame([(0, 1, 1)], "user_id long, rank int, item_id long")
    m = evaluation.ranking_metrics(recs, of_rows(spark, [(0, 1, 1.0), (1, 0, 1.0)]), 2, 5).first()
    # User 0: one hit and an empty slot, (1 + (1 + 1) / 2 * (4 - 1)) / 4; user 1: no hits, (0 + 1 / 2 * (4 - 2)) / 4.
    assert m["auc"] == pytest.approx((1.0 + 0.25) / 2)
    assert m["precision"] == pytest.approx(0.5)
    none = evaluation.ranking_metrics(recs, of_rows(spark, []), 2, 5).first()
    assert none["precision"] is None and none["auc"] is None


def test_dictionary(spark):
    df = spark.createDataFrame([(f"l{i % 40:03d}",) for i in range(100)] + [(None,)], "label string")
    got = {r["label"]: r["code"] for r in encode_labels(df, "label", "code").collect()}
    assert got == {f"l{i:03d}": i for i in range(40)}


def test_lists_as_sets(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "q long, i long")
    assert topk.without(df, "i", ids(spark, [1, 1])).count() == 1
    assert topk.only(df, "i", ids(spark, [2, 2])).count() == 1
    assert topk.without(df, "i", None).count() == 2


@pytest.mark.parametrize("cosine", [False, True])
def test_top_beyond_the_broadcast(spark, monkeypatch, cosine):
    """The same rows as with a broadcast, by a join on block numbers; blocks that the k-th score rules out are not met."""
    rng = np.random.default_rng(4)
    y = (rng.normal(size=(400, 6)) * rng.exponential(size=(400, 1))).astype(np.float32)
    y[7] = 0
    q = rng.normal(size=(25, 6)).astype(np.float32)
    liked = spark.createDataFrame([(i, j) for i in range(25) for j in range(i, 400, 3)], "query_id long, id long")
    queries, items = fx.to_df(spark, q), fx.to_df(spark, y)
    want = sorted(map(tuple, topk.score_top(queries, items, 7, cosine=cosine, liked=liked, digits=5).collect()))
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    far = topk.score_top(queries, items, 7, cosine=cosine, liked=liked, digits=5)
    assert "CartesianProduct" not in far._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, far.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-5)


def test_blocks_that_are_skipped(spark):
    lengths = [5.0, 3.0, 1.0, 0.5]
    asked = spark.createDataFrame([(0, [1.0, 0.0], []), (1, [0.0, 2.0], []), (2, [1.0, 0.0], []), (3, [0.0, 0.0], [])], "id long, features array<float>, liked array<bigint>")
    best = spark.createDataFrame([(0, 4.0), (0, 2.0), (1, 2.5), (1, 2.1), (2, 9.0), (3, 0.0), (3, 0.0)], "query_id long, score double")
    depths = {r["id"]: r["depth"] for r in topk.scan_depths(asked, best, 2, lengths, 0.0).collect()}
    # Query 0 needs a length of 2, query 1 of 1.05; query 2 has one item only; a score of zero rules nothing out.
    assert depths == {0: 2, 1: 2, 2: 4, 3: 4}


def test_back_fill_of_an_allow_list(spark):
    """Items that no neighbour reaches come last, with the least score; all allowed items are there."""
    x = of_rows(spark, [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (1, 2, 2.0), (2, 4, 1.0)], 3, 6)
    model = knn.ItemItemRecommender(K=5).fit(x)
    rows = model.recommend(ids(spark, [0], "user_id"), x, 1, allow=ids(spark, [0, 2, 3, 4]), backfill=True).orderBy("rank").collect()
    assert [(r["item_id"], r["score"]) for r in rows] == [(2, 2.0), (4, knn.LEAST_SCORE), (3, knn.LEAST_SCORE), (0, knn.LEAST_SCORE)]
    assert lists(model.recommend(ids(spark, [0], "user_id"), x, 9, allow=ids(spark, [0, 2, 3, 4])), "user_id", "item_id") == {0: [2]}
    near = model.similar_items(ids(spark, [1, 9]), 3, allow=ids(spark, [2, 3, 5]), backfill=True)
    assert lists(near, "query_id", "id") == {1: [2, 5, 3]}
    with pytest.raises(ValueError):
        model.recommend(None, x, backfill=True)


def test_choosing_by_a_histogram(spark, monkeypatch):
    from tastegrid.functions.vectors import hash_uniform

    monkeypatch.setattr(evaluation, "CELLS", 8)
    df = spark.range(200).selectExpr("id", "id % 3 other").union(spark.range(50).selectExpr("id", "id"))
    order = [r["id"] for r in spark.range(200).withColumn("u", hash_uniform(7, F.col("id"))).orderBy("u", "id").collect()]
    for share, n in ((0.0, 1), (0.25, 50), (0.999, 199), (1.0, 200)):
        assert sorted(r["id"] for r in evaluation.choose(df, "id", share, 7).collect()) == sorted(order[:n])
    assert evaluation.choose(df.limit(0), "id", 0.5, 7).count() == 0


def test_a_heavy_user_meets_all_cells(spark):
    """One user has every item; neighbours are those of the whole product."""
    rng = np.random.default_rng(6)
    rows = [(0, i, 1.0) for i in range(300)] + [(u, int(i), float(rng.integers(-2, 4))) for u in range(1, 40) for i in rng.choice(300, 7, replace=False)]
    x = of_rows(spark, rows, 40, 300)
    a = dense(x, 40, 300)
    got = {(r["item"], r["neighbour"]): r["score"] for r in knn.all_pairs(x).collect()}
    assert len(got) == 300 * 300 and np.allclose([got[i, j] for i in range(300) for j in range(300)], (a.T @ a).ravel())
    best = lists(knn.rank_top(knn.all_pairs(x), "item", "neighbour", 4), "item", "neighbour")
    near = {}
    for r in sorted(knn.all_pairs_knn(x, 4, digits=6).collect(), key=lambda r: (r["item"], -r["score"], -r["neighbour"])):
        near.setdefault(r["item"], []).append(r["neighbour"])
    assert near == best


def test_cells_in_several_blocks(spark, monkeypatch):
    """Looking into all cells gives the exact result, however the cells are cut and whatever is left out."""
    monkeypatch.setattr(ann, "CELL_BLOCK", 7)
    rng = np.random.default_rng(9)
    df = fx.to_df(spark, rng.integers(-3, 4, (120, 5)))
    index = ann.IVFIndex(nlist=4, nprobe=4).build(df)
    liked = spark.createDataFrame([(q, i) for q in range(0, 120, 2) for i in range(q % 5, 120, 3)], "query_id long, id long")
    for options in ({}, {"liked": liked}, {"liked": liked, "deny": ids(spark, range(0, 120, 4))}, {"allow": ids(spark, [3, 50, 51])}):
        got, want = (lists(f(df, *a, digits=3, **options), "query_id", "id") for f, a in ((index.search, (6,)), (topk.score_top, (df, 6))))
        assert got == want
    none = ann.IVFIndex(nlist=1, nprobe=1).build(df.limit(0))
    assert none.search(df, 3).count() == 0


def _sparse_interactions(spark, local):
    """Six items a user at random, or from the user's own tenth of the items; one user has half of all."""
    rng = np.random.default_rng(12)
    rows = [(0, i, 1.0) for i in range(0, 800, 2)]
    for u in range(1, 200):
        pool = np.arange(80) + 80 * (u // 20) if local else np.arange(800)
        rows += [(u, int(i), float(rng.integers(-2, 4))) for i in rng.choice(pool, 6, replace=False)]
    return of_rows(spark, rows, 200, 800)


@pytest.mark.parametrize("local", [True, False])
@pytest.mark.parametrize("entries", [12_000_000, 300])
def test_rows_of_a_sparse_product(spark, monkeypatch, local, entries):
    """Neighbours and recommendations without squares are those of the whole product, however ranges and columns are cut."""
    monkeypatch.setattr(knn, "PLACES_PER_PAIR", 0)
    monkeypatch.setattr(knn, "_squares", None)
    monkeypatch.setattr(sparse, "MOST_PAIRS", 500)
    monkeypatch.setattr(sparse, "TASK_ENTRIES", entries)
    x = _sparse_interactions(spark, local)
    a = dense(x, 200, 800)
    full, shared = a.T @ a, {(r["user_id"], r["item_id"]) for r in x.df.collect()}
    held = np.zeros((200, 800))
    held[tuple(np.array(sorted(shared)).T)] = 1
    meets = held.T @ held > 0
    model = knn.ItemItemRecommender(K=5, digits=6).fit(x)
    got = lists(topk.rank_top(model.similarity, "item", "neighbour", 5), "item", "neighbour")
    near, chosen = np.zeros((800, 800)), np.zeros((800, 800))
    for i in np.flatnonzero(meets.any(axis=1)):
        best = sorted(np.flatnonzero(meets[i]), key=lambda j: (-full[i, j], -j))[:5]
        assert got[i] == best
        near[i, best], chosen[i, best] = full[i, best], 1
    scores, some = a @ near, held @ chosen > 0
    for keep in (False, True):
        found = lists(model.recommend(None, x, 4, filter_already_liked_items=not keep, deny=ids(spark, range(0, 800, 7))), "user_id", "item_id")
        for u in range(200):
            ok = [j for j in found.get(u, []) if j % 7 and (keep or not held[u, j])]
            assert ok == found.get(u, [])
            want = sorted((j for j in np.flatnonzero(some[u]) if j % 7 and (keep or not held[u, j])), key=lambda j: (-scores[u, j], -j))[:4]
            assert [scores[u, j] for j in ok[: len(want)]] == [scores[u, j] for j in want]


def test_what_a_sparse_product_sends(spark):
    """Where users keep to their own items, an entry is sent about once, whatever the number of blocks."""
    n = 40_000
    df = spark.range(n).selectExpr("cast(id / 20 as bigint) user_id", "id item_id", "1.0D weight")
    assert knn.all_pairs(Interactions(df, n // 20, n)).count() == n * 20
    found = lists(knn.ItemItemRecommender(K=3).fit(Interactions(df, n // 20, n)).similar_items(ids(spark, [0, 39_999]), 3), "query_id", "id")
    assert found == {0: [19, 18, 17], 39_999: [39_999, 39_998, 39_997]}


@pytest.mark.parametrize("cosine", [False, True])
def test_top_by_leaves(spark, monkeypatch, cosine):
    """The exact best, ties by id, with liked ids left out; most leaves are ruled out by their bounds."""
    for name, value in (("LEAF", 16), ("MOST_FOUND", 300), ("MOST_BOUNDS", 1)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    y, q = ((rng.random((n, 3)) - 0.5).astype(np.float32) for n in (3000, 300))
    y[100:140], y[50] = y[100], 0
    q[5], q[6] = y[100], 0
    liked = [(i, int(j)) for i in range(0, 300, 2) for j in rng.choice(3000, 200, replace=False)]
    a, b = q.astype(float), y.astype(float)
    if cosine:
        a, b = (m / np.where(np.linalg.norm(m, axis=1) == 0, 1e-10, np.linalg.norm(m, axis=1))[:, None] for m in (a, b))
    scores = np.round(a @ b.T, 6)
    scores[tuple(np.array(liked).T)] = -np.inf
    pairs = spark.createDataFrame(liked, "query_id long, id long")
    got = lists(topk.score_top(fx.to_df(spark, q), fx.to_df(spark, y), 10, cosine=cosine, liked=pairs, digits=6), "query_id", "id")
    for i in range(300):
        assert got[i] == np.lexsort((-np.arange(3000), -scores[i]))[:10].tolist()
    t = topk._Leaves(np.arange(3000), b)
    bounds, kth = t.bounds(a), np.sort(a @ b.T, axis=1)[:, -10]
    assert (bounds >= np.array([(a @ b[t.ids[s:e]].T).max(axis=1) for s, e in zip(t.starts, t.ends)]).T).all()
    assert (bounds >= kth[:, None]).mean() < 0.2


@pytest.mark.parametrize("weigh", [lambda x: weighting.normalize(x, by="item"), lambda x: weighting.tfidf(x, by="item"), lambda x: weighting.bm25(x, by="item")])
def test_weights_deal_entries_once_a_side(spark, weigh, capsys):
    """Sums by item or user come with the entries: no join sends them again."""
    weigh(of_matrix(spark, NEIGHBOURS)).df.explain()
    assert "Join Inner" not in (plan := capsys.readouterr().out) and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_rows_that_are_whole_are_ranked_in_place(spark, capsys):
    """Only the products' own shuffle is left, and ranks are those of all cells, ties going to the greater id."""
    df = spark.createDataFrame([(m, [m % 5, 7], [1.0, 0.5], [m % 3, 4, 6], [1.0, 2.0, 2.0000001]) for m in range(20)], "m long, a array<long>, v array<double>, b array<long>, w array<double>")
    best = sparse.ranked_product(df, 2, digits=6)
    best.explain()
    assert (plan := capsys.readouterr().out).count("Exchange") == 1 and "Window" not in plan
    want = topk.rank_top(sparse.product_top(df), "a", "b", 2, digits=6).select("a", "b", "score", "rank")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("local,entries", [(True, 1 << 30), (False, 1 << 30), (False, 300)])
def test_a_sparse_product_in_passes(spark, monkeypatch, local, entries):
    x = _sparse_interactions(spark, local)
    rows = x.rows()
    products = rows.select(F.col("user_id").alias("m"), F.col("items").alias("a"), F.col("weights").alias("v"), F.col("items").alias("b"), F.col("weights").alias("w"))
    want = sorted(map(tuple, sparse.ranked_product(products, 3, digits=6, squares=True).collect()))
    monkeypatch.setattr(sparse, "TASK_ENTRIES", entries)
    monkeypatch.setattr(sparse, "PASS_ENTRIES", 100)
    monkeypatch.setattr(sparse, "PASS_SHARE", 1)
    monkeypatch.setattr(sparse, "PASS_RANGES", 4)
    written = []
    monkeypatch.setattr(sparse, "stash", lambda df, label: written.append(label) or stash(df, label))
    assert sorted(map(tuple, sparse.ranked_product(products, 3, digits=6, squares=True).collect())) == want
    # Several passes, none of which is sent more than it may be, but for a single range.
    assert len(written) > 1
    assert sparse._passes(np.array([3, 4, 9, 1, 1, 7]), 8) == [range(0, 2), range(2, 3), range(3, 5), range(5, 6)]
    whole = sorted(map(tuple, sparse.product_top(products, squares=True).collect()))
    assert len(whole) > len(want) and {(a, b) for a, b, *_ in want} <= {(a, b) for a, b, _ in whole}


def test_leaves_are_searched_in_single_precision():
    """Bounds of 4 bytes; what single precision cannot tell apart is ranked by the exact products, and liked items stay out."""
    rng = np.random.default_rng(8)
    y, x = ((rng.random((n, 8)) - 0.5) for n in (20_000, 600))
    y[:300] = y[0] * (1 + 1e-9 * np.arange(300))[:, None]
    x[:50] = y[0]
    y, x = (m / np.linalg.norm(m, axis=1)[:, None] for m in (y, x.astype(np.float32).astype(np.float64)))
    y[:300] = y[0] * (1 - 1e-9 * np.arange(300))[:, None]
    index = topk._Leaves(np.arange(len(y)), y)
    assert index.bounds(x).dtype == np.float32 and (index.bounds(x) >= np.array([(x @ y[index.ids[s:e]].T).max(axis=1) for s, e in zip(index.starts, index.ends)]).T).all()
    lists_ = pa.ListArray.from_arrays(pa.array(np.arange(601, dtype=np.int32) * 8), pa.array(x.astype(np.float32).ravel()))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), lists_, pa.array([[3, 5]] * 600, pa.list_(pa.int64()))], ["id", "features", "liked"])
    found = pa.Table.from_batches(topk._searched(type("", (), {"value": index}), 10, True, 0.0)(iter([rows])))
    q, i = (found.column(c).to_numpy() for c in (0, 1))
    own = np.array([r.as_py() for r in lists_], np.float64)
    scores = own / np.linalg.norm(own, axis=1)[:, None] @ y.T
    scores[:, [3, 5]] = -np.inf
    for a in range(0, 600, 7):
        assert set(i[q == a]) >= set(np.argsort(-scores[a], kind="stable")[:10].tolist()) and not {3, 5} & set(i[q == a])
