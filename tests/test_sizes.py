"""Tables and passes of neighbours that grow with the input: what stays on disk, and what is read how often."""

import os

import numpy as np

from tastegrid.operators import sparse
from tastegrid.operators.evaluation import leave_k_out_split
from tastegrid.operators.knn import BM25Recommender
from tastegrid.plans import queries
from tastegrid.sources import checkpoints
from tests.helpers import of_rows

PRODUCTS = "m long, a array<long>, v array<double>, b array<long>, w array<double>"


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def tables(spark):
    return set(os.listdir(checkpoints.shared_dir(spark).removeprefix("file:")))


def test_neighbours_are_written_once_and_go_with_the_model(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = of_rows(spark, [(u, int(i), float(rng.integers(1, 6))) for u in range(60) for i in rng.choice(900, 4, replace=False)])
    given = x.with_df(checkpoints.stash(x.df, "given"))
    monkeypatch.setattr(sparse, "PASS_ENTRIES", 400)
    monkeypatch.setattr(sparse, "PASS_SHARE", 0)
    before = tables(spark)
    model = BM25Recommender(K=6, digits=6).fit(given)
    left = tables(spark) - before
    assert len(left) > 1 and {t.split("-")[0] for t in left} == {"product"}
    want = rows(model.recommend(None, given, 4))
    found = model.recommend(None, given, 4, discard_model=True)
    assert not left & tables(spark) and model.similarity is None
    assert rows(found) == want and want


def test_a_pass_gets_only_what_touches_its_ranges(spark, monkeypatch):
    products = spark.createDataFrame([(m, [m], [1.0], [m % 7, 9], [1.0, 2.0]) for m in range(200)], PRODUCTS)
    want = rows(sparse.ranked_product(products, 2, digits=6))
    dealt, seen = sparse._dealt, []

    def checked(cuts, own, *rest):
        seen.append(own)
        run = dealt(cuts, own, *rest)

        def all_near(batches):
            for batch in batches:
                at = np.searchsorted(cuts, np.asarray(batch.column(1).flatten()), side="right")
                assert ((at >= own.start) & (at < own.stop)).all()
                yield from run(iter([batch]))

        return all_near

    monkeypatch.setattr(sparse, "_dealt", checked)
    monkeypatch.setattr(sparse, "PASS_ENTRIES", 1200)
    monkeypatch.setattr(sparse, "PASS_SHARE", 0)
    assert rows(sparse.ranked_product(products, 2, digits=6)) == want and len(seen) > 1


def test_order_is_stable_with_and_without_room_for_places():
    rng = np.random.default_rng(7)
    for most in (1, 50, 1 << 40, (1 << 62) - 1):
        keys = rng.integers(0, most, 1000)
        assert (sparse._order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(sparse._order(np.zeros(0, np.int64))) == 0


def test_held_out_entries_are_marked_once(spark, monkeypatch):
    labels, stash = [], queries.stash_in_passes
    monkeypatch.setattr(queries, "stash_in_passes", lambda tables, key, f, label, n: labels.append(label) or stash(tables, key, f, label, n))
    x = of_rows(spark, [(u, i, 1.0 + i) for u in range(40) for i in range(u % 9 + 1)])
    monkeypatch.setattr(queries, "cp_stored", lambda spark, d: x.with_df(checkpoints.stash(x.df, "given")))
    parts = []
    monkeypatch.setattr(queries.evaluation, "ranking_metrics_at_k", lambda model, train, test, k: parts.extend((train, test)) or spark.range(1))
    queries._metrics(spark, "")
    assert labels == ["split"]
    assert [rows(p.df) for p in parts] == [rows(p.df) for p in leave_k_out_split(x, 3, 0.0, 7)]
