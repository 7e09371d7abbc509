"""Neighbours and recommendations whose shuffles are dealt with in passes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.interactions import USER
from tastegrid.operators import sparse
from tastegrid.operators.knn import BM25Recommender, TFIDFRecommender
from tastegrid.sources import checkpoints
from tests.helpers import ids, of_rows


def rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=lambda r: [(v is None, v or 0) for v in r])


def test_a_pass_holds_all_rows_of_its_keys(spark, monkeypatch):
    monkeypatch.setattr(checkpoints, "PASS_ROWS", 30)
    seen, released = [], []
    monkeypatch.setattr(checkpoints, "release", lambda s: released.append(1))

    def counted(df):
        seen.append({r["k"]: r["n"] for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()})
        return df.groupBy("k").agg(F.sum("v").alias("v"))

    df = spark.range(100).selectExpr("case when id % 10 < 9 then id % 10 end k", "id v")
    out = checkpoints.stash_in_passes([df], "k", counted, "sums", 100)
    assert len(seen) == len(released) == 4 and len([k for s in seen for k in s]) == 10 and all(n == 10 for s in seen for n in s.values())
    assert rows(out) == rows(df.groupBy("k").agg(F.sum("v").alias("v")))
    # Passes are bounded: the tables are read once for each of them.
    seen.clear()
    checkpoints.stash_in_passes([df], "k", counted, "sums", 1 << 40)
    assert len(seen) == checkpoints.MOST_PASSES


@pytest.mark.parametrize("kind", [TFIDFRecommender, BM25Recommender])
def test_passes_change_no_result(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = of_rows(spark, [(u, int(i), float(rng.integers(1, 6))) for u in range(40) for i in rng.choice(60, 5, replace=False)])

    def found():
        given = x.with_df(checkpoints.stash(x.df, "given"))
        model = kind(K=6, digits=6).fit(given)
        some = ids(spark, range(0, 40, 3), USER)
        out = [rows(t) for t in (model.similarity, model.recommend(None, x, 4), model.recommend(some, given, 4, deny=ids(spark, range(9))), model.similar_items(ids(spark, range(60)), 3))]
        path = given.df.stashed_at
        assert os.path.isdir(path.removeprefix("file:")) and kind(K=6, digits=6).fit(given, discard_interactions=True).similarity.count() == len(out[0])
        assert not os.path.isdir(path.removeprefix("file:"))
        return out

    want = found()
    monkeypatch.setattr(checkpoints, "PASS_ROWS", 40)
    monkeypatch.setattr(checkpoints, "MOST_PASSES", 2)
    assert found() == want and all(want)


def test_ranges_go_together_up_to_a_part_of_a_pass(spark, monkeypatch):
    """Ranges of little are not all sent at once where a single one could send as much, and what is sent is the same."""
    df = spark.createDataFrame([(m, [m, m + 200], [1.0, 0.5], [m % 7, 9], [1.0, 2.0]) for m in range(200)], "m long, a array<long>, v array<double>, b array<long>, w array<double>")
    monkeypatch.setattr(sparse, "PASS_ENTRIES", 1200)
    monkeypatch.setattr(sparse, "PASS_SHARE", 0)
    written = []
    monkeypatch.setattr(sparse, "stash", lambda df, label: written.append(label) or checkpoints.stash(df, label))
    found = rows(sparse.ranked_product(df, 2, digits=6))
    assert len(written) > 1
    monkeypatch.setattr(sparse, "TOGETHER", 1 << 20)
    written.clear()
    assert rows(sparse.ranked_product(df, 2, digits=6)) == found and not written
