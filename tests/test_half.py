"""Factors of 16 bits."""

import numpy as np
from pyspark.sql import functions as F

from tastegrid.operators import factors as fx
from tastegrid.operators import half, topk
from tests.helpers import ids


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_packed_factors_take_half_and_come_back(spark):
    rng = np.random.default_rng(0)
    y = (rng.normal(size=(200, 64)) * 10.0 ** rng.integers(-6, 7, (200, 1))).astype(np.float32)
    y[3] = 0
    packed = half.pack(fx.to_df(spark, y))
    got = {r["id"]: r for r in packed.collect()}
    assert all(len(r["half"]) == 128 for r in got.values())
    back = {r["id"]: np.array(r["features"]) for r in half.unpack(packed).collect()}
    for i in range(200):
        assert np.linalg.norm(back[i] - y[i]) <= got[i]["off"] * 1.001 + 1e-30 and got[i]["off"] <= 2e-3 * (np.linalg.norm(y[i]) or 1)


def test_the_best_are_those_of_full_precision(spark):
    """Items so near each other that 16 bits cannot tell them apart."""
    rng = np.random.default_rng(1)
    y = np.repeat(rng.normal(size=(30, 16)), 10, axis=0) + 1e-5 * rng.normal(size=(300, 16))
    q, y = fx.to_df(spark, rng.normal(size=(20, 16))), fx.to_df(spark, y)
    packed = half.pack(y)
    assert rows(half.score_top_half(q, packed, y, 10)) == rows(half.score_top_half(q, packed, y, 10))
    want, got = (rows(t.select("query_id", "rank", "id")) for t in (topk.score_top(q, y, 10), half.score_top_half(q, packed, y, 10)))
    assert got == want
    liked = spark.createDataFrame([(i, j) for i in range(0, 20, 2) for j in range(i, 300, 4)], "query_id long, id long")
    want, got = (rows(t.select("query_id", "rank", "id")) for t in (topk.score_top(q, y, 7, liked=liked, deny=ids(spark, range(0, 300, 7))), half.score_top_half(q, packed, y, 7, liked=liked, deny=ids(spark, range(0, 300, 7)))))
    assert got == want


def test_saved_in_half(spark, tmp_path):
    model = fx.FactorModel()
    rng = np.random.default_rng(2)
    model.user_factors, model.item_factors = fx.to_df(spark, rng.normal(size=(9, 4))), fx.to_df(spark, rng.normal(size=(7, 4)))
    model.save(str(tmp_path / "m"), half=True)
    again = fx.FactorModel.load(spark, str(tmp_path / "m"))
    for a, b in ((model.user_factors, again.user_factors), (model.item_factors, again.item_factors)):
        x, y = (np.array([r["features"] for r in sorted(t.collect(), key=lambda r: r["id"])]) for t in (a, b))
        assert x.shape == y.shape and np.allclose(x, y, atol=2e-3) and not (x == y).all()


def test_queries_meet_items_by_blocks(spark):
    """An item block goes to a block of queries, not to each of them."""
    y = fx.to_df(spark, np.random.default_rng(3).normal(size=(3000, 4)))
    sent = [b.num_rows for b in half._asked(y.select("id", "features", F.lit(0).cast("bigint")).toArrow().combine_chunks().to_batches())]
    assert len(sent) == 3 and set(sent) == {1}
    got, want = (sorted(map(tuple, t.select("query_id", "rank", "id").collect())) for t in (half.score_top_half(y, half.pack(y), y, 5), topk.score_top(y, y, 5)))
    assert got == want
