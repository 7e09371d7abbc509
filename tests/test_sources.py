import os

import numpy as np

from tastegrid.interactions import Interactions
from tastegrid.operators.als import AlternatingLeastSquares
from tastegrid.sources import readers
from tastegrid.streaming.foldin import FoldIn
from tests.helpers import checkerboard, lists


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(x):
    return sorted(map(tuple, x.df.collect()))


def test_lastfm(spark, tmp_path):
    p = write(tmp_path / "plays.tsv", "u2\tid1\tNA\t3\nu1\tid2\tb\t4\nu2\tid1\tNA\t1\n")
    users, items, x = readers.lastfm(spark, p)
    assert {r["label"]: r["user_id"] for r in users.collect()} == {"u1": 0, "u2": 1}
    assert {r["label"] for r in items.collect()} == {"NA", "b"}
    assert rows(x) == [(0, 1, 4.0), (1, 0, 4.0)]


def test_movielens(spark, tmp_path):
    assert rows(readers.movielens(spark, write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\n1,2,3.5,9\n"), "20m")) == [(1, 2, 3.5)]
    assert rows(readers.movielens(spark, write(tmp_path / "r.dat", "1::2::4::9\n"), "1m")) == [(1, 2, 4.0)]
    assert rows(readers.movielens(spark, write(tmp_path / "u.data", "1\t2\t4\t9\n"), "100k")) == [(1, 2, 4.0)]
    titles = readers.delimited(spark, write(tmp_path / "u.item", "1|Café|x\n", "latin-1"), "id long, title string, more string", "|", encoding="ISO-8859-1", keep=["id", "title"])
    assert titles.collect() == [(1, "Café")]


def test_other_sets(spark, tmp_path):
    votes = write(tmp_path / "votes.csv", "a,i,sub,-1\nb,i,sub,1\n")
    assert rows(readers.reddit(spark, votes)[2]) == [(0, 0, -1.0), (1, 0, 1.0)]
    likes = write(tmp_path / "likes.psv", "uid|mid\na|m\nb|n\n")
    assert rows(readers.sketchfab(spark, likes)[2]) == [(0, 0, 1.0), (1, 1, 1.0)]
    plays, tracks = write(tmp_path / "plays.txt", "a\tt1\t2\n"), write(tmp_path / "tracks.txt", "t1\tA\tB\tC\n")
    _, items, x = readers.taste_profile(spark, plays, tracks)
    assert rows(x) == [(0, 0, 2.0)] and items.first()["artist"] == "A"


def test_matrix_market(spark, tmp_path):
    x = readers.matrix_market(spark, write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate real general\n% c\n3 4 2\n1 1 5.0\n3 4 1.5\n"))
    assert rows(x) == [(0, 0, 5.0), (2, 3, 1.5)] and (x.n_users, x.n_items) == (3, 4)


def test_matrix_market_size_line_and_symmetry(spark, tmp_path):
    banner = "%%MatrixMarket matrix coordinate real "
    x = readers.matrix_market(spark, write(tmp_path / "a.mtx", banner + "general\n%c\n3 3 3\n3 3 3\n1 2 1\n2 1 4\n"))
    assert rows(x) == [(0, 1, 1.0), (1, 0, 4.0), (2, 2, 3.0)]
    x = readers.matrix_market(spark, write(tmp_path / "b.mtx", banner + "symmetric\n3 3 2\n2 1 5\n3 3 1\n"))
    assert rows(x) == [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 1.0)]
    x = readers.matrix_market(spark, write(tmp_path / "c.mtx", banner + "skew-symmetric\n3 3 1\n2 1 5\n"))
    assert rows(x) == [(0, 1, -5.0), (1, 0, 5.0)]
    x = readers.matrix_market(spark, write(tmp_path / "d.mtx", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n"))
    assert rows(x) == [(1, 0, 1.0)]


def test_titles_and_stored_data_sets(spark, tmp_path):
    titles = readers.movielens_titles(spark, write(tmp_path / "movies.csv", 'movieId,title,genres\n1,"A, the",x\n'), "20m")
    assert titles.collect() == [(1, "A, the")]
    doubled = 'movieId,title,genres\n3,"""Great Performances"" Cats, A (1998)",Musical\n4,"Say ""x""",y\n5,a\\b,z\n'
    assert readers.movielens_titles(spark, write(tmp_path / "quoted.csv", doubled), "20m").collect() == [(3, '"Great Performances" Cats, A (1998)'), (4, 'Say "x"'), (5, "a\\b")]
    assert readers.movielens_titles(spark, write(tmp_path / "movies.dat", "1::Caf\xe9::x|y\n", "latin-1"), "1m").collect() == [(1, "Caf\xe9")]
    bars = readers.movielens_titles(spark, write(tmp_path / "u2.item", "7|Caf\xe9|date|more|1\n", "latin-1"), "100k")
    assert bars.collect() == [(7, "Caf\xe9")]
    x = readers.movielens(spark, write(tmp_path / "ratings.csv", "userId,movieId,rating,timestamp\n1,2,3.5,9\n"), "20m")
    readers.dataset(spark, str(tmp_path / "set"), titles, None, x)
    items, back = readers.stored_dataset(spark, str(tmp_path / "set"))
    assert items.collect() == titles.collect() and rows(back) == rows(x) and (back.n_users, back.n_items) == (x.n_users, x.n_items)


def test_results_file(spark, tmp_path):
    found = spark.createDataFrame([(0, 1, 1, 0.5)], "query_id long, rank int, id long, score double")
    a, b = spark.createDataFrame([(0, "x")], "query_id long, label string"), spark.createDataFrame([(1, "y")], "id long, label string")
    n = spark.createDataFrame([(0, 7)], "id long, n long")
    readers.write_results(found, str(tmp_path / "out"), "query_id", "id", a, b, n)
    text = "".join((tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out") if f.startswith("part"))
    assert text == "x\ty\t0.5\n"


def test_stream_folds_users_in(spark, tmp_path):
    x = checkerboard(spark, 20)
    model = AlternatingLeastSquares(factors=2, regularization=0.001, random_state=23, iterations=5).fit(x)
    history = str(tmp_path / "history")
    own = x.df.where("user_id = 1").selectExpr("cast(30 as long) user_id", "item_id", "weight").orderBy("item_id")
    folds = FoldIn(model, history)
    source = tmp_path / "in"
    own.where("item_id < 10").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(own.schema).parquet(str(source))
    folds.start(stream, str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
    own.where("item_id >= 10").coalesce(1).write.mode("append").parquet(str(source))
    folds.start(stream, str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
    assert model.user_factors.count() == 31
    mine = x.with_df(own)
    assert lists(model.recommend(own.select("user_id").distinct(), mine, 1), "user_id", "item_id") == {30: [1]}


def test_stream_keeps_state_over_restarts(spark, tmp_path):
    x = checkerboard(spark, 20)
    fitted = AlternatingLeastSquares(factors=2, regularization=0.01, random_state=23, iterations=3).fit(x)
    fitted.save(str(tmp_path / "model"))
    batches = [
        [(1, 2, 1.0), (30, 3, 2.0), (30, 5, 1.0), (None, 1, 1.0), (2, None, 1.0)],
        [(30, 3, 1.0), (31, 4, 4.0), (31, 4, 0.5), (31, 7, None), (31, 99, 1.0)],
        [(32, 1, 1.0), (1, 8, 3.0)],
    ]
    source, schema = tmp_path / "in", "user_id long, item_id long, weight double"
    for batch in batches:
        # Each run begins with the model as it was stored: what earlier runs did is in the store and the checkpoint.
        model = AlternatingLeastSquares.load(spark, str(tmp_path / "model"))
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        FoldIn(model, str(tmp_path / "store")).start(stream, str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {r["id"]: r["features"] for r in fitted.recalculate_users(Interactions.of(everything)).collect()}
    got = {r["id"]: r["features"] for r in model.user_factors.collect()}
    assert want.keys() == {1, 30, 31, 32} and got.keys() == set(range(33))
    for i, features in want.items():
        assert np.allclose(got[i], features, atol=1e-5)
    before = {r["id"]: r["features"] for r in fitted.user_factors.collect()}
    assert all(got[i] == before[i] for i in before if i != 1) and not any(any(got[i]) for i in range(20, 30))
    # A batch refits its own users only.
    stored = spark.read.parquet(str(tmp_path / "store")).groupBy("batch").agg({"id": "collect_set"}).collect()
    assert [set(s) for _, s in sorted(map(tuple, stored))] == [{1, 30}, {30, 31}, {1, 32}]
