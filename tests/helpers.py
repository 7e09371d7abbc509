"""Fixtures as plain lists."""

from tastegrid.interactions import Interactions

SCHEMA = "user_id long, item_id long, weight double"

FACTORIZE = [[0, 1, 0, 0, 1, 1], [1, 0, 0, 1, 1, 0], [0, 0, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 0, 1], [1, 0, 1, 0, 1, 1], [0, 1, 0, 0, 0, 0]]
EXPLAIN = [[3, 0, 1, 0, 2, 0], [0, 5, 0, 1, 0, 1], [2, 1, 0, 0, 8, 0], [6, 0, 3, 1, 0, 0], [1, 0, 0, 4, 1, 2], [0, 2, 7, 0, 0, 1], [0, 0, 1, 1, 3, 0]]
NEIGHBOURS = [[0, 3, 1, 0, 4, 0], [2, 0, 0, 5, 1, 0], [0, 0, 6, 2, 0, 1], [8, 1, 0, 0, 0, 0], [0, 7, 0, 1, 2, 0], [1, 0, 3, 0, 0, 5], [0, 0, 0, 2, 0, 9]]


def of_rows(spark, rows, n_users=None, n_items=None):
    return Interactions.of(spark.createDataFrame(rows, SCHEMA), n_users=n_users, n_items=n_items)


def of_matrix(spark, m):
    rows = [(u, i, float(w)) for u, r in enumerate(m) for i, w in enumerate(r) if w]
    return of_rows(spark, rows, len(m), len(m[0]))


def checkerboard(spark, n, without=()):
    """User u likes item i if both are even or both odd, but for i = u."""
    rows = [(u, i, 1.0) for u in range(n) for i in range(n) if u % 2 == i % 2 and u != i and u not in without and i not in without]
    return of_rows(spark, rows, n, n)


def ids(spark, values, column="id"):
    return spark.createDataFrame([(int(v),) for v in values], f"{column} long")


def lists(df, key, value):
    """The values of each key in order of rank."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r["rank"])):
        out.setdefault(r[key], []).append(r[value])
    return out
