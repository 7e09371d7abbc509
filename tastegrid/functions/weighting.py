"""Weightings of interactions.

`row` is the side whose vectors are weighted, `col` the other one.  Models of
items weight item vectors, so there row is the item and the inverse frequency is
that of users.  What holds for a row or a column is taken over a window, which
deals the entries out once; a join with sums would do so for the sums as well.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions


def _sides(by: str) -> tuple[str, str]:
    return (ITEM, USER) if by == "item" else (USER, ITEM)


def _n_rows(x: Interactions, by: str) -> int:
    return x.n_items if by == "item" else x.n_users


def _idf(n_rows: int, df: str) -> Column:
    return F.log(F.lit(float(n_rows))) - F.log1p(F.col(df).cast("double"))


def tfidf_value(n_rows: int, df: str) -> Column:
    return F.sqrt(WEIGHT) * _idf(n_rows, df)


def bm25_value(n_rows: int, k1: float, b: float, df: str, length: str, mean: Column) -> Column:
    norm = (1.0 - b) + b * F.try_divide(F.col(length), mean)
    value = F.try_divide(F.col(WEIGHT) * (k1 + 1.0), k1 * norm + F.col(WEIGHT)) * _idf(n_rows, df)
    return F.coalesce(value, F.lit(0.0))


def tfidf(x: Interactions, by: str = "user") -> Interactions:
    """sqrt(weight) times ln N - ln(1 + df), with N all rows, also empty ones, and df the entries of the column."""
    _, col = _sides(by)
    counted = x.df.withColumn("df", F.count("*").over(Window.partitionBy(col)))
    weighted = counted.withColumn(WEIGHT, tfidf_value(_n_rows(x, by), "df"))
    return x.with_df(weighted.select(USER, ITEM, WEIGHT))


def bm25(x: Interactions, k1: float = 100.0, b: float = 0.8, by: str = "user") -> Interactions:
    """Okapi BM25; the mean length counts empty rows."""
    row, col = _sides(by)
    n = _n_rows(x, by)
    counts = "df", F.count("*").over(Window.partitionBy(col))
    sums = "length", F.sum(WEIGHT).over(Window.partitionBy(row))
    mean = x.df.agg((F.sum(WEIGHT) / float(max(n, 1))).alias("mean"))  # one row
    # The user last: rows are then where the lists of users are made.
    first, last = (sums, counts) if by == "item" else (counts, sums)
    counted = x.df.withColumn(*first).withColumn(*last).crossJoin(F.broadcast(mean))
    return x.with_df(counted.withColumn(WEIGHT, bm25_value(n, k1, b, "df", "length", F.col("mean"))).select(USER, ITEM, WEIGHT))


def normalize(x: Interactions, by: str = "user") -> Interactions:
    """Rows of length one; a row of zeros stays zero."""
    row, _ = _sides(by)
    norms = F.sqrt(F.sum(F.col(WEIGHT) * F.col(WEIGHT)).over(Window.partitionBy(row)))
    value = F.coalesce(F.try_divide(F.col(WEIGHT), F.col("norm")), F.lit(0.0))
    return x.with_df(x.df.withColumn("norm", norms).withColumn(WEIGHT, value).select(USER, ITEM, WEIGHT))


def scale(x: Interactions, alpha: float) -> Interactions:
    return x.with_df(x.df.withColumn(WEIGHT, F.col(WEIGHT) * float(alpha)))


def binarize(x: Interactions, least: float) -> Interactions:
    """Entries of at least `least` become 1, others go."""
    return x.with_df(x.df.where(F.col(WEIGHT) >= float(least)).withColumn(WEIGHT, F.lit(1.0)))


def drop_zeros(x: Interactions) -> Interactions:
    return x.with_df(x.df.where(F.col(WEIGHT) != 0))


def positive(x: Interactions) -> Interactions:
    return x.with_df(x.df.where(F.col(WEIGHT) > 0))
