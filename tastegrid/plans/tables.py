"""Interactions and factors from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.vectors import hash_uniform
from tastegrid.interactions import Interactions
from tastegrid.sources.checkpoints import discard, stash_in_passes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bought(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), "l_partkey", "l_quantity")
    return lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), "o_custkey")


def _by_quantity(bought: DataFrame, n_users: int | None = None, n_items: int | None = None) -> Interactions:
    return Interactions.of(bought, "o_custkey", "l_partkey", "l_quantity", n_users, n_items)


def _shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count()


def cp(spark: SparkSession, sf_dir: str) -> Interactions:
    """Customers and parts, weighted by the quantity bought."""
    lines, orders = _bought(spark, sf_dir)
    return _by_quantity(lines.join(orders, "order"), *_shape(spark, sf_dir))


def cp_stored(spark: SparkSession, sf_dir: str) -> Interactions:
    """Those of cp, written by some orders and then by some customers at a time; discard(x.df) gives their disk back."""
    tables = _bought(spark, sf_dir)
    n = sum(t.count() for t in tables)
    bought = stash_in_passes(list(tables), "order", lambda lines, orders: lines.join(orders, "order").select("o_custkey", "l_partkey", "l_quantity"), "bought", n)
    stored = stash_in_passes([bought], "o_custkey", lambda df: _by_quantity(df).df, "interactions", bought.count())
    discard(bought)
    return Interactions(stored, *_shape(spark, sf_dir))


def ev(spark: SparkSession, sf_dir: str) -> Interactions:
    """Users of events and the number in their properties, weighted by the events."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return Interactions.of(e, "user_id", "k", None, n_items=100)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def hashed_factors(ids: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """id and k features that depend on the seed, the id and the place alone."""
    cells = F.array(*[(hash_uniform(seed, F.col("id"), F.lit(d)) - 0.5).cast("float") for d in range(k)])
    return ids.select(F.col(column).cast("long").alias("id")).select("id", cells.alias("features"))


def user_factors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return hashed_factors(table(spark, sf_dir, "customer"), "c_custkey", k, 11)


def item_factors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return hashed_factors(table(spark, sf_dir, "part"), "p_partkey", k, 13)
