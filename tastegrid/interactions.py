"""Interactions: the sparse (user, item, weight) matrix as a long relation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.sources.checkpoints import stash

USER, ITEM, WEIGHT = "user_id", "item_id", "weight"


@dataclass(frozen=True, eq=False)
class Interactions:
    """One row for each (user_id, item_id) with its weight.

    The shape is data: ids without interactions still count as rows of the
    matrix.  Where a shape is not given it is the largest id and one.
    """

    df: DataFrame
    users: int | None = None
    items: int | None = None

    @staticmethod
    def of(df: DataFrame, user: str = USER, item: str = ITEM, weight: str | None = WEIGHT, n_users: int | None = None, n_items: int | None = None) -> "Interactions":
        """From any DataFrame; equal (user, item) rows are summed, rows without an id are left out, a null weight counts as zero."""
        value = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
        own = df.select(F.col(user).cast("long").alias(USER), F.col(item).cast("long").alias(ITEM), value.alias(WEIGHT))
        own = own.dropna(subset=[USER, ITEM]).groupBy(USER, ITEM).agg(F.sum(WEIGHT).alias(WEIGHT))
        return Interactions(own, n_users, n_items)

    @cached_property
    def _largest(self) -> tuple[int, int]:
        r = self.df.agg(F.max(USER), F.max(ITEM)).first()
        return (-1 if r[0] is None else r[0]) + 1, (-1 if r[1] is None else r[1]) + 1

    @property
    def n_users(self) -> int:
        return self._largest[0] if self.users is None else self.users

    @property
    def n_items(self) -> int:
        return self._largest[1] if self.items is None else self.items

    def with_df(self, df: DataFrame) -> "Interactions":
        return Interactions(df, self.users, self.items)

    def transposed(self) -> "Interactions":
        """Items as users and users as items."""
        return Interactions(self.df.select(F.col(ITEM).alias(USER), F.col(USER).alias(ITEM), WEIGHT), self.items, self.users)

    def rows(self) -> DataFrame:
        """One row for each user: user_id, items and weights, in order of item."""
        packed = self.df.groupBy(USER).agg(F.sort_array(F.collect_list(F.struct(ITEM, WEIGHT))).alias("x"))
        return packed.select(USER, F.col(f"x.{ITEM}").alias("items"), F.col(f"x.{WEIGHT}").alias("weights"))


def encode_labels(df: DataFrame, label: str, code: str) -> DataFrame:
    """A dictionary of the labels: label and its place in label order, from 0; null labels have none.

    Labels are first range-partitioned, so that each partition is numbered on its own and
    offset by the sizes of those before it: no step sorts all labels in one task.
    """
    spark = df.sparkSession
    labels = df.select(F.col(label).alias("label")).dropna().distinct()
    ranged = labels.repartitionByRange("label").sortWithinPartitions("label")
    # Written down: ranges are drawn by sampling, so a second run might number otherwise.
    numbered = stash(ranged.select("label", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % (1 << 33)).alias("i")), "labels")
    # One row for each partition.
    sizes = sorted((r["p"], r["n"]) for r in numbered.groupBy("p").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets or [(-1, 0)], "p int, at long")
    return numbered.join(F.broadcast(table), "p").select(F.col("label").alias(label), (F.col("i") + F.col("at")).alias(code))


def join_labels(df: DataFrame, labels: DataFrame, code: str, label: str) -> DataFrame:
    """Put labels beside codes; codes without a label stay, with null."""
    return df.join(labels.select(code, label), code, "left")
