"""Fold users into a model as their interactions arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tastegrid.interactions import ITEM, USER, WEIGHT, Interactions
from tastegrid.operators.als import AlternatingLeastSquares, upsert_all

ENTRIES = "items array<bigint>, weights array<double>"


def remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a user's new entries to those in its state, and give all of them."""
    known = dict(zip(*state.get)) if state.exists else {}
    for part in parts:
        for item, weight in zip(part[ITEM].tolist(), part[WEIGHT].tolist()):
            known[item] = known.get(item, 0.0) + weight
    items = sorted(known)
    weights = [known[i] for i in items]
    state.update((items, weights))
    yield pd.DataFrame({USER: [key[0]], "items": [items], "weights": [weights]})


def entries_of(stream: DataFrame) -> DataFrame:
    """user_id, items, weights: all entries so far of the users that a batch touches.

    Entries are keyed streaming state, so a batch reads the state of its own users only, and a restart finds it in the
    checkpoint.  Equal (user, item) rows are summed, rows without an id are left out, a null weight counts as zero.
    """
    own = stream.select(
        F.col(USER).cast("long").alias(USER), F.col(ITEM).cast("long").alias(ITEM), F.coalesce(F.col(WEIGHT).cast("double"), F.lit(0.0)).alias(WEIGHT)
    ).dropna(subset=[USER, ITEM])
    return own.groupBy(USER).applyInPandasWithState(remember, f"{USER} bigint, {ENTRIES}", ENTRIES, "update", GroupStateTimeout.NoTimeout)


class FoldIn:
    """Applies a stream of (user_id, item_id, weight) to a model.

    store: a Parquet folder of the factors that batches have refitted.  A batch writes under its id, so that one that is
    tried again replaces itself; the model shows each user's latest factors, also those of earlier runs.  A user's
    factors come from the entries that arrived by the stream: what came before it goes through the stream first.
    """

    def __init__(self, model: AlternatingLeastSquares, store: str):
        self.model, self.store = model, store
        self.base = model._fitted()[0]
        self.n = (self.base.agg(F.max("id")).first()[0] or 0) + 1
        path = self.base.sparkSession._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(self.base.sparkSession._jsc.hadoopConfiguration()).exists(path):
            self._show(self._stored().agg(F.max("id")).first()[0])

    def _stored(self) -> DataFrame:
        return self.base.sparkSession.read.schema("id bigint, features array<float>, batch bigint").parquet(self.store)

    def _show(self, largest: int | None) -> None:
        """Let the model's factors be those of the base with the latest refitted ones; read where they are used."""
        self.n = max(self.n, -1 if largest is None else largest + 1)
        latest = self._stored().groupBy("id").agg(F.max_by("features", "batch").alias("features"))
        both = self.base.join(latest.select("id"), "id", "left_anti").select("id", "features").unionByName(latest)
        self.model.user_factors = upsert_all(both, self.n, self.model.factors)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Refit the users of a batch of user_id, items, weights."""
        path = f"{self.store}/batch={batch_id}"
        # Kept, since each further reading would go through the state again.
        batch.persist()
        try:
            pairs = batch.select(USER, F.explode(F.arrays_zip("items", "weights")).alias("x"))
            # A user has each item once already.
            x = Interactions(pairs.select(USER, F.col("x.items").alias(ITEM), F.col("x.weights").alias(WEIGHT)))
            found = self.model.recalculate_users(x).select("id", F.col("features").cast("array<float>").alias("features"))
            found.write.mode("overwrite").parquet(path)
        finally:
            batch.unpersist()
        self._show(self.base.sparkSession.read.schema(found.schema).parquet(path).agg(F.max("id")).first()[0])

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a stream; trigger as in writeStream.trigger."""
        writer = entries_of(stream).writeStream.outputMode("update").foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
