"""Factors in half precision: packed 16-bit rows, searched as such and ranked again in full precision.

A row holds its components divided by their greatest magnitude, so none overflows,
and how far the packed vector is from the full one; a product is then off by no
more than that times the query's length.  A search takes every item that these
bounds leave a chance, so what is ranked again holds the exact best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.operators import factors as fx
from tastegrid.operators.topk import BLOCK_ROWS, only, score_pairs, without

HALF = "id bigint, half binary, scale float, off float"


def pack(factors: DataFrame) -> DataFrame:
    """id, half (components of 16 bits), scale and off (the greatest distance from the full vector) of factors (id, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
            scale = np.abs(x).max(axis=1, initial=0).astype(np.float32)
            scale[scale == 0] = 1
            h = (x / scale[:, None]).astype(np.float16)
            off = np.linalg.norm(x - h.astype(np.float64) * scale[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in h], pa.binary()), pa.array(scale), pa.array(np.nextafter(off.astype(np.float32), np.float32(np.inf)))], ["id", "half", "scale", "off"])

    return factors.select(F.col("id").cast("long"), F.col("features").cast("array<float>")).mapInArrow(run, HALF)


def unpack(packed: DataFrame) -> DataFrame:
    """id and features, as far as 16 bits hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float16).reshape(n, -1) if n else np.zeros((0, 1))
            yield fx.factor_batch(batch.column(0).to_numpy(), h.astype(np.float32) * batch.column(2).to_numpy()[:, None])

    return packed.select("id", "half", "scale").mapInArrow(run, fx.FACTORS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            ids, half, scale, off = (c for c in batch.slice(at, BLOCK_ROWS).columns)
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(ids.to_numpy()).tobytes()]), pa.array([b"".join(half.to_pylist())]), pa.array([scale.to_numpy().tobytes()]), pa.array([off.to_numpy().tobytes()])], ["ids", "half", "scale", "off"])


BLOCK = "ids binary, half binary, scale binary, off binary"


#: Queries that meet a block of items at once.
QUERY_ROWS = 1024
ASKED = "q_ids binary, q_data binary, q_more binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (query_id, features, more) in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_ROWS):
            ids, features, more = batch.slice(at, QUERY_ROWS).columns
            x = np.asarray(features.flatten().to_numpy(zero_copy_only=False), np.float64)
            columns = [np.asarray(ids.to_numpy()), x, np.asarray(more.to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in columns], ["q_ids", "q_data", "q_more"])


def _chances(k: int, margin: float) -> Callable:
    """Rows (a block of queries, a block of items): the items of the block that may be among a query's k + more best, sums that differ by up to margin counting as equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                # One pair of blocks at a time is taken out of the batch.
                r = {name: column[at].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                ids, asked, more = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids", "q_more"))
                x = np.frombuffer(r["q_data"], np.float64).reshape(len(asked), -1)
                scale, off = (np.frombuffer(r[c], np.float32).astype(np.float64) for c in ("scale", "off"))
                y = np.frombuffer(r["half"], np.float16).reshape(len(ids), -1).astype(np.float64) * scale[:, None]
                for s in range(0, len(asked), 128):
                    own = x[s : s + 128]
                    score, slack = own @ y.T, np.linalg.norm(own, axis=1)[:, None] * off + 1e-9
                    n, low = np.minimum(k + more[s : s + 128], len(ids)), score - slack
                    # Places of all the counts asked for are found by one partition.
                    cut = np.partition(low, np.unique(len(ids) - n), axis=1)[np.arange(len(own)), len(ids) - n]
                    q, c = np.nonzero(score + slack >= cut[:, None] - margin)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[s + q]), pa.array(ids[c])], ["query_id", "id"])

    return run


def score_top_half(queries: DataFrame, packed: DataFrame, items: DataFrame, k: int, liked: DataFrame | None = None, allow: DataFrame | None = None, deny: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The k best items of each query by inner product, as score_top gives them: query_id, rank, id, score.

    packed: the items as `pack` gives them, which are what is sent to the queries, in blocks; items (id, features): the
    full vectors, of which only those with a chance are joined.
    """
    packed = without(only(packed, "id", allow), "id", deny)
    asked = queries.select(F.col("id").cast("long").alias("query_id"), "features").dropDuplicates(["query_id"])
    more = F.lit(0).cast("bigint")
    if liked is not None:
        asked = asked.join(liked.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left")
        more = F.coalesce("more", F.lit(0))
    blocks = packed.select("id", "half", "scale", "off").mapInArrow(_blocks, BLOCK)
    size = packed.agg(F.sum(F.octet_length("half") + 16)).first()[0] or 0
    if size > fx.BROADCAST_BYTES:
        raise ValueError("the packed items are too large to be broadcast; score_top takes them by a shuffle")
    sent = asked.select("query_id", F.col("features").cast("array<double>").alias("features"), more.alias("more")).mapInArrow(_asked, ASKED)
    pairs = sent.crossJoin(F.broadcast(blocks)).mapInArrow(_chances(k, 0.0 if digits is None else 10.0**-digits), "query_id bigint, id bigint")
    if liked is not None:
        pairs = pairs.join(liked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return score_pairs(queries, items, pairs, k, digits)
