"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.sources.checkpoints import discard, shared_dir, stash

__all__ = [
    "bounded_bytes", "bound", "cutter", "discard", "documents", "shared_dir", "shuffle_partitions", "slices", "stash", "table", "text_of",
]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_bytes(df: DataFrame, size: Column, limit: int) -> bool:
    """Whether df holds at most `limit` bytes; the check that a broadcast needs."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return total <= limit


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most `rows` rows and, but for single rows, about `size` bytes, so that few texts are Python objects at a time."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > size:
            n = (n + 1) // 2
        yield batch.slice(at, n)
        at += n


#: Code points of a text's pieces from which parts are cut.
PIECE = 256


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value bound to a name, so that it is worked out once and not for each use."""
    return F.get(F.transform(F.array(value), then), 0)


def cutter(text: Column) -> tuple[Column, Callable[[Column, Column, Column], Column]]:
    """A text's pieces, and a function of (bound pieces, start, end) that gives that part of the text in code points.

    A substring is looked for from the text's beginning; from a piece on it costs its own length and at most two pieces.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        begin = F.get(pieces, first)
        inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        long = F.concat(begin.substr(start - first * PIECE + 1, F.lit(PIECE)), inner, F.get(pieces, last).substr(F.lit(1), end - last * PIECE))
        return F.when(end <= start, "").when(first == last, begin.substr(start - first * PIECE + 1, end - start)).otherwise(long)

    return pieces, cut
