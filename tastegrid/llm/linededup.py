"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded with their positions, normalised and hashed; documents are
counted for each hash; what is over the threshold goes, but for the largest id
that holds it; texts are reassembled by position.  Texts cross a shuffle once,
to meet the positions of the lines they lose; lines themselves never do, only
their 16-byte hashes, and those only once counted within a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import bounded_bytes, discard, stash, text_of

LEAST_CHARS, LEAST_DOCS = 40, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of repeated hashes up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint while it is small, a row of it being under 64 bytes."""
    return F.broadcast(df) if bounded_bytes(df, F.lit(64), BROADCAST_BYTES) else df


def _versions(docs: DataFrame) -> DataFrame:
    """doc_id, text and its MD5, taken before a text becomes lines, so once for each text."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return own.withColumn("version", F.md5(F.col("text").cast("binary")))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Lines to drop: doc_id, version (the MD5 of the text, so that rows that share an id keep apart) and dropped (positions from 0).

    docs: doc_id, text.  A document is a doc_id, whatever its number of rows: rows
    that share an id count as one holder, and a line of any of them stays where that
    id is the largest holder.  Rows without an id count as one document, less than
    all others.
    """
    lines = _versions(docs).select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    # The length of a key is known before any letter of it is changed.
    long = lines.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= least_chars)
    hashed = long.select("doc_id", "version", "at", F.unhex(F.md5(line_key(F.col("line")).cast("binary"))).alias("hash"))
    # Rows are at least as many as documents: most hashes go here, added up within tasks before they are dealt.
    often = stash(hashed.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("hash"), "lines-often")
    hits = stash(hashed.join(_small(often), "hash"), "lines-hits")
    discard(often)
    holders = hits.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    shared = stash(holders.where(F.col("n") >= least_docs).select("hash", "keeper"), "lines-shared")
    lost = hits.join(_small(shared), "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # A set, since equal rows of a document lose the same positions.
    return lost.groupBy("doc_id", "version").agg(F.collect_set("at").alias("dropped"))


def _kept(text: Column, dropped: Column) -> Column:
    """The text without the lines at `dropped`.  The places that stay are found by hashing and read one by one, so the work is linear in the lines."""
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    # The text is split outside the lambda that reads its lines, so once.
    both = F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), lambda x: F.transform(x["places"], lambda i: F.get(x["lines"], i)))
    return F.when(F.size(dropped) == 0, text).otherwise(F.array_join(F.element_at(both, 1), "\n"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All documents without the lines that at least `least_docs` of them share, but for one.

    docs: doc_id, text.  Returns doc_id, text (of the lines that stay, joined by
    newlines), n_lines (before), n_dropped.  A line is dropped where its key, of
    `least_chars` code points or more, occurs in that many documents and a larger
    doc_id holds it too; within its keeper all its repetitions stay.

    A null text is empty; an empty text is one empty line; a text that loses all
    its lines is empty.  Every row gives a row, repeated ones too; rows without an
    id count as one document.  An empty table gives no rows; other columns are not
    read.
    """
    lost = repeated_lines(docs, least_chars, least_docs)
    own = _versions(docs)
    lost = lost.withColumnsRenamed({"doc_id": "lost_id", "version": "lost_version"})
    both = own.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("version") == F.col("lost_version")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return both.select(
        "doc_id",
        _kept(F.col("text"), dropped).alias("text"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
    )


def digest(kept: DataFrame) -> DataFrame:
    """The columns of the query: a digest in place of the text."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
