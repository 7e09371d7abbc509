"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item leaks into a document when at least `threshold` of the item's word
shingles occur in it.  Items are short and documents may be very long, so their
Jaccard similarity says little and the search is for containment.

Items are partitioned by their number of shingles.  An item's MinHash sketch
holds its k smallest shingle hashes, and k depends on the size partition: with n
the largest size of the partition, k = n - ceil(threshold * n) + 1.  By the
pigeonhole principle a document that contains enough of the item contains at
least one hash of its sketch, so probing documents' shingles for sketch hashes
finds every leak; candidates are then verified by exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import bounded_bytes, stash, text_of

WORDS, THRESHOLD = 5, 0.8
#: The item tables are broadcast only below this many shingles (of about 50 bytes each); beyond it the joins shuffle.
BROADCAST_SHINGLES = 400_000
#: Bytes of the suspected documents' keys up to which they are broadcast.
BROADCAST_SUSPECTS = 4 << 20


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    return F.filter(cut, lambda w: w != "")


def _shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of the runs of n words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)], F.lit(n)))


def item_shingles(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """Distinct shingles of each item: item_id, width, n_shingles, hash.

    An item of fewer words is one shingle of all of them; an item without words
    has none and is never found.  Items are told apart by id and text.
    """
    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words_of(text_of()).alias("w")).where(F.size("w") > 0).distinct()
    hashes = F.lit(None).cast("array<bigint>")
    for n in range(1, words + 1):
        hashes = F.when((F.size("w") == n) if n < words else (F.size("w") >= n), _shingle_hashes(F.col("w"), n)).otherwise(hashes)
    own = own.select(
        "item_id",
        F.xxhash64("w").alias("item_key"),
        F.least(F.size("w"), F.lit(words)).alias("width"),
        F.array_distinct(hashes).alias("h"),
    )
    # explode_outer: for explode, the optimiser would infer a filter on the array's size and put the cutting of words into its inner function.
    out = own.select("item_id", "item_key", "width", F.size("h").alias("n_shingles"), F.explode_outer("h").alias("hash"))
    return out.where(F.col("hash").isNotNull())


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The MinHash sketches: item_id, item_key, hash.

    Size partition p holds items of 2^p to 2^(p+1) - 1 shingles; each takes the
    sketch size that its partition's largest item needs, or all its hashes.
    """
    from pyspark.sql import Window

    largest = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1
    k = largest - F.ceil(largest * threshold) + 1
    rank = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy("hash"))
    return items.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "item_key", "hash")


def _document_hashes(docs: DataFrame, widths: list[int]) -> DataFrame:
    """Distinct shingle hashes of each document row: doc_id, doc_key, hash."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("doc_key"), words_of(F.col("text")).alias("w"))
    every = F.concat(*[_shingle_hashes(F.col("w"), n) for n in widths])
    return own.select("doc_id", "doc_key", F.explode_outer(every).alias("hash")).where(F.col("hash").isNotNull())


def contained(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id) in which a document contains an item.

    Returns doc_id, item_id, shared (the item's shingles found), n_shingles (all
    it has) and containment = shared / n_shingles >= threshold.  Documents are
    told apart by id and text, items likewise; repeated rows count once.  Null
    texts have no shingles.  A null id stays null.  Empty tables give no pairs.
    Other columns are not read.
    """
    items = item_shingles(benchmark, words)
    # At most `words` numbers, whatever the size of the benchmark.
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    if not widths:
        return docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.lit(None).cast("bigint").alias("item_id"),
            F.lit(0).cast("bigint").alias("shared"),
            F.lit(0).cast("bigint").alias("n_shingles"),
            F.lit(0.0).alias("containment"),
        ).where(F.lit(False))
    small = bounded_bytes(items, F.lit(1), BROADCAST_SHINGLES)
    hint = F.broadcast if small else (lambda x: x)
    # Probe: which documents hold a hash of which item's sketch.
    probes = _document_hashes(docs, widths).join(hint(sketches(items, threshold)), "hash")
    keys = ["doc_id", "doc_key", "item_id", "item_key"]
    candidates = stash(probes.select(*keys).distinct(), "decontam-candidates")
    # Verify: all shingles of the candidates' documents against all shingles of their items.
    suspects = candidates.select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    if bounded_bytes(suspects, F.lit(16), BROADCAST_SUSPECTS):
        suspects = F.broadcast(suspects)
    keyed = docs.select("doc_id", "text").withColumn("__own", F.xxhash64(text_of()))
    suspected = keyed.join(suspects, (F.col("__own") == F.col("__key")) & keyed["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    found = (
        _document_hashes(suspected, widths)
        .join(hint(items), "hash")
        .groupBy(*keys)
        .agg(F.count_distinct("hash").alias("shared"), F.max("n_shingles").cast("bigint").alias("n_shingles"))
    )
    a, b = found.alias("a"), candidates.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return (
        a.join(b, same, "left_semi")
        .withColumn("containment", F.col("shared") / F.col("n_shingles"))
        .where(F.col("shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
        .select("doc_id", "item_id", "shared", "n_shingles", "containment")
        .distinct()
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that contain an item; all columns stay, and so do rows with a null doc_id."""
    leaks = contained(docs, benchmark, words, threshold).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__leak")).distinct()
    if bounded_bytes(leaks, F.lit(8), 8 << 20):
        leaks = F.broadcast(leaks)
    return docs.join(leaks, docs["doc_id"] == leaks["__leak"], "left_anti")
