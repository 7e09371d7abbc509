"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at RADIUS or fewer differing bits.  The bits are
cut into m parts, correlated bits together, and part i gets its own threshold
t_i >= -1 with sum(t_i) = RADIUS - m + 1: two linked fingerprints must differ in
at most t_i bits of some part i.  A dynamic programme allocates the thresholds
(and picks m) by the estimated number of candidates and probes, from counts over
all fingerprints.  Each fingerprint probes its parts' neighbours within t_i bits,
and what it meets is verified on all 64 bits; only links come out of that join.
Components of the links are found by alternating star contractions.

All of this works on distinct fingerprints, so groups of copies, however large,
are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import bounded_bytes, slices, stash, text_of

RADIUS, WORDS, BITS, SEED = 3, 3, 64, 42
#: Relative costs of a candidate pair and of a probe.
PAIR_COST, PROBE_COST = 1.0, 1.5
MOST_PARTS, MOST_THRESHOLD = 6, 2


def fingerprint(text: str, words: int = WORDS) -> int:
    """The fingerprint of one text, as a signed 64-bit number; 0 without words."""
    import xxhash

    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(shingles)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(s, SEED) for s in shingles[at : at + (1 << 16)]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = [fingerprint(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(run, "doc_id bigint, fp bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how many have bits i and j both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += (x.T @ x).astype(np.int64)
            n += len(h)
        cells = np.arange(BITS * BITS + 1)
        values = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(values, pa.int64())], ["cell", "n"])

    # 4,097 sums, whatever the input.
    rows = fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def correlated_parts(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size, each grown by the bit that correlates most with it."""
    left, parts = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, parts))) // (m - i)
        seed = max(sorted(left), key=lambda b: correlation[b, sorted(left)].sum())
        part = [seed]
        left.discard(seed)
        while len(part) < size:
            best = max(sorted(left), key=lambda b: correlation[b, part].sum())
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts of the bits with their thresholds, parts that are not probed left out.

    The estimate of the pairs that differ in at most t bits of a part takes each
    bit's chance of differing, and counts correlated bits as fewer.
    """
    share = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    correlation = np.abs((both / max(1, n) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    correlation = np.clip(correlation, 0, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, MOST_PARTS + 1):
        parts = correlated_parts(correlation, m)
        costs = []
        for part in parts:
            chance = np.zeros(len(part) + 1)
            chance[0] = 1
            for b in part:
                p = 2 * share[b] * (1 - share[b])
                chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
                chance[0] *= 1 - p
            inner = correlation[np.ix_(part, part)]
            free = len(part) / (1 + (inner**2).sum() / len(part)) / len(part)
            cost = {-1: 0.0}
            for t in range(min(MOST_THRESHOLD, radius, len(part)) + 1):
                pairs = n * n / 2 * min(1.0, chance[: t + 1].sum()) ** free
                cost[t] = pairs * PAIR_COST + n * sum(math.comb(len(part), k) for k in range(t + 1)) * PROBE_COST
            costs.append(cost)
        # least[s]: the least cost of the parts so far with thresholds that sum to s.
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in least.items():
                for t, x in cost.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, [*chosen, t])
            least = step
        if (goal := radius - m + 1) in least and least[goal][0] < best[0]:
            best = (least[goal][0], [(p, t) for p, t in zip(parts, least[goal][1]) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """Distinct pairs a < b of distinct fingerprints at most `radius` bits apart."""
    masks = [_signed(sum(1 << b for b in part)) for part, _ in plan]

    def key(fp: Column, k: int) -> Column:
        return fp.bitwiseAND(F.lit(masks[k]).cast("bigint"))

    def cell(k: int, value: Column) -> Column:
        return F.struct(F.lit(k).alias("part"), value.alias("key"))

    index = F.array(*[cell(k, key(F.col("fp"), k)) for k in range(len(plan))])
    probes = []
    for k, (part, t) in enumerate(plan):
        flips = [_signed(sum(1 << b for b in x)) for r in range(t + 1) for x in combinations(part, r)]
        own = F.array(*[F.lit(x).cast("bigint") for x in flips])
        probes.append(F.transform(own, lambda x: cell(k, key(F.col("fp"), k).bitwiseXOR(x))))
    a = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("c")).select("a", "c.part", "c.key")
    b = fps.select(F.col("fp").alias("b"), F.explode(index).alias("c")).select("b", "c.part", "c.key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    same = (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key"))
    return a.alias("x").join(b.alias("y"), same & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the component's least node, for all nodes of edges (a, b).

    Alternating star contractions: each round hangs larger neighbours on the
    least, then smaller ones; rounds grow with the logarithm of a component's
    length.  Every round is written to the shared folder.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stash(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every document with its fingerprint and component.

    Returns doc_id, fp, root (a fingerprint that names the component),
    component_id (the smallest doc_id of the component) and links (other texts'
    fingerprints within the radius).

    A null text counts as empty: fingerprint zero, linked like any other.  A null
    doc_id never names a component unless all its ids are null; repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    """
    own = stash(fingerprints(docs), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    n, both = bit_statistics(fps)
    pairs = stash(links(fps, allocate(n, both, radius), radius), "links") if n > 1 else None
    if pairs is None:
        return own.join(fps, "fp").select("doc_id", "fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), F.lit(0).cast("bigint").alias("links"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    member = components(pairs).join(degree, "node").join(fps, F.col("node") == F.col("fp")).select("node", "root", "links", "least")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id", "links")
    classes = fps.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )
    return own.join(classes, "fp").select("doc_id", "fp", "root", "component_id", "links")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def _marked(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint)


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that of the smallest doc_id; all columns stay.

    Of rows that repeat that doc_id one stays, and so does one of a component
    whose ids are all null.
    """
    found = stash(near_duplicates(docs, radius), "near-duplicates")
    usual = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("c"))
    gone = usual.where((F.col("n") > 1) | (F.col("c") != F.col("doc_id"))).select(F.col("doc_id").alias("__gone"))
    if bounded_bytes(gone, F.lit(8), 4 << 20):
        gone = F.broadcast(gone)
    kept = docs.where(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # Rows whose id does not tell them apart: nulls and repeated ids.
    odd_ids = usual.where("n > 1").select(F.col("doc_id").alias("__odd"))
    if found.where(F.col("doc_id").isNull()).isEmpty() and odd_ids.isEmpty():
        return kept
    odd = docs.join(odd_ids, F.col("doc_id") == F.col("__odd"), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    roots = found.select("fp", "root", "component_id").distinct()
    mark = F.pandas_udf(_marked, "bigint")
    first = Window.partitionBy("__root").orderBy(F.col("__text"))
    tagged = odd.withColumn("__text", text_of()).withColumn("__fp", mark(F.col("__text")))
    tagged = tagged.join(roots.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__c")), "__fp")
    chosen = tagged.where(F.col("doc_id").eqNullSafe(F.col("__c"))).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.unionByName(chosen.select(*docs.columns))
