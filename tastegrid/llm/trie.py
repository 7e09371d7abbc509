"""Conversation prefix trie, its subtrees summed by leaf peeling.

A node is a distinct sequence of first turns; the conversations that start with
it are its members.  Turns get their places by a range-partitioned sort, so a
conversation may span partitions; a node's key is the exclusive-or of the hashes
of (place, role, text) up to it, taken in chunks, so no conversation is
gathered either.

Subtree totals go up by messages: every node holds a counter of the children it
still waits for; a node whose counter is zero is complete and sends its totals
to its parent, until only the root finishes.  What hangs below a node of a
single member is one chain that saves nothing and ends in one leaf, so such
nodes are complete from the start, and the rounds are as many as the longest
prefix that two conversations share has turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import discard, stash

#: Turns whose running hash is taken in one group, and ids of one stretch that are joined into one text.
CHUNK, STRETCH = 4096, 8192
NODE = ["depth", "a", "b"]


def places(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role and text: the turns of each conversation in order of turn (null first), role and text.

    Rows are sorted in ranges, numbered within each range and moved on by what earlier ranges hold of their conversation.
    """
    own = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written down: ranges are drawn by sampling, so a second run might cut elsewhere.
    rows = stash(ranged.select("conv_id", "role", "text", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("i")), "turns")
    held = rows.groupBy("conv_id", "part").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    # A conversation has a row here for each range that it reaches into.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("i") + F.col("shift")).alias("place"), "role", "text")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def paths(placed: DataFrame) -> DataFrame:
    """conv_id, depth, a and b (the key of the node that the conversation passes at that depth), up_a and up_b (its parent's) and words (of the node's last text)."""
    hashed = placed.select(
        "conv_id",
        F.col("place").alias("depth"),
        # Two hashes of 64 bits of the same turn; the place is part of them, since exclusive-or forgets order.
        F.xxhash64("place", "role", "text").alias("h"),
        F.xxhash64(F.lit("second"), "text", "role", "place").alias("g"),
        words(F.col("text")).alias("words"),
        F.floor(F.col("place") / CHUNK).alias("chunk"),
    )
    rows = stash(hashed, "turn-hashes")
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "hg"])
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(before, ["conv_id", "chunk"]).withColumns({f"{c}1": F.bit_xor(c).over(upto) for c in "hg"})
    a, b = (F.col(f"{c}0").bitwiseXOR(F.col(f"{c}1")) for c in "hg")
    return running.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("h")).alias("up_a"), b.bitwiseXOR(F.col("g")).alias("up_b"), "words")


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node over the stretches of its ids, which come in order."""
    key, state, out = None, None, []
    for batch in batches:
        for *node, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(4).to_pylist()):
            if node == key:
                state.update(b"," + text.encode())
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(text.encode())
        if len(out) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])


def ends_digests(last: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 from the node at which each conversation ends (conv_id, depth, a, b).

    Ids are joined in stretches, which hold few since ids are distinct; a node's stretches then stream through one
    running hash, so its ids are never in memory together.
    """
    stretches = last.groupBy(*NODE, F.floor(F.col("conv_id") / STRETCH).alias("stretch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return stretches.repartition(*NODE).sortWithinPartitions(*NODE, "stretch").mapInArrow(_ends_digest, "depth bigint, a bigint, b bigint, ends_sha256 string")


def nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie's nodes, written to the shared folder: depth, a, b, up_a, up_b, conv_id, n_convs, words, n_children, ends_sha256."""
    path = stash(paths(places(turns)), "trie-paths")
    convs = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).where(F.col("conv_id").isNotNull()).distinct()
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("bigint").alias("up_a"), F.lit(None).cast("bigint").alias("up_b"), zero.alias("words"))
    every = path.unionByName(roots)
    found = stash(every.groupBy(*NODE, "up_a", "up_b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "trie-nodes")
    end = every.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    # What a node gets from its children and from the conversations that end at it meets it in one grouping.
    nothing = {"up_a": "bigint", "up_b": "bigint", "conv_id": "bigint", "n_convs": "bigint", "words": "bigint"}
    empty = [F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parts = [
        found.select(*NODE, *nothing, F.lit(0).cast("bigint").alias("n_children"), F.lit(None).cast("string").alias("ends_sha256")),
        children.select(*NODE, *empty, "n_children", F.lit(None).cast("string").alias("ends_sha256")),
        ends_digests(end).select(*NODE, *empty, F.lit(0).cast("bigint").alias("n_children"), "ends_sha256"),
    ]
    none = hashlib.sha256(b"").hexdigest()
    both = reduce(DataFrame.unionByName, parts).groupBy(*NODE).agg(*[F.max(c).alias(c) for c in nothing], F.sum("n_children").alias("n_children"), F.coalesce(F.max("ends_sha256"), F.lit(none)).alias("ends_sha256"))
    out = stash(both, "trie")
    discard(found)
    discard(path)
    return out


def peel(trie: DataFrame) -> DataFrame:
    """depth, a, b, n_leaves and saved_tokens of the nodes of several members, and of the root, by messages from children to parents."""
    shared = trie.where("n_convs > 1 or depth = 0")
    saves = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    waits = shared.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("waiting"))
    start = shared.join(waits, NODE, "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    # Children of a single member bring a leaf each; a node without children is one.
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_children") - F.col("waiting")).cast("bigint")
    state = stash(start.select(*NODE, "up_a", "up_b", "waiting", leaves.alias("n_leaves"), saves), "trie-state")
    complete = []
    while not state.isEmpty():
        done = state.where("waiting = 0")
        complete.append(done.select(*NODE, "n_leaves", "saved_tokens"))
        sent = done.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
        sent = sent.agg(F.count("*").alias("k"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
        heard = state.where("waiting > 0").join(sent, NODE, "left")
        state = stash(
            heard.select(
                *NODE,
                "up_a",
                "up_b",
                (F.col("waiting") - F.coalesce("k", F.lit(0))).alias("waiting"),
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"),
            ),
            "trie-state",
        )
    none = state.select(*NODE, "n_leaves", "saved_tokens")
    return reduce(DataFrame.unionByName, complete, none)


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text).

    conversations: conv_id of the conversations to count, those without turns too; by default those that have turns.
    Returns depth, a, b (the node's key), conv_id (its smallest member), parent_conv_id (its parent's; null for the
    root), n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members but
    one times the words of the last text: what a cache of prefixes saves) and ends_sha256 (of the ids, in order and
    joined by commas, of the conversations that end at it).

    A null role or text is empty; turns go by turn, null first, then role and text, so ties and repeated rows keep a
    fixed order and all stay; rows without a conv_id are left out; no conversations give no nodes; other columns are
    not read.  Equal sequences are told by 128 bits of hashes.
    """
    conversations = turns.select("conv_id") if conversations is None else conversations
    trie = nodes(turns, conversations)
    sums = peel(trie)
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    whole = trie.join(sums, NODE, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    return whole.select(
        *NODE,
        "conv_id",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
        "ends_sha256",
    )


def branched(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns with shared beginnings, and all conversation ids: each conversation c begins with the first h turns of c - c % group, h = crc32(c) % most, and goes on with its own after its first h.

    Turns that the other conversation does not have are not replaced.
    """
    placed = stash(places(turns), "placed")
    convs = placed.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = placed.where(F.col("place") > h).select("conv_id", F.col("place").alias("turn"), "role", "text")
    # A beginning goes to `group` conversations at most.
    heads = placed.where((F.col("place") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")).where("h > 0")
    lent = asked.join(heads, "base").where(F.col("place") <= F.col("h")).select("conv_id", F.col("place").alias("turn"), "role", "text")
    return own.unionByName(lent), convs


def digest(trie: DataFrame) -> DataFrame:
    """The columns of the query."""
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
