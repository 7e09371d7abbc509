"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens with positions.  Each distinct pre-token is
encoded once, its ids are joined back and the texts are reassembled by
position; decoding joins the ids with the token-byte table, whose size the
vocabulary bounds.

To keep the shuffles small, documents are packed into blocks of bounded size.
A block sends its distinct pre-tokens, not every occurrence, to the buckets that
encode them (a frequent word crosses once for each block, so no word is hot),
and its positions travel as a compressed sequence of local word numbers.  Both
meet again by block.  The two branches scan the texts separately and name a
block by its content, so docs must be a stable read, such as a table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import shuffle_partitions, slices, text_of

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Distinct pre-tokens of a bucket that its task remembers; beyond them some are encoded again.
MEMO = 500_000
MOST_BUCKETS = 1024
#: Documents of a block that leave its task together.
OUT_ROWS = 256


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, where each token starts, how long it is."""
    with open(ranks_path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    size = max(i for i, _ in pairs) + 1
    table = [b""] * size
    for i, piece in pairs:
        table[i] = piece
    lengths = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of all the given runs, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def join_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Join ids with the token-byte table and put the bytes together by position."""
    all_bytes, starts, lengths = table
    return all_bytes[_spread(starts[ids], lengths[ids])].tobytes()


def _pack(values: np.ndarray, planes: int) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    import zstandard

    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(data: bytes, planes: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u4").ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids and texts, a few as Python objects at a time."""
    for batch in batches:
        for part in slices(batch, 256):
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list, list[str]]]:
    """(name, doc_ids, texts) of blocks of at most BLOCK_BYTES, or of one text."""

    def name(ids: list, texts: list[str]) -> bytes:
        h = xxhash.xxh3_128()
        for i, t in zip(ids, texts):
            h.update(f"{i}:{len(t)}:")
            h.update(t.encode("utf-8"))
        return h.digest()

    ids, texts, size = [], [], 0
    for i, t in _rows(batches):
        n = len(t) if t.isascii() else len(t.encode("utf-8"))
        if texts and size + n > BLOCK_BYTES:
            yield name(ids, texts), ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if texts:
        yield name(ids, texts), ids, texts


def _order(words: dict, buckets: int) -> list[list[str]]:
    """A block's distinct words by bucket, in the order in which they first come: frequent words come early."""
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in words:
        out[zlib.crc32(w.encode("utf-8")) % buckets].append(w)
    return out


def _words_of(pattern: str, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        cut = _compiled(pattern).findall
        for name, _, texts in _blocks(batches):
            words: dict[str, None] = {}
            for t in texts:
                words.update(dict.fromkeys(cut(t)))
            squeeze = zstandard.ZstdCompressor(level=3)
            rows = [(b, w) for b, w in enumerate(_order(words, buckets)) if w]
            encoded = [[x.encode("utf-8") for x in w] for _, w in rows]
            packed = [
                squeeze.compress(np.array([len(x) for x in w], "<u4").tobytes() + b"".join(w)) for w in encoded
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in rows], pa.int32()),
                    pa.array([name] * len(rows), pa.binary()),
                    pa.array([len(w) for _, w in rows], pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                ["bucket", "block", "n", "words"],
            )

    return run


def _positions_of(pattern: str, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _compiled(pattern).findall
        for name, ids, texts in _blocks(batches):
            # Words are numbered as they come, so that no list of all words is held; then as they will come back.
            seen: dict[str, int] = {}
            parts = []
            for t in texts:
                parts.append(np.array([seen.setdefault(w, len(seen)) for w in cut(t)], np.uint32))
            raw = np.concatenate(parts)
            lengths = [len(x) for x in parts]
            del parts
            renumbered = np.empty(len(seen), np.uint32)
            # Numbers run across the buckets, so that frequent words get small ones.
            for b, own in enumerate(_order(seen, buckets)):
                for k, w in enumerate(own):
                    renumbered[seen[w]] = k * buckets + b
            flat = renumbered[raw] if len(raw) else raw
            planes = 4 if len(flat) and int(flat.max()) >= 1 << 24 else 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.binary()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([planes], pa.int32()),
                    pa.array([_pack(flat, planes)], pa.binary()),
                ],
                ["block", "doc_ids", "lengths", "planes", "positions"],
            )

    return run


def _encode_of(ranks_path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        piece = encoder(ranks_path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        bucket = None
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for own, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "words"))):
                if own != bucket or len(known) >= MEMO:
                    known.clear()
                    bucket = own
                raw = open_(data)
                at, ids = 4 * n, []
                for k in np.frombuffer(raw, "<u4", n).tolist():
                    w = raw[at : at + k]
                    at += k
                    got = known.get(w)
                    if got is None:
                        x = piece(w)
                        got = known[w] = struct.pack(f"<{len(x)}I", *x)
                    ids.append(got)
                both = np.concatenate([np.array([len(x) >> 2 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4")])
                planes = 2 if both.max() < 1 << 16 else 4
                out.append(bytes([planes]) + _pack(both, planes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), batch.column("n"), pa.array(out, pa.binary())],
                ["block", "bucket", "n", "ids"],
            )

    return run


def _assemble_of(ranks_path: str, buckets: int, keep_ids: bool) -> Callable:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def documents(starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, row: dict) -> Iterator[pa.RecordBatch]:
        """A block's documents from where each word's ids start, how many there are, and the positions."""
        table = token_bytes(ranks_path)
        numbers = _unpack(row["data"], row["n"])
        at = 0
        for first in range(0, len(row["doc_ids"]), OUT_ROWS):
            keys = row["doc_ids"][first : first + OUT_ROWS]
            out, n_tokens, shas, decoded = [], [], [], []
            for n in row["lengths"][first : first + OUT_ROWS]:
                w = numbers[at : at + n]
                at += n
                if n and (int(w.max()) >= len(starts) or (starts[w] < 0).any()):
                    raise ValueError("a block came back without some of its words: docs gave other rows when they were read again")
                own = ids[_spread(starts[w], counts[w])]
                n_tokens.append(len(own))
                shas.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(join_bytes(own, table)).hexdigest())
                if keep_ids:
                    out.append(own.astype(np.int32))
            columns = [pa.array(keys, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(shas), pa.array(decoded)]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out))))
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, known = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] != block:
                    block, words, known = row["block"], [], None
                if row["bucket"] >= 0:
                    words.append((row["bucket"], row["n"], _unpack(row["data"][1:], row["data"][0])))
                    continue
                if known is None:
                    # For word number k * buckets + bucket: where its ids start and how many there are.
                    most = max((n for _, n, _ in words), default=0)
                    starts, counts = np.full(most * buckets, -1, np.int64), np.zeros(most * buckets, np.int64)
                    size = 0
                    for bucket, n, both in words:
                        own = both[:n].astype(np.int64)
                        at = np.arange(n) * buckets + bucket
                        counts[at], starts[at] = own, size + np.cumsum(own) - own
                        size += int(own.sum())
                    ids = np.concatenate([both[n:] for _, n, both in words]) if words else np.zeros(0, np.uint32)
                    known, words = (starts, counts, ids), []
                yield from documents(*known, row)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes) and, with
    keep_ids=True, ids.  Each match of `pattern` is encoded separately, without
    special tokens, by the ranks in the tiktoken file at `ranks_path`.

    A null text counts as empty and has no tokens.  A null doc_id stays null;
    repeated rows give repeated results; an empty table gives none; other columns
    are not read.
    """
    buckets = max(8, min(MOST_BUCKETS, shuffle_partitions(docs.sparkSession)))
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of().alias("text"))
    words = own.mapInArrow(_words_of(pattern, buckets), "bucket int, block binary, n int, words binary")
    encoded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_of(ranks_path, pattern), "block binary, bucket int, n int, ids binary")
    positions = own.mapInArrow(
        _positions_of(pattern, buckets),
        "block binary, doc_ids array<bigint>, lengths array<int>, planes int, positions binary",
    )
    # A block's words come before its positions, which have bucket -1.
    both = encoded.select(
        "block", "bucket", "n", F.col("ids").alias("data"), F.lit(None).cast("array<bigint>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("lengths")
    ).unionByName(positions.select("block", F.lit(-1).alias("bucket"), F.col("planes").alias("n"), F.col("positions").alias("data"), "doc_ids", "lengths"))
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    together = both.repartition("block").sortWithinPartitions("block", F.col("bucket").desc())
    return together.mapInArrow(_assemble_of(ranks_path, buckets, keep_ids), kind)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Decode an ids column by the token-byte table: doc_id, decoded (binary).

    Null ids count as none; an id outside the table raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            out = [join_bytes(np.array(x or [], np.int64), table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select(tokens["doc_id"].cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, decoded binary")
