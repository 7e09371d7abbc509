"""Vector code compression: product codes by Lloyd's rounds with Hamerly's bounds.

Vectors become integers and are cut into equal parts; each part position has a
codebook.  The state of a round is a table: for each part its entry, an upper
bound of the distance to it and one lower bound of the distance to the second
nearest.  When the entries have moved, the bounds are moved along; a part whose
upper bound stays strictly below its lower one keeps its entry, all others are
scanned in integers, ties to the lower index, so the result is that of full
scans.  A round is a pass over the partitions and one small sum; no vector is
shuffled, and the driver sees the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import bounded_bytes, discard, slices, stash

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Largest magnitude of a scaled component: squared distances of 64 dimensions then fit 64 bits.
LARGEST = 1 << 27
#: Bytes of labels up to which their sums are broadcast.
BROADCAST_BYTES = 8 << 20
KEPT = "vec_id bigint, x array<bigint>, label string"


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, x (the floors of the scaled components) and label, as text, of the vectors that can be coded.

    vectors: vec_id, embedding, label.  Vectors that are null, or hold null or
    non-finite components, are left out, and so are those of no components.  All
    others must be of one length, a multiple of parts, and below LARGEST when
    scaled; else a ValueError says so.
    """
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    own = own.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    least, most, value = own.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(largest)).first()
    if least is not None:
        if least != most or most % parts:
            raise ValueError(f"vectors of {least} to {most} components cannot be cut into {parts} equal parts")
        if value * scale >= LARGEST:
            raise ValueError(f"a component of {value} is too large to be coded exactly")
    return own.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"), "label")


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x width: the parts of the vectors of the smallest ids, null ids last, equal ids by their components."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # at most `entries` vectors
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    x = np.array([r["x"] for r in rows], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * big * big < 1 << 53:
        # Whole numbers that floats hold exactly.
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    return ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)


def _up(x: np.ndarray) -> np.ndarray:
    """Floats of 32 bits that are not below x."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index; an upper bound of its distance and a lower one of the second nearest's."""
    d = _squares(x, entries)
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    first = d[rows, code]
    if d.shape[1] > 1:
        d[rows, code] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64))
    else:
        second = np.full(len(x), np.inf)
    return code, _up(np.sqrt(first.astype(np.float64))), _down(second)


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry has moved, and how far any other entry at its position has, both at least."""
    own = np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64))
    others = np.zeros_like(own)
    if own.shape[1] > 1:
        order = np.argsort(-own, axis=1)
        most, next_ = (np.take_along_axis(own, order[:, [k]], 1) for k in (0, 1))
        others = np.where(np.arange(own.shape[1])[None] == order[:, [0]], next_, most)
    return _up(own), _up(others)


def rescan(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The scan of rows whose codes and bounds are from before the entries moved; also which rows were scanned in full."""
    code = code.astype(np.int64)
    upper = _up(upper.astype(np.float64) + own[code])
    lower = _down(lower.astype(np.float64) - others[code])
    loose = np.flatnonzero(~(upper < lower))
    # The exact distance to the own entry often settles it.
    near = ((x[loose] - entries[code[loose]]) ** 2).sum(axis=1)
    upper[loose] = _up(np.sqrt(near.astype(np.float64)))
    full = ~(upper < lower)
    if full.any():
        code[full], upper[full], lower[full] = scan(x[full], entries)
    return code, upper, lower, full


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


STATE = f"{KEPT}, code array<int>, upper array<float>, lower array<float>, scanned int"
NAMES = ["vec_id", "x", "label", "code", "upper", "lower", "scanned"]


def assign(rows: DataFrame, entries: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """rows with the code of each part and its bounds, and how many of its parts were scanned in full.

    before: the codebooks that the codes and bounds in rows belong to; None where rows have none yet.
    """
    moved = None if before is None else moves(before, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, rows=4096)):
            n = batch.num_rows
            x = _matrix(batch.column(1), n, np.int64).reshape(n, len(entries), -1)
            code, upper, lower = np.empty((n, len(entries)), np.int32), np.empty((n, len(entries)), np.float32), np.empty((n, len(entries)), np.float32)
            scanned = np.full(n, len(entries), np.int32)
            if moved is not None:
                known, u, low = (_matrix(batch.column(c), n, t) for c, t in ((3, np.int64), (4, np.float32), (5, np.float32)))
                scanned[:] = 0
            for p, book in enumerate(entries):
                part = np.ascontiguousarray(x[:, p])
                if moved is None:
                    code[:, p], upper[:, p], lower[:, p] = scan(part, book)
                else:
                    code[:, p], upper[:, p], lower[:, p], full = rescan(part, book, known[:, p], u[:, p], low[:, p], moved[0][p], moved[1][p])
                    scanned += full
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(code), _lists(upper), _lists(lower), pa.array(scanned)], NAMES)

    return rows.mapInArrow(run, STATE)


def means(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of its parts; unused entries stay.  Sums are added up within tasks first."""
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if n:
                x, code = _matrix(batch.column(0), n, np.int64).reshape(n, parts, width), _matrix(batch.column(1), n, np.int64)
                for p in range(parts):
                    np.add.at(total[p, :, :width], code[:, p], x[:, p])
                    total[p, :, width] += np.bincount(code[:, p], minlength=k)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel()[cells])], ["cell", "value"])

    # parts * entries * (width + 1) sums at most, whatever the number of vectors.
    rows = state.select("x", "code").mapInArrow(run, "cell bigint, value bigint").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(parts * k * (width + 1), np.int64)
    total[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    total = total.reshape(parts, k, width + 1)
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), entries)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The last round's state, which is written to the shared folder, and the codebooks.

    kept: as integers() gives it.  The state holds vec_id, x, label, code, upper and lower (an item for each part) and
    scanned, the parts that its last round scanned in full.
    """
    books = first_codebooks(kept, parts, entries)
    if not books.shape[1]:
        return kept.sparkSession.createDataFrame([], STATE), books
    state = stash(assign(kept, books), "codes")
    for _ in range(rounds):
        before, books = books, means(state, books)
        # The state before is read once more, by the pass that writes this one.
        old, state = state, stash(assign(state, books, before), "codes")
        discard(old)
    return state, books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Product codes of vectors (vec_id, embedding, label), and the codebooks (parts x entries x width).

    Returns vec_id, label (as text), codes (an entry's index for each part) and error, the squared distances summed
    over parts.  Codebooks start as the parts of the vectors of the smallest ids (null ids last, equal ids by their
    components; fewer vectors than entries: as many); each round assigns all parts and moves each entry to the floor
    of its parts' mean; unused entries stay; at the end parts are assigned again.

    Vectors that are null, empty, or hold null or non-finite components are left out; repeated rows and ids all stay
    and count; an empty table gives no rows and empty codebooks; other columns are not read.  Lengths that differ or
    cannot be cut into parts, and components that are too large for exact sums, raise ValueError.
    """
    state, books = fit(integers(vectors, scale, parts), parts, entries, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, rows=4096)):
            n = batch.num_rows
            x, code = _matrix(batch.column(1), n, np.int64).reshape(n, len(books), -1), _matrix(batch.column(3), n, np.int64)
            error = sum(((x[:, p] - book[code[:, p]]) ** 2).sum(axis=1) for p, book in enumerate(books))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return state.mapInArrow(run, "vec_id bigint, label string, codes array<int>, error bigint"), books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the embedding that its codes stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code = _matrix(batch.column(1), n, np.int64).reshape(n, len(books))
            x = np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x.astype(np.float32))], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id bigint, embedding array<float>")


def digest(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The columns of the query: codes in hexadecimal digits, errors by label, and a digest of the codebooks."""
    sums = coded.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"))
    if bounded_bytes(sums, F.coalesce(F.octet_length("same_label"), F.lit(0)) + 32, BROADCAST_BYTES):
        sums = F.broadcast(sums)
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same_label")), "left")
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(said).alias("codebooks_sha256"))
