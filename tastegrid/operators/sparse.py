"""The best of each row of a sparse product, by blocks of rows.

The product is given as outer products: a row (m, a, v, b, w) adds v[i] * w[j] to the
cell (a[i], b[j]) for all i and j.  Result rows are cut into ranges of ids; an
outer product goes, with its whole right side, to each range that its left side
touches, so pairs are made and summed in one task and only the best leave it.
Ranges are as many as the left sides' locality allows: ids that lie near each
other and meet the same right sides share a block.  Where a block would need more
than a task should hold, the right sides are cut by column, and the best of a
row's parts meet by a shuffle; else a row is ranked where it was summed.  Where
much would be sent at once, ranges are dealt with in passes, each written before
the next one, so the shuffle files of one pass are on disk and not those of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.sources.checkpoints import kept_at, release, stash

#: Pairs that are multiplied at once, ranges of rows at most (a power of two), and entries that a task should hold at most.
MOST_PAIRS, RANGES, TASK_ENTRIES = 2_000_000, 1024, 12_000_000
#: Entries that a pass may send, or PASS_SHARE times what the right sides have if that is more; ranges that passes alone may make.
PASS_ENTRIES, PASS_SHARE, PASS_RANGES = 48_000_000, 2, 64
#: Entries that are worth a task of their own.
CELL_ENTRIES = 100_000
#: Ranges go together into a pass up to this part of what a single one may send.
TOGETHER = 0.25


def _flat(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the lists' lengths."""
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False)), np.asarray(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] of them) for each i."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _loads(cuts: np.ndarray) -> Callable:
    """Entries of right and of left sides that each range would be sent, for every number of ranges; one row for each range that a partition touches, and the sums at level -1."""
    levels = RANGES.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, alone = np.zeros((2, levels, RANGES), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            a, la = _flat(batch.column(0))
            lb = np.asarray(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            pair, n = np.unique(np.repeat(np.arange(len(la)), la) * RANGES + np.searchsorted(cuts, a, side="right"), return_counts=True)
            row, at = pair // RANGES, pair % RANGES
            for level in range(levels):
                # Each level from the one before it, whose pairs are in order.
                starts = _runs(row, at)
                row, at, n = row[starts], at[starts], np.add.reduceat(n, starts) if len(starts) else n
                for side, weights in enumerate((lb[row], n)):
                    load[side, level] += np.bincount(at, weights=weights, minlength=RANGES).astype(np.int64)
                at = at >> 1
            alone += lb[la > 0].sum(), la.sum()
        level, at = np.nonzero(load.any(axis=0))
        columns = [pa.array(np.r_[level, -1].astype(np.int32)), pa.array(np.r_[at, 0].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.r_[load[side, level, at], alone[side]]) for side in (0, 1))], ["level", "at", "right", "left"])

    return run


def _dealt(cuts: np.ndarray, own: range, parts: int, kind: type, within: bool) -> Callable:
    """Each outer product once for each of the `own` ranges and part of the columns that it touches; left sides that are within the right ones are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            (a, la), (v, _), (b, lb), (w, _) = (_flat(batch.column(c)) for c in range(1, 5))
            row, at = np.repeat(np.arange(len(la)), la), np.searchsorted(cuts, a, side="right")
            mine = np.flatnonzero((at >= own.start) & (at < own.stop))
            order = mine[np.lexsort((at[mine], row[mine]))]
            if not len(order):
                continue
            starts = _runs(row[order], at[order])
            lengths = np.diff(np.r_[starts, len(order)])
            if within:
                left = [_lists(x, np.zeros(len(starts), np.int64)) for x in (np.zeros(0, kind), np.zeros(0))]
            else:
                left = [_lists(a[order].astype(kind), lengths), _lists(v[order].astype(np.float64), lengths)]
            row_of, range_of = row[order][starts], at[order][starts]
            place = np.repeat(np.arange(len(lb)), lb)
            for part in range(parts):
                mine = slice(None) if parts == 1 else np.flatnonzero(b % parts == part)
                sizes = np.bincount(place[mine], minlength=len(lb))
                right = [_lists(b[mine].astype(kind), sizes), _lists(w[mine].astype(np.float64), sizes)]
                # Right sides are repeated a few thousand entries at a time.
                ends = np.cumsum(sizes[row_of] + lengths)
                bounds = np.unique(np.r_[0, np.searchsorted(ends, np.arange(MOST_PAIRS, ends[-1] if len(ends) else 0, MOST_PAIRS)), len(row_of)])
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    taken = pa.array(row_of[s:e])
                    columns = [pa.array((range_of[s:e] * parts + part).astype(np.int32)), pa.array(m[row_of[s:e]])]
                    columns += [x.slice(s, e - s) for x in left] + [x.take(taken) for x in right]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "m", "a", "v", "b", "w"])

    return run


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys of zero and more; sorted together with their places where both fit into 63 bits, which is faster."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)) >> (62 - bits):
        return np.argsort(keys, kind="stable")
    return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)


def _best(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int | None, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sums in order of row those that may be among a row's k best."""
    if k is None or not len(r):
        return r, c, s
    starts = _runs(r)
    n = np.diff(np.r_[starts, len(r)])
    long = n > k
    if not long.any():
        return r, c, s
    least = np.full(len(starts), -np.inf)
    # Rows of like length are put side by side, so that little is padding.
    for size in np.unique(np.ceil(np.log2(n[long])).astype(int)):
        own = np.flatnonzero(long & (np.ceil(np.log2(n)).astype(int) == size))
        for at in range(0, len(own), max(1, MOST_PAIRS >> int(size))):
            some = own[at : at + max(1, MOST_PAIRS >> int(size))]
            width = n[some].max()
            square = np.full((len(some), width), -np.inf)
            square[np.arange(width) < n[some][:, None]] = s[_expanded(starts[some], n[some])]
            least[some] = np.partition(square, width - k, axis=1)[:, width - k]
    keep = s >= np.repeat(least, n) - margin
    return r[keep], c[keep], s[keep]


def _summed(k: int | None, margin: float, leave_out: bool, within: np.ndarray | None) -> Callable:
    """The sums of each cell's pairs, its rows in order; rows (cell, m, a, v, b, w) come in order of cell.

    With leave_out a pair (a, m) has no sum.  Where `within` gives the cuts of the ranges, left sides are the part of the
    right ones in the cell's range.
    """

    def sums(own: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        m, a, v, la, b, w, lb = (np.concatenate(x) for x in zip(*own))
        own.clear()
        row = np.repeat(np.arange(len(la), dtype=np.int32), la)
        order = np.argsort(a, kind="stable")
        a, v, row = a[order].astype(np.int64), v[order], row[order]
        reps, first = lb[row], (np.cumsum(lb) - lb)[row]
        width = int(max(b.max(initial=0), m.max(initial=0))) + 1
        if width >= 1 << 40:
            raise ValueError("ids of 2^40 and more cannot be multiplied")
        starts = _runs(a) if len(a) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(a)].astype(np.int64)
        before = np.r_[0, np.cumsum(reps)]
        s = 0
        while s < len(starts):
            # Whole result rows, MOST_PAIRS pairs at most unless a single row has more.
            e = max(s + 1, int(np.searchsorted(before[ends], before[starts[s]] + MOST_PAIRS, side="right")))
            yield from rows(int(starts[s]), int(ends[e - 1]), a, v, m[row] if leave_out else None, b, w, reps, first, before, width)
            s = e

    def rows(s, e, a, v, m, b, w, reps, first, before, width) -> Iterator[pa.RecordBatch]:
        ids = a[s:e][_runs(a[s:e])]
        local = np.searchsorted(ids, a[s:e])
        keys, totals = np.zeros(0, np.int64), np.zeros(0)
        # A single row of very many pairs is summed in parts.
        cuts = np.unique(np.r_[s, s + np.searchsorted(before[s + 1 : e + 1], np.arange(before[s] + 2 * MOST_PAIRS, before[e], 2 * MOST_PAIRS)), e])
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = reps[p:q]
            right = _expanded(first[p:q], n)
            key = np.repeat(local[p - s : q - s] * width, n) + b[right]
            value = np.repeat(v[p:q], n) * w[right]
            if len(keys):
                key, value = np.r_[keys, key], np.r_[totals, value]
            n_pairs = len(key)
            if m is not None and q == e:
                # What is left out comes last among its equals.
                key, value = np.r_[key, local * width + m[s:e]], np.r_[value, np.zeros(e - s)]
            order = _order(key)
            key = key[order]
            at = _runs(key) if len(key) else np.zeros(0, np.int64)
            keys, totals = key[at], np.add.reduceat(value[order], at) if len(at) else np.zeros(0)
            if len(key) > n_pairs:
                keep = order[np.r_[at[1:], len(key)] - 1] < n_pairs
                keys, totals = keys[keep], totals[keep]
        r, c, x = _best(keys // width, keys % width, totals, k, margin)
        if len(r):
            starts = _runs(r)
            lengths = np.diff(np.r_[starts, len(r)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[r[starts]]), _lists(c, lengths), _lists(x, lengths)], ["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            own = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            starts = _runs(own) if len(own) else np.zeros(0, np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
                if held and own[s] != cell:
                    yield from sums(held)
                cell, part = own[s], batch.slice(s, e - s)
                (a, la), (v, _), (b, lb), (w, _) = (_flat(part.column(c)) for c in range(2, 6))
                if within is not None:
                    own_range = np.searchsorted(within, b, side="right") == cell
                    a, v, la = b[own_range], w[own_range], np.bincount(np.repeat(np.arange(len(lb)), lb)[own_range], minlength=len(lb))
                # Copies: a slice would keep its whole batch.
                held.append([np.array(x) for x in (part.column(1).to_numpy(zero_copy_only=False), a, v, la, b, w, lb)])
        if held:
            yield from sums(held)

    return run


def _rows(products: DataFrame, k: int | None, margin: float, leave_out: bool, squares: bool) -> tuple[list[DataFrame], bool]:
    """a, b and score (arrays) of the rows of a sum of outer products, a table for each pass, and whether each row is whole."""
    spark = products.sparkSession
    entries = products.select(F.explode("a").alias("a"))
    shares = [i / RANGES for i in range(1, RANGES)]
    most = products.agg(F.max(F.array_max("a")), F.max(F.array_max("b")), F.max("m")).first()
    kind, name = (np.int32, "int") if max(x or 0 for x in most) < 1 << 31 else (np.int64, "bigint")
    fine = np.array(entries.agg(F.percentile_approx("a", shares, 20_000)).first()[0] or [], np.int64)
    # At most 2 * RANGES rows, whatever the number of entries.
    right, left = np.zeros((2, RANGES.bit_length(), RANGES), np.int64)
    alone = (0, 0)
    for r in products.select("a", F.size("b").alias("n")).mapInArrow(_loads(fine), "level int, at int, right bigint, left bigint").groupBy("level", "at").agg(F.sum("right").alias("right"), F.sum("left").alias("left")).collect():
        if r["level"] < 0:
            alone = r["right"], r["left"]
        else:
            right[r["level"], r["at"]], left[r["level"], r["at"]] = r["right"], r["left"]
    # The most ranges that send little more than one would; otherwise as few as keep half of the cores at work.
    least = max(1, spark.sparkContext.defaultParallelism // 2)
    load = right if squares else right + left
    level = next(i for i in range(len(load)) if load[i].sum() <= 2 * (alone[0] if squares else sum(alone)) or RANGES >> i <= least)
    pass_entries = max(PASS_ENTRIES, PASS_SHARE * alone[0])

    def cut(level: int) -> tuple[int, np.ndarray]:
        """Parts of the columns, and what each range is sent."""
        parts = max(1, -(-int(load[level].max()) * (2 if squares else 1) // TASK_ENTRIES))
        return parts, (right + left * (0 if squares and parts == 1 else parts))[level, : RANGES >> level]

    # A range that is too much for a pass is divided, as long as that helps.
    while level > 0 and RANGES >> level < PASS_RANGES and pass_entries < cut(level)[1].max() > cut(level - 1)[1].max():
        level -= 1
    parts, sent = cut(level)
    cuts = fine[(1 << level) - 1 :: 1 << level]
    lists = f"a array<{name}>, v array<double>, b array<{name}>, w array<double>"
    within = squares and parts == 1
    summed = _summed(k, margin, leave_out, cuts if within else None)

    def one(own: range) -> DataFrame:
        near = products
        # Outer products that touch none of the pass's ranges need not reach Python.
        if own.start > 0:
            near = near.where(F.array_max("a") >= int(cuts[own.start - 1]))
        if own.stop - 1 < len(cuts):
            near = near.where(F.array_min("a") < int(cuts[own.stop - 1]))
        dealt = near.select("m", "a", "v", "b", "w").mapInArrow(_dealt(cuts, own, parts, kind, within), f"cell int, m bigint, {lists}")
        # Cells are dealt out in turn: by hash, some tasks would get several large ones.
        n = min(parts * len(own), max(spark.sparkContext.defaultParallelism, int(sent[own.start : own.stop].sum()) // CELL_ENTRIES))
        return dealt.repartitionById(n, "cell").sortWithinPartitions("cell").mapInArrow(summed, "a bigint, b array<bigint>, score array<double>")

    return [one(own) for own in _passes(sent, int(TOGETHER * pass_entries))], parts == 1


def _passes(sent: np.ndarray, most: int) -> list[range]:
    """Runs of ranges that are sent `most` entries at most, or a single range that is sent more."""
    out, first, total = [], 0, 0
    for at, n in enumerate(sent.tolist()):
        if at > first and total + n > most:
            out.append(range(first, at))
            first, total = at, 0
        total += n
    return [*out, range(first, len(sent))]


def _written(passes: list[DataFrame], stored: bool) -> DataFrame:
    """All passes; where there are several each is written before the next one is begun.  stored: a single one is written too."""
    if len(passes) == 1 and not stored:
        return passes[0]
    out, done = None, []
    for i in range(len(passes)):
        done.append(stash(passes[i], "product-pass"))
        passes[i] = None
        release(done[i].sparkSession)
        out = done[i] if out is None else out.unionByName(done[i])
    return kept_at(out, *done)


def product_top(products: DataFrame, leave_out: bool = False, squares: bool = False, stored: bool = False) -> DataFrame:
    """a, b and score of the cells of a sum of outer products.

    products: m, a, v, b, w, which is read three times and once for each pass, and should be stored.  With leave_out cells
    (a, m) of a product's own m are left out.  squares: b and w are a and v.  stored: the result is in a stash, and `discard`
    may be called with it.
    """
    rows = _written(_rows(products, None, 0.0, leave_out, squares)[0], stored)
    return kept_at(rows.select("a", F.explode(F.arrays_zip("b", "score")).alias("x")).select("a", "x.b", "x.score"), rows)


def ranked_product(products: DataFrame, k: int, digits: int | None = None, leave_out: bool = False, squares: bool = False, stored: bool = False) -> DataFrame:
    """a, b, score and rank of the k best cells of each a, as rank_top ranks those of product_top."""
    # Sums that are equal when rounded are told apart by id: all of them are kept.
    passes, whole = _rows(products, k, 0.0 if digits is None else 10.0**-digits, leave_out, squares)

    def ranked(rows: DataFrame) -> DataFrame:
        cells = F.zip_with("score", "b", lambda s, b: F.struct((s if digits is None else F.round(s, digits)).alias("score"), b.alias("b")))
        own = rows.select("a", cells.alias("x"))
        if not whole:
            # A row's parts meet as lists.
            own = own.repartition("a").groupBy("a").agg(F.flatten(F.collect_list("x")).alias("x"))
        return own.select("a", F.slice(F.sort_array("x", asc=False), 1, k).alias("x"))

    best = _written([ranked(rows) for rows in passes], stored)
    return kept_at(best.select("a", F.posexplode("x").alias("place", "x")).select("a", "x.b", "x.score", (F.col("place") + 1).alias("rank")), best)
