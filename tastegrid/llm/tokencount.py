"""Exact token counts at every prefix of a text.

The vocabulary is a BPE piece model with byte fallback.  `PrefixCounter` never
runs the merges over a text.  It uses two facts about BPE with a fixed merge
order: a run of pieces is the encoding of its string if and only if every two
neighbours are the encoding of theirs, and so exactly one vocabulary piece that
ends at position i is compatible with the encoding of what stands before it.
A dynamic programme over prefixes therefore stores, for every prefix, its last
piece and its token count: count[i] = count[i - len(last)] + 1.

Merges never cross certain places (before a run of spaces, around a character
that occurs in no longer piece), so the programme runs chunk by chunk; equal
chunks are looked up in a bounded memo.  A prefix of a text is some whole chunks
and a prefix of one chunk, so counts at every prefix follow from the chunk
totals' prefix sums and the chunk's own table: truncation and budget questions
need no further encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tastegrid.llm.common import slices, text_of

SPACE = "▁"
#: Entries of the memo of chunk counts, and of that of piece pairs, in one Python worker.
MEMO, PAIR_MEMO = 900_000, 500_000
#: Rows that are taken as Python objects at a time.
SLICE = 1000
DEFAULT_LIMIT = 4096


class PrefixCounter:
    """Token counts of all prefixes under one piece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space after another character; chunks would not be independent")
        joined = "".join(sorted({c for p in self.score if len(p) > 1 for c in p} - {SPACE}))
        inner = re.escape(joined)
        self.chunk = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]", re.S)
        self.valid = {p for p in self.score if len(p) == 1 or self.merge(p) == [p]}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}

    def merge(self, s: str) -> list[str]:
        """BPE of a short string: the best pair first, of equals the leftmost."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether the pieces a and b are the encoding of a + b."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def cost(self, char: str) -> int:
        return 1 if char in self.score else len(char.encode("utf-8", "surrogatepass"))

    def extend(self, chunk: str, count: list[int], last: list[str]) -> None:
        """Carry the programme on from the prefix that count and last hold to the whole chunk."""
        valid, longest, pairs = self.valid, self.longest, self.pairs
        for i in range(len(count), len(chunk) + 1):
            for start in range(i - longest if i > longest else 0, i):
                piece = chunk[start:i]
                if piece in valid or start == i - 1:
                    if start:
                        before = last[start]
                        fit = pairs.get((before, piece))
                        if fit is None:
                            fit = self.fits(before, piece)
                        if not fit:
                            continue
                    count.append(count[start] + (1 if piece in valid else self.cost(piece)))
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no compatible piece at {i} of {chunk!r}")

    def table(self, chunk: str) -> list[int]:
        """Token counts of the chunk's prefixes of 0, 1, ... characters."""
        count, last = [0], [""]
        self.extend(chunk, count, last)
        return count

    def learn(self, chunks: set[str]) -> None:
        """Remember the totals of chunks.  In order, one chunk goes on from the prefix that it shares with the one before."""
        if len(self.totals) + len(chunks) > MEMO:
            self.totals.clear()
        count, last, before = [0], [""], ""
        for chunk in sorted(chunks):
            n = 0
            for x, y in zip(before, chunk):
                if x != y:
                    break
                n += 1
            del count[n + 1 :], last[n + 1 :]
            self.extend(chunk, count, last)
            self.totals[chunk] = count[-1]
            before = chunk

    def total(self, chunk: str) -> int:
        if chunk not in self.totals:
            self.learn({chunk})
        return self.totals[chunk]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        cut = [self.chunks(t) for t in texts]
        missing = set().union(*cut).difference(self.totals)
        if missing:
            self.learn(missing)
        known = self.totals
        return [sum([known[c] if c in known else self.total(c) for c in x]) for x in cut]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the text's prefixes of 0, 1, ..., len(text) characters."""
        out, before = [np.zeros(1, np.int32)], 0
        for chunk in self.chunks(text):
            t = np.array(self.table(chunk)[1:], np.int32) + before
            out.append(t)
            before = int(t[-1])
        all_ = np.concatenate(out)
        # position 0 is the empty text, position 1 the space put before every text
        return np.concatenate([all_[:1], all_[2:]]) if len(all_) > 1 else all_

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that takes at most `budget` tokens."""
        chunks = self.chunks(text)
        ends = np.cumsum([self.total(c) for c in chunks], dtype=np.int64)
        if not len(ends) or ends[-1] <= budget:
            return len(text)
        # Counts grow from chunk to chunk, so the answer lies in the last chunk that begins within the budget.
        starts = np.concatenate([[0], ends[:-1]])
        at = int(np.searchsorted(starts, budget, side="right")) - 1
        while at > 0 and starts[at] + min(self.table(chunks[at])[1:]) > budget:
            at -= 1
        table = self.table(chunks[at])
        inside = max(i for i, c in enumerate(table) if starts[at] + c <= budget)
        return max(0, sum(map(len, chunks[:at])) + inside - 1)


@lru_cache(maxsize=4)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = DEFAULT_LIMIT, prefixes: bool = False) -> DataFrame:
    """Token counts of every whole text, from the prefix programme.

    Returns doc_id, n_bytes, n_tokens, over_limit, limit_chars (characters of
    the longest prefix within `limit` tokens) and, with prefixes=True,
    prefix_tokens: array of the counts at prefixes of 0, 1, ... code points.

    A null text counts as empty: no bytes, no tokens.  A null doc_id stays
    null; repeated rows give repeated results; an empty table gives none; other
    columns of docs are not read.
    """
    kind = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint"
    kind += ", prefix_tokens array<int>" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            for part in slices(batch, SLICE):
                texts = part.column(1).to_pylist()
                n = c.counts(texts)
                out = [
                    part.column(0),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                    pa.array([len(t) if x <= limit else c.longest_prefix(t, limit) for t, x in zip(texts, n)], pa.int64()),
                ]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"]
                if prefixes:
                    out.append(pa.array([c.prefixes(t) for t in texts], pa.list_(pa.int32())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(out, names)

    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(run, kind)
