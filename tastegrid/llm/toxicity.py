"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
Every window of a text is compressed with either, and the difference of the two
lengths, as a share of the window's length, says how much closer the window is
to toxic text.  Thresholds are quantiles of that share over windows of ordinary
labelled texts; a document's score is a logistic function of how many of its
windows reach each threshold, against how many would by chance.

A toxic text is mostly ordinary, so the dictionaries are trained in rounds: first
on whole texts of either label, then on those of their windows that dictionaries
trained on other texts found closer to toxic text than nearly all ordinary
windows are.  Windows of that kind in ordinary texts teach the ordinary
dictionary what is there by chance.  A part of the labelled texts trains no
dictionary and calibrates.

Training takes a bounded sample of the labelled rows (TOXIC_ROWS, ORDINARY_ROWS,
SAMPLE_CHARS, LONGEST), whole texts each, drawn by hashes, in one task for each
member; scoring takes every window of every whole text.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import slices, text_of

#: Labelled rows that training takes at most, the first by a hash of their id, and characters of either kind in all.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 2000, 6000, 16_000_000
#: Characters of the longest text that trains.
LONGEST = 1_000_000
#: Words in a window.
WINDOW = 1
#: Bytes of a dictionary, of a piece that its training takes, and of the runs by which pieces are rated.
SIZE, PIECE, RUN = 16_384, 16, 6
#: Rounds of choosing windows, the share of ordinary windows that the first round's choice lets through (halved each round),
#: parts of the cross-fitting, and windows of a text in a training sample.
ROUNDS, CHANCE, FOLDS, SAMPLE_WINDOWS = 3, 0.03, 6, 50
#: Shares of ordinary windows below the thresholds.
QUANTILES = (0.9, 0.97, 0.99, 0.997, 0.999, 0.9999)
#: Bytes that either dictionary knows, put after every window: a block too small would be stored as it is, and no match begins
#: in its last bytes.
BALLAST = bytes(range(128, 208))
MATCH, LEVEL, RIDGE = 4, 9, 0.3
#: Windows that a shorter text counts as, and the most standard deviations that count.
LEAST, MOST = 50, 6.0
REJECT = 0.7
#: Windows whose share a worker remembers.
MEMO = 200_000
_WORD = re.compile(r"\w+")


def windows_of(text: str) -> list[str]:
    """Every run of WINDOW words, in lower case, between spaces; of a shorter text the only one."""
    words = _WORD.findall(text.lower())
    if WINDOW == 1:
        return [f" {w} " for w in words]
    return [f" {' '.join(words[i : i + WINDOW])} " for i in range(max(1, len(words) - WINDOW + 1))] if words else []


class Distance:
    """How much shorter a window gets by the toxic dictionary than by the ordinary one, in percent of its bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MATCH, strategy=z.STRATEGY_LAZY2, window_log=17, hash_log=14, chain_log=14,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS,
        )

        def compressor(content: bytes) -> z.ZstdCompressor:
            # As raw content: a trained dictionary's own tables would code the letters of both kinds differently.
            d = z.ZstdCompressionDict(content + BALLAST, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(compression_params=params, dict_data=d)

        self.toxic, self.ordinary = compressor(toxic).compress, compressor(ordinary).compress
        self.memo: dict[str, int] = {}

    def shares(self, windows: list[str]) -> np.ndarray:
        memo, out = self.memo, []
        for w in windows:
            x = memo.get(w)
            if x is None:
                # A window's letters can't differ by more than its length, so 16 bits hold the percentage.
                own = w.encode("utf-8", "surrogatepass")
                data = own + BALLAST
                x = round(100 * (len(self.ordinary(data)) - len(self.toxic(data))) / len(own))
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = x
            out.append(x)
        return np.array(out, np.int16)


def dictionary(texts: list[list[str]], size: int = SIZE) -> bytes:
    """Train a zstandard dictionary on the windows of texts; windows too few for that are the dictionary themselves."""
    import zstandard as z

    def samples(most: int) -> list[bytes]:
        # The trainer skips runs that begin in a sample's last bytes, so spaces follow.
        return [("".join(t[i : i + most]) + " " * 8).encode("utf-8", "surrogatepass") for t in texts for i in range(0, len(t), most)]

    found = samples(SAMPLE_WINDOWS)
    if len(found) < 5 * RUN:
        found = samples(1)
    size = max(256, min(size, sum(map(len, found)) // 2))
    try:
        return z.train_dictionary(size, found, k=PIECE, d=RUN, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(found)[:size]


@dataclass(frozen=True)
class Model:
    """Dictionaries, thresholds with the shares of ordinary windows that reach them, and the calibration; without thresholds a constant score.

    others: further members, with whose log odds this one's are averaged.
    """

    toxic: bytes
    ordinary: bytes
    thresholds: tuple[int, ...]
    chances: tuple[float, ...]
    weights: tuple[float, ...]
    others: tuple["Model", ...] = ()

    def dumps(self) -> str:
        own = replace(self, others=())
        return json.dumps(asdict(own) | {"toxic": self.toxic.hex(), "ordinary": self.ordinary.hex(), "others": [m.dumps() for m in self.others]})

    @staticmethod
    def loads(text: str) -> "Model":
        x = json.loads(text)
        numbers = (tuple(x[k]) for k in ("thresholds", "chances", "weights"))
        return Model(bytes.fromhex(x["toxic"]), bytes.fromhex(x["ordinary"]), *numbers, tuple(map(Model.loads, x["others"])))

    def scorer(self) -> "Scorer":
        return _scorer(self)


def features(shares: np.ndarray, thresholds: tuple[int, ...], chances: tuple[float, ...]) -> list[float]:
    """For each threshold, by how many a text's windows that reach it exceed what chance gives for its length: in standard deviations, in a hundred windows, and the root of that."""
    n = len(shares)
    out = [1.0]
    for t, p in zip(thresholds, chances):
        beyond = int((shares >= t).sum()) - n * p
        dense = 100 * max(0.0, beyond) / max(LEAST, n)
        out += [max(-MOST, min(MOST, beyond / math.sqrt(n * p + 0.5))), min(20.0, dense), math.sqrt(dense)]
    return out


class Scorer:
    def __init__(self, model: Model):
        self.members = [(m, np.array(m.weights), Distance(m.toxic, m.ordinary)) for m in (model, *model.others) if m.thresholds]
        self.constant = float(model.weights[0])

    def score(self, text: str) -> float:
        if not self.members:
            return self.constant
        windows = windows_of(text)
        odds = [float(np.dot(w, features(d.shares(windows), m.thresholds, m.chances))) for m, w, d in self.members]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, sum(odds) / len(odds)))))


@lru_cache(maxsize=2)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method, on columns scaled to unit variance."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    mean[0], sd[0] = 0.0, 1.0
    u, w = (x - mean) / sd, np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [RIDGE] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        step = np.linalg.solve(u.T @ (u * (p * (1 - p))[:, None]) + ridge, u.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-7:
            break
    w /= sd
    w[0] -= float(w[1:] @ mean[1:])
    return w


def by_hash(sample: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Distinct (label, text) in an order that depends on neither their order nor what the texts begin with."""
    return sorted(set(sample), key=lambda x: (hashlib.sha256(x[1].encode("utf-8", "surrogatepass")).digest(), x[0]))


def train(sample: list[tuple[int, str]], aside: int = 0) -> Model:
    """Train a member on (label, text); part `aside` of the texts calibrates.

    Copies of a text count once, and the order of the sample does not matter.  Without at least FOLDS texts of both labels, all scores are the share of toxic
    labels (0.5 without any).
    """
    texts = by_hash(sample)
    share = sum(label for label, _ in sample) / len(sample) if sample else 0.5
    parts: dict[tuple[int, int], list[list[str]]] = {(k, i): [] for k in (0, 1) for i in range(FOLDS)}
    same: dict[str, str] = {}  # one object for each distinct window
    for label, text in texts:
        parts[label, zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS].append([same.setdefault(w, w) for w in windows_of(text)])
    if not all(parts.values()):
        return Model(b"", b"", (), (), (share,))
    # Texts of one part calibrate; each other part's windows are chosen by dictionaries that the rest trained.
    fitting = [i for i in range(FOLDS) if i != aside]
    own = {(k, i): parts[k, i] for k in (0, 1) for i in fitting}

    def trained(label: int, without: int) -> bytes:
        return dictionary([t for i in fitting if i != without for t in own[label, i]])

    for turn in range(ROUNDS):
        got = {}
        for i in fitting:
            distance = Distance(trained(1, i), trained(0, i))
            got |= {(k, i): [distance.shares(t) for t in parts[k, i]] for k in (0, 1)}
        chance = _all(s for i in fitting for s in got[0, i])
        if not len(chance):
            break
        least = max(1.0, float(np.quantile(chance, 1 - CHANCE / 2**turn)))
        for k in own:
            chosen = [[t[j] for j in np.flatnonzero(s >= least).tolist()] for t, s in zip(parts[k], got[k])]
            own[k] = [t for t in chosen if t]
    toxic, ordinary = trained(1, aside), trained(0, aside)
    distance = Distance(toxic, ordinary)
    got = {k: [distance.shares(t) for t in parts[k, aside]] for k in (0, 1)}
    chance = _all(iter(got[0]))
    if not len(chance) or not toxic:
        return Model(b"", b"", (), (), (share,))
    thresholds = tuple(sorted({max(2, int(np.quantile(chance, q)) + 1) for q in QUANTILES}))
    chances = tuple(float((chance >= t).mean()) + 1 / len(chance) for t in thresholds)
    x = np.array([features(s, thresholds, chances) for k in got for s in got[k]])
    y = np.array([float(k) for k in got for _ in got[k]])
    return Model(toxic, ordinary, thresholds, chances, tuple(float(v) for v in _logistic(x, y)))


def joined(members: list[Model]) -> Model:
    """One model of all members; those that came out constant count only if all did."""
    able = [m for m in members if m.thresholds] or members[:1]
    return replace(able[0], others=tuple(able[1:]))


def _all(shares: Iterator[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int16), *shares])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, members: int = 1) -> Model:
    """Train on labelled documents that are not held out; a document with conflicting labels counts as toxic.

    Null ids and labels are left out, a null text counts as empty; of the texts of a repeated id the least is taken.
    The sample goes to one task for each member, in the order of a hash, of either kind up to the text with which it would pass
    SAMPLE_CHARS characters; texts over LONGEST are left out.  Only the model comes to the driver.

    members: pairs of dictionaries whose log odds are averaged, at most FOLDS.
    """
    if not 1 <= members <= FOLDS:
        raise ValueError(f"members must be between 1 and {FOLDS}")
    known = labels.select(F.col("doc_id").cast("bigint").alias("__id"), (F.col("toxic") == 1).cast("int").alias("__toxic"))
    known = known.dropna().where(fold_of(F.col("__id")) != 1).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    known = known.withColumn("__at", F.xxhash64("__id"))
    chosen = [
        known.where(F.col("__toxic") == label).orderBy("__at", "__id").limit(most)
        for label, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))
    ]
    # At most TOXIC_ROWS + ORDINARY_ROWS rows of 24 bytes.
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).join(few, F.col("doc_id") == F.col("__id"))
    # At most `members` copies of the sample, each in a task of its own.
    one = rows.where(F.char_length("text") <= LONGEST).groupBy("__id", "__toxic", "__at").agg(F.min("text").alias("text"))
    each = one.select(F.explode(F.array(*[F.lit(i) for i in range(members)])).alias("__aside"), "__toxic", "text", "__at", "__id")
    each = each.repartitionById(members, "__aside").sortWithinPartitions("__at", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, left, aside = [], {0: SAMPLE_CHARS, 1: SAMPLE_CHARS}, None
        for batch in batches:
            for aside, label, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                left[label] -= len(text)
                if left[label] >= 0:
                    sample.append((label, text))
        if aside is not None:
            yield pa.RecordBatch.from_arrays([pa.array([aside]), pa.array([train(sample, aside).dumps()])], ["aside", "model"])

    found = sorted((r["aside"], r["model"]) for r in each.select("__aside", "__toxic", "text").mapInArrow(run, "aside bigint, model string").collect())
    return joined([Model.loads(m) for _, m in found]) if found else train([])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, score, predicted.

    A null text counts as empty and is scored as such; a null doc_id stays null
    and is not held out; repeated rows give repeated results; an empty table
    gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in slices(batch):
                s = [scorer.score(t) for t in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array([int(x >= REJECT) for x in s], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    key = F.col("doc_id").cast("bigint")
    own = docs.select(key.alias("doc_id"), F.coalesce(fold_of(key) == 1, F.lit(False)).alias("held_out"), text_of().alias("text"))
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below the rejection threshold, with all columns.

    A null text is scored as empty and stays null; repeated rows are kept or go together; an empty table gives none.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([scorer.score(t or "") < REJECT for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
