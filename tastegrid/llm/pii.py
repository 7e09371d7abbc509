"""Personal data and the terms that disclose it.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
The corpus then tells which ordinary terms give a protected entity (a found
value) away.  With the shares of rows that hold a term, an entity, and the term
near the entity, the pointwise mutual information says how many of the entity's
bits the term reveals; a term that reveals at least GENERALISE of the entity's
information is generalised wherever it stands near that entity, one that reveals
at least REMOVE is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import bound, cutter, slices, stash, text_of
from tastegrid.llm.secrets import running

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information from which on a term is generalised, and removed.
GENERALISE, REMOVE = 0.7, 0.95
#: Words to either side of an entity that count as near, and different texts in which a term must stand near it.
NEAR, SUPPORT = 8, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each @ is looked at once, from the run of local characters before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, in order of kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (x[-4:] if x[:-4].strip("0") == "" else "999" for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> str:
    """What an entity is known by: its kind and its value without layout."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else _digits(value)}"


def _near(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each entity of the text the terms near it, with all their places."""
    if not spans:
        return []
    words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    taken = sorted((a, b) for _, a, b in spans)
    free, i = [], 0
    for w in words:
        while i < len(taken) and taken[i][1] <= w[0]:
            i += 1
        if i == len(taken) or taken[i][0] >= w[1]:
            free.append(w)
    starts = [w[0] for w in free]
    from bisect import bisect_left

    found: dict[tuple[str, str], set[tuple[int, int]]] = {}
    for kind, a, b in spans:
        name = entity(kind, text[a:b])
        left, right = bisect_left(starts, a), bisect_left(starts, b)
        for s, e, term in free[max(0, left - NEAR) : left] + free[right : right + NEAR]:
            found.setdefault((name, term), set()).add((s, e))
    return [{"entity": n, "term": t, "places": [x for p in sorted(places) for x in p]} for (n, t), places in found.items()]


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, counts, base digest and spans, and the terms near entities."""
    near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("places", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text in batch.column(2).to_pylist():
                spans = base_spans(text)
                n = Counter(k for k, _, _ in spans)
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
                digest = hashlib.sha256(joined.encode()).hexdigest()
                rows.append((*[n[k] for k in range(4)], digest, joined, _near(text, spans)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), near]
            names = ["doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "near"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names
            )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return own.mapInArrow(
        run,
        f"doc_id bigint, text_key bigint, {counts}, base_sha256 string, base string, near array<struct<entity:string,term:string,places:array<int>>>",
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """term and n_term, the number of rows that hold it, over all rows; each task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])
            n.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole)):
            for text in batch.column(0).to_pylist():
                n.update(set(_WORD.findall(text.lower())))
                if len(n) > 600_000:
                    yield flush()
        yield flush()

    return docs.select(text_of().alias("text")).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(scanned: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Pairs of an entity and a term that discloses it: entity, term, share, action."""
    total = scanned.count()
    each = scanned.select("doc_id", "text_key", F.explode("near").alias("x"))
    pairs = each.groupBy(F.col("x.entity").alias("entity"), F.col("x.term").alias("term")).agg(
        F.count("*").alias("n_both"), F.count_distinct("text_key").alias("texts")
    )
    pairs = pairs.where(F.col("texts") >= SUPPORT)
    # Rows that hold the entity near any term; one without terms near it discloses nothing.
    own = scanned.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    entities = own.groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = term_counts(docs)
    bits = F.log2(F.lit(float(total)) / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * float(total) / (F.col("n_term") * F.col("n_entity")))
    share = F.when(bits > 0, shared / F.nullif(bits, F.lit(0.0))).otherwise(F.lit(0.0))
    return (
        pairs.join(entities, "entity")
        .join(terms, "term")
        .withColumn("share", share)
        .where(F.col("share") >= generalise)
        .select("entity", "term", "share", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))
    )


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Personal data in every whole text, with the terms that disclose it.

    Returns doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, base
    (the base's spans as text) and terms (array of (start, end, action)).

    A null text counts as empty.  A null doc_id stays null; repeated rows give
    repeated results, and each counts in the corpus; an empty table gives none;
    other columns are not read.
    """
    scanned = stash(_scan(docs), "pii")
    pairs = disclosing(scanned, docs, generalise, remove)
    places = F.transform(
        F.sequence(F.lit(0), F.size("x.places") - 2, F.lit(2)),
        lambda i: F.struct(F.get("x.places", i).alias("start"), F.get("x.places", i + 1).alias("end"), F.col("action").alias("action")),
    )
    terms = (
        scanned.where(F.size("near") > 0)
        .select("doc_id", "text_key", F.explode("near").alias("x"))
        .join(pairs, (F.col("x.entity") == F.col("entity")) & (F.col("x.term") == F.col("term")))
        .select("doc_id", "text_key", F.explode(places).alias("p"))
        .groupBy("doc_id", "text_key", "p.start", "p.end")
        .agg(F.max(F.col("p.action")).alias("action"))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    )
    terms = terms.withColumnsRenamed({"doc_id": "t_id", "text_key": "t_key"})
    joined = scanned.drop("near").join(terms, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key")), "left")
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return joined.withColumn("terms", F.coalesce("terms", none)).drop("t_id", "t_key")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    terms = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string"))), ",")
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit("")))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id and text with base spans replaced by their kind, disclosing terms by [TERM] or by nothing.

    A null text counts as empty; a null doc_id stays null; repeated rows are replaced alike and stay; an empty table
    gives none; other columns are not read.
    """
    found = find(docs, generalise, remove).select(F.col("doc_id").alias("f_id"), "text_key", "base", "terms").distinct()
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("own_key"))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("own_key") == F.col("text_key")))

    def place(x: Column) -> Column:
        cut = F.split(x, ":")
        return F.struct(F.get(cut, 1).cast("int").alias("start"), F.get(cut, 2).cast("int").alias("end"), F.concat(F.lit("["), F.upper(F.get(cut, 0)), F.lit("]")).alias("by"))

    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), place)
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["action"] == "remove", "").otherwise("[TERM]").alias("by")))
    text = F.col("text")
    pieces, cut = cutter(text)

    def reach(at: Column, x: Column) -> Column:
        return F.greatest(at, x["end"])

    def clean(pieces: Column, spans: Column) -> Column:
        def piece(at: Column, x: Column) -> Column:
            return F.when(x["start"] >= at, F.concat(cut(pieces, at, x["start"]), x["by"])).otherwise(F.lit(""))

        rest = cut(pieces, F.array_max(F.transform(spans, lambda x: x["end"])), F.char_length(text))
        return F.concat(F.array_join(running(spans, F.lit(0), reach, piece), ""), rest)

    changed = bound(F.array_sort(F.concat(base, terms)), lambda spans: bound(pieces, lambda p: clean(p, spans)))
    return joined.select("doc_id", F.when((F.col("base") != "") | (F.size("terms") > 0), changed).otherwise(text).alias("text"))
