"""Secret scans through an incremental blob ledger.

Every historical version of a file is a row (path, version, content).  Contents
are addressed by their SHA-256, so copies and unchanged versions are one blob.
A stored ledger keeps which (blob, rule, rule version) pairs have been scanned and what
was found; a scan takes only pairs that it has not seen, appends to the ledger,
and joins the findings back to all paths.

Matches and their places come from two built-in expressions on the same
pattern: the matches themselves and the text between them; their lengths add up
to the places.  The main path holds no Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import bound, bounded_bytes, cutter, shared_dir, stash, text_of


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts (0: the match), and the least length.

    hint: a cheap pattern that every matching text matches.
    """

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hint: str = ""


# The base rules.  {24,} and {16,} find the same matches as + with a length check, since such runs end where the class ends.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, ASSIGN, 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Rules beside the base: key blocks, signed web tokens, tokens of code hosts and chat services, and logins in addresses.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?", hint="PRIVATE KEY-----"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("host", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("chat", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
    Rule("login", 1, r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{1,64}@", hint="://"),
)
RULES = BASE + MORE

FINDING = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, kind string, rule_version int, found {FINDING}"
#: Bytes up to which the hashes of contents seen before, and findings, are broadcast.
SEEN_BROADCAST, FOUND_BROADCAST = 8 << 20, 8 << 20


#: Items that a running sum takes at a time; its cost for n of them is n * CHUNK + (n / CHUNK)².
CHUNK = 256


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """out(state before the item, item) of every item of an array, where step(state, item) is the state after it.

    An array that grows by an item is copied each time, so results are gathered by chunks, from the state at each chunk's beginning.
    """
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    chunks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, CHUNK)))

    def states(chunk: Column, start: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            return F.struct(step(s["now"], x).alias("now"), F.concat(s["all"], F.array(out(s["now"], x))).alias("all"))

        return F.aggregate(chunk, F.struct(start.alias("now"), F.slice(F.array(out(start, F.get(chunk, 0))), 1, 0).alias("all")), add, lambda s: s["all"])

    def next_(s: Column, chunk: Column) -> Column:
        return F.struct(F.aggregate(chunk, s["now"], step).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all"))

    def whole(c: Column) -> Column:
        begin = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("all"))
        return F.flatten(F.zip_with(c, F.aggregate(c, begin, next_, lambda s: s["all"]), states))

    # The chunks are bound to a name, so that they are made once and not for each use.
    return F.get(F.transform(F.array(chunks), whole), 0)


def find(text: Column, rule: Rule) -> Column:
    """Places of the rule's matches in the text, as an array of (kind, start, end) in code points."""
    between = F.split(text, rule.pattern, -1)

    def measured(gap: Column, hit: Column) -> Column:
        # what follows the group's beginning is the group: its pattern is the last part
        long_enough = F.char_length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("hit"), long_enough.alias("ok"))

    def places(hits: Column) -> Column:
        each = F.zip_with(F.slice(between, 1, F.size(hits)), hits, measured)
        return F.get(F.transform(F.array(each), lambda x: running(x, F.lit(0), after, place)), 0)

    def after(at: Column, x: Column) -> Column:
        return at + x["gap"] + x["hit"]

    def place(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), after(at, x).alias("end"), x["ok"].alias("ok"))

    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    found = F.filter(F.get(F.transform(F.array(whole), places), 0), lambda x: x["ok"])
    spans = F.transform(found, lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast(FINDING)
    return F.when(text.rlike(rule.hint or rule.pattern), F.coalesce(spans.cast(FINDING), none)).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan blobs (blob, content): the ledger's rows (blob, kind, rule_version, found)."""
    each = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), _found(r).alias("found"))
        for r in rules
    ]
    return blobs.select("blob", F.explode(F.array(*each)).alias("x")).select("blob", "x.kind", "x.rule_version", "x.found")


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Blobs with the rules of which the ledger has no row: blob, content, todo (kinds)."""
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "rule_version")).alias("seen"))
    todo = F.array_except(now, F.coalesce("seen", F.array().cast("array<struct<kind:string,rule_version:int>>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).drop("seen")


def suspect(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule can match the text."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | text.rlike(r.hint or r.pattern)
    return hit


def blobs_of(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each distinct content once: blob (SHA-256), and its content where a rule can match, else null.

    So only hashes and the few contents with a match cross the shuffle.  Copies
    within a partition meet before it, and a content with very many copies
    crosses once for each partition.
    """
    content = F.when(suspect(F.col("content"), rules), F.col("content"))
    return versions.select("blob", content.alias("content")).groupBy("blob").agg(F.first("content", ignorenulls=True).alias("content"))


def _found(rule: Rule) -> Column:
    """What the rule finds in a blob's content; a content that no rule can match is null."""
    return F.coalesce(find(F.col("content"), rule), F.array().cast(FINDING))


def versions_of(files: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
    """Content-addressed versions: path, blob, content; a null content counts as empty."""
    own = files.select(files[path].alias("path"), text_of(content).alias("content"))
    return own.withColumn("blob", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    """The stored ledger: blob, kind, rule_version, found; empty where nothing is stored yet."""
    try:
        return spark.read.schema(LEDGER).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*[f"cast(null as {kind}) as {name}" for name, kind in (x.split(" ", 1) for x in LEDGER.split(", "))])


def update_ledger(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: findings of each unseen pair of a blob and a rule version.

    ledger: blob, kind, rule_version, found; None when there is none yet.
    """
    if ledger is None:
        return scan(blobs_of(versions, rules), rules)
    pairs = F.struct("kind", "rule_version").isin([F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules])
    done = ledger.where(pairs).groupBy("blob").agg(F.count_distinct("kind").alias("n")).where(F.col("n") == len(rules)).select("blob")
    # Contents that every rule has seen are neither read through nor shuffled.
    fresh = versions.join(F.broadcast(done) if bounded_bytes(done, F.lit(48), SEEN_BROADCAST) else done, "blob", "left_anti")
    waiting = unseen(blobs_of(fresh, rules), ledger, rules)
    each = []
    for r in rules:
        wanted = F.array_contains(F.transform("todo", lambda x: x["kind"]), r.kind)
        each.append(
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("rule_version"),
                F.when(wanted, _found(r)).alias("found"),
            )
        )
    new = waiting.select("blob", F.explode(F.array(*each)).alias("x")).select("blob", "x.kind", "x.rule_version", "x.found")
    return new.where(F.col("found").isNotNull())


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and found of the blobs in which the current rule versions found anything, as a written table, so that a join can deal out its rows anew."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("rule_version") == r.version))
    own = ledger.where(current & (F.size("found") > 0)).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    own = stash(own, "secrets-findings")
    return F.broadcast(own) if bounded_bytes(own, 48 + 32 * F.size("found"), FOUND_BROADCAST) else own


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Join the findings of the current rule versions back to all paths: path, blob, found.

    Paths without findings stay, with an empty list.  Findings are broadcast up
    to FOUND_BROADCAST bytes; beyond that a blob's findings cross once, and
    adaptive execution can split the paths of a blob that has very many.
    """
    return versions.select("path", "blob").join(findings(ledger, rules), "blob", "left").select(
        "path", "blob", F.coalesce("found", F.array().cast(FINDING)).alias("found")
    )


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of the query from path, found."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    ranked = F.array_sort(
        F.transform("found", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    out = found.select(F.col("path").cast("bigint").alias("doc_id"), ranked.alias("s"))
    base = F.filter("s", lambda x: x["k"] < len(BASE))
    return out.select(
        "doc_id",
        *[F.size(F.filter("s", lambda x: x["kind"] == r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
    )


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, store: str | None = None) -> DataFrame:
    """Secrets in every whole text of documents, through the ledger.

    store: folder of the stored ledger, to which what is new is added; without it, `ledger` is what has been seen before.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans.  A null text
    counts as empty; a null doc_id stays null; repeated rows give repeated
    results; an empty table gives none; other columns are not read.
    """
    versions = versions_of(docs)
    if store is not None:
        return digest(findings_by_path(versions, stored(versions, store, rules), rules), rules)
    new = update_ledger(versions, ledger, rules)
    book = new if ledger is None else ledger.select("blob", "kind", "rule_version", "found").unionByName(new)
    return digest(findings_by_path(versions, book, rules), rules)


def stored(versions: DataFrame, store: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add what is new in versions to the stored ledger, and read it again."""
    spark = versions.sparkSession
    update_ledger(versions, read_ledger(spark, store), rules).write.mode("append").option("compression", "zstd").parquet(store)
    return read_ledger(spark, store)


def new_store(spark: SparkSession) -> str:
    """A folder for a ledger that begins empty."""
    return f"{shared_dir(spark)}/secrets-ledger-{uuid.uuid4().hex}"


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", store: str | None = None) -> DataFrame:
    """documents with every found span replaced by `mask`; all rows and columns stay, n_chars follows the text.

    store: folder of the ledger that the scan goes through; one that begins empty if not given.  A null text stays null;
    repeated rows are masked alike and stay; an empty table gives none; other columns may have any names.
    """
    text = text_of()
    book = findings(stored(versions_of(docs, "text"), store or new_store(docs.sparkSession), rules), rules)
    # Texts without a match cross no shuffle.  The others' columns travel as one, where no name of theirs can clash.
    hit = suspect(text, rules)
    held = docs.where(hit).select(F.struct("*").alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")).join(book, "blob", "left")

    def masked(text: Column, found: Column) -> Column:
        pieces, cut = cutter(text)
        places = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

        def reach(at: Column, x: Column) -> Column:
            return F.greatest(at, x["end"])

        def clean(pieces: Column) -> Column:
            def piece(at: Column, x: Column) -> Column:
                # Of overlapping spans the covered part is masked once.
                return F.when(x["start"] >= at, F.concat(cut(pieces, at, x["start"]), F.lit(mask))).otherwise(F.lit(""))

            rest = cut(pieces, F.array_max(F.transform(found, lambda x: x["end"])), F.char_length(text))
            return F.concat(F.array_join(running(places, F.lit(0), reach, piece), ""), rest)

        return bound(pieces, clean)

    held = held.withColumn("clean", F.when(F.size("found") > 0, masked(F.col("row")["text"].cast("string"), F.col("found"))))
    changed = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("bigint")}
    out = [
        F.when(F.col("clean").isNotNull(), changed[n]).otherwise(F.col("row")[n]).alias(n) if n in changed else F.col("row")[n].alias(n)
        for n in docs.columns
    ]
    return docs.where(~hit).unionByName(held.select(*out))
