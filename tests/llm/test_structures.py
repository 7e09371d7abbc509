"""Prefix trie, vector codes and line dedup against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tastegrid.llm import linededup, trie, vectorcode
from tastegrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Prefix trie.

TURNS = "conv_id long, turn long, role string, text string, depth string, a int"


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def words(node):
        return len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    def sums(node):
        leaves, saved = (0, 0) if kids[node] else (1, 0)
        for k in kids[node]:
            x, y = sums(k)
            leaves, saved = leaves + x, saved + y
        return leaves, saved + (len(members[node]) - 1) * words(node)

    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), *sums(node), sha(ends)))
    return order(out)


def test_trie_of_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    monkeypatch.setattr(trie, "STRETCH", 4)
    rng = random.Random(3)
    convs = {c: [(rng.choice("ua"), rng.choice(["x y", "x", "", "y x z"])) for _ in range(rng.randrange(0, 9))] for c in range(60)}
    convs |= {c: convs[7] for c in range(100, 120)} | {-5: convs[7] + [("u", "x" * 5000)] * 2, 10**12: convs[7]}
    rows = [(c, 10 * i, r, t, "no", 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    every = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = trie.digest(trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), every))
    assert order(map(tuple, got.collect())) == plain_trie(convs)


def test_trie_of_odd_rows(spark):
    """Nulls count as empty, null turns come first, ties go by role and text, repeated rows stay, rows without an id go."""
    rows = [(1, None, None, None), (1, 2, "u", "b"), (1, 2, "u", "b"), (1, 2, "a", "z"), (None, 1, "u", "b"), (2, 0, "", ""), (2, 5, "a", "z")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], TURNS)
    want = plain_trie({1: [("", ""), ("a", "z"), ("u", "b"), ("u", "b")], 2: [("", ""), ("a", "z")]})
    assert order(map(tuple, trie.digest(trie.prefix_trie(df)).collect())) == want
    assert trie.prefix_trie(df.limit(0)).count() == 0
    turnless = spark.createDataFrame([(4,), (3,), (3,), (None,)], "conv_id long")
    assert trie.digest(trie.prefix_trie(df.limit(0), turnless)).collect() == [(3, 0, None, 2, 0, 1, 0, sha("3,4"))]


def test_trie_does_not_mix_roles_with_texts(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "c", "ab"), (4, 0, "ab", "c")]
    got = trie.prefix_trie(spark.createDataFrame([(*r, None, None) for r in rows], TURNS))
    assert sorted(r["n_convs"] for r in got.where("depth = 1").collect()) == [1, 1, 2]


def test_a_long_conversation_is_not_gathered(spark):
    """One conversation holds most rows: it spans ranges and chunks, and its places and keys come out the same."""
    n = 10_000
    rows = spark.range(n).selectExpr("cast(9 as long) conv_id", "id turn", "'u' role", "concat('w ', id % 3) text")
    rows = rows.union(spark.range(2).selectExpr("cast(8 as long)", "id", "'u'", "concat('w ', id % 3)"))
    placed = trie.places(rows)
    got = placed.where("conv_id = 9").agg({"place": "min", "*": "count"}).first(), placed.where("conv_id = 9").agg({"place": "max"}).first()[0]
    assert tuple(got[0]) == (n, 1) or tuple(got[0]) == (1, n)
    assert got[1] == n
    t = trie.prefix_trie(rows)
    assert t.count() == n + 1
    assert sorted(map(tuple, t.where("depth < 4").select("depth", "n_convs", "n_leaves", "saved_tokens").collect())) == [(0, 2, 1, 4), (1, 2, 1, 4), (2, 2, 1, 2), (3, 1, 1, 0)]


def test_branched_turns(spark):
    rng = random.Random(5)
    convs = {c: [("u", f"t{c} {i}") for i in range(rng.randrange(1, 6))] for c in [*range(0, 45), 20 * 10**6]}
    convs |= {c: [("u", f"t{c}")] for c in range(61, 70)}
    rows = [(c, i, r, t, None, None) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    turns, every = trie.branched(spark.createDataFrame(rows, TURNS))
    assert order(map(tuple, trie.digest(trie.prefix_trie(turns, every)).collect())) == plain_trie(want)
    assert any(not t for t in want.values())


# Vector codes.


def plain_codes(x, parts, entries, rounds):
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near():
        return np.stack([((x[:, p, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for p, b in enumerate(books)], axis=1)

    for _ in range(rounds):
        code = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    code = near()
    return code, sum(((x[:, p] - b[code[:, p]]) ** 2).sum(axis=1) for p, b in enumerate(books)), books


@pytest.mark.parametrize("size", [1, 3, 40])
def test_codes_against_full_scans(spark, size):
    """Components on few values, so that ties abound."""
    rng = np.random.default_rng(size)
    v = rng.integers(-size, size + 1, (300, 8)) / 64
    rows = [(i, [float(c) for c in r], i % 5 or None, "x") for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string").repartition(4)
    coded, books = vectorcode.encode(df, parts=4, entries=9, rounds=4)
    code, error, want = plain_codes(np.floor(256 * v).astype(int), 4, 9, 4)
    assert (books == want).all()
    got = {r["vec_id"]: r for r in coded.collect()}
    assert all(got[i]["codes"] == code[i].tolist() and got[i]["error"] == error[i] for i in range(300))
    by = defaultdict(int)
    for i in range(300):
        by[i % 5] += int(error[i])
    for r in vectorcode.digest(coded, books).collect():
        i = r["vec_id"]
        assert (r["code"], r["label_error"]) == ("".join(f"{c:02x}" for c in code[i]), by[i % 5])
        assert r["codebooks_sha256"] == sha(",".join(map(str, want.ravel().tolist())))
    back = {r["vec_id"]: r["embedding"] for r in vectorcode.decode(coded, books).collect()}
    assert all((256 * (np.array(back[i]) * 256 - np.floor(256 * v[i])) ** 2).sum() == pytest.approx(256 * error[i]) for i in range(300))


def test_bounds_spare_scans_and_hold(spark):
    rng = np.random.default_rng(0)
    x, old = rng.integers(-200, 200, (2000, 4)), rng.integers(-200, 200, (30, 4))
    code, upper, lower = vectorcode.scan(x, old)
    new = old + rng.integers(-3, 4, old.shape)
    own, others = (m[0] for m in vectorcode.moves(old[None], new[None]))
    found, u, low, full = vectorcode.rescan(x, new, code, upper, lower, own, others)
    d = ((x[:, None] - new[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and full.mean() < 0.5
    rows = np.arange(len(x))
    assert (u.astype(float) ** 2 >= d[rows, found]).all()
    d[rows, found] = 1 << 60
    assert (low.astype(float) ** 2 <= d.min(axis=1)).all()


def test_vectors_that_are_left_out(spark):
    schema = "vec_id long, embedding array<float>, label int"
    good = [0.5, -0.001953125, 0.0, 1.0]
    rows = [(5, good, 1), (5, good, 1), (None, [0.0] * 4, None), (1, None, 1), (2, [0.1, None, 0.0, 0.0], 1), (3, [0.1, float("nan"), 0.0, 0.0], 1), (4, [0.1, float("inf"), 0.0, 0.0], 1), (6, [], 1)]
    df = spark.createDataFrame(rows, schema)
    kept = order(map(tuple, vectorcode.integers(df, parts=2).collect()))
    assert kept == order([(5, [128, -1, 0, 256], "1"), (5, [128, -1, 0, 256], "1"), (None, [0, 0, 0, 0], None)])
    coded, books = vectorcode.encode(df, parts=2)
    # Three vectors, three entries; equal ones share the lower.
    assert books.shape == (2, 3, 2) and order((r["vec_id"], r["codes"], r["error"]) for r in coded.collect()) == order([(5, [0, 0], 0), (5, [0, 0], 0), (None, [2, 2], 0)])
    none, books = vectorcode.encode(df.where("vec_id = 1"), parts=2)
    assert vectorcode.digest(none, books).count() == 0
    for bad in ([(1, [0.0, 1.0], 1), (2, good, 1)], [(1, [0.0] * 3, 1)], [(1, [1e30, 0.0], 1)]):
        with pytest.raises(ValueError):
            vectorcode.encode(spark.createDataFrame(bad, schema), parts=2)


# Line dedup.


def plain_lines(rows, least_chars, least_docs):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != (-1 if d is None else d) for x in lines]
        out.append((d, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return order(out)


DOCS = "doc_id long, text string, dropped int, version string, hash string, lost_id int"


@pytest.mark.parametrize("limit", [linededup.BROADCAST_BYTES, 0])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", limit)
    rng = random.Random(7)
    pool = [f"line {i} " + "ÄöÉx"[i % 4] * 6 for i in range(12)] + ["", " ", "\x85wide　", "short"]

    def line():
        x = rng.choice(pool)
        return rng.choice([x, x.upper() if x.isascii() else x.replace("line", "LINE"), f"\t {x}\r", f"{x}\x0b", x])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (61, None), (62, ""), (63, "\n\n"), (None, rows[5][1]), (None, rows[6][1]), (None, None)]
    df = spark.createDataFrame([(*r, 1, "v", "h", 2) for r in rows], DOCS).repartition(3)
    got = linededup.digest(linededup.drop_repeated_lines(df, least_chars=8, least_docs=4))
    want = plain_lines(rows, 8, 4)
    assert order(map(tuple, got.collect())) == want and sum(r[2] for r in want) > 20
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_an_id_counts_once(spark):
    """Four ids and six rows hold the line: under five documents it stays."""
    text = "a line of more than forty code points, held often"
    rows = [(i, text) for i in (1, 1, 1, 2, 3)] + [(None, text)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], DOCS)
    assert {r["n_dropped"] for r in linededup.drop_repeated_lines(df).collect()} == {0}
    five = df.union(spark.createDataFrame([(4, text + "\nmine", None, None, None, None)], DOCS))
    assert {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(five).collect()} == {1: "", 2: "", 3: "", None: "", 4: text + "\nmine"}


def test_a_text_of_very_many_lines(spark):
    shared = "a line of more than forty code points, which is shared"
    long = "\n".join(x for i in range(100_000) for x in (shared, f"own {i}"))
    rows = [(i, shared) for i in range(10, 20)] + [(1, long)]
    got = linededup.drop_repeated_lines(spark.createDataFrame([(*r, None, None, None, None) for r in rows], DOCS))
    one = got.where("doc_id = 1").first()
    assert one["text"] == "\n".join(f"own {i}" for i in range(100_000)) and (one["n_lines"], one["n_dropped"]) == (200_000, 100_000)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_vector_codes", "op13_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert order(map(tuple, df.select(*columns).collect())) == order(sql.select(*columns).fetchall())
