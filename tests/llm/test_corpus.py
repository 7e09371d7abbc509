"""Operators of the whole corpus against brute force."""

import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tastegrid.llm import bpe, decontam, secrets, simhash, substring, toxicity
from tastegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(w + "x" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with exact and near copies, nulls, empty texts, repeated ids and rows."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(60)]
    texts += [texts[i % 7] for i in range(25)] + [edited(rng, texts[i % 9], 0.004) for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (501, "", "en", "s", 0), (None, texts[0], "en", "s", 1), (None, prose(rng, 50), "en", "s", 1), (3, texts[30], "en", "s", 1), (502, prose(rng, 20_000), "en", "s", 1)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


# SimHash.


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{fp[i]:016x}", least.get(root(i)), root(i)) for i, (d, _) in enumerate(rows)]


def test_components_equal_brute_force(corpus, empty):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = order(r[:3] for r in map(tuple, simhash.digest(simhash.near_duplicates(corpus)).collect()))
    assert got == order(r[:3] for r in plain_components(rows))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n,scale", [(400, 1), (400, 100_000)])
def test_links_equal_brute_force_under_any_plan(spark, n, scale):
    rng = np.random.default_rng(n + scale)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    fps = sorted({int(x) for x in base} | {int(rng.choice(base)) ^ int(sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(1, 5))})) for _ in range(n)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    count, both = simhash.bit_statistics(df)
    assert count == len(fps)
    plan = simhash.allocate(count * scale, both * scale)
    assert sum(t for _, t in plan) >= 3 - simhash.MOST_PARTS + 1
    m64 = (1 << 64) - 1
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & m64).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(df, plan).collect()} == want


def test_pigeonhole_sum():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    for n in (500, 10**6, 10**9, 10**12):
        both = (x.T @ x * n / 500).astype(np.int64)
        plan = simhash.allocate(n, both)
        for _ in range(300):
            flips = set(rng.choice(64, 3, replace=False).tolist())
            assert any(len(flips & set(part)) <= t for part, t in plan)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_one_document_of_each_group_stays(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    kept = simhash.deduplicate(corpus)
    assert kept.columns == corpus.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {}
    for x, (_, _, c, root) in zip(rows, plain_components(rows)):
        groups.setdefault((c, root), []).append(x)
    assert len(found) == len(groups)
    for (c, _), members in groups.items():
        assert len([x for x in found if x in members and x[0] == c]) == 1


# Decontamination.


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_leaks(docs, items):
    out = set()
    for d, t in docs:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        for i, s in items:
            want = shingles(s)
            if not want:
                continue
            n = len(next(iter(want)))
            have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if (m := len(want & have)) >= 0.8 * len(want):
                out.add((d, i, m, len(want)))
    return out


def test_leaks_equal_brute_force(spark, corpus, empty):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 15, 40, 41, 60] * 3)] + [(90, None), (91, ""), (92, "..."), (5, prose(rng, 12)), (7, None)]
    docs = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    for k, (_, t) in enumerate(x for x in items if x[1]):
        w = t.split()
        docs.append((1000 + k, f"{prose(rng, 30)} {t.upper()}, {prose(rng, 30)}"))
        docs.append((2000 + k, f"{prose(rng, 500)} {' '.join(w[: max(1, int(len(w) * 0.9))])}. {prose(rng, 5)}"))
        docs.append((3000 + k, f"{prose(rng, 9)} {' '.join(w[: len(w) // 2])} {prose(rng, 5)}"))
        docs.append((4000 + k, f"{prose(rng, 9)} {edited(rng, t, 0.05)}"))
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as hash")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r["doc_id"], r["item_id"], r["shared"], r["n_shingles"]) for r in decontam.contained(a, b).collect()}
    assert got == plain_leaks(docs, items) and len(got) > 40
    assert decontam.contained(empty, b).count() == decontam.contained(a, b.where("false")).count() == 0


def test_leaks_without_broadcasts(spark, corpus, monkeypatch):
    items = corpus.where("doc_id < 5").selectExpr("doc_id as item_id", "text")
    want = order(map(tuple, decontam.contained(corpus, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontam, "BROADCAST_SUSPECTS", 0)
    assert want == order(map(tuple, decontam.contained(corpus, items).collect()))


def test_decontamination_keeps_the_rest(corpus):
    items = corpus.where("doc_id = 3").selectExpr("doc_id as item_id", "text")
    kept = decontam.decontaminate(corpus, items)
    bad = {d for d, *_ in plain_leaks([(r["doc_id"], r["text"]) for r in corpus.collect()], [(r["item_id"], r["text"]) for r in items.collect()])}
    want = [r for r in corpus.collect() if r["doc_id"] is None or r["doc_id"] not in bad]
    assert order(map(tuple, kept.collect())) == order(map(tuple, want)) and kept.columns == corpus.columns


# Substrings.


@pytest.fixture(scope="module")
def passages(spark):
    """Documents of their own words with planted passages: (documents, {passage: holders})."""
    rng = random.Random(9)
    planted = {p: prose(rng, 60 + 15 * p) for p in range(8)}
    holders, rows = {p: [] for p in planted}, []
    for d in range(80):
        p = d % 10
        text = prose(rng, rng.randrange(20, 200))
        if p in planted:
            body = planted[p] if d % 3 else edited(rng, planted[p], 0.04)
            text = f"{prose(rng, rng.randrange(5, 100))} {body} {text}"
            holders[p].append(d)
        rows.append((d, text))
    rows += [(200, rows[8][1]), (201, rows[8][1]), (202, None), (203, ""), (None, rows[9][1]), (204, prose(rng, 20_000)), (8, rows[8][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "'k' as seed"), holders


def test_planted_passages_are_found(passages, spark):
    docs, holders = passages
    rows = substring.repeated_passages(docs).collect()
    near = [r for r in rows if r["kind"] == "passage"]
    for p, own in holders.items():
        found = {x for r in near if r["doc_id"] in own and r["ref_doc_id"] in own for x in (r["doc_id"], r["ref_doc_id"])}
        assert found == set(own), p
    linked = {d: p for p, own in holders.items() for d in own}
    for r in near:
        assert linked[r["doc_id"]] == linked[r["ref_doc_id"]]
        assert r["end_word"] - r["start_word"] >= substring.MIN_WORDS and r["similarity"] >= substring.SIMILARITY
    assert {(r["doc_id"], r["ref_doc_id"], r["start_word"]) for r in rows if r["kind"] == "copy"} == {(200, 8, 0), (201, 8, 0), (203, 202, 0)}
    assert substring.repeated_passages(docs.where("false")).count() == 0


def test_passages_without_broadcasts(passages, monkeypatch):
    docs, _ = passages
    want = order(map(tuple, substring.repeated_passages(docs).collect()))
    monkeypatch.setattr(substring, "bounded_bytes", lambda *a: False)
    assert want == order(map(tuple, substring.repeated_passages(docs).collect()))


def shared_words(spark, texts):
    """(doc_id, ref_doc_id, the passage's words) of each passage of a few texts."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substring.repeated_passages(docs).where("kind = 'passage'").collect()
    return [(r["doc_id"], r["ref_doc_id"], *texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]]) for r in found]


def holds(found, passage):
    return any(" ".join(words).find(passage) >= 0 for _, _, *words in found)


def test_passages_near_each_other_are_found(spark):
    """Two passages, and a passage and a shared line, with other words between them, are not one passage."""
    rng, texts, cases = random.Random(21), [], []
    for first, gap, second in ((60, 50, 60), (100, 60, 100), (60, 40, 20), (60, 80, 20)):
        x, y = prose(rng, first), prose(rng, second)
        texts += [f"{prose(rng, 40)} {x} {prose(rng, gap)} {y} {prose(rng, 40)}" for _ in range(2)]
        cases.append((len(texts) - 1, x, y if second >= 50 else None))
    found = shared_words(spark, texts)
    for d, x, y in cases:
        own = [r for r in found if d in r[:2]]
        assert holds(own, x) and (y is None or holds(own, y)) and len(own) == (1 if y is None else 2), d


@pytest.mark.parametrize("lines,words", [(3, 20), (3, 30), (4, 25)])
def test_lines_that_others_hold_part_no_two_texts(lines, words):
    """Two texts that share a passage are linked by it, though texts of lesser keys hold its lines singly."""
    rng = random.Random(lines * words)
    for _ in range(30):
        own = [prose(rng, words) for _ in range(lines)]
        texts = [f"{prose(rng, 30)} {x} {prose(rng, 30)}" for x in own] + [f"{prose(rng, 30)} {' '.join(own)} {prose(rng, 30)}" for _ in range(2)]
        rows = []
        for key, text in enumerate(texts):
            seed, at = substring.seeds_of(text)
            run, first = substring.runs_of(seed, at)
            rows += [(s | 1, key, p) for s, p in zip(run.tolist(), first.tolist())]
        seed, key, _ = (np.array(x) for x in zip(*sorted(rows)))
        i, j = substring.links(seed, key, np.zeros(len(seed), bool))
        assert (lines + 1, lines) in set(zip(key[i].tolist(), key[j].tolist()))


def passages_of(a, b):
    """Passages of two texts that hold no seed twice, from all the seeds and runs they share."""
    sides = []
    for text in (a, b):
        seed, at = substring.seeds_of(text)
        run, first = substring.runs_of(seed, at)
        sides.append((dict(zip(seed.tolist(), at.tolist())), dict(zip(run.tolist(), first.tolist()))))
    runs = {sides[0][1][s] for s in sides[0][1].keys() & sides[1][1].keys()}
    pairs = sorted({(one[s], two[s]) for one, two in zip(*sides) for s in one.keys() & two.keys()})
    out, (x, y) = [], (substring.words_of(a), substring.words_of(b))
    p, r = (np.array([q[i] for q in pairs], np.int64) for i in (0, 1))
    for own in substring.chain(p, r) if pairs else []:
        long = len(own) > 1 and p[own[-1]] - p[own[0]] >= substring.MIN_WORDS - substring.EXTEND - substring.K
        if long or not runs.isdisjoint(p[own].tolist()):
            i, j = (max(0, int(q[own[0]]) - substring.EXTEND) for q in (p, r))
            u, v = (int(q[own[-1]]) + substring.K + substring.EXTEND for q in (p, r))
            found = substring.pieces(x[i:u], y[j:v], [(int(p[k]) - i, int(r[k]) - j) for k in own])
            out += [(i + s, i + e, j + t, j + f) for s, e, t, f, _ in found]
    return out


def test_many_holders_lose_no_link(spark):
    """Where many texts hold each part of a passage, two that hold it whole, or nearly, are linked or of one class."""
    rng, texts, whole = random.Random(33), [], []
    for case in range(6):
        words = prose(rng, 64).split()
        parts = [words[i : i + 40] for i in (0, 8, 16, 24)] if case < 4 else [words[i : i + 26] for i in (0, 13, 26, 38)]
        for part in parts:
            texts += [f"{prose(rng, 30)} {' '.join(part)} {prose(rng, 30)}" for _ in range(14)]
        for _ in range(2):
            body = " ".join(words) if case < 4 else " ".join(w if k not in (13, 31, 49) else prose(rng, 1) for k, w in enumerate(words))
            texts.append(f"{prose(rng, 30)} {body} {prose(rng, 30)}")
        whole.append((len(texts) - 2, len(texts) - 1))
    rows = substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    linked = {frozenset((r["doc_id"], r["ref_doc_id"])) for r in rows}
    assert all(frozenset(x) in linked for x in whole)
    spans = [(r["doc_id"], r["start_word"], r["end_word"], r["class_doc_id"], r["class_start_word"]) for r in rows]
    spans += [(r["ref_doc_id"], r["ref_start_word"], r["ref_end_word"], r["class_doc_id"], r["class_start_word"]) for r in rows]

    def classes(d, x, z):
        return {s[3:] for s in spans if s[0] == d and s[1] < z and x < s[2]}

    for d in range(len(texts)):
        for e in range(d):
            for x, z, y, w in passages_of(texts[d], texts[e]):
                assert frozenset((d, e)) in linked or classes(d, x, z) & classes(e, y, w), (d, e)


@pytest.mark.parametrize("seed", range(4))
def test_unlinked_pairs(seed):
    """Of the holders of a code all pairs come but those of the same class, and those without a seed far enough off."""
    rng = random.Random(seed)
    rows = sorted((rng.randrange(6), k, rng.choice([0, 0, 7, 8]), rng.random() < 0.5) for k in range(60))
    rows += [(9, k, 5, True) for k in range(40)] + [(10, k, 0, True) for k in range(1200)]
    want = {
        (max(a[1], b[1]), min(a[1], b[1]))
        for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and (a[3] or b[3]) and (a[2] != b[2] or not a[2])
    }
    got = [(k, r) for part in substring.unlinked(*(np.array(x) for x in zip(*rows))) for k, r in zip(*(x.tolist() for x in part))]
    assert set(got) == want


def test_codes_of_classes():
    """Runs and two seeds far enough apart are codes of the class that covers them, of none if their places differ."""
    rows = [  # key, pos, end, seed, kind
        (1, 0, 60, 77, 2), (1, 5, 0, 11, 1), (1, 5, 0, 20, 1), (1, 25, 0, 22, 0), (1, 62, 0, 24, 0),
        (2, 5, 0, 11, 1), (2, 5, 0, 20, 1), (2, 12, 0, 22, 0), (2, 400, 0, 24, 0),
    ]
    code, key, both, far = (x.tolist() for x in substring.codes(*(np.array(x, np.int64) for x in zip(*rows))))
    got = {(c, k): (b, f) for c, k, b, f in zip(code, key, both, far)}
    assert len(got) == len(code) == 5
    assert got[11, 1] == (77, True) and got[11, 2] == (0, True)
    two = substring._mixed(np.array([20]), np.array([22]))[0]
    assert got[two, 1][0] != 0 and got[two, 1][1] and got[two, 2] == (0, False)
    assert got[substring._mixed(np.array([20]), np.array([24]))[0], 1] == (0, True)


def best_chain(p, r):
    """The best chain's score by trying all predecessors."""
    best = {}
    for i in sorted(range(len(p)), key=lambda i: (p[i], -r[i])):
        best[i] = float(substring.K)
        for j in best:
            dx, dy = p[i] - p[j], r[i] - r[j]
            if j != i and dx > 0 and dy > 0:
                best[i] = max(best[i], best[j] - substring.GAP_COST * (dx + dy) + min(substring.K, dx, dy))
    return max(best.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=14, unique=True))
def test_chains_are_in_order(points):
    scaled = [(7 * a, 7 * b) for a, b in points]  # far enough apart that a match counts in full
    p, r = (np.array(x) for x in zip(*scaled))
    chains = substring.chain(p, r)
    assert sorted(i for c in chains for i in c) == list(range(len(points)))
    for c in chains:
        assert (np.diff(p[c]) > 0).all() and (np.diff(r[c]) > 0).all()
    first = chains[0]
    score = substring.K * len(first) - substring.GAP_COST * (p[first[-1]] - p[first[0]] + r[first[-1]] - r[first[0]])
    assert score == pytest.approx(best_chain(p.tolist(), r.tolist()))


@pytest.mark.parametrize("first,gap,shift", [(60, 150, 0), (300, 500, 7), (1000, 1500, -40)])
def test_a_strong_chain_hides_no_later_one(first, gap, shift):
    """A later passage's matches follow each other, however strong a chain too far before them is."""
    p = np.array([*range(0, first, 6), *range(first + gap, first + gap + 60, 6)])
    r = p + np.where(p < first, 0, shift)
    assert sorted(len(c) for c in substring.chain(p, r)) == sorted([len(range(0, first, 6)), 10])


@pytest.mark.parametrize("seed", range(6))
def test_matches_that_cannot_chain_are_known(seed):
    """Chains of several matches are the same without those that belong to none, and of far ones none is looked at."""
    rng, lone = random.Random(seed), 0
    for spread in (60, 400, 3000):
        sets = [sorted({(rng.randrange(spread), rng.randrange(spread)) for _ in range(rng.randint(1, 30))}) for _ in range(60)]
        pair = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        p, r = (np.array([m[i] for x in sets for m in x]) for i in (0, 1))
        keep = substring.chainable(pair, p, r)
        lone += (~keep).sum()
        for k in range(len(sets)):
            both = []
            for own in (np.flatnonzero(pair == k), np.flatnonzero((pair == k) & keep)):
                chains = substring.chain(p[own], r[own]) if len(own) else []
                both.append(sorted(own[c].tolist() for c in chains if len(c) > 1))
            assert both[0] == both[1]
    assert lone > 100
    far = np.arange(50) * 100
    assert not substring.chainable(np.zeros(50, int), far, far).any() and not len(substring.chainable(far[:0], far[:0], far[:0]))


@pytest.mark.parametrize("seed", range(3))
def test_passages_by_runs_and_by_words(seed):
    """Few and many runs are searched in different ways with the same passages."""
    rng = random.Random(seed)
    several = 0
    for _ in range(400):
        runs, i, j = [], 0, 0
        for _ in range(rng.randint(1, substring.FEW_RUNS)):
            g = rng.choice([0, 0, 1, 1, 2, 5, 20])
            h = rng.choice([g, g, 0, 1, 3, 30])
            i, j = i + g + (not g and not h), j + h
            n = rng.choice([1, 1, 2, 4, 8, 15, 30, 60])
            runs.append((i, j, n))
            i, j = i + n, j + n
        if sum(n for _, _, n in runs) >= substring.MIN_WORDS * substring.SIMILARITY:
            found = substring._by_runs(runs)
            assert found == substring._by_words(runs)
            several += len(found) > 1
    assert several > 50


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_matched_words(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    found = substring.matched_words(a, b)
    assert len(found) == t[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(x < z and y < w for (x, y), (z, w) in zip(found, found[1:]))


@settings(deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 30))
def test_alignment_is_in_order(seed, percent):
    rng = random.Random(seed)
    a = [rng.choice("abcdefghijkl") + str(rng.randrange(30)) for _ in range(rng.randrange(1, 300))]
    b = [w + "x" if rng.randrange(100) < percent else w for w in a if rng.randrange(100) >= percent]
    anchors, last = [], (-1, -1)
    for i in range(0, len(a) - 4, 7):
        for j in range(last[1] + 1, len(b) - 4):
            if a[i : i + 5] == b[j : j + 5]:
                anchors.append((i, j))
                last = (i, j)
                break
    runs = substring.alignment(a, b, anchors)
    for i, j, n in runs:
        assert n > 0 and a[i : i + n] == b[j : j + n]
    assert all(i + n <= x and j + n <= y for (i, j, n), (x, y, _) in zip(runs, runs[1:]))
    if not percent:
        assert sum(n for _, _, n in runs) == len(a)


def test_words_are_cut_alike(spark):
    texts = ["A  b\tC\n", "", " é x y ", "İI", "a\x1cb \x0b\x0c c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(substring._words(F.col("text"))).collect()]
    assert got == [[w.decode() for w in substring.words_of(t)] for t in texts]


# Toxicity.


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    bad = ["vilewort", "scumbag", "nastyfool"]
    rows, labels = [], []
    for d in range(600):
        words = prose(rng, rng.randrange(30, 120)).split()
        toxic = d % 4 == 0
        if toxic:
            for _ in range(max(3, len(words) // 12)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((d, " ".join(words), "en", "s", 0))
        if d % 5:
            labels.append((d, 1, int(toxic)))
    labels += [(None, 1, 1), (1, None, None), (9999, 1, 1)]
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, labelled, empty):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    more = docs.unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (7000, "", "en", "s", 0)], COLUMNS))
    rows = toxicity.score(more, model).collect()
    assert len(rows) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in held}
    right = sum((r["doc_id"] % 4 == 0 and r["doc_id"] < 600) == bool(r["predicted"]) for r in held)
    assert right / len(held) > 0.97
    assert toxicity.score(empty, model).count() == 0
    kept = toxicity.accepted(docs, model)
    gone = {r["doc_id"] for r in rows if r["predicted"]}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(600)) - gone


def test_held_out_labels_are_not_learnt(labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_without_labels(labelled, empty):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.fit(empty, labels).weights == (0.5,)


def plain_score(model, text):
    """The score from the formulas alone: every window compressed with both dictionaries, none left out or remembered."""
    import zstandard as z

    params = z.ZstdCompressionParameters.from_level(
        toxicity.LEVEL, min_match=toxicity.MATCH, strategy=z.STRATEGY_LAZY2, window_log=17, hash_log=14, chain_log=14,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS,
    )

    def size(content, window):
        d = z.ZstdCompressionDict(content + toxicity.BALLAST, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(compression_params=params, dict_data=d).compress(window + toxicity.BALLAST))

    windows = [f" {w} ".encode() for w in re.findall(r"\w+", text.lower())]
    shares = sorted((round(100 * (size(model.ordinary, w) - size(model.toxic, w)) / len(w)) for w in windows), reverse=True)
    x = [1.0]
    for t, p in zip(model.thresholds, model.chances):
        n = len(shares)
        beyond = sum(v >= t for v in shares) - n * p
        dense = 100 * max(0, beyond) / max(50, n)
        x += [np.clip(beyond / np.sqrt(n * p + 0.5), -6, 6), min(20, dense), np.sqrt(dense)]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))


def test_scores_equal_those_of_all_windows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert model.toxic and model.ordinary and toxicity.Model.loads(model.dumps()) == model
    texts = [r["text"] for r in docs.limit(6).collect()] + ["", "a", "É x9 _ vilewort"]
    for t in texts:
        assert model.scorer().score(t) == pytest.approx(plain_score(model, t), abs=1e-9)


def test_very_long_texts_are_scored_by_all_their_windows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rng = random.Random(8)
    clean = prose(rng, 40_000)
    bad = " ".join(w + " vilewort" if i % 12 == 0 else w for i, w in enumerate(clean.split()))
    late = clean + " " + " ".join(f"{w} scumbag" for w in prose(rng, 3_000).split())
    rows = spark.createDataFrame([(1, clean, "en", "s", 0), (2, bad, "en", "s", 0), (3, late, "en", "s", 0)], COLUMNS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(rows, model).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_order_of_texts_does_not_matter():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    sample = [(int(i % 3 == 0), " ".join(rng.choices(words, k=60)) + (f" zor{i % 7}gh grimfoul" if i % 3 == 0 else "")) for i in range(150)]
    model = toxicity.train(sample)
    for _ in range(2):
        rng.shuffle(sample)
        assert toxicity.train(sample) == model
    # What training sees first does not follow the alphabet: the first half in order holds texts of all beginnings.
    firsts = [t for _, t in toxicity.by_hash([(0, f"{i:03d}") for i in range(200)])][:100]
    assert 60 < sum(map(int, firsts)) / 100 < 140
    several = toxicity.joined([toxicity.train(sample, i) for i in range(3)])
    assert len(several.others) == 2 and toxicity.Model.loads(several.dumps()) == several
    odds = []
    for m in (several, *several.others):
        p = toxicity.Scorer(toxicity.replace(m, others=())).score(sample[0][1])
        odds.append(math.log(p / (1 - p)))
    p = several.scorer().score(sample[0][1])
    assert abs(math.log(p / (1 - p)) - sum(odds) / 3) < 1e-6


def test_few_labels_and_the_sample_bound(labelled, monkeypatch):
    """Without a text of either label in each part scores are constant; a text beyond the characters left is not in the sample."""
    docs, labels = labelled
    few = toxicity.fit(docs, labels.where("doc_id in (4, 8, 1, 2)"))
    assert not few.thresholds and 0 <= few.weights[0] <= 1
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 0)
    assert toxicity.fit(docs, labels).weights == (0.5,)


# Queries and the pipeline.

pytestmark = []
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_return_a_row_for_each_document(spark, name):
    df = QUERIES[name](spark, SF)
    n = df.count()
    if name in ("op3_substring_dedup", "op4_decontamination", "op7_chat_windows", "op11_prefix_trie"):
        assert n > 0
    else:
        table = "embeddings" if name == "op12_vector_codes" else "documents"
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()


@needs_tables
def test_queries_equal_their_sql(spark):
    import duckdb

    from tastegrid.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    for name, sql in ORACLES.items():
        df, want = QUERIES[name](spark, SF), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns), name
        assert order(map(tuple, df.select(*columns).collect())) == order(want.select(*columns).fetchall()), name


@needs_tables
def test_pipeline_equals_its_stages_by_brute_force(spark):
    import public_tokenizers

    from tastegrid.llm.queries import vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = [x for x in rows if scorer.score(x[1]) < toxicity.REJECT]
    first = [x for x, (d, _, c, _) in zip(clean, plain_components(clean)) if d == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in plain_leaks(first, items)}
    kept = spark.createDataFrame([x for x in first if x[0] not in leaks], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(kept).collect()}
    lib = bpe.encoder(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: lib.encode_ordinary(t) for d, t in masked.items()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]
