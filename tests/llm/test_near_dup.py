"""Operator 10 against brute force, and its parts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from llm_samples import WORDS, documents, prose  # noqa: F401
from sqlgauge.llm import graph
from sqlgauge.llm import near_dup as ND
from sqlgauge.llm import textvec as V


def word_sets(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: word_sets(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k] = rng.choice(WORDS) + str(rng.randrange(50))
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one\x0btwo", "one two three", "É é", "é É"]
    for _ in range(8):  # groups of copies at all distances, and chains of edits
        base = prose(rng, rng.randint(20, 120)).split()
        texts += [" ".join(base)] * 3 + ["\n".join(base).upper()]
        texts += [" ".join(edited(rng, base, rng.randint(1, len(base) // 5))) for _ in range(25)]
        chain = base
        for _ in range(8):
            chain = edited(rng, chain, max(1, len(base) // 25))
            texts.append(" ".join(chain))
    texts += [prose(rng, 30) for _ in range(60)]
    texts.append(" ".join(base * 300))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(7 * i + 1, texts[i]) for i in order]


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(documents, rows, size):
    got = ND.near_duplicates(documents(rows), words=size).collect()
    want = brute(rows, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_give_what_pairs_give(documents, rows, monkeypatch):
    want = brute(rows, 2)
    monkeypatch.setattr(ND, "HOT", 3)  # nearly all entries are compared in blocks
    monkeypatch.setattr(ND, "BLOCK", 8)
    got = ND.near_duplicates(documents(rows), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_repeated_rows_null_ids_and_empty_tables(documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A B C D E F"), (2, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in ND.near_duplicates(documents(rows)).collect())
    assert got == [("2", 2, True), ("5", 5, True), ("5", 5, True), ("9", 5, False), ("None", None, True)]
    assert ND.near_duplicates(documents([])).count() == 0
    left = ND.drop_near_duplicates(documents(rows))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "5", "5", "None"]
    assert left.columns == documents(rows).columns


def test_every_pair_within_the_distance_shares_an_entry():
    rng = np.random.RandomState(5)
    a = rng.randint(0, 1 << 16, (400, ND.SLOTS)).astype(np.uint16)
    b = a.copy()
    for k in range(len(b)):
        wrong = rng.choice(ND.SLOTS, ND.CHUNKS * (ND.ERRORS + 1) - 1, replace=False)
        b[k, wrong] ^= 1
    assert (ND.index_entries(a) == ND.index_entries(b)).any(axis=1).all()


def test_signature_distance_follows_similarity():
    rng = random.Random(6)
    texts = []
    for _ in range(200):
        base = prose(rng, 200).split()
        texts += [" ".join(base), " ".join(edited(rng, base, 8))]
    raw, off = V.text_bytes(pa.array(texts))
    sets, cut = ND.shingles(raw, off, 3)
    sig = ND.signatures(sets, cut)
    far = []
    for k in range(0, len(texts), 2):
        x, y = set(sets[cut[k]:cut[k + 1]].tolist()), set(sets[cut[k + 1]:cut[k + 2]].tolist())
        far.append((sig[k] != sig[k + 1]).mean() - (1 - len(x & y) / len(x | y)))
    assert abs(np.mean(far)) < 0.02


def test_block_intersections(monkeypatch):
    monkeypatch.setattr(ND, "COLUMNS", 7)
    rng = np.random.RandomState(1)
    make = lambda n: [np.unique(rng.randint(0, 60, rng.randint(1, 40))) for _ in range(n)]
    pack = lambda s: (np.arange(len(s)), np.arange(len(s)), np.concatenate([[0], np.cumsum([len(x) for x in s])]),
                      np.concatenate(s))
    x, y = make(9), make(5)
    want = [[len(np.intersect1d(p, q)) for q in y] for p in x]
    assert ND._common(pack(x), pack(y)).tolist() == want


def test_components_of_chains_stars_and_rings(spark):
    n = 40
    links = [(i, i + 1) for i in range(1, n)] + [(1000, 1000 + i) for i in range(1, 30)]
    links += [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(1, 1)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, n + 1)} == {1}
    assert {got[1000 + i] for i in range(30)} == {1000} and {got[2000 + i] for i in range(7)} == {2000}
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert graph.components(empty).count() == 0


def test_words_that_share_a_polynomial_hash_stay_apart(documents):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    two = "".join("ba"[bin(k).count("1") % 2] for k in range(1024))
    raw, off = V.text_bytes(pa.array([one, two]))
    pre = V.prefix_hash(raw)
    assert len(set(V.span_hash(pre, off[:-1], off[1:]).tolist())) == 1  # what the test is about
    assert len(set(V.byte_hash(raw, off[:-1], off[1:]).tolist())) == 2
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one} {two} {one}"), (5, one.upper())]
    got = ND.near_duplicates(documents(rows), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)


def test_planted_pairs_near_the_threshold_share_an_entry_within_the_distance():
    rng = np.random.RandomState(8)
    found = 0
    for k in range(2000):  # 400 shared of 500 shingles: similarity 0.8
        pool = rng.randint(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
        x, y = np.sort(pool[:450]), np.sort(np.concatenate([pool[:400], pool[450:]]))
        a, b = ND.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        shares = (ND.index_entries(a[None]) == ND.index_entries(b[None])).any()
        assert shares or (a != b).sum() > ND.DISTANCE
        found += bool(shares and (a != b).sum() <= ND.DISTANCE)
    assert found >= 1995


def test_links_grow_in_proportion_to_a_group_of_near_copies(spark, documents, monkeypatch):
    """Near copies of one text: rows that are walked grow with the group, not with its square."""
    walked = []
    real = graph.written

    def counting(df, name, path=None):
        out = real(df, name, path)
        if name in ("edges", "moves", "joined"):
            walked.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counting)
    totals = []
    for n in (250, 1000):
        rng = random.Random(4)
        base = prose(rng, 100).split()
        rows = [(k, " ".join(edited(rng, base, rng.randint(1, 8)))) for k in range(n)]
        walked.clear()
        got = ND.near_duplicates(documents(rows), words=2).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)
        totals.append(sum(walked))
    assert totals[1] <= 6 * totals[0], totals


def test_spanning_links_join_all_and_no_more():
    left, right = np.array([1, 1, 2, 3, 5]), np.array([2, 2, 3, 1, 6])
    assert ND.spanning(left, right) == [0, 2, 4]


def test_no_plan_has_a_cross_join(documents, rows):
    plan = ND.near_duplicates(documents(rows[:40]))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_merging_components_equals_walking_all_links(spark):
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    kind = "a bigint, b bigint"
    whole = {r.node: r.component for r in graph.components(spark.createDataFrame(links, kind)).collect()}
    labels = None
    for k in range(0, 220, 55):
        labels = graph.merge_components(labels, spark.createDataFrame(links[k:k + 55], kind))
    assert {r.node: r.component for r in labels.collect()} == whole


def test_tables_of_unknown_size_are_joined_by_key(documents, rows, monkeypatch):
    """Spark sizes the exploded index as one entry per document; sent to all tasks it would fill the driver."""
    plans = {}
    real = graph.Scratch.written

    def spy(self, df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return real(self, df, name)

    monkeypatch.setattr(graph.Scratch, "written", spy)
    got = ND.near_duplicates(documents(rows), words=2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 2)
    [members], [sets] = plans["members"], plans["sets"]
    assert "SortMergeJoin [entry" in members and "BroadcastHashJoin [entry" not in members
    assert "SortMergeJoin [doc_id" in sets and "Broadcast" not in sets
    for name in ("links", "labels"):  # (the last links are of the entries compared in blocks)
        assert all("BroadcastHashJoin" not in p for p in plans[name][:2]), name
    assert "BroadcastHashJoin" not in plans["edges"][0]  # later rounds know how few edges are left


def test_components_of_more_edges_than_are_sent(spark, monkeypatch):
    """Every round joined by key gives the same components."""
    links = spark.createDataFrame([(k, k + 1) for k in range(60) if k % 7], "a bigint, b bigint")
    got = {}
    for few in (0, 10**6):
        monkeypatch.setattr(graph, "FEW", few)
        got[few] = {r.node: r.component for r in graph.components(graph.written(links, "links")).collect()}
    root = {}
    for a, b in sorted((r.a, r.b) for r in links.collect()):
        root[b] = root.setdefault(a, a)
    assert got[0] == got[10**6] == root
