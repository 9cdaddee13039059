"""Operator 13 against brute force, and its residue products against whole numbers."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from sqlgauge.llm import hard_negatives as HN

SCHEMA = "vec_id bigint, label int, embedding array<float>, rank string, score string, anchor_id string"


def brute(rows, is_anchor, n_pos, n_neg, low=30, high=90):
    good = []
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(
                x is not None and math.isfinite(x) for x in v):
            good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for i, label, v in sorted(good):
        if is_anchor(i):
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other)
                        for i, other, w in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            found = [(-n, i) for n, i, other in scored
                     if other != label and low * -s <= 100 * -n <= high * -s][:n_neg]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(found)]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                  for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(600):
        c = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.8), 1) for x in c]  # coarse: many ties
        rows.append((i - 100, rng.randrange(4), v))
    rows += [rows[50], rows[150], (20, 3, [1.0] * 8)]  # repeated ids
    rows += [(None, 1, [1.0] * 8), (900, None, [1.0] * 8), (910, 1, None), (920, 1, [1.0, None] * 4),
             (930, 1, [float("nan")] * 8), (940, 2, [float("inf")] * 8), (950, 2, [1.0] * 3), (960, 1, [0.9] * 3),
             (970, 2, [-1.0, 0.0, 0.0]), (980, 1, []), (990, 1, [3e38] * 8)]
    return rows


@pytest.mark.parametrize("tile", [4096, 50])
def test_equals_brute_force(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(HN, "TILE", tile)
    monkeypatch.setattr(HN, "ANCHOR_BLOCK", 16)
    monkeypatch.setattr(HN, "FAN", 2)
    got = result(HN.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, 3, 4))
    assert got == brute(rows, lambda i: i % 10 == 0, 3, 4)


def test_defaults_and_empty_tables(spark, rows):
    few = [r for r in rows if r[0] != 990]
    got = result(HN.hard_negatives(table(spark, few), F.col("vec_id") % 100 == 0))
    assert got == brute(few, lambda i: i % 100 == 0, 5, 10) and got
    assert HN.hard_negatives(table(spark, few), F.lit(False)).count() == 0
    assert HN.hard_negatives(table(spark, few).where("false"), F.lit(True)).count() == 0
    assert HN.hard_negatives(table(spark, [(1, 1, [1.0])]), F.lit(True)).count() == 0


@pytest.mark.parametrize("columns,most", [(1, 3), (64, 256), (64, 2**20), (300, 2**31), (2500, 200), (5, 2**53),
                                          (3, 1e30), (2, 1e300)])
def test_residue_products_are_exact(columns, most):
    rng = np.random.RandomState(columns)
    q, c = (np.floor(rng.uniform(-most, most, (n, columns))) for n in (7, 9))
    whole = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in c] for a in q]
    want = np.clip(np.array(whole, dtype=object), -2**63, 2**63 - 1).astype(np.int64)
    assert (HN.products(q, c) == want).all()


def test_moduli_keep_partial_sums_exact():
    for columns in (1, 64, 1024):
        primes = HN.moduli(10**12, columns)
        assert math.prod(primes) > 2 * 10**12 and len(set(primes)) == len(primes)
        assert all(columns * (p // 2) ** 2 < 2**24 for p in primes)
    assert HN.moduli(10**600, 64) == []


def test_extreme_scores_and_windows():
    scores = np.array([[2**63 - 1, -2**63, 5, 5, -7]], dtype=np.int64)
    ids = np.array([1, 2, 3, 4, 5])
    s, i, o = HN.pick(scores, np.array([[True, True, True, True, False]]), ids, 4)
    assert i[o].tolist() == [1, 3, 4, 2]
    for p in (-11, 0, 1, 7, 333, 2**40):
        lo, hi = HN.window(p, 30, 90)
        for n in range(lo - 3, min(hi, lo + 50) + 3):
            assert (lo <= n <= hi) == (30 * p <= 100 * n <= 90 * p)
