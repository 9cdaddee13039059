"""A third of all rows on one key: results stay exact and whole."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from sqlgauge.operators import report as RP
from sqlgauge.operators import score as S
from sqlgauge.operators import validate as V
from sqlgauge.sources.tables import ForeignKey

N = 30_000


def _skewed(spark):
    # key 7 holds a third of the rows; key -1 (hot orphan) another sixth
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(7))
        .when(F.col("id") % 6 == 1, F.lit(-1))
        .otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("v"))


def test_fk_check_hot_key(spark):
    child = _skewed(spark)
    parent = spark.range(1000).select(F.col("id").alias("pk"))
    r = V.fk_check({"c": child, "p": parent}, [ForeignKey("c", ("k",), "p", ("pk",))]).first()
    want_orphans = sum(1 for i in range(N) if i % 3 != 0 and i % 6 == 1)
    assert (r["n_child_rows"], r["n_orphan_rows"], r["n_orphan_keys"]) == (N, want_orphans, 1)
    plan = V.fk_check({"c": child, "p": parent},
                      [ForeignKey("c", ("k",), "p", ("pk",))])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan          # map-side combine before the shuffle


def test_pk_check_hot_duplicate(spark):
    r = V.pk_check({"t": _skewed(spark)}, {"t": ("k",)}).first()
    assert r["verdict"] == "duplicate key" and r["n_rows"] == N


def test_scoring_hot_row(spark, tmp_path):
    # one row repeated for a third of a 30k-row result, the copy one short
    rows = spark.range(N).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                 .otherwise(F.col("id").cast("string")).alias("row"))
    a = rows.withColumn("run_id", F.lit("a"))
    b = rows.where(F.col("row") != "hot").unionByName(
        spark.range(N // 3 - 1).select(F.lit("hot").alias("row"))).withColumn("run_id", F.lit("b"))
    c = rows.withColumn("run_id", F.lit("c"))
    results = a.unionByName(b).unionByName(c).select("run_id", F.to_json(F.array("row")).alias("row"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "gold_run_id string, gen_run_id string")
    eq = {(r["gold_run_id"], r["gen_run_id"]): r["equal"] for r in S.compare_runs(pairs, results).collect()}
    assert eq == {("a", "b"): False, ("a", "c"): True}


def test_running_sums_hot_group(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", f"e{i:06d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o string, x long")
    got = {(r["g"], r["o"]): r["running_x"] for r in RP.running_sums(df, "g", "o", ["x"], parts=7).collect()}
    for g, items in itertools.groupby(sorted(rows), key=lambda t: t[0]):
        total = 0
        for _, o, x in items:
            total += x
            assert got[(g, o)] == total


def test_scoring_matches_multiset_definition(spark):
    """compare_runs agrees with Counter equality on random small results."""
    import json
    import random
    from collections import Counter
    rnd = random.Random(3)
    alphabet = [("a",), ("b",), ("a", "b"), (None,), ("None",), ("1",), ("1.0",), ()]
    rows, pairs, want = [], [], {}
    for k in range(60):
        gold = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 6))]
        kind = rnd.random()
        if kind < 0.4:
            gen = gold[:]
            rnd.shuffle(gen)
        elif kind < 0.7:
            gen = gold + [rnd.choice(alphabet)] if gold else [rnd.choice(alphabet)]
            rnd.shuffle(gen)
            gen = gen[1:] if rnd.random() < 0.5 else gen
        else:
            gen = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 6))]
        g, n = f"g{k}", f"n{k}"
        rows += [(g, json.dumps(list(r))) for r in gold] + [(n, json.dumps(list(r))) for r in gen]
        pairs.append((g, n))
        want[(g, n)] = Counter(map(tuple, gold)) == Counter(map(tuple, gen))
    results = spark.createDataFrame(rows, "run_id string, row string")
    p = spark.createDataFrame(pairs, "gold_run_id string, gen_run_id string")
    got = {(r["gold_run_id"], r["gen_run_id"]): r["equal"] for r in S.compare_runs(p, results).collect()}
    assert got == want
