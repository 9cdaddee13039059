"""Extensions: exact top-k against brute force, centroids."""

from __future__ import annotations

import numpy as np

from sqlgauge.operators import extend as X


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(300, 8))
    corpus[17] = corpus[3]                      # an exact tie, broken by id
    queries = rng.normal(size=(5, 8))
    queries[0] = corpus[3]
    cdf = spark.createDataFrame([(i, corpus[i].tolist()) for i in range(300)], "id long, vec array<double>")
    qdf = spark.createDataFrame([(i, queries[i].tolist()) for i in range(5)], "qid long, qvec array<double>")
    got = X.top_k_similar(qdf, cdf.repartition(7), k=4, query_block=2).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(queries) @ unit(corpus).T
    for q in range(5):
        order = sorted(range(300), key=lambda c: (-sims[q, c], c))[:4]
        mine = [r["id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])]
        assert mine == order
    assert [r["id"] for r in sorted((r for r in got if r["qid"] == 0), key=lambda r: r["rank"])][:2] == [3, 17]


def test_top_k_scans_the_corpus_once(spark):
    cdf = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(99, [0.0, 0.0]), (98, None)],
                                "id long, vec array<double>")
    qdf = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)] + [(77, None)], "qid long, qvec array<double>")
    df = X.top_k_similar(qdf, cdf, k=3, query_block=4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "WindowGroupLimit" in plan
    assert df.count() == 20 * 3 and df.where("qid = 77").count() == 0
    assert X.top_k_similar(qdf.limit(0), cdf, k=3).count() == 0


def test_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])],
                               "label int, embedding array<float>")
    got = {r["label"]: list(r["centroid"]) for r in X.label_centroids(df).collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}
