"""Vector index, BM25 ranking and schema context (P2) against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from sqlgauge.operators import catalog as CT
from sqlgauge.operators import extend as XT
from sqlgauge.operators import retrieval as RT


def vectors(n=900, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dims)) * 3
    return centres[rng.integers(0, 15, n)] + rng.normal(size=(n, dims))


def table(spark, m, kind="id long, vec array<double>"):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], kind)


def test_index_holds_every_row_once_and_finds_nine_of_ten(spark):
    m = vectors()
    corpus = table(spark, m).repartition(6)
    index = RT.build_index(corpus, k=5)
    ids = [i for r in index.chunks().collect() for i in r["ids"]]
    assert sorted(ids) == list(range(len(m)))
    asked = corpus.where("id % 7 = 0").toDF("qid", "qvec")
    found = RT.others(RT.search_index(index, asked, 6), 5)
    exact = RT.others(XT.top_k_similar(asked, corpus, 6), 5)
    r = RT.recall(found, exact).first()
    assert r["n_queries"] == 129 and r["n_expected"] == 645 and r["n_found"] >= 0.9 * 645
    assert index.probes < len(index.centroids) == 30
    # All lists asked: the exact search's own result, scores included.
    whole = RT.search_index(index, asked, 6, probes=len(index.centroids))
    rows = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(whole) == rows(XT.top_k_similar(asked, corpus, 6))


def test_a_hot_list_is_split_and_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(RT, "CHUNK_ROWS", 20)
    monkeypatch.setattr(RT, "QUERY_ROWS", 8)
    m = np.concatenate([np.tile([1.0, 2.0, 0.5], (300, 1)), vectors(100, 3)])  # a third and more are one vector
    corpus = table(spark, m)
    index = RT.build_index(corpus, lists=6, k=3)
    chunks = index.chunks().collect()
    assert max(len(r["ids"]) for r in chunks) < 60 and len(chunks) > 15
    asked = corpus.where("id % 10 = 0").toDF("qid", "qvec")
    got = RT.search_index(index, asked, 4, probes=6).collect()
    want = XT.top_k_similar(asked, corpus, 4).collect()
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got) == sorted((r["qid"], r["rank"], r["id"]) for r in want)


def test_rows_without_a_usable_vector_and_empty_tables(spark):
    kind = "id long, vec array<double>"
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]),
                                    (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [2.0, 0.1])], kind)
    index = RT.build_index(corpus, lists=2, k=2)
    assert sorted(i for r in index.chunks().collect() for i in r["ids"]) == [1, 2, 7]
    got = RT.search_index(index, corpus.toDF("qid", "qvec"), 2, probes=2).where("qid = 1").orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 7]
    none = RT.build_index(corpus.where("false"))
    assert none.chunks().count() == 0
    assert RT.search_index(none, corpus.toDF("qid", "qvec"), 2).count() == 0
    only_zero = RT.build_index(corpus.where("id = 2"))
    assert RT.search_index(only_zero, corpus.toDF("qid", "qvec"), 1).where("qid = 1").first()["id"] == 2


def brute_bm25(queries, docs, k):
    """qid -> [(doc, score)] by the formula, document by document."""
    split = lambda t: re.findall(r"[^\W_]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = {d: Counter(split(t)) for d, t in docs}
    n = len(words)
    mean = sum(sum(w.values()) for w in words.values()) / n
    df = Counter(t for w in words.values() for t in w)
    out = {}
    for q, text in queries:
        scores = {}
        for t, times in Counter(split(text)).items():
            if t not in df or 2 * df[t] >= n:
                continue
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
            for d, w in words.items():
                if w[t]:
                    x = idf * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean))
                    scores[d] = scores.get(d, 0) + times * math.floor(x * 1_000_000)
        best = sorted(((d, s) for d, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]
        out[q] = best
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "naïve", "Ärger", "x_y"]
    weights = [1 / (k + 1) for k in range(60)] + [3, 3, 0.2, 0.2, 0.3]
    docs = [(d, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for d in range(200)]
    docs += [(900, None), (901, ""), (902, docs[5][1]), (903, docs[5][1])]
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for q in range(40)]
    return docs, queries + [(100, None), (101, "unknown"), (102, "the the the")]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_bm25_equals_the_formula(spark, corpus, monkeypatch, sent):
    monkeypatch.setattr(RT, "SPLIT_ROWS", 7)  # common terms stand in many parts
    docs, queries = corpus
    d = spark.createDataFrame(docs + [(None, "w1 w2")], "doc long, text string").repartition(5)
    q = spark.createDataFrame(queries + [(None, "w1")], "qid long, text string")
    df = RT.rank_documents(q, d, 5, doc_id="doc", sent_terms=sent)
    got = {}
    for r in df.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["doc"], r["score"]))
    want = brute_bm25(queries, docs, 5)
    assert got == {q: hits for q, hits in want.items() if hits}
    assert RT.rank_documents(q, d.where("false"), doc_id="doc", sent_terms=sent).count() == 0
    assert RT.rank_documents(q.where("false"), d, doc_id="doc", sent_terms=sent).count() == 0


def test_pairs_are_added_up_where_they_arise(spark, corpus):
    docs, queries = corpus
    d = spark.createDataFrame(docs, "doc long, text string")
    q = spark.createDataFrame(queries, "qid long, text string")
    plan = RT.rank_documents(q, d, 5, doc_id="doc")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(id#" in plan
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(id#\d+L?, qid#", plan)


def catalogs(spark):
    cols = [("d", "orders", 1, "order_id"), ("d", "orders", 2, "customer_id"), ("d", "orders", 3, "price"),
            ("d", "customer", 1, "customer_id"), ("d", "customer", 2, "nation_id"), ("d", "nation", 1, "nation_id"),
            ("d", "nation", 2, "name"), ("d", "island", 1, "area"), ("e", "orders", 1, "price"),
            ("e", "lone", 1, "thing")]
    c = spark.createDataFrame(cols, "db_id string, table_name string, ordinal int, column_name string")
    f = spark.createDataFrame([("d", "orders", "customer"), ("d", "customer", "nation"), ("d", "nation", "nation")],
                              "db_id string, table_name string, ref_table string")
    return c, f


def test_references_are_followed_to_the_end(spark):
    _, f = catalogs(spark)
    got = {(r["table_name"], r["referred"]) for r in RT.referred_tables(f).collect()}
    assert got == {("orders", "customer"), ("orders", "nation"), ("customer", "nation"), ("nation", "nation")}
    chain = spark.createDataFrame([("x", f"t{k}", f"t{(k + 1) % 9}") for k in range(9)],
                                  "db_id string, table_name string, ref_table string")
    assert RT.referred_tables(chain).count() == 81  # a ring: every table refers to every one


def test_a_question_gets_its_tables_and_what_they_refer_to(spark):
    c, f = catalogs(spark)
    q = spark.createDataFrame([(1, "d", "Total price?"), (2, "d", "area of each ISLAND"), (3, "d", "who knows"),
                               (4, "e", "price of a thing"), (5, "d", None)], "example_id int, db_id string, question string")
    ddl = c.groupBy("db_id", "table_name").agg(F.concat(F.lit("CREATE TABLE "), F.first("table_name")).alias("ddl"))
    got = {r["example_id"]: r for r in RT.schema_context(q, c, f, ddl, k=1).collect()}
    assert sorted(got) == [1, 2]  # in e, each word is in half of the tables
    assert list(got[1]["tables"]) == ["customer", "nation", "orders"] and list(got[2]["tables"]) == ["island"]
    assert got[1]["schema_text"].count("CREATE TABLE") == 3
    ranks = {(r["example_id"], r["table_name"]): r["rank"] for r in RT.tables_for(q, c, f, k=1).collect()}
    assert ranks[(1, "orders")] == 1 and ranks[(1, "nation")] is None


def test_table_texts_hold_all_names(spark):
    c, _ = catalogs(spark)
    texts = {(r["db_id"], r["table_name"]): r["text"] for r in RT.table_texts(c).collect()}
    assert texts[("d", "orders")] == "orders order id customer id price"


def test_real_catalog(spark):
    from sqlgauge.registry import both_databases
    dbs = both_databases("/root/testdata/sf0.001")
    cols = CT.columns(spark, dbs[0])
    q = spark.createDataFrame([(1, "shop", "orderpriority of the highest totalprice")],
                              "example_id int, db_id string, question string")
    got = RT.schema_context(q, cols, CT.foreign_keys(spark, dbs[0]), CT.ddl_text(spark, dbs[0])).first()
    assert list(got["tables"]) == ["customer", "nation", "orders", "region"]


def test_vectors_leave_a_task_in_small_frames(monkeypatch):
    """However many lists there are: calibration goes through all of them."""
    monkeypatch.setattr(RT, "OUT_ROWS", 50)
    rng = np.random.default_rng(2)
    centroids = RT.unit_rows(pd.Series(list(rng.normal(size=(20, 4)))))
    pdf = pd.DataFrame({"id": range(33), "vec": [list(v) for v in rng.normal(size=(33, 4))]})
    for probes in (1, 3, 20):
        for with_vec in (True, False):
            out = list(RT._nearest_lists(centroids, probes, with_vec)([pdf]))
            assert max(len(x) for x in out) <= 50
            got = pd.concat(out)
            m = RT.unit_rows(pdf["vec"])
            want = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :probes]
            assert got["list"].tolist() == want.ravel().tolist() and got["place"].tolist() == list(range(probes)) * 33
            assert got["id"].tolist() == np.repeat(pdf["id"], probes).tolist() and ("vec" in got) == with_vec


def test_bm25_partitions_grow_with_the_pairs(spark, corpus, monkeypatch):
    monkeypatch.setattr(RT, "PAIR_ROWS", 20)
    docs, queries = corpus
    df = RT.rank_documents(spark.createDataFrame(queries, "qid long, text string"),
                           spark.createDataFrame(docs, "id long, text string"), 5)
    dealt = re.findall(r"RepartitionByExpression \[id#\d+L?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
    assert dealt and int(dealt[0]) > 20
    got = {}
    for r in df.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert got == {q: hits for q, hits in brute_bm25(queries, docs, 5).items() if hits}
