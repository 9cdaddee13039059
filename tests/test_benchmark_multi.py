"""The benchmark over two databases: prompts carry each database's schema,
runs resolve names in their own database, scores and reports are whole."""

from __future__ import annotations

from sqlgauge.operators import benchmark as B
from sqlgauge.operators import report as R
from sqlgauge.sources.tables import parquet_dir_database

SF = "/root/testdata/sf0.001"

# Generous statement limit for tests that are not about timeouts
# (a busy machine must not turn a verdict into a timeout).
LIMIT = 120_000


def test_two_databases(spark, tmp_path):
    shop = parquet_dir_database(SF, name="shop", tables=["orders", "customer"])
    corpus = parquet_dir_database(SF, name="corpus", tables=["documents", "labels"])
    ex = spark.createDataFrame([
        ("s1", "shop", "How many orders?", "SELECT count(*) FROM orders"),
        ("c1", "corpus", "Documents per quality label.",
         "SELECT l.quality, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.quality"),
        ("c2", "corpus", "How many orders?", "SELECT count(*) FROM orders"),   # gold fails: no such table here
    ], "example_id string, db_id string, question string, gold_sql string")
    resp = spark.createDataFrame([
        ("s1", "zero_shot", "SELECT count(o_orderkey) FROM orders"),
        ("c1", "zero_shot", "```sql\nSELECT quality, count(*) FROM labels GROUP BY quality;\n```"),
        ("c2", "zero_shot", "SELECT 1"),
    ], "example_id string, strategy string, response string")
    res = B.run_benchmark(spark, {"shop": shop, "corpus": corpus}, ex, responses=resp,
                          out_dir=str(tmp_path / "b"), timeout_ms=LIMIT)
    prompts = {r["example_id"]: r["user"] for r in res.prompts.where("strategy = 'zero_shot'").collect()}
    assert "orders(" in prompts["s1"] and "documents(" not in prompts["s1"]
    assert "labels(" in prompts["c1"] and "orders(" not in prompts["c1"]
    scored = {r["example_id"]: r for r in res.scored.collect()}
    assert set(scored) == {"s1", "c1", "c2"}
    assert scored["s1"]["correct"] and scored["c1"]["correct"]
    assert scored["c2"]["reason"].startswith("gold query failed: ")
    rep = R.strategy_report(res.scored).first()
    assert (rep["n"], rep["n_correct"]) == (3, 2)


def test_failed_generation_is_reported(spark, tmp_path):
    from sqlgauge.operators import generate as G
    from sqlgauge.operators import prompts as P
    shop = parquet_dir_database(SF, name="shop", tables=["orders"])
    ex = spark.createDataFrame([("s1", "shop", "How many orders?", "SELECT count(*) FROM orders")],
                               "example_id string, db_id string, question string, gold_sql string")
    texts = B.schema_texts(spark, shop)
    ps = P.build_prompts(ex, texts, ["zero_shot"])
    gen = spark.createDataFrame([("s1", "zero_shot", "model-s", None, None, None, "rate limited")],
                                G.GENERATED_SCHEMA)
    res = B.score_generated(spark, {"shop": shop}, ex, ps, gen, out_dir=str(tmp_path / "b"), timeout_ms=LIMIT)
    r = res.scored.first()
    assert not r["correct"] and r["verdict"] == "generation_failed"
    assert r["reason"] == "generation failed: rate limited" and r["cost_usd"] == 0.0
    assert res.executions.count() == 1            # only the gold query ran
