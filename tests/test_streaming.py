"""Classifier over a file stream: two batches of log files, resumed from checkpoint."""

from __future__ import annotations

from sqlgauge.sources import derived
from sqlgauge.streaming import querylog as S


def test_stream_classifier(spark, tmp_path):
    src, sink, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    log = derived.query_log(spark, "/root/testdata/sf0.001")
    log.where("log_id < 500").write.parquet(str(src / "b1"))
    q = S.start_classifier(spark, str(src / "*"), str(sink), str(ck / "a"), available_now=True)
    q.awaitTermination()
    first = spark.read.parquet(str(sink)).count()
    log.where("log_id >= 500").write.parquet(str(src / "b2"))
    q = S.start_classifier(spark, str(src / "*"), str(sink), str(ck / "a"), available_now=True)
    q.awaitTermination()
    out = spark.read.parquet(str(sink))
    assert first == 500 and out.count() == log.count()
    batch = {r["tier"]: r["count"] for r in
             S.with_complexity(log, "query").groupBy("tier").count().collect()}
    streamed = {r["tier"]: r["count"] for r in out.groupBy("tier").count().collect()}
    assert streamed == batch
    t = S.start_tier_counts(spark, str(src / "*"), "tier_counts_test", str(ck / "b"), available_now=True)
    t.awaitTermination()
    assert {r["tier"]: r["n"] for r in spark.table("tier_counts_test").collect()} == batch
