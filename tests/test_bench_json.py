"""Benchmark JSON readers and dataset reports."""

from __future__ import annotations

import os

import pytest

from sqlgauge.operators import querylog as QL
from sqlgauge.sources import bench_json as B


def test_schema_columns(spark, bench_dir):
    dbs = B.read_schema_file(spark, os.path.join(bench_dir, "tables.json"))
    cols = B.schema_columns(dbs)
    berth = cols.where("db_id = 'harbor' AND table_name = 'berth'").orderBy("col_pos").collect()
    assert [(r["column_name"], r["column_type"]) for r in berth] == [
        ("berth_no", "number"), ("label", "text"), ("depth_m", "number")]
    tree = cols.where("db_id = 'orchard' AND table_name = 'tree'").orderBy("col_pos").collect()
    assert tree[-1]["column_type"] == "?"         # types list shorter than columns
    hedge = cols.where("table_name = 'hedge'").collect()
    assert len(hedge) == 1 and hedge[0]["column_name"] is None   # table without columns kept


def test_dataset_reports(spark, bench_dir):
    dbs = B.read_schema_file(spark, os.path.join(bench_dir, "tables.json"))
    ex = B.read_examples(spark, os.path.join(bench_dir, "dev.json"),
                         os.path.join(bench_dir, "train_missing.json"))
    size = B.dataset_size(dbs, ex).first()
    assert (size["databases"], size["tables"], size["dev"], size["train"], size["total"]) == (2, 6, 8, 0, 8)
    st = {r["db_id"]: r for r in B.database_structure(dbs, show=1).collect()}
    assert (st["harbor"]["n_tables"], st["harbor"]["n_foreign_keys"]) == (3, 2)
    assert st["harbor"]["listing"].splitlines()[1] == "berth(berth_no:number, label:text, depth_m:number)"
    assert st["orchard"]["listing"] is None
    first = B.first_examples(ex, 3).collect()
    assert [r["tier"] for r in first] == [1, 3, 2]
    cls = QL.classify_log(ex, "query")
    hist = {r["tier"]: (r["n"], r["bar"]) for r in QL.tier_histogram(cls).collect()}
    assert {t: n for t, (n, _) in hist.items()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    assert hist[3][1] == "#" * 10
    feats = {r["feature"]: r["n"] for r in QL.feature_counts(cls).collect()}
    assert feats == {"join": 3, "aggregate": 2, "group_by": 2, "having": 1, "subquery": 2, "set_operation": 1,
                     "cte": 1, "window_function": 1}


def test_histogram_with_zeros(spark):
    df = spark.createDataFrame([(1,)], "tier int").where("false")
    rows = QL.tier_histogram(df).orderBy("tier").collect()
    assert [(r["tier"], r["n"], r["bar"]) for r in rows] == [(t, 0, "") for t in range(1, 6)]


def test_examples_are_found_by_any_uri(spark, bench_dir):
    from sqlgauge.sources import bench_json as B
    plain = B.read_examples(spark, f"{bench_dir}/dev.json", None).count()
    assert plain > 0 and B.read_examples(spark, f"file:{bench_dir}/dev.json", f"{bench_dir}/absent.json").count() == plain
    with pytest.raises(Exception):
        B.read_examples(spark, "nostore://x/dev.json", None)
