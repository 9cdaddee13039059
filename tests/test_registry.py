"""Every registered query runs at sf0.001; a sample agrees with DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from sqlgauge import registry
from sqlgauge.sources.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) >= {"strategy", "n_correct", "n", "accuracy_pct"}


def test_every_query_runs(spark):
    qs = E.queries()
    orc = E.oracle_sql()
    assert set(orc) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SF)
        assert df.columns, name
        df.limit(5).collect()


FAST = ["classify", "extract_sql", "map_types", "sanitize_names", "pk_check", "fk_check",
        "run_gold_string_agg", "run_gold_window_frames", "cat_profile", "schema_text", "similar_topk"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    mine = sorted(tuple(str(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    theirs = sorted(tuple(str(v) for _, v in sorted(zip(cols, r))) for r in res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert mine == theirs


@pytest.fixture
def three_lines(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "l_orderkey int, l_linenumber int").coalesce(1).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("any_columns", [False, True])
def test_scores_of_statements_that_fail_are_no_scores(spark, three_lines, any_columns):
    fine, fails = "SELECT l_orderkey FROM lineitem", "SELECT 1 / (l_orderkey - 1) FROM lineitem"
    got = registry._lineitem_scores(spark, three_lines, [("p", fine, fine + " ORDER BY 1")], any_columns).collect()
    assert [tuple(r) for r in got] == [("p", True)]
    for pair in [("one", fine, fails), ("both", fails, fails + " WHERE true"), ("gold", fails, fine)]:
        with pytest.raises(RuntimeError, match="without a result"):
            registry._lineitem_scores(spark, three_lines, [pair], any_columns)


def test_scores_of_statements_that_are_stopped_are_no_scores(spark, three_lines, monkeypatch):
    monkeypatch.setattr(registry, "BENCH_TIMEOUT_MS", 1)
    slow = "SELECT count(*) FROM lineitem a, range(3000000000) b WHERE a.l_orderkey <> b.id % 7"
    with pytest.raises(RuntimeError, match="timeout"):
        registry._lineitem_scores(spark, three_lines, [("p", slow, "SELECT 1")], False)
