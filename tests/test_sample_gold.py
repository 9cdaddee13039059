"""The sample databases end to end: load, run the eight gold queries, check
the answers, classify them, score reorderings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE_EXAMPLES
from sqlgauge.functions.querylog import with_complexity
from sqlgauge.operators import execute as X
from sqlgauge.operators import score as S
from sqlgauge.operators.load import load_sqlite_dir

ANSWERS = [
    [("HJUK",), ("LMKA",), ("QEEV",)],
    [("FI", "1"), ("NO", "2"), ("PT", "2")],
    [("fuel pier", "3"), ("fuel pier", "40"), ("fuel pier", "6"), ("north quay", "12"), ("north quay", "21"),
     ("slip", "5"), ("slip", "8")],
    [("fuel pier", "40"), ("north quay", "21")],
    [("slip",)],
    [("pear",)],
    [("clay", "5.5"), ("loam", "4.5"), ("loam", "6.0")],
    [("1", "2"), ("2", "1"), ("3", "2"), ("4", "3"), ("5", "1")],
]
TIERS = [(1, []), (3, ["aggregate", "group_by"]), (2, ["join"]), (3, ["join", "aggregate", "group_by", "having"]),
         (4, ["subquery"]), (4, ["subquery", "set_operation"]), (5, ["join", "cte"]),
         (5, ["window_function"])]

# Generous statement limit for tests that are not about timeouts
# (a busy machine must not turn a verdict into a timeout).
LIMIT = 120_000


@pytest.fixture(scope="module")
def loaded(spark, sample_dir, tmp_path_factory):
    return load_sqlite_dir(spark, sample_dir, str(tmp_path_factory.mktemp("wh")))


def _rows(spark, result_rows):
    return [tuple(json.loads(r["row"])) for r in result_rows]


def test_gold_answers(spark, loaded, tmp_path):
    runs = spark.createDataFrame([(f"g{i}", db, q) for i, (db, _, q) in enumerate(SAMPLE_EXAMPLES)],
                                 "run_id string, db_id string, sql string")
    rr = X.run_batch(spark, runs, loaded.databases, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
    assert rr.executions.where("NOT success").count() == 0
    res = rr.results.collect()
    for i, want in enumerate(ANSWERS):
        got = _rows(spark, [r for r in res if r["run_id"] == f"g{i}"])
        assert sorted(got) == want, i


def test_gold_tiers(spark):
    df = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(SAMPLE_EXAMPLES)], "i int, query string")
    got = [(r["tier"], list(r["features"])) for r in with_complexity(df).orderBy("i").collect()]
    assert got == TIERS


def test_reordered_answers_score_correct(spark, loaded, tmp_path):
    pairs, runs = [], []
    for i, (db, _, q) in enumerate(SAMPLE_EXAMPLES):
        runs += [(f"g{i}", db, q), (f"r{i}", db, f"SELECT * FROM ({q}) t ORDER BY 1 DESC")]
        pairs.append((f"e{i}", f"g{i}", f"r{i}"))
    rr = X.run_batch(spark, spark.createDataFrame(runs, "run_id string, db_id string, sql string"),
                     loaded.databases, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
    p = spark.createDataFrame(pairs, "example_id string, gold_run_id string, gen_run_id string")
    v = S.verdicts(p, rr.executions, rr.results)
    assert v.where(~F.col("correct")).count() == 0


def test_catalog_namespaces(spark, loaded, tmp_path):
    """One namespace per database; runs resolve unqualified names in it."""
    from sqlgauge.operators import catalog as C
    from sqlgauge.operators.load import register_in_catalog
    from sqlgauge.sources.tables import catalog_database
    dbs = {}
    try:
        for name, db in loaded.databases.items():
            dbs[name] = register_in_catalog(spark, db, f"sg_{name}", replace=True)
        assert {"sg_harbor", "sg_orchard"} <= {r["schema_name"] for r in C.list_schemas(spark).collect()}
        assert [r["table_name"] for r in C.list_tables(spark, "sg_orchard").collect()] == ["plot", "tree"]
        cat = {n: catalog_database(spark, f"sg_{n}", d.keys) for n, d in dbs.items()}
        runs = spark.createDataFrame([(f"g{i}", db, q) for i, (db, _, q) in enumerate(SAMPLE_EXAMPLES)],
                                     "run_id string, db_id string, sql string")
        rr = X.run_batch(spark, runs, cat, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
        assert rr.executions.where("NOT success").count() == 0
        got = [tuple(json.loads(r["row"])) for r in rr.results.where("run_id = 'g0'").collect()]
        assert sorted(got) == ANSWERS[0]
        # a run session stays inside its namespace: other databases are refused
        bad = spark.createDataFrame([("x", "harbor", "SELECT * FROM sg_orchard.tree"),
                                     ("y", "harbor", "SELECT * FROM IDENTIFIER('sg_orchard.tree')")],
                                    "run_id string, db_id string, sql string")
        ex = X.run_batch(spark, bad, cat, out_dir=str(tmp_path / "b"), timeout_ms=LIMIT).executions.collect()
        assert {r["run_id"]: r["error_class"] for r in ex} == {"x": "READ_ONLY", "y": "READ_ONLY"}
        assert spark.catalog.currentDatabase() == "default"
    finally:
        for n in dbs:
            spark.sql(f"DROP DATABASE IF EXISTS sg_{n} CASCADE")
