"""Reports and the cube over a hand-made scored table."""

from __future__ import annotations

import pytest

from sqlgauge.operators import extend as X
from sqlgauge.operators import report as R

ROWS = [
    # example, strategy, model, correct, cost, in, out, gold_sql, sql, verdict, gen_run_id
    ("e1", "zero_shot", "m", True, 0.001, 100, 10, "SELECT 1", "SELECT 1", "match", "r1"),
    ("e2", "zero_shot", "m", False, 0.002, 200, 20, "SELECT a FROM t JOIN u ON t.k = u.k", "x", "differ", "r2"),
    ("e1", "few_shot", "m", True, 0.003, 300, 30, "SELECT 1", "SELECT 1", "match", "r1"),
    ("e2", "few_shot", "m", True, 0.004, 400, 40, "SELECT a FROM t JOIN u ON t.k = u.k", "y", "match", "r3"),
]
SCHEMA = ("example_id string, strategy string, model string, correct boolean, cost_usd double, "
          "input_tokens bigint, output_tokens bigint, gold_sql string, sql string, verdict string, "
          "gen_run_id string")


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_strategy_and_overall(spark, scored):
    st = {r["strategy"]: r for r in R.strategy_report(scored).collect()}
    assert (st["zero_shot"]["n_correct"], st["zero_shot"]["n"], st["zero_shot"]["accuracy_pct"]) == (1, 2, 50.0)
    assert st["few_shot"]["accuracy_pct"] == 100.0 and st["few_shot"]["cost_usd"] == pytest.approx(0.007)
    ov = R.overall_report(scored).first()
    assert (ov["n_correct"], ov["n"], ov["accuracy_pct"]) == (3, 4, 75.0)
    empty = R.overall_report(scored.where("false")).first()
    assert (empty["n"], empty["accuracy_pct"], empty["cost_usd"]) == (0, 0.0, 0.0)


def test_question_and_cost_reports(spark, scored):
    q = {(r["example_id"], r["strategy"]): r for r in R.question_report(scored).collect()}
    assert q[("e2", "zero_shot")]["mark"] == "FAIL" and q[("e2", "zero_shot")]["why"] == "differ"
    assert q[("e1", "few_shot")]["why"] is None
    c = {(r["strategy"], r["example_id"]): r for r in R.cost_report(scored).collect()}
    assert c[("few_shot", "e2")]["running_input_tokens"] == 700
    assert c[("few_shot", "e2")]["running_cost_usd"] == pytest.approx(0.007)


def test_cube_levels(spark, scored):
    cube = X.benchmark_cube(scored).collect()
    top = [r for r in cube if r["level"] == 7][0]
    assert (top["n"], top["n_correct"]) == (4, 3)
    by_tier = {r["tier"]: r["n"] for r in cube if r["level"] == 6}     # only tier kept
    assert by_tier == {1: 2, 2: 2}


def test_repair_gain(spark, scored):
    after = spark.createDataFrame([("e2", "zero_shot", True)], "example_id string, strategy string, correct boolean")
    g = {r["strategy"]: r for r in X.repair_gain(scored, after).collect()}
    assert (g["zero_shot"]["correct_before"], g["zero_shot"]["correct_after"], g["zero_shot"]["gain"]) == (1, 2, 1)
    assert g["few_shot"]["gain"] == 0


def test_question_report_reason(spark):
    df = spark.createDataFrame(
        [("e1", "s", False, "x", "g", "generated_failed", "generated query failed: boom")],
        "example_id string, strategy string, correct boolean, sql string, gold_sql string, "
        "verdict string, reason string")
    r = R.question_report(df).first()
    assert (r["mark"], r["why"], r["reason"]) == ("FAIL", "generated_failed", "generated query failed: boom")


def test_running_sums_at_scale_with_extra_columns_and_a_projection(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = (spark.range(600_000).select(
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("grp"),
        F.xxhash64("id").alias("pos"), (F.col("id") % 101).alias("v"),
        F.repeat(F.lit("x"), 40).alias("extra")))
    w = Window.partitionBy("grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("grp", "pos", F.sum("v").over(w).alias("want"))
    got = R.running_sums(df, "grp", "pos", ["v"], parts=13).select("grp", "pos", "running_v")
    both = want.join(got, want.grp.eqNullSafe(got.grp) & (want.pos == got.pos))
    assert both.count() == 600_000
    assert both.where("want <> running_v").count() == 0


def test_cost_report_at_scale_keeps_totals_under_projection(spark):
    from pyspark.sql import functions as F
    df = spark.range(500_000).select(
        F.concat(F.lit("s"), F.col("id") % 4).alias("strategy"), F.format_string("e%08d", "id").alias("example_id"),
        F.lit("note").alias("note"), (F.col("id") % 50).alias("input_tokens"), F.lit(2).cast("bigint").alias("output_tokens"),
        (F.col("id") % 8 / 8).alias("cost_usd"))
    r = R.cost_report(df).select("strategy", "example_id", "running_output_tokens")
    top = {x["strategy"]: x["m"] for x in r.groupBy("strategy").agg(F.max("running_output_tokens").alias("m")).collect()}
    assert top == {f"s{k}": 250_000 for k in range(4)}
    first = r.where("example_id < 'e00000004'").collect()
    assert {x["running_output_tokens"] for x in first} == {2}
