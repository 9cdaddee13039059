"""Kept runs (P4) and the repair loop (P3): commits, repeats, crashes, gains."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F
from sqlgauge import publish
from sqlgauge.operators import history as HS
from sqlgauge.operators import repair as RE

SCORES = "example_id long, strategy string, correct boolean, reason string"


def scores(spark, rows):
    return spark.createDataFrame([(*r, f"why {r[0]}") for r in rows], SCORES)


def held(spark, path, kind="scores", only=None):
    return sorted((r["bench_run"], r["example_id"], r["strategy"], r["correct"])
                  for r in HS.read_history(spark, path, kind, only).collect())


def test_writing_a_run_twice_changes_nothing(spark, tmp_path):
    path = f"file:{tmp_path}/h"
    df = scores(spark, [(1, "a", True), (2, "a", False), (1, "b", None)])
    HS.record_run(spark, path, "007", {"scores": df, "log": df.select("example_id")})
    once = held(spark, path)
    HS.record_run(spark, path, "007", {"scores": df, "log": df.select("example_id")})
    assert held(spark, path) == once and len(once) == 3
    assert {r[0] for r in once} == {"007"}  # names stay text
    assert HS.read_history(spark, path, "log").count() == 3
    assert HS.vacuum(spark, path) == 2 and held(spark, path) == once and HS.vacuum(spark, path) == 0


def test_a_write_that_fails_is_never_seen(spark, tmp_path):
    path = f"file:{tmp_path}/h"
    good = scores(spark, [(1, "a", True)])
    HS.record_run(spark, path, "r1", {"scores": good, "z_last": good})
    bad = good.withColumn("correct", F.raise_error(F.lit("broken")).cast("boolean"))
    with pytest.raises(Exception, match="broken"):  # the first table of the run is written by then
        HS.record_run(spark, path, "r1", {"scores": scores(spark, [(9, "a", True)]), "z_last": bad})
    with pytest.raises(Exception, match="broken"):
        HS.record_run(spark, path, "r2", {"scores": good, "z_last": bad})
    assert HS.runs(spark, path) == ["r1"] and held(spark, path) == [("r1", 1, "a", True)]
    with pytest.raises(LookupError):
        HS.read_history(spark, path, "scores", ["r2"])
    with pytest.raises(ValueError):
        HS.record_run(spark, path, "r3", {"manifest": good})


def test_reading_some_runs_reads_their_files_only(spark, tmp_path):
    path = f"file:{tmp_path}/h"
    for run in ("a/b", "a b", "c"):
        HS.record_run(spark, path, run, {"scores": scores(spark, [(1, run, True)])})
    assert HS.runs(spark, path) == ["a b", "a/b", "c"]
    h = HS.read_history(spark, path, "scores", ["a/b"])
    assert [r["strategy"] for r in h.collect()] == ["a/b"]
    assert "PartitionFilters: [" in (plan := h._jdf.queryExecution().executedPlan().toString())
    assert "PartitionFilters: []" not in plan
    assert HS.read_history(spark, path, "scores").count() == 3


def test_differences_of_two_runs(spark, tmp_path):
    path = f"file:{tmp_path}/h"
    HS.record_run(spark, path, "x", {"scores": scores(spark, [
        (1, "a", True), (2, "a", False), (3, "a", True), (4, "a", None), (5, None, True)])})
    HS.record_run(spark, path, "y", {"scores": scores(spark, [
        (1, "a", False), (2, "a", True), (3, "a", True), (5, None, True), (6, "b", None)])})
    d = HS.diff_runs(spark, path, "x", "y")
    got = {(r["example_id"], r["strategy"]): r["change"] for r in d.collect()}
    assert got == {(1, "a"): "broken", (2, "a"): "fixed", (3, "a"): "same", (4, "a"): "removed",
                   (5, None): "same", (6, "b"): "added"}
    assert {(r["strategy"], r["change"]): r["n"] for r in HS.diff_summary(d).collect()}[(None, "same")] == 1


def test_a_pointer_is_switched_whole(spark, tmp_path):
    path = f"file:{tmp_path}/p/CURRENT.json"
    assert publish.read_pointer(spark, path) is None
    for k in range(3):
        publish.write_pointer(spark, path, {"k": k, "text": "é"})
        assert publish.read_pointer(spark, path) == {"k": k, "text": "é"}
    assert [p.name for p in (tmp_path / "p").iterdir() if not p.name.startswith(".")] == ["CURRENT.json"]


def rule(failed, round_):
    """Answers of round r: every third is not answered, the others are right where the id allows."""
    return failed.where(F.col("example_id") % 3 != round_ % 3).withColumn(
        "correct", F.col("example_id") % (round_ + 3) == 0)


def simulate(n, most, least=1):
    wrong = {(i, s) for i in range(n) for s in ("a", "b") if i % 7}
    asked, gains = 2 * n, [(0, 2 * n, 2 * n - len(wrong))]
    for r in range(1, most + 1):
        if not wrong:
            break
        fixed = {(i, s) for i, s in wrong if i % 3 != r % 3 and i % (r + 3) == 0}
        gains.append((r, len(wrong), len(fixed)))
        wrong -= fixed
        if len(fixed) < least:
            break
    return gains, wrong


def start(spark, n=120):
    return scores(spark, [(i, s, i % 7 == 0) for i in range(n) for s in ("a", "b")])


def gains(spark, path):
    rows = RE.gain_per_round(spark, path).groupBy("round").agg(F.sum("asked").alias("a"), F.sum("fixed").alias("f"))
    return [(r["round"], r["a"], r["f"]) for r in rows.orderBy("round").collect()]


@pytest.mark.parametrize("most,least", [(3, 1), (9, 10), (0, 1)])
def test_rounds_shrink_and_stop(spark, tmp_path, most, least):
    path = f"file:{tmp_path}/r"
    done = RE.repair_loop(spark, start(spark), rule, path, most, least)
    want, wrong = simulate(120, most, least)
    assert gains(spark, path) == want and done.rounds == len(want) - 1
    assert done.stopped == ("no_gain" if want[-1][2] < least and done.rounds else "most_rounds")
    last = {(r["example_id"], r["strategy"]) for r in RE.final_scores(spark, path).where("NOT correct").collect()}
    assert last == wrong and RE.final_scores(spark, path).count() == 240


def test_all_correct_stops_at_once(spark, tmp_path):
    asked = []
    done = RE.repair_loop(spark, start(spark).withColumn("correct", F.lit(True)),
                          lambda failed, r: asked.append(r) or failed, f"file:{tmp_path}/r")
    assert (done.rounds, done.stopped, asked) == (0, "all_correct", [])


def test_a_killed_round_is_done_again_and_finished_ones_are_not(spark, tmp_path):
    path, asked = f"file:{tmp_path}/r", []

    def dies_in_round_2(failed, round_):
        asked.append(round_)
        if round_ == 2 and asked.count(2) == 1:
            raise RuntimeError("killed")
        return rule(failed, round_)

    with pytest.raises(RuntimeError):
        RE.repair_loop(spark, start(spark), dies_in_round_2, path, 4)
    RE.repair_loop(spark, start(spark).limit(0), dies_in_round_2, path, 4)  # the committed start counts
    rounds = len(simulate(120, 4)[0])
    assert asked == [1, 2, *range(2, rounds)] and rounds > 3
    whole = f"file:{tmp_path}/whole"
    RE.repair_loop(spark, start(spark), rule, whole, 4)
    assert gains(spark, path) == gains(spark, whole)


def test_an_answer_that_was_not_asked_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        RE.repair_loop(spark, start(spark), lambda failed, r: start(spark), f"file:{tmp_path}/r")


def test_follow_up_prompts_carry_reason_query_and_tables(spark):
    failed = spark.createDataFrame([(1, "a", "no such column", "SELECT x"), (2, "a", None, None)],
                                   "example_id long, strategy string, reason string, sql string")
    prompts = spark.createDataFrame([(1, "a", "sys", "Q1", 9), (2, "a", "sys", "Q2", 9), (3, "a", "sys", "Q3", 9)],
                                    "example_id long, strategy string, system string, user string, max_tokens int")
    context = spark.createDataFrame([(1, "CREATE TABLE t")], "example_id long, schema_text string")
    got = {r["example_id"]: r["user"] for r in RE.follow_up(failed, prompts, context).collect()}
    assert sorted(got) == [1, 2]
    assert "no such column" in got[1] and "SELECT x" in got[1] and "CREATE TABLE t" in got[1]
    assert got[2].startswith("Q2") and "Tables that" not in got[2]
    assert RE.follow_up(failed, prompts).columns == prompts.columns
