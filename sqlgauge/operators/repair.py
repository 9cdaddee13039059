"""The repair loop (P3): rounds over a shrinking set of failed answers.

A round takes the answers that are still wrong, asks again with the reason of the
failure (and, given retrieval, the part of the schema that the question needs), scores
what comes back and commits it to a history under the round's name. The loop ends when
nothing is wrong, when a round gains less than ``least_gain`` answers, or after
``most_rounds``. It holds no state but what is committed: started again after a crash,
it goes on after the last committed round, and no finished round asks twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.operators import history
from sqlgauge.session import work_path, written

KEYS = ["example_id", "strategy"]


@dataclass
class RepairResult:
    path: str
    rounds: int              # repair rounds that were scored
    stopped: str             # all_correct, no_gain or most_rounds


def _name(round_: int) -> str:
    return f"round-{round_:04d}"


def still_wrong(spark: SparkSession, path: str, round_: int) -> DataFrame:
    """The answers of a round that are not correct: what the next one asks again."""
    return history.read_history(spark, path, "scores", [_name(round_)]).where(
        ~F.coalesce("correct", F.lit(False))).drop(history.RUN)


def repair_loop(spark: SparkSession, scored: DataFrame, repair: Callable[[DataFrame, int], DataFrame],
                path: str | None = None, most_rounds: int = 5, least_gain: int = 1) -> RepairResult:
    """Run rounds until a stop rule holds; state and result are the history at ``path``.

    ``scored`` (example_id, strategy, correct, ...) is round 0. ``repair(failed, round)`` gets the
    rows that are still wrong and returns their new scored rows, with the columns of ``scored``;
    a pair that it leaves out stays as it was, one that was not asked is an error.
    """
    path = path or work_path(spark, "repair")
    done = [r for r in history.runs(spark, path) if r.startswith("round-")]
    if not done:
        history.record_run(spark, path, _name(0), {"scores": scored})
    round_ = max(0, len(done) - 1)
    while True:
        stop = _stop(spark, path, round_, most_rounds, least_gain)
        if stop:
            return RepairResult(path, round_, stop)
        failed = still_wrong(spark, path, round_)
        answers = written(repair(failed, round_ + 1), "repaired")  # asked once
        if answers.join(failed.select(*KEYS), KEYS, "left_anti").limit(1).count():
            raise ValueError("a repair answered what was not asked")
        kept = failed.join(answers.select(*KEYS), KEYS, "left_anti")
        history.record_run(spark, path, _name(round_ + 1),
                           {"scores": answers.select(*failed.columns).unionByName(kept)})
        round_ += 1


def _counts(spark: SparkSession, path: str, round_: int) -> tuple[int, int]:
    """(answers of a round, those of them that are correct)."""
    row = history.read_history(spark, path, "scores", [_name(round_)]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("correct", F.lit(False))).alias("ok")).first()
    return row["n"], row["ok"]


def _stop(spark: SparkSession, path: str, round_: int, most_rounds: int, least_gain: int) -> str | None:
    asked, correct = _counts(spark, path, round_)
    if asked == correct:
        return "all_correct"
    if round_ and correct < least_gain:
        return "no_gain"
    return "most_rounds" if round_ >= most_rounds else None


def gain_per_round(spark: SparkSession, path: str) -> DataFrame:
    """round, strategy, asked, fixed, correct, n: the gain of each round, and where it left the strategy.

    A strategy with nothing left to ask has no row for that round.
    """
    rows = history.read_history(spark, path, "scores").select(
        F.substring(history.RUN, 7, 4).cast("int").alias("round"), "strategy",
        F.coalesce("correct", F.lit(False)).alias("correct"))
    per = rows.groupBy("round", "strategy").agg(F.count(F.lit(1)).alias("asked"),
                                                F.count_if("correct").alias("fixed"))
    so_far = Window.partitionBy("strategy").orderBy("round")
    return per.select("round", "strategy", "asked", "fixed", F.sum("fixed").over(so_far).alias("correct"),
                      F.first("asked").over(so_far).alias("n"))


def final_scores(spark: SparkSession, path: str) -> DataFrame:
    """Every answer as the last round that held it left it."""
    rows = history.read_history(spark, path, "scores")
    columns = [c for c in rows.columns if c not in (*KEYS, history.RUN)]
    last = F.max_by(F.struct(*columns), history.RUN).alias("s")
    return rows.groupBy(*KEYS).agg(last).select(*KEYS, *[F.col(f"s.`{c}`").alias(c) for c in columns])


def follow_up(failed: DataFrame, prompts: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Prompts that ask again: the first prompt, why its answer failed and, with ``context``
    (example_id, schema_text), the declarations that the question needs."""
    p = prompts.join(failed.select(*KEYS, "reason", "sql"), KEYS)
    parts = [F.col("user"), F.lit("\n\nYour previous query was not accepted ("),
             F.coalesce("reason", F.lit("no reason given")), F.lit(").\nPrevious query:\n"),
             F.coalesce("sql", F.lit(""))]
    if context is not None:
        p = p.join(context.select("example_id", F.col("schema_text").alias("_needed")), "example_id", "left")
        parts.append(F.coalesce(F.concat(F.lit("\n\nTables that the question needs:\n"), "_needed"), F.lit("")))
    p = p.withColumn("user", F.concat(*parts, F.lit("\n\nWrite a corrected query.")))
    return p.drop("reason", "sql", "_needed")
