"""Order-insensitive result scoring for a whole corpus in one job.

Two results are equal when their rows are equal as multisets: row order and
column names are ignored, duplicates count, column order and number matter,
two empty results are equal.

Plan, for N (gold run, generated run) pairs:

1. A fingerprint per run (row count and two sums of independent row hashes),
   observed while the run was written or aggregated here.  Equal multisets
   always have equal fingerprints, so pairs whose fingerprints differ are
   settled as "differ" without moving their rows.
2. Runs of the other pairs form teams: a gold run and up to TEAM - 1 of the runs
   that may equal it.  Their rows are exchanged once, by (team, row), as one
   count per member, with map-side partials, so duplicates and one huge result
   spread over all partitions.  A member equals the gold run iff their counts
   agree for every row; only one flag per member and partition goes further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.operators.execute import fingerprint_columns
from sqlgauge.session import written


def fingerprints(results: DataFrame) -> DataFrame:
    """(run_id, fp_n, fp_a, fp_b): row count and two order-free hash sums."""
    return results.groupBy("run_id").agg(*fingerprint_columns())


def compare_runs(run_pairs: DataFrame, results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(gold_run_id, gen_run_id, equal) for each distinct pair of runs.

    ``known`` holds fingerprints (run_id, fp_n, fp_a, fp_b) that need not be computed.
    """
    pairs = run_pairs.select("gold_run_id", "gen_run_id").distinct()
    fp = fingerprints(results) if known is None else known.select("run_id", "fp_n", "fp_a", "fp_b")
    names = ["fp_n", "fp_a", "fp_b"]
    g = fp.select(F.col("run_id").alias("gold_run_id"), *[F.col(c).alias("g_" + c) for c in names])
    n = fp.select(F.col("run_id").alias("gen_run_id"), *[F.col(c).alias("n_" + c) for c in names])
    cand = (pairs.join(g, "gold_run_id", "left").join(n, "gen_run_id", "left"))
    same_fp = F.lit(True)
    for c in names:
        same_fp = same_fp & (F.coalesce(F.col("g_" + c), F.lit(0)) == F.coalesce(F.col("n_" + c), F.lit(0)))
    # One row per pair, written in the shared folder: fingerprints are computed once,
    # survive executor loss, and the exact step below sees their true size.
    cand = written(cand.select("gold_run_id", "gen_run_id",
                               (F.col("gold_run_id") == F.col("gen_run_id")).alias("same_run"),
                               same_fp.alias("same_fp"),
                               (F.coalesce("g_fp_n", F.lit(0)) == 0).alias("empty")), "pairs")
    # Exact check only where fingerprints agree, rows exist and runs differ.
    exact = exactly_equal(cand.where("same_fp AND NOT same_run AND NOT empty"), results)
    out = cand.join(exact, ["gold_run_id", "gen_run_id"], "left").select(
        "gold_run_id", "gen_run_id",
        (F.col("same_run") | (F.col("same_fp") & (F.col("empty") | F.coalesce(F.col("exact"), F.lit(False)))))
        .alias("equal"))
    return out


TEAM = 8                  # runs whose counts a row carries
SENT_MEMBERS = 500_000    # members that are sent to all tasks (some 50 MB); more are joined by shuffle
NAMED_RUNS = 1_000        # runs that are named in the scan's filter, so that others' files are not read


def exactly_equal(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """(gold_run_id, gen_run_id, exact) of distinct pairs of runs, by the counts of all their rows.

    A row travels with its team's number and, per member, how much oftener that member holds it
    than the gold run: all zeros mean equal.
    """
    place = F.row_number().over(Window.partitionBy("gold_run_id").orderBy("gen_run_id")) - 1
    teams = written(
        pairs.select("gold_run_id", "gen_run_id", place.alias("p"))
        .groupBy("gold_run_id", F.expr(f"p div {TEAM - 1}").alias("k"))
        .agg(F.array_sort(F.collect_list("gen_run_id")).alias("gens"))
        .select("gold_run_id", "gens", F.monotonically_increasing_id().cast("string").alias("team")), "teams")
    one = teams.agg(F.max(F.size("gens")).alias("most"), F.sum(F.size("gens") + 1).alias("n")).first()
    gens = teams.select("gold_run_id", "team", F.posexplode("gens").alias("member", "gen_run_id"))
    if not one["most"]:  # no pair at all
        return gens.select("gold_run_id", "gen_run_id", F.lit(False).alias("exact"))
    members = gens.select("team", F.col("gen_run_id").alias("run_id"), "member").unionByName(
        teams.select("team", F.col("gold_run_id").alias("run_id"), F.lit(-1).alias("member")))
    if one["n"] <= SENT_MEMBERS:
        members = F.broadcast(members)
    if one["n"] <= NAMED_RUNS:
        results = results.where(F.col("run_id").isin(sorted({r[0] for r in members.select("run_id").collect()})))
    more = lambda i: F.sum(F.when(F.col("member") == i, 1).when(F.col("member") == -1, -1).otherwise(0))
    counts = (results.join(members, "run_id").groupBy("team", "row")
              .agg(*[more(i).alias(f"d{i}") for i in range(one["most"])]))
    flags = counts.groupBy("team").agg(*[F.bool_and(F.col(f"d{i}") == 0).alias(f"e{i}") for i in range(one["most"])])
    each = F.array(*[F.struct(F.lit(i).alias("member"), F.col(f"e{i}").alias("exact")) for i in range(one["most"])])
    found = flags.select("team", F.explode(each).alias("m")).select("team", "m.member", "m.exact")
    return gens.join(found, ["team", "member"]).select("gold_run_id", "gen_run_id", "exact")


def compare_executed(pairs: DataFrame, executions: DataFrame, results: DataFrame,
                     any_columns: bool = False) -> DataFrame:
    """(gold_run_id, gen_run_id, equal) of runs of a batch; runs that shared a job are compared
    as the run whose rows they name. ``any_columns``: see ``verdicts``."""
    known = None
    if "fp_a" in executions.columns:
        known = executions.where("success").select("run_id", F.col("n_rows").alias("fp_n"), "fp_a", "fp_b")
    pairs = pairs.select("gold_run_id", "gen_run_id").distinct()
    if "source_run_id" not in executions.columns:
        return _with_columns(pairs, compare_runs(pairs, results, known), results, any_columns)
    named = pairs
    for c in ("gold", "gen"):
        source = executions.select(F.col("run_id").alias(f"{c}_run_id"), F.col("source_run_id").alias(f"{c}_source"))
        named = named.join(source, f"{c}_run_id", "left").withColumn(
            f"{c}_source", F.coalesce(f"{c}_source", f"{c}_run_id"))
    named = written(named, "sources")
    asked = named.select(F.col("gold_source").alias("gold_run_id"), F.col("gen_source").alias("gen_run_id")).distinct()
    eq = _with_columns(asked, compare_runs(asked, results, known), results, any_columns).select(
        F.col("gold_run_id").alias("gold_source"), F.col("gen_run_id").alias("gen_source"), "equal")
    return named.join(eq, ["gold_source", "gen_source"]).select("gold_run_id", "gen_run_id", "equal")


def _with_columns(pairs: DataFrame, eq: DataFrame, results: DataFrame, any_columns: bool) -> DataFrame:
    if not any_columns:
        return eq
    from sqlgauge.operators.columns import matching_columns
    eq = written(eq, "equal")
    found = matching_columns(eq.where("NOT equal"), results).select("gold_run_id", "gen_run_id", F.lit(True).alias("m"))
    return eq.join(found, ["gold_run_id", "gen_run_id"], "left").select(
        "gold_run_id", "gen_run_id", (F.col("equal") | F.coalesce("m", F.lit(False))).alias("equal"))


def verdicts(pairs: DataFrame, executions: DataFrame, results: DataFrame, any_columns: bool = False) -> DataFrame:
    """Per pair: correct and reason (G8), with the two run logs' key fields.

    Order of reasons: gold failed (the generated query still ran), then
    generated failed, then match / differ. With ``any_columns`` a generated result
    also matches if some of its columns, in some order, are the gold result.
    """
    eq = compare_executed(pairs, executions, results, any_columns)
    g = executions.select(F.col("run_id").alias("gold_run_id"),
                          F.col("success").alias("gold_ok"), F.col("error").alias("gold_error"),
                          F.col("n_rows").alias("gold_rows"))
    n = executions.select(F.col("run_id").alias("gen_run_id"),
                          F.col("success").alias("gen_ok"), F.col("error").alias("gen_error"),
                          F.col("n_rows").alias("gen_rows"))
    s = (pairs.join(g, "gold_run_id", "left").join(n, "gen_run_id", "left")
         .join(eq, ["gold_run_id", "gen_run_id"], "left"))
    gold_ok = F.coalesce(F.col("gold_ok"), F.lit(False))
    # A model call that failed (generation ``error``) produced no query at all.
    gen_error = F.col("error") if "error" in pairs.columns else F.lit(None).cast("string")
    gen_ok = F.coalesce(F.col("gen_ok"), F.lit(False)) & gen_error.isNull()
    equal = F.coalesce(F.col("equal"), F.lit(False))
    reason = (F.when(~gold_ok, F.concat(F.lit("gold query failed: "),
                                         F.coalesce(F.col("gold_error"), F.lit("not run"))))
              .when(gen_error.isNotNull(), F.concat(F.lit("generation failed: "), gen_error))
              .when(~gen_ok, F.concat(F.lit("generated query failed: "),
                                      F.coalesce(F.col("gen_error"), F.lit("not run"))))
              .when(equal, F.lit("result sets match"))
              .otherwise(F.lit("result sets differ")))
    verdict = (F.when(~gold_ok, F.lit("gold_failed"))
               .when(gen_error.isNotNull(), F.lit("generation_failed"))
               .when(~gen_ok, F.lit("generated_failed"))
               .when(equal, F.lit("match")).otherwise(F.lit("differ")))
    # Equality is only defined when both runs produced a result.
    return (s.withColumn("equal", F.when(gold_ok & gen_ok, equal))
            .withColumn("correct", gold_ok & gen_ok & equal)
            .withColumn("reason", reason).withColumn("verdict", verdict))
