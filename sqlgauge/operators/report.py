"""Reports over scored generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.session import written


def _acc(n_correct, n):
    return F.when(n > 0, F.round(F.lit(100.0) * n_correct / n, 2)).otherwise(F.lit(0.0))


def strategy_report(scored: DataFrame) -> DataFrame:
    """Per strategy: correct, n, percent (n=0 safe), total cost."""
    return scored.groupBy("strategy").agg(
        F.sum(F.col("correct").cast("bigint")).alias("n_correct"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    ).withColumn("accuracy_pct", _acc(F.col("n_correct"), F.col("n")))


def overall_report(scored: DataFrame) -> DataFrame:
    """correct/n, percent and total cost over everything."""
    return scored.agg(
        F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).alias("n_correct"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    ).withColumn("accuracy_pct", _acc(F.col("n_correct"), F.col("n")))


def question_report(scored: DataFrame, with_reason: bool = True) -> DataFrame:
    """PASS/FAIL per question, generated and gold SQL, and on failure the
    verdict (``why``) and the full reason text (error first line included)."""
    cols = ["example_id", "strategy",
            F.when(F.col("correct"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("mark"),
            F.col("sql").alias("generated_sql"), "gold_sql",
            F.when(~F.col("correct"), F.col("verdict")).alias("why")]
    if with_reason and "reason" in scored.columns:
        cols.append(F.when(~F.col("correct"), F.col("reason")).alias("reason"))
    return scored.select(*cols)


def running_sums(df: DataFrame, group: str, order: str, cols: list[str],
                 parts: int | None = None) -> DataFrame:
    """Exact running totals of ``cols`` per ``group`` in ``order``, distributed.

    A window partitioned by a low-cardinality group (a handful of strategies)
    would put each group's rows into one task.  Instead: range-partition by
    (group, order) and write that once, with each row's partition; take local
    running sums inside each partition, and add the totals of all earlier
    partitions of the same group (one row per group and partition).  Both
    branches read the written partitions, so they cannot disagree about the
    bounds.  ``order`` must be unique within a group; a null group is a group.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, group, order).withColumn("_pid", F.spark_partition_id()),
                     "ranged")
    local_w = (Window.partitionBy(group, "_pid").orderBy(order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(c).over(local_w).alias(f"_loc_{c}") for c in cols])
    totals = ranged.groupBy(group, "_pid").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    before = (Window.partitionBy(group).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col(group).alias("_group"), F.col("_pid").alias("_part"),
                            *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}")
                              for c in cols])
    out = local.join(offsets, (F.col("_pid") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    for c in cols:
        out = out.withColumn(f"running_{c}", F.col(f"_loc_{c}") + F.col(f"_off_{c}"))
    return out.drop("_pid", "_part", "_group", *[f"_loc_{c}" for c in cols], *[f"_off_{c}" for c in cols])


def cost_report(scored: DataFrame) -> DataFrame:
    """Per question cost and tokens, with running totals per strategy batch."""
    base = scored.select("strategy", "example_id", "input_tokens", "output_tokens",
                         F.col("cost_usd").alias("cost"))
    r = running_sums(base, "strategy", "example_id", ["input_tokens", "output_tokens", "cost"])
    return r.select(
        "strategy", "example_id", "input_tokens", "output_tokens",
        F.round("cost", 8).alias("cost_usd"),
        F.col("running_input_tokens").cast("bigint").alias("running_input_tokens"),
        F.col("running_output_tokens").cast("bigint").alias("running_output_tokens"),
        F.round("running_cost", 8).alias("running_cost_usd"))
