"""Query-log jobs: classify a log, tier histogram, feature hit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.functions import querylog as Q

BAR_WIDTH = 40


def classify_log(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Tier, features and label for every row: a narrow projection, no shuffle."""
    return Q.with_complexity(df, query_col)


def tier_histogram(classified: DataFrame, tier_col: str = "tier") -> DataFrame:
    """Tiers 1-5 with zeros; bar of ``floor(40*n/total)`` '#' (total >= 1).

    One partial+final aggregate over the log; everything after it has at most
    five rows, so the window that sums the total is bounded.
    """
    spark = classified.sparkSession
    counts = classified.groupBy(F.col(tier_col).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    tiers = spark.range(1, 6).select(F.col("id").cast("int").alias("tier"))
    hist = tiers.join(F.broadcast(counts), "tier", "left").select(
        "tier", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    # A window over the whole frame: at most five rows (one per tier).
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    bar = F.expr("repeat('#', CAST(floor(%d * n / total) AS INT))" % BAR_WIDTH)
    return hist.withColumn("total", total).select("tier", "n", bar.alias("bar"))


def feature_counts(classified: DataFrame, features_col: str = "features") -> DataFrame:
    """Hits per feature (features never seen are absent, like a Counter).

    A plain ``explode`` lets Spark infer a filter on the size of the array, which it
    moves down to the scan with the whole classification written out in it, every
    regex many times over. The outer form infers none; rows without features go after it.
    """
    return (classified.select(F.posexplode_outer(features_col).alias("pos", "feature"))
            .where(F.col("pos").isNotNull())
            .groupBy("feature").agg(F.count(F.lit(1)).alias("n")))


def classified_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sqlgauge.sources import derived
    return classify_log(derived.query_log(spark, sf_dir, dealt=True))
