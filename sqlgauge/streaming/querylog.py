"""The query-log classifier over a growing folder of log files.

Logs of submitted SQL or model responses usually arrive as files.  The same
Column expressions as the batch classifier (no new operator) run on a file
stream; each micro-batch appends classified rows to a parquet sink, and the
running tier histogram is kept as streaming aggregation state.  Checkpoints
go under the shared checkpoint folder so a restarted query resumes exactly
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sqlgauge.functions.querylog import extract_sql, with_complexity
from sqlgauge.session import work_path

LOG_SCHEMA = "log_id bigint, source string, query string, response string"


def classified_stream(spark: SparkSession, source_dir: str, schema: str = LOG_SCHEMA,
                      fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame: every new log row with tier, features, label and
    the SQL extracted from its response."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(source_dir)
    out = with_complexity(df, "query")
    if "response" in df.columns:
        out = out.withColumn("extracted", extract_sql(F.col("response")))
    return out


def start_classifier(spark: SparkSession, source_dir: str, sink_dir: str,
                     checkpoint_dir: str | None = None, available_now: bool = False,
                     schema: str = LOG_SCHEMA, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append classified rows to ``sink_dir`` (parquet), exactly once."""
    ckpt = checkpoint_dir or work_path(spark, "stream-ckpt", "classify")
    w = (classified_stream(spark, source_dir, schema, max_files_per_trigger=max_files_per_trigger)
         .withColumn("features", F.array_join("features", ","))
         .writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_tier_counts(spark: SparkSession, source_dir: str, query_name: str,
                      checkpoint_dir: str | None = None, available_now: bool = False,
                      schema: str = LOG_SCHEMA) -> StreamingQuery:
    """Running count per tier (state: five rows), served as an in-memory table."""
    ckpt = checkpoint_dir or work_path(spark, "stream-ckpt", "tiers")
    counts = classified_stream(spark, source_dir, schema).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"))
    w = (counts.writeStream.format("memory").queryName(query_name)
         .option("checkpointLocation", ckpt).outputMode("complete"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
