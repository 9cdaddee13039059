"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is forced to completion with a no-op write (nothing is collected),
so the time covers the whole distributed plan.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from sqlgauge import registry as R  # noqa: E402
from sqlgauge.operators import execute as EX  # noqa: E402
from sqlgauge.operators import score as SC  # noqa: E402
from sqlgauge.session import env_cpus, local_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stage_metrics(log_dir: str, windows: dict[str, tuple[float, float]]) -> dict[str, dict]:
    """Shuffle bytes written per bench item, from the event log: a stage belongs to the item whose time window holds its
    submission (jobs from worker threads carry no job group)."""
    out = {k: {"shuffle_bytes": 0, "stages": 0} for k in windows}
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(f) and "appstatus" not in os.path.basename(f)]
    for f in files:
        with open(f) as fh:
            for line in fh:
                if '"SparkListenerStageCompleted"' not in line:
                    continue
                info = json.loads(line)["Stage Info"]
                t = info.get("Submission Time", 0) / 1000.0
                acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
                for k, (a, b) in windows.items():
                    if a <= t <= b:
                        out[k]["shuffle_bytes"] += int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0)
                        out[k]["stages"] += 1
                        break
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = env_cpus(8)
    log_dir = tempfile.mkdtemp(prefix="sqlgauge-eventlog-", dir="/tmp")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, cpus * 2), app_name="sqlgauge-bench",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false"})
    times: dict[str, float] = {}
    windows: dict[str, tuple[float, float]] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        t1 = time.time()
        times[name] = round(t1 - t0, 3)
        windows[name] = (t0, t1)

    qs = R.queries()
    # Warm the JVM (codegen, regex JIT) on the smallest scale (not timed).
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small):
        run(qs["classify"](spark, small))
        run(qs["run_gold_scan"](spark, small))
    run(R.q_cat_row_counts(spark, sf_dir))

    # Query log: classify + extract over every derived query string.
    timed("classify", lambda: run(qs["classify"](spark, sf_dir)))
    timed("extract_sql", lambda: run(qs["extract_sql"](spark, sf_dir)))
    timed("tier_histogram", lambda: run(qs["tier_histogram"](spark, sf_dir)))
    # BASELINE: classify + extract over 1M derived query strings (10 per event at sf0.1).
    from pyspark.sql import functions as F

    from sqlgauge.functions import querylog as Q
    from sqlgauge.sources import derived
    # Written as many files first: the small source file alone is one input split.
    from sqlgauge.session import work_path
    log_path = work_path(spark, "bench-log")
    derived.query_log_copies(spark, sf_dir, 10).repartition(4 * cpus).write.parquet(log_path)
    big_log = spark.read.parquet(log_path)
    timed("classify_extract_1m", lambda: run(
        Q.with_complexity(big_log, "query").withColumn("extracted", Q.extract_sql(F.col("response")))))
    # Validation: keys of all tables, orphan checks of all foreign keys.
    timed("pk_check", lambda: run(qs["pk_check"](spark, sf_dir)))
    timed("fk_check", lambda: run(qs["fk_check"](spark, sf_dir)))
    # BASELINE: the orphan check lineitem -> orders alone.
    from sqlgauge.operators import validate as V
    from sqlgauge.sources.tables import TEST_KEYS, parquet_dir_database
    li_fk = [f for f in TEST_KEYS.foreign_keys if f.table == "lineitem" and f.ref_table == "orders"]
    timed("fk_lineitem_orders", lambda: run(V.fk_check(
        parquet_dir_database(sf_dir, tables=["lineitem", "orders"]).tables(spark), li_fk)))
    timed("cast_audit", lambda: run(qs["cast_audit"](spark, sf_dir)))
    timed("schema_text", lambda: run(qs["schema_text"](spark, sf_dir)))
    # The gold corpus, one query each.
    for name in [k for k in qs if k.startswith("run_gold_")]:
        timed(name, lambda n=name: run(qs[n](spark, sf_dir)))

    # Scoring: two large results (every lineitem row, two orders) compared as multisets.
    def score_big():
        runs = spark.createDataFrame(
            [("li_a", "shop", "SELECT * FROM lineitem"),
             ("li_b", "shop", "SELECT * FROM lineitem ORDER BY l_shipdate DESC")],
            "run_id string, db_id string, sql string")
        rr = EX.run_batch(spark, runs, {"shop": R.shop_db(sf_dir)}, timeout_ms=600_000)
        pairs = spark.createDataFrame([("big", "li_a", "li_b")],
                                      "example_id string, gold_run_id string, gen_run_id string")
        v = SC.verdicts(pairs, rr.executions, rr.results).first()
        assert v["correct"], v["reason"]
    timed("score_rows_big", score_big)

    # The whole replayed benchmark (prompts, answers, 60+ runs, one scoring job).
    timed("benchmark", lambda: run(R.q_strategy_report(spark, sf_dir)))
    timed("similar_topk", lambda: run(qs["similar_topk"](spark, sf_dir)))
    # Retrieval by index and by terms, kept runs, the repair loop, calls in workers.
    for name in ("similar_topk_index", "bm25_documents", "history_diff", "repair_rounds", "generate_calls"):
        timed(name, lambda n=name: run(qs[n](spark, sf_dir)))

    n_log = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    n_lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()   # flushes the event log
    metrics = stage_metrics(log_dir, windows)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus,
        "rows_per_sec": {
            "classify_extract_1m": round(10 * n_log / max(times["classify_extract_1m"], 1e-9)),
            "classify": round(n_log / max(times["classify"], 1e-9)),
            "extract_sql": round(n_log / max(times["extract_sql"], 1e-9)),
            "score_rows_big": round(2 * n_lineitem / max(times["score_rows_big"], 1e-9)),
            "fk_lineitem_orders": round(n_lineitem / max(times["fk_lineitem_orders"], 1e-9)),
        },
        "shuffle_bytes": {k: v["shuffle_bytes"] for k, v in metrics.items()},
    }))


if __name__ == "__main__":
    main()
