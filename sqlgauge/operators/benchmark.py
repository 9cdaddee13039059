"""The benchmark run: examples -> prompts -> generations -> runs -> scores.

One lineage per stage; the expensive stages write their output once under
the shared checkpoint folder: schema texts, generations (model calls cost
money) and query runs (one job each).
Scoring over all runs is one job (plus the exact check of candidate pairs).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.operators import catalog, execute, generate, prompts, score
from sqlgauge.operators.history import record_run
from sqlgauge.plans.gold import GOLD
from sqlgauge.session import work_path
from sqlgauge.sources.tables import Database


def run_id(db_col, sql_col):
    """Deterministic id of a (database, statement) pair: identical runs dedupe."""
    return F.sha2(F.concat_ws("\u001f", db_col, F.coalesce(sql_col, F.lit(""))), 256)


def gold_examples(spark: SparkSession, db_id: str) -> DataFrame:
    rows = [(f"q{i:02d}_{g.key}", db_id, g.question, g.sql) for i, g in enumerate(GOLD)]
    return spark.createDataFrame(rows, "example_id string, db_id string, question string, gold_sql string")


FAILING_SQL = "SELECT no_such_column FROM orders"
# Write statements a model may answer with; the read-only guard refuses them.
REFUSED_SQL = ["DELETE FROM orders WHERE o_orderkey = 0", "DROP TABLE customer"]


def replay_variant(i: int, strategy: str) -> str:
    """Which answer the replay gives for gold example ``i`` under ``strategy``:
    'alt' (equivalent), 'wrong' (near miss), 'failing' or 'refused'."""
    if strategy == "zero_shot":
        if i % 8 == 5:
            return "refused"
        if i % 4 == 3:
            return "failing"
        return "wrong" if i % 2 else "alt"
    if strategy == "chain_of_thought":
        return "wrong" if i % 3 == 0 else "alt"
    return "alt"


def replay_sql(i: int, variant: str, alt: str, wrong: str) -> str:
    if variant == "failing":
        return FAILING_SQL
    if variant == "refused":
        return REFUSED_SQL[(i // 8) % len(REFUSED_SQL)]
    return alt if variant == "alt" else wrong


def replay_text(i: int, strategy: str, alt: str, wrong: str) -> str:
    """The replayed model answer for gold example ``i`` under ``strategy``."""
    sql = replay_sql(i, replay_variant(i, strategy), alt, wrong)
    if strategy == "few_shot":
        return f"```sql\n{sql};\n```"
    if strategy == "chain_of_thought":
        return f"First find the tables involved.\n```sql\n{sql}\n```\nThat query answers it."
    return sql


def replay_responses(spark: SparkSession) -> DataFrame:
    rows = [(f"q{i:02d}_{g.key}", s, replay_text(i, s, g.alt, g.wrong))
            for i, g in enumerate(GOLD) for s in prompts.STRATEGIES]
    return spark.createDataFrame(rows, "example_id string, strategy string, response string")


def schema_texts(spark: SparkSession, db: Database, sample_limit: int = 3,
                 order_by_key: bool = False) -> DataFrame:
    cols = catalog.columns(spark, db)
    full = catalog.schema_text(spark, db, True, sample_limit, order_by_key, cols)
    return full.join(catalog.schema_text_min(spark, db, cols), "db_id")


@dataclass
class BenchmarkResult:
    prompts: DataFrame
    generations: DataFrame
    executions: DataFrame
    results: DataFrame
    scored: DataFrame
    out_dir: str


def run_benchmark(spark: SparkSession, databases: dict[str, Database], examples: DataFrame,
                  generated: DataFrame | None = None, responses: DataFrame | None = None,
                  prices: DataFrame | None = None, sample_limit: int = 3,
                  timeout_ms: int | None = None, parallelism: int = 8,
                  out_dir: str | None = None,
                  sample_order_by_key: bool = False, history: str | None = None,
                  run: str | None = None) -> BenchmarkResult:
    """Score every (example, strategy) answer against its gold query.

    Give either ``generated`` (F1 output) or ``responses`` (a replay table).
    Sample rows for the schema text are the first rows read (a minimal scan);
    ``sample_order_by_key`` makes them repeatable at the cost of a full scan.
    ``history`` is a folder that keeps the run's log, results and scores under the
    name ``run``; the same name again takes the place of what was there.
    """
    if history and not run:
        raise ValueError("a run of a history needs a name")
    out_dir = out_dir or work_path(spark, "benchmark")
    texts = None
    for db in databases.values():
        t = schema_texts(spark, db, sample_limit, sample_order_by_key)
        texts = t if texts is None else texts.unionByName(t)
    texts.write.mode("overwrite").parquet(f"{out_dir}/schema_texts")
    texts = spark.read.parquet(f"{out_dir}/schema_texts")
    ps = prompts.build_prompts(examples, texts)
    if generated is None:
        generated = generate.replay(ps, responses)
    done = score_generated(spark, databases, examples, ps, generated, prices, timeout_ms,
                           parallelism, out_dir)
    if history:
        keep(spark, done, history, run)
    return done


def keep(spark: SparkSession, done: BenchmarkResult, history: str, run: str) -> None:
    """Commit a benchmark's query log, result rows and scores to a history."""
    record_run(spark, history, run, {"log": done.executions, "results": done.results, "scores": done.scored})


def score_generated(spark: SparkSession, databases: dict[str, Database], examples: DataFrame,
                    ps: DataFrame, generated: DataFrame, prices: DataFrame | None = None,
                    timeout_ms: int | None = None, parallelism: int = 8,
                    out_dir: str | None = None) -> BenchmarkResult:
    """F3 -> G: clean and cost the answers, run gold and generated SQL, score."""
    out_dir = out_dir or work_path(spark, "benchmark")
    prices = prices if prices is not None else generate.price_table(spark)
    gens = generate.generations(ps, generated, prices)
    gens = gens.join(examples.select("example_id", "gold_sql"), "example_id")
    gens = gens.withColumn("gold_run_id", run_id(F.col("db_id"), F.col("gold_sql"))) \
               .withColumn("gen_run_id", run_id(F.col("db_id"), F.col("sql")))
    gens.write.mode("overwrite").parquet(f"{out_dir}/generations")
    gens = spark.read.parquet(f"{out_dir}/generations")
    # Failed model calls have no query to run.
    runs = (gens.select(F.col("gold_run_id").alias("run_id"), "db_id", F.col("gold_sql").alias("sql"))
            .unionByName(gens.where(F.col("error").isNull())
                         .select(F.col("gen_run_id").alias("run_id"), "db_id", "sql")))
    rr = execute.run_batch(spark, runs, databases, out_dir=f"{out_dir}/runs",
                           timeout_ms=timeout_ms, parallelism=parallelism)
    scored = score.verdicts(gens, rr.executions, rr.results)
    scored.write.mode("overwrite").parquet(f"{out_dir}/scored")
    scored = spark.read.parquet(f"{out_dir}/scored")
    return BenchmarkResult(ps, gens, rr.executions, rr.results, scored, out_dir)


def repair_responses(spark: SparkSession) -> DataFrame:
    """Replay for the repair round: the equivalent rewrite for every example."""
    rows = [(f"q{i:02d}_{g.key}", s, g.alt) for i, g in enumerate(GOLD) for s in prompts.STRATEGIES]
    return spark.createDataFrame(rows, "example_id string, strategy string, response string")
