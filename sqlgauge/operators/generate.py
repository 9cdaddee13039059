"""Batch generation and cost.

F1 calls a model for every prompt inside ``mapInPandas``: each task builds
one client from a user-supplied factory and streams Arrow batches through
it, a few calls at a time; the number of partitions bounds how many tasks
call at once.  A failed call is a row with an error, not a failed task.
Model calls cost money, so outputs are written once, keyed by (example,
strategy, model), and a rerun only calls for keys without a good answer
(``left_anti``). While a job runs, each task records every few finished calls
in a call log in the shared folder, under the keys of their prompts: a task that
is run again finds them there, and so does the next run of a job that failed.

For tests and the registered queries a replay table stands in for the model
and is joined on (example_id, strategy).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.files import read_texts, write_text
from sqlgauge.session import child_names, delete_path, path_exists, qualified
from sqlgauge.functions.querylog import extract_sql, strip_ws

GENERATED_SCHEMA = ("example_id string, strategy string, model string, response string, "
                    "input_tokens bigint, output_tokens bigint, error string")
STORED_SCHEMA = GENERATED_SCHEMA + ", called_at timestamp"

# ---- fixed values: USD per million tokens (input, output) per model class ----
DEFAULT_PRICES = [
    ("model-s", 1.00, 5.00),
    ("model-m", 3.00, 15.00),
    ("model-l", 5.00, 25.00),
]
# ---- end of fixed values ----
DEFAULT_MODEL = "model-s"


def price_table(spark: SparkSession, prices=None) -> DataFrame:
    return spark.createDataFrame(prices or DEFAULT_PRICES,
                                 "model string, input_rate double, output_rate double")


def with_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """F2: cost_usd = in/1e6*rate_in + out/1e6*rate_out; unknown model -> 0.0.

    The caller's price table may have any size; Spark broadcasts it if it is small.
    """
    cost = (F.col("input_tokens") / F.lit(1e6) * F.col("input_rate")
            + F.col("output_tokens") / F.lit(1e6) * F.col("output_rate"))
    return (df.join(prices, "model", "left")
            .withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
            .drop("input_rate", "output_rate"))


LOGGED_CALLS = 16  # finished calls that are logged together: what a lost machine may repeat
ANSWER = ["example_id", "strategy", "model", "response", "input_tokens", "output_tokens", "error"]


def prompt_key(model: str, temperature: float) -> Column:
    """What makes two calls the same: the whole prompt, the model and its settings."""
    parts = [F.col(c).cast("string") for c in ("example_id", "strategy", "system", "user", "max_tokens")]
    return F.sha2(F.to_json(F.array(*parts, F.lit(model), F.lit(str(temperature)))), 256)


def generate(prompts: DataFrame, client_factory: Callable[[], object], model: str,
             partitions: int | None = None, temperature: float = 0.0,
             concurrency: int = 4, call_log: str | None = None) -> DataFrame:
    """one model call per prompt row, in Python workers, Arrow-batched.

    ``client_factory()`` returns an object with
    ``generate(system, user, max_tokens, temperature) -> (text, in_tokens, out_tokens)``;
    one client per task.  Calls are I/O-bound, so each task runs up to
    ``concurrency`` at once.  A failed call is a row with ``error`` set (text
    NULL, no tokens), never a failed task: a task retry would repeat -- and
    pay for -- every call of its partition.  Text is stripped.

    With ``call_log`` (a folder that all executors share, one per job) finished calls
    are recorded there, LOGGED_CALLS at a time, by partition: prompts are dealt by key,
    so a repeated task has the same ones and takes the recorded answers. Failed calls
    are not recorded. Speculative copies of a task would call twice: leave
    ``spark.speculation`` off.
    """
    src = prompts.select("example_id", "strategy", "system", "user", "max_tokens",
                         prompt_key(model, temperature).alias("key"))
    if partitions:
        src = src.repartition(partitions, "key")
    elif call_log:
        src = src.repartition("key")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        client = client_factory()
        folder = f"{call_log}/part-{TaskContext.get().partitionId():06d}" if call_log else None
        known = {}
        for text in read_texts(folder) if folder else ():
            for line in text.splitlines():
                row = json.loads(line)
                known[row["key"]] = tuple(row[c] for c in ANSWER)

        def one(r):
            try:
                text, n_in, n_out = client.generate(r.system, r.user, int(r.max_tokens), temperature)
                return (r.example_id, r.strategy, model, (text or "").strip(), int(n_in), int(n_out), None)
            except Exception as exc:  # noqa: BLE001 - a failed call is data
                msg = (str(exc).strip().splitlines() or [type(exc).__name__])[0]
                return (r.example_id, r.strategy, model, None, None, None, msg)

        def record(rows, answers) -> None:
            lines = [json.dumps({"key": r.key, **dict(zip(ANSWER, a))})
                     for r, a in zip(rows, answers) if a[-1] is None]
            if lines:
                write_text(f"{folder}/{uuid.uuid4().hex}.jsonl", "\n".join(lines))

        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for pdf in batches:
                rows = list(pdf.itertuples(index=False))
                fresh = [r for r in rows if r.key not in known]
                answers = {}
                for lo in range(0, len(fresh), LOGGED_CALLS):
                    part = fresh[lo:lo + LOGGED_CALLS]
                    got = list(pool.map(one, part))
                    if folder:
                        record(part, got)
                    answers.update((id(r), a) for r, a in zip(part, got))
                yield pd.DataFrame([answers[id(r)] if id(r) in answers else known[r.key] for r in rows],
                                   columns=ANSWER)

    return src.mapInPandas(call, GENERATED_SCHEMA)


CALLS_PER_TASK = 200


def call_logs(path: str) -> str:
    """The folder of the call logs that belong to the answers at ``path``."""
    return path.rstrip("/") + "-calls"


def salvage_calls(spark: SparkSession, path: str) -> int:
    """Move what logs of jobs that failed hold into the answers at ``path``; returns how many calls.

    Answers that are there already are not added again, so a salvage that is cut off is repeated whole.
    """
    logs = call_logs(path)
    if not child_names(spark, logs):
        return 0
    logged = spark.read.schema(GENERATED_SCHEMA).option("recursiveFileLookup", "true").json(logs)
    new = logged.dropDuplicates(["example_id", "strategy", "model"])
    if path_exists(spark, path):
        done = (spark.read.schema(STORED_SCHEMA).parquet(path).where(F.col("error").isNull())
                .select("example_id", "strategy", "model"))
        new = new.join(done, ["example_id", "strategy", "model"], "left_anti")
    n = new.count()
    new.withColumn("called_at", F.current_timestamp()).write.mode("append").parquet(path)
    delete_path(spark, logs)
    return n


def generate_once(spark: SparkSession, prompts: DataFrame, client_factory, model: str,
                  path: str, partitions: int | None = None) -> DataFrame:
    """F1 with resume: call only for keys without a good answer under ``path``
    (never answered, or failed), append them; the latest answer per key wins.

    A lost executor makes Spark rerun its tasks; their finished calls are in the call log.
    Logs that a failed job left are moved to the answers first. By default each task
    holds about ``CALLS_PER_TASK`` prompts. One job at a time may write to ``path``.
    """
    salvage_calls(spark, path)
    todo = prompts
    if path_exists(spark, path):  # any other failure to read must not repeat paid calls
        done = (spark.read.schema(STORED_SCHEMA).parquet(path).where(F.col("error").isNull())
                .select("example_id", "strategy", "model"))
        todo = prompts.withColumn("model", F.lit(model)).join(
            done, ["example_id", "strategy", "model"], "left_anti").drop("model")
    if partitions is None:
        partitions = max(1, -(-todo.count() // CALLS_PER_TASK))
    log = qualified(spark, f"{call_logs(path)}/job-{uuid.uuid4().hex[:12]}")
    (generate(todo, client_factory, model, partitions, call_log=log).withColumn("called_at", F.current_timestamp())
     .write.mode("append").parquet(path))
    delete_path(spark, log)  # its answers are committed
    # Per key: a good answer before a failed one, then the latest.
    out = spark.read.schema(STORED_SCHEMA).parquet(path).where(F.col("model") == model)
    names = [c for c in out.columns if c not in ("example_id", "strategy", "called_at")]
    latest = out.groupBy("example_id", "strategy").agg(F.max_by(
        F.struct(*names), F.struct(F.col("error").isNull(), F.col("called_at"), "response")).alias("r"))
    return latest.select("example_id", "strategy", *[f"r.{c}" for c in names])


class ReverseClient:
    """A stand-in for a model that anyone can check: it answers with the prompt backwards, counts
    characters as tokens, and fails for prompts of a length divisible by 13."""

    def generate(self, system: str, user: str, max_tokens: int, temperature: float):
        if len(user) % 13 == 0:
            raise ValueError("length divisible by 13")
        return user[::-1], len(system) + len(user), len(user)


def approx_tokens(text) -> object:
    """A stand-in token count for replays: ceil(characters / 4)."""
    return F.ceil(F.length(text) / F.lit(4)).cast("bigint")


def replay(prompts: DataFrame, responses: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """F1 stand-in: responses (example_id, strategy, response) joined to prompts."""
    r = responses.select("example_id", "strategy", "response")
    return prompts.join(r, ["example_id", "strategy"], "inner").select(
        "example_id", "strategy", F.lit(model).alias("model"),
        strip_ws(F.col("response")).alias("response"),
        approx_tokens(F.concat("system", "user")).alias("input_tokens"),
        approx_tokens(strip_ws(F.col("response"))).alias("output_tokens"),
        F.lit(None).cast("string").alias("error"))


def generations(prompts: DataFrame, generated: DataFrame, prices: DataFrame) -> DataFrame:
    """question, db, strategy, cleaned SQL, raw text, tokens and cost."""
    g = generated.join(prompts.select("example_id", "strategy", "db_id", "question"),
                       ["example_id", "strategy"], "inner")
    g = g.withColumn("sql", extract_sql(F.col("response")))
    out = with_cost(g, prices)
    # A failed call has no answer and costs nothing; its empty SQL scores as failed.
    return out.withColumn("cost_usd", F.when(F.col("error").isNull(), F.col("cost_usd"))
                          .otherwise(F.lit(0.0)))
