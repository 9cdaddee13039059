"""Batch execution of SQL runs: read-only, timed out, failures as data.

Each distinct (database, SQL) pair is one run.  Every statement is parsed,
guarded and analysed on its own (errors there cost no job).  Statements whose
plans are the same up to names, blanks and letter case share one job: the later
ones take the first one's outcome and point to its rows (``source_run_id``).
Every other statement runs as a Spark job of its own, under its own job tag and
its own clock.  A run that fails for no fault of its statement (a lost executor, a
full disk, memory) has no outcome: the batch ends with ``RunLost``.  A watchdog
cancels the tag when the deadline passes and goes on cancelling until the
write returns, so a job that starts late is stopped too; what a late write may
still have committed is deleted.  A run that ignores its cancel is given up:
its thread is left alone and its place goes to the next run.

A run's rows never reach the driver: they are rendered to string cells (one
JSON text per row) and written under one root, ``results/run_id=<id>``.  The
row count and the multiset fingerprint are observed during that write, so
scoring does not read the rows again to get them.  The driver keeps one small
log row per run.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.plans import guard
from sqlgauge.session import delete_path, work_path
from sqlgauge.sources.tables import Database

DEFAULT_TIMEOUT_MS = 5000
# After a run's deadline, how long to wait for its job to honour the cancel
# before giving up on it (a job that ignores cancels must not hang the batch).
CANCEL_GRACE_S = 30.0
# How often a passed deadline is enforced again.
CANCEL_AGAIN_S = 0.1
LOG_ROWS = 1000
RESULT_CODEC = "zstd"  # rendered rows take about half of what they take in snappy
RESULT_SPLIT = "16m"  # of result files that one task reads: some hold ten times the rows per byte of others
NULL_TEXT = "None"

EXECUTION_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("db_id", T.StringType(), True),
    T.StructField("sql", T.StringType(), True),
    T.StructField("success", T.BooleanType(), False),
    T.StructField("error", T.StringType(), True),
    T.StructField("error_class", T.StringType(), True),
    T.StructField("timed_out", T.BooleanType(), False),
    T.StructField("columns", T.ArrayType(T.StringType()), True),
    T.StructField("n_rows", T.LongType(), True),
    T.StructField("ms", T.LongType(), True),
    T.StructField("result_path", T.StringType(), True),
    T.StructField("fp_a", T.DecimalType(38, 0), True),
    T.StructField("fp_b", T.DecimalType(38, 0), True),
    T.StructField("source_run_id", T.StringType(), False),
])


def run_session(spark: SparkSession, db: Database) -> SparkSession:
    """An isolated session whose unqualified names are the database's tables."""
    s = spark.newSession()
    s.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    db.register(s)
    return s


def render_cells(df: DataFrame, strict_null: bool = False) -> Column:
    """Row -> array<string>, one cell per column by position.

    NULL renders as ``None`` (so it equals the text 'None', as Python's
    ``str()`` does) unless ``strict_null``, where it stays NULL.  Use on a
    frame from ``positional``: result names may repeat or contain dots.
    """
    cells = []
    for name in df.columns:
        c = F.col(f"`{name}`").cast("string")
        cells.append(c if strict_null else F.coalesce(c, F.lit(NULL_TEXT)))
    return F.array(*cells) if cells else F.array().cast("array<string>")


def row_key(df: DataFrame, strict_null: bool = False) -> Column:
    """The rendered row as one string: the JSON array of its cells.

    JSON escaping makes this injective (NULL is ``null``, the text 'None'
    is ``"None"``), so equal keys mean equal rows; a single string is about
    twice as fast to write, hash and group as ``array<string>``.
    """
    return F.to_json(render_cells(df, strict_null))


def positional(df: DataFrame) -> DataFrame:
    """Rename result columns to _c0, _c1, ... (names are ignored by scoring)."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def sql_frame(spark: SparkSession, db: Database, sql: str,
              allow_qualified: bool = False) -> DataFrame:
    """G1 for one query: read-only check, then the lazy result DataFrame."""
    return guard.guarded_sql(run_session(spark, db), sql, allow_qualified, db)


def _first_line(exc: BaseException) -> str:
    text = str(exc).strip()
    return text.splitlines()[0] if text else type(exc).__name__


def _error_class(exc: BaseException) -> str:
    cond = getattr(exc, "getCondition", None) or getattr(exc, "getErrorClass", None)
    try:
        v = cond() if cond else None
    except Exception:  # noqa: BLE001
        v = None
    return v or type(exc).__name__


# PostgreSQL constructs Spark SQL rejects, with the Spark form to use instead.
DIALECT_GAPS = [
    ("(?i)\\bdistinct\\s+on\\s*\\(", "DISTINCT ON: use row_number() over a window, keep rank 1"),
    ("\\s!?~\\*?\\s", "regex operator ~: use rlike / regexp"),
    ("(?i)\\bfetch\\s+(first|next)\\b", "FETCH FIRST: use LIMIT"),
    ("(?i)\\bgenerate_series\\s*\\(", "generate_series: use explode(sequence(...))"),
]


def with_dialect_hints(executions: DataFrame) -> DataFrame:
    """Failed runs whose text uses a PostgreSQL-only construct get a hint
    (reported, never rewritten)."""
    hint = F.lit(None).cast("string")
    for rx, text in reversed(DIALECT_GAPS):
        hint = F.when(F.coalesce(F.col("sql"), F.lit("")).rlike(rx), F.lit(text)).otherwise(hint)
    return executions.withColumn("dialect_hint", F.when(~F.col("success"), hint))


class _LazySessions:
    """One isolated session per database, built on first use by a worker
    thread (in parallel across databases; never for unused databases)."""

    def __init__(self, spark: SparkSession, databases: dict[str, Database]):
        self.spark, self.databases = spark, databases
        self._made: dict[str, SparkSession] = {}
        self._locks = {name: threading.Lock() for name in databases}

    def __getitem__(self, name: str) -> SparkSession:
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = run_session(self.spark, self.databases[name])
            return self._made[name]


@dataclass
class RunResult:
    executions: DataFrame
    results: DataFrame
    out_dir: str


def _log(run_id, db_id, sql, ok, error=None, error_class=None, timed_out=False,
         columns=None, n_rows=None, ms=0, path=None, fp=(None, None)) -> tuple:
    return (run_id, db_id, sql, ok, error, error_class, timed_out, columns, n_rows, ms, path, *fp, run_id)


PLANS_KEPT = 2000  # distinct plans that a batch remembers on the driver; one that is forgotten runs again


class _Shared:
    """The outcome of the first run of a plan, for those that come after it."""

    def __init__(self):
        self.ended, self.row = threading.Event(), None

    def finish(self, row: tuple) -> None:
        if not self.ended.is_set():
            self.row = row
            self.ended.set()

    def outcome(self, ready: _Ready) -> tuple:
        """The log row of another statement with the same plan."""
        self.ended.wait()
        run_id, _, _, *rest, source = self.row
        rest[4] = list(ready.df.columns) if self.row[3] else None
        return (ready.run_id, ready.db_id, ready.sql, *rest, source)


class _PlanBook:
    """Canonical plans of a batch's runs: equal ones share an outcome."""

    def __init__(self):
        self._lock, self._known, self._order = threading.Lock(), {}, []

    def claim(self, db_id: str, plans: list) -> tuple[_Shared, bool]:
        """(the outcome of a statement with these plans, whether the caller is the one to run it).

        Statements are the same if one of their plans is."""
        keys = [(db_id, p.hashCode()) for p in plans]
        with self._lock:
            for key, plan in zip(keys, plans):
                for other, shared in self._known.get(key, ()):
                    if plan.equals(other):  # the whole trees, on the JVM
                        return shared, False
            shared = _Shared()
            for key, plan in zip(keys, plans):
                self._known.setdefault(key, []).append((plan, shared))
            self._order.append(keys)
            if len(self._order) > PLANS_KEPT:
                for key in self._order.pop(0):
                    self._known[key].pop(0)
            return shared, True


def canonical_plans(df: DataFrame) -> list | None:
    """The plans of a result's rows without names and ids, optimized and physical, or None where running
    it twice may give two results.

    Either may tell equal statements apart: the optimized plan keeps the alias of a lateral view, the
    physical one the ids of partial aggregates."""
    try:
        run = row_frame(df)._jdf.queryExecution()
        plan = run.optimizedPlan()
        return [plan.canonicalized(), run.sparkPlan().canonicalized()] if plan.deterministic() else None
    except Exception:  # noqa: BLE001 - a plan that fails here fails when it is run
        return None


def _failure(run_id, db_id, sql, exc: BaseException, ms: int) -> tuple:
    if isinstance(exc, guard.GuardError):
        return _log(run_id, db_id, sql, False, _first_line(exc), "READ_ONLY", ms=ms)
    return _log(run_id, db_id, sql, False, _first_line(exc), _error_class(exc), ms=ms)


class RunLost(RuntimeError):
    """A run that the machines, their storage or this program failed: its statement has no outcome."""


# How SQL states begin of failures that are not the statement's: connection, resources, checkpoints, intervention,
# system, configuration, cancelled, files.
SYSTEM_STATES = ("08", "53", "56", "57", "58", "F0", "HY", "KD", "XXKDA")
WRITE_FAILED = "58030"  # wraps whatever failed
# What functions throw on a statement's values where Spark gives the error no state.
VALUE_ERRORS = ["java.lang.ArithmeticException", "java.lang.IllegalArgumentException",
                "java.lang.IndexOutOfBoundsException", "java.time.DateTimeException"]


def _causes(exc: BaseException) -> Iterator:
    cause = getattr(exc, "_origin", None) or getattr(exc, "java_exception", None)
    for _ in range(50):  # causes may run in a circle
        if cause is None:
            return
        yield cause
        cause = cause.getCause()


def is_outcome(spark: SparkSession, exc: BaseException) -> bool:
    """Whether a run's error is its statement's own: then it is data."""
    if isinstance(exc, (guard.GuardError, PythonException)):
        return True
    kinds = spark._jvm.java.lang.Class
    throwable, *values = [kinds.forName(c) for c in ("org.apache.spark.SparkThrowable", *VALUE_ERRORS)]
    for cause in _causes(exc):
        state = cause.getSqlState() if throwable.isInstance(cause) else None
        if state and state != WRITE_FAILED:
            return not state.startswith(SYSTEM_STATES)
        if any(v.isInstance(cause) for v in values):
            return True
    return False


def _prepare(session: SparkSession, sql: str, allow_qualified: bool,
             db: Database | None = None) -> DataFrame:
    """Parse, guard and analyse one statement (no job runs)."""
    guard.check_parsed(session, sql, allow_qualified)
    df = session.sql(sql)
    guard.check_analyzed(df, None if (allow_qualified or db is None) else guard.scope_of(db))
    return df


def row_frame(df: DataFrame, strict_null: bool = False) -> DataFrame:
    """A result as one column ``row`` of rendered rows."""
    pos = positional(df)
    return pos.select(row_key(pos, strict_null).alias("row"))


def hash_sum(hashed: Column) -> Column:
    """The order-free sum of 64-bit hashes as decimal(38,0). The halves are added up as whole numbers (for 2 ** 31
    rows at least), since a decimal for each row costs several times as much."""
    half = F.lit(1 << 32).cast("decimal(14,0)")
    high, low = F.shiftright(hashed, 32), hashed.bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))
    return (F.sum(high).cast("decimal(20,0)") * half + F.sum(low).cast("decimal(20,0)")).cast("decimal(38,0)")


def fingerprint_columns() -> list[Column]:
    """n, fp_a, fp_b over ``row``: a count and two order-free hash sums."""
    zero = F.lit(0).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("fp_n"),
            F.coalesce(hash_sum(F.xxhash64("row")), zero).alias("fp_a"),
            F.coalesce(F.sum(F.hash("row").cast("bigint")).cast("decimal(38,0)"), zero).alias("fp_b")]


def timed_write(spark: SparkSession, out: DataFrame, path: str, timeout_ms: int) -> bool:
    """Write under a job tag; True when the deadline passed (then nothing is left at ``path``)."""
    sc = spark.sparkContext
    tag = f"sqlgauge-run-{uuid.uuid4().hex}"
    ended, late = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(timeout_ms / 1000.0):
            return
        late.set()
        while True:  # a job that starts after the first cancel needs another
            sc.cancelJobsWithTag(tag)
            if ended.wait(CANCEL_AGAIN_S):
                return

    sc.addJobTag(tag)
    dog = threading.Thread(target=watch, daemon=True)
    dog.start()
    try:
        out.write.mode("overwrite").option("compression", RESULT_CODEC).parquet(path)
    except Exception:
        if not late.is_set():
            raise
    finally:
        ended.set()
        dog.join()
        sc.removeJobTag(tag)
    if late.is_set():
        delete_path(spark, path)
    return late.is_set()


@dataclass
class _Ready:
    run_id: str
    db_id: str
    sql: str
    df: DataFrame


def _prepare_run(sessions, run_id: str, db_id: str, sql: str, allow_qualified: bool):
    """A decided log row (unknown database, empty, refused, analysis error) or a ready run."""
    started = time.time()
    if db_id not in sessions.databases:
        return _log(run_id, db_id, sql, False, f"database {db_id} does not exist", "SCHEMA_NOT_FOUND")
    text = (sql or "").strip()
    if not text:
        # No statement, no result set: success with no rows.
        return _log(run_id, db_id, sql, True, columns=[], n_rows=0, fp=(Decimal(0), Decimal(0)))
    try:
        df = _prepare(sessions[db_id], text, allow_qualified, sessions.databases[db_id])
        return _Ready(run_id, db_id, sql, df)
    except Exception as exc:  # noqa: BLE001 - a failed query is data (G4)
        return _failure(run_id, db_id, sql, exc, int((time.time() - started) * 1000))


def _timeout_log(r: _Ready, timeout_ms: int, ms: int) -> tuple:
    return _log(r.run_id, r.db_id, r.sql, False, f"statement timeout: canceled after {timeout_ms} ms",
                "TIMEOUT", True, ms=ms)


def _run_one(spark: SparkSession, r: _Ready, out_dir: str, timeout_ms: int,
             strict_null: bool) -> tuple:
    """One prepared run as its own job; ``RunLost`` where not the statement failed."""
    started = time.time()
    try:
        obs = Observation(f"run_{uuid.uuid4().hex}")
        out = row_frame(r.df, strict_null).observe(obs, *fingerprint_columns())
        path = f"{out_dir}/results/run_id={r.run_id}"
        late = timed_write(spark, out, path, timeout_ms)
        ms = int((time.time() - started) * 1000)
        if late:
            return _timeout_log(r, timeout_ms, ms)
        got = obs.get
        return _log(r.run_id, r.db_id, r.sql, True, columns=list(r.df.columns), n_rows=int(got["fp_n"]),
                    ms=ms, path=path, fp=(got["fp_a"], got["fp_b"]))
    except Exception as exc:  # noqa: BLE001
        if not is_outcome(spark, exc):
            raise RunLost(f"run {r.run_id} has no outcome: {_first_line(exc)}") from exc
        return _failure(r.run_id, r.db_id, r.sql, exc, int((time.time() - started) * 1000))


def run_batch(spark: SparkSession, runs: DataFrame, databases: dict[str, Database],
              *, out_dir: str | None = None, timeout_ms: int | None = None,
              parallelism: int = 8, strict_null: bool = False,
              allow_qualified: bool = False) -> RunResult:
    """Run every (run_id, db_id, sql) row; return the run log and result cells.

    Statements stream through the driver, which submits ``parallelism`` jobs at
    a time; result rows stay on executors.  ``timeout_ms`` of 0/None falls back
    to the 5000 ms default (G3).
    """
    timeout_ms = timeout_ms or DEFAULT_TIMEOUT_MS
    out_dir = out_dir or work_path(spark, "runs")
    plan = runs.select("run_id", "db_id", "sql").distinct().orderBy("db_id", "run_id").toLocalIterator()
    sessions = _LazySessions(spark, databases)
    rows: list[tuple] = []
    path = f"{out_dir}/executions"
    delete_path(spark, path)

    def flush() -> None:
        spark.createDataFrame(rows, EXECUTION_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        rows.clear()

    work = ((r["run_id"], r["db_id"], r["sql"]) for r in plan)
    for row in _executed(spark, work, sessions, out_dir, timeout_ms, parallelism, strict_null, allow_qualified):
        rows.append(row)
        if len(rows) >= LOG_ROWS:
            flush()
    flush()
    executions = spark.read.schema(EXECUTION_SCHEMA).parquet(path)
    return RunResult(executions, read_results(spark, out_dir, executions), out_dir)


def _executed(spark: SparkSession, work: Iterator[tuple], sessions, out_dir: str, timeout_ms: int,
              parallelism: int, strict_null: bool, allow_qualified: bool) -> Iterator[tuple]:
    """Log rows as runs end.  A run past its outer limit is logged as timed out and
    no longer counted; its thread may end whenever its job does.  After a lost run
    no other is begun; when those under way have ended, its error is raised."""
    done: queue.Queue = queue.Queue()
    active: dict[int, dict] = {}
    limit_s = timeout_ms / 1000.0 + CANCEL_GRACE_S

    book = _PlanBook()

    def outcome(item: tuple, state: dict) -> tuple:
        out = _prepare_run(sessions, *item, allow_qualified)
        if not isinstance(out, _Ready):
            return out
        plans = canonical_plans(out.df)
        shared, first = book.claim(out.db_id, plans) if plans else (_Shared(), True)
        if not first:
            return shared.outcome(out)
        state["shared"], state["ready"], state["started"] = shared, out, time.time()
        row = _run_one(spark, out, out_dir, timeout_ms, strict_null)
        shared.finish(row)
        return row

    def run(token: int, item: tuple, state: dict) -> None:
        try:
            out = outcome(item, state)
        except Exception as exc:  # noqa: BLE001 - raised where the rows are read
            out = exc
            if "shared" in state:  # the batch ends without those that wait for it
                state["shared"].finish(_failure(*item, exc, 0))
        done.put((token, out))

    token, left, lost = 0, True, None
    while left or active:
        while left and len(active) < max(1, parallelism):
            item = next(work, None)
            if item is None:
                left = False
                break
            token += 1
            active[token] = {}
            threading.Thread(target=run, args=(token, item, active[token]), daemon=True).start()
        if not active:
            break
        try:
            ended, row = done.get(timeout=0.2)
            if active.pop(ended, None) is not None:  # else it was given up before
                if isinstance(row, Exception):
                    lost, left = lost or row, False
                else:
                    yield row
        except queue.Empty:
            pass
        now = time.time()
        for t, state in list(active.items()):
            if "started" in state and now - state["started"] > limit_s:
                del active[t]
                row = _timeout_log(state["ready"], timeout_ms, int((now - state["started"]) * 1000))
                state["shared"].finish(row)
                yield row
    if lost:
        raise lost


RESULT_SCHEMA = T.StructType([
    T.StructField("row", T.StringType(), True),
    T.StructField("run_id", T.StringType(), True),
])


def read_results(spark: SparkSession, out_dir: str, executions: DataFrame) -> DataFrame:
    """Result rows (run_id, row) of successful runs, from the one root they are written to.

    Runs that shared a job have their rows once, under the ``source_run_id`` that they name.
    """
    ok = executions.where("success AND n_rows > 0").select(F.col("source_run_id").alias("run_id")).distinct()
    if not ok.limit(1).count():
        return spark.createDataFrame([], RESULT_SCHEMA).select("run_id", "row")
    reader = spark.newSession()  # a read's split size is its session's
    reader.conf.set("spark.sql.files.maxPartitionBytes", RESULT_SPLIT)
    rows = reader.read.schema(RESULT_SCHEMA).parquet(f"{out_dir}/results")
    return ok.join(rows, "run_id").select("run_id", "row")
