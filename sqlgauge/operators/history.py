"""Benchmark history (P4): logs, results and scores of many runs, committed run by run.

``record_run`` writes each table of a run under a new attempt,
``<path>/<kind>/attempt=<id>``, and then the run's entry in the manifest,
``<path>/manifest/<run>.json``, which names the attempts. Readers follow the manifest
alone: a run shows up whole or not at all, a repeated write of a run replaces it, and
what a failed write left is never read (``vacuum`` removes it). Attempts are
partitions, so reading some runs reads only their files.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sqlgauge.publish import read_pointer, write_pointer
from sqlgauge.session import child_names, delete_path

MANIFEST = "manifest"
RUN = "bench_run"


def record_run(spark: SparkSession, path: str, run: str, tables: dict[str, DataFrame]) -> dict:
    """Commit ``tables`` (kind -> rows) as the run ``run``; returns its manifest entry.

    The same run written again takes the place of what was there. Kinds that an earlier
    write of the run had and this one has not are gone.
    """
    path = path.rstrip("/")
    entry = {"run": run, "tables": {}}
    for kind, df in sorted(tables.items()):
        if kind == MANIFEST or "/" in kind:
            raise ValueError(f"{kind!r} cannot name a table of the history")
        attempt, seen = f"a{uuid.uuid4().hex[:16]}", Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("n"))
         .write.parquet(f"{path}/{kind}/attempt={attempt}"))
        entry["tables"][kind] = {"attempt": attempt, "rows": int(seen.get["n"])}
    write_pointer(spark, _entry(path, run), entry)
    return entry


def _entry(path: str, run: str) -> str:
    return f"{path.rstrip('/')}/{MANIFEST}/{quote(run, safe='')}.json"


def runs(spark: SparkSession, path: str) -> list[str]:
    """The committed runs, sorted."""
    names = child_names(spark, f"{path.rstrip('/')}/{MANIFEST}")
    return sorted(unquote(n[:-len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def read_history(spark: SparkSession, path: str, kind: str, only: list[str] | None = None) -> DataFrame:
    """The rows of ``kind`` of all committed runs (or ``only`` these), with the run's name in ``bench_run``."""
    path = path.rstrip("/")
    found = []  # one small entry per run
    for run in runs(spark, path) if only is None else only:
        entry = read_pointer(spark, _entry(path, run))
        if entry and kind in entry["tables"]:
            found.append((entry["tables"][kind]["attempt"], run))
    if not found:
        raise LookupError(f"no committed run of {path} has {kind}")
    rows = spark.read.parquet(f"{path}/{kind}").where(F.col("attempt").isin([a for a, _ in found]))
    named = spark.createDataFrame(found, f"attempt string, {RUN} string")
    return rows.join(named, "attempt").drop("attempt")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove attempts that no committed run names; returns how many. Not while a run is being written."""
    path = path.rstrip("/")
    live = {(kind, t["attempt"]) for run in runs(spark, path)
            for kind, t in read_pointer(spark, _entry(path, run))["tables"].items()}
    gone = 0
    for kind in child_names(spark, path):
        if kind == MANIFEST:
            continue
        for name in child_names(spark, f"{path}/{kind}"):
            if name.startswith("attempt=") and (kind, name[len("attempt="):]) not in live:
                delete_path(spark, f"{path}/{kind}/{name}")
                gone += 1
    return gone


def diff_runs(spark: SparkSession, path: str, before: str, after: str,
              keys: tuple[str, ...] = ("example_id", "strategy"), kind: str = "scores") -> DataFrame:
    """``keys``, before, after, change: how each scored answer changed from one run to another.

    ``change`` is fixed, broken, same, added (not scored before) or removed. Keys are unique
    within a run; null keys are keys like others. A ``correct`` that is null counts as false.
    """
    def side(run: str, name: str) -> DataFrame:
        rows = read_history(spark, path, kind, [run])
        return rows.select(*[F.col(k).alias(f"{name}_{k}") for k in keys],
                           F.coalesce("correct", F.lit(False)).alias(name))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"before_{k}").eqNullSafe(F.col(f"after_{k}"))
    both = side(before, "before").join(side(after, "after"), same, "full")
    change = (F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
              .when(F.col("before") == F.col("after"), "same").when(F.col("after"), "fixed").otherwise("broken"))
    return both.select(*[F.coalesce(f"before_{k}", f"after_{k}").alias(k) for k in keys], "before", "after",
                       change.alias("change"))


def diff_summary(diff: DataFrame, by: str = "strategy") -> DataFrame:
    """``by``, change, n."""
    return diff.groupBy(by, "change").agg(F.count(F.lit(1)).alias("n"))
