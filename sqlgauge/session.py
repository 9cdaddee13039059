"""Session helpers: local sessions for tests, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a benchmark session wants; applied only when building a session here.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "sqlgauge", extra: dict | None = None) -> SparkSession:
    """A local session (tests and bench). Clusters build their own session."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``, not ``local-cluster``)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3...);
    we read it from the session and never replace it.  Without one, a cluster
    session is refused: a folder of the driver's machine is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # A local run (tests): a fresh scratch folder of our own.
        configured = tempfile.mkdtemp(prefix="sqlgauge-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    leaf = "/".join(p.strip("/") for p in parts) if parts else ""
    tail = f"sqlgauge-{uuid.uuid4().hex[:12]}"
    return f"{base}/{tail}/{leaf}".rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store's scheme, as tasks need it that open files themselves."""
    fs, jpath = _hadoop(spark, path)
    return fs.makeQualified(jpath).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads exists."""
    fs, jpath = _hadoop(spark, path)
    return bool(fs.exists(jpath))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any store (nothing to do if it is absent)."""
    fs, jpath = _hadoop(spark, path)
    fs.delete(jpath, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder of any store (none if it is absent)."""
    fs, jpath = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def written(df, name: str):
    """``df`` as a table under the shared folder, read back: computed once, with
    a short lineage that survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def env_cpus(default: int = 8) -> int:
    try:
        return int(os.environ.get("BENCH_CPUS", default))
    except ValueError:
        return default


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per context).

    Needed where Spark pickles our classes by reference (the SQLite data
    source); the zip travels through Spark's own file distribution.
    """
    import zipfile

    import sqlgauge
    sc = spark.sparkContext
    if getattr(sc, "_sqlgauge_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(sqlgauge.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="sqlgauge-code-"), "sqlgauge.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    sc._sqlgauge_shipped = True
