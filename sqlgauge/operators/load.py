"""Load many databases at once (A6-A9) from the SQLite directory source.

Plan:

1. Metadata (tables, columns, foreign keys) is read by the source in
   parallel, one task per file, and mapped with Column expressions: cleaned
   names (B2) and target types (B1).
2. All rows of all tables are read once, in rowid-range partitions, and
   staged as text cells under the shared checkpoint folder, partitioned by
   (db_id, table_name).
3. Per database: name collisions (B3), values that do not fit the declared
   type (B4) and primary keys (B5) are checked on the staged data; a database
   with any failure is reported and skipped -- the others load (A9).
4. Each table of a passing database is written typed, with its row count
   taken by ``observe`` during the write (A7).  Foreign keys are checked
   afterwards and either accepted or skipped with a reason (B6).

A database's tables are written to a new folder, ``<target>/<db>/v-<id>``, and
published by switching its pointer, ``<target>/<db>/CURRENT.json``, when all of them
are there: readers (``open_database``) see the old tables or the new ones, and a load
that fails midway leaves the old ones. The version before the current one stays for
those who still read it; older ones go. Replacing needs ``replace=True``. Databases whose
names become one folder name, and several files of one name, are refused before
anything of them is written.
"""

from __future__ import annotations

import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions.names import map_type, sanitize, spark_type_name
from sqlgauge.operators import validate
from sqlgauge.publish import read_pointer, write_pointer
from sqlgauge.session import child_names, delete_path, work_path
from sqlgauge.sources import sqlite
from sqlgauge.sources.tables import Database, ForeignKey, KeyMetadata


@dataclass
class LoadResult:
    log: DataFrame          # db_id, ok, tables, rows, error
    stats: DataFrame        # databases, failed, tables, rows
    foreign_keys: DataFrame
    databases: dict[str, Database]


def column_plan(columns: DataFrame) -> DataFrame:
    """Columns with cleaned names and target types (B1, B2)."""
    target = map_type(F.col("declared"))
    spark_type = spark_type_name(target)
    return columns.select(
        "db_id", "table_name", sanitize(F.col("table_name")).alias("clean_table"), "cid",
        "column_name", sanitize(F.col("column_name")).alias("clean_name"), "declared",
        target.alias("target_type"), spark_type.alias("spark_type"), "pk_position")


def resolve_foreign_keys(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """Group composite parts by (db, table, id) in ``seq`` order; a NULL target
    column means the parent's primary key column at the same position."""
    pk = columns.where(F.col("pk_position").isNotNull()).select(
        "db_id", F.col("table_name").alias("ref_table"),
        (F.col("pk_position") - 1).alias("seq"), F.col("column_name").alias("pk_col"))
    j = fks.join(pk, ["db_id", "ref_table", "seq"], "left")
    j = j.withColumn("ref_column", F.coalesce("ref_column", "pk_col"))
    return j.groupBy("db_id", "table_name", "fk_id", "ref_table").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "column_name"))),
                    lambda s: s["column_name"]).alias("columns"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref_column"))),
                    lambda s: s["ref_column"]).alias("ref_columns"))


def load_sqlite_dir(spark: SparkSession, path: str, target: str, *, only: str | None = None,
                    limit: int | None = None, replace: bool = False,
                    chunk_rows: int | None = None, parallelism: int = 8) -> LoadResult:
    refuse_existing(spark, target, replace)
    cols = column_plan(sqlite.read(spark, path, "columns", only, limit)).persist()
    fks_raw = sqlite.read(spark, path, "foreign_keys", only, limit)
    stage = work_path(spark, "load-stage")
    (sqlite.read(spark, path, "rows", only, limit, chunk_rows)
     .write.mode("overwrite").partitionBy("db_id", "table_name").parquet(stage))
    staged = spark.read.schema(STAGE_SCHEMA).parquet(stage)
    # Files that cannot be read, or broke while they were: one message per database.
    unreadable = sqlite.read(spark, path, "errors", only, limit).select("db_id", "error").unionByName(
        staged.where(F.col("table_name").isNull()).select("db_id", F.col("cells")[0].alias("error")))
    broken = {r["db_id"]: r["error"] for r in
              unreadable.groupBy("db_id").agg(F.min("error").alias("error")).collect()}

    files = sqlite.list_files(path, only, limit)
    refused = clashing_names([d for d, _ in files])
    for d, n in Counter(d for d, _ in files).items():
        if n > 1:
            refused[d] = f"{n} files hold a database of this name"

    meta = cols.orderBy("db_id", "table_name", "cid").collect()   # column metadata: small
    by_table: dict[tuple[str, str], list] = {}
    for r in meta:
        by_table.setdefault((r["db_id"], r["table_name"]), []).append(r)
    fk_rows = resolve_foreign_keys(fks_raw, cols).collect()

    collisions = validate.name_collisions(
        cols.select("db_id", F.col("table_name"), F.col("column_name").alias("raw_name")))
    bad_names = {(r["db_id"]) for r in collisions.select("db_id").distinct().collect()}
    table_coll = validate.name_collisions(
        cols.select("db_id", F.lit("").alias("table_name"), F.col("table_name").alias("raw_name"))
        .distinct())
    bad_names |= {r["db_id"] for r in table_coll.select("db_id").distinct().collect()}

    def typed(db_id: str, table: str) -> DataFrame:
        part = staged.where((F.col("db_id") == db_id) & (F.col("table_name") == table))
        return part.select(*[typed_cell(c["cid"], c["spark_type"]).alias(c["clean_name"])
                             for c in by_table[(db_id, table)]])

    def load_one(db_id: str):
        """Check and write one database; returns (log row, Database or None)."""
        tables = sorted(t for d, t in by_table if d == db_id)
        error = refused.get(db_id) or held_by_another(spark, target, db_id)
        if error is not None:
            pass
        elif db_id in broken:
            error = f"cannot be read: {broken[db_id]}"
        elif db_id in bad_names:
            error = "column or table names collide after cleaning"
        frames, keys = {}, KeyMetadata()
        if error is None:
            audits = []
            for t in tables:
                ccols = by_table[(db_id, t)]
                part = staged.where((F.col("db_id") == db_id) & (F.col("table_name") == t))
                raw = part.select(*[F.col("cells")[c["cid"]].alias(c["clean_name"]) for c in ccols])
                audits.append(validate.cast_audit(
                    raw, {c["clean_name"]: c["spark_type"] for c in ccols}, t))
                frames[t] = typed(db_id, t)
                pk = tuple(c["clean_name"] for c in sorted(
                    (c for c in ccols if c["pk_position"]), key=lambda c: c["pk_position"]))
                if pk:
                    keys.primary_keys[t] = pk
            bad = (reduce(DataFrame.unionByName, audits).where("n_bad > 0")
                   .orderBy("table_name", "column_name").limit(1).collect())
            if bad:
                error = f"{bad[0]['table_name']}.{bad[0]['column_name']}: value does not fit " \
                        f"{bad[0]['target_type'].upper()}"
        if error is None:
            error = first_key_error(frames, keys)
        if error is not None:
            return (db_id, False, 0, 0, error), None
        for r in fk_rows:
            if r["db_id"] == db_id:
                keys.foreign_keys.append(ForeignKey(
                    sanitize_text(r["table_name"]), tuple(sanitize_text(c) for c in r["columns"]),
                    sanitize_text(r["ref_table"]), tuple(sanitize_text(c) for c in r["ref_columns"])))
        keys.primary_keys = {sanitize_text(t): v for t, v in keys.primary_keys.items()}
        paths, n_rows = write_tables(spark, frames, target, db_id, keys)
        return (db_id, True, len(tables), n_rows, None), Database(sanitize_text(db_id), paths, keys)

    # One database per worker thread: each submits its own small jobs, so many
    # databases load at once; a failure stays inside its database.
    logs, loaded = [], {}
    dbs = sorted({k[0] for k in by_table} | set(broken))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for db_id, (row, db) in zip(dbs, pool.map(isolated(load_one, lambda d: d), dbs)):
            logs.append(row)
            if db is not None:
                loaded[db_id] = db
    cols.unpersist()
    log = spark.createDataFrame(logs, LOG_SCHEMA)
    fk_parts = [validate.fk_check(db.tables(spark), db.keys.foreign_keys).withColumn(
        "db_id", F.lit(name)) for name, db in loaded.items() if db.keys.foreign_keys]
    fks = (reduce(DataFrame.unionByName, fk_parts) if fk_parts else
           spark.createDataFrame([], "db_id string, fk_name string, status string"))
    return LoadResult(log, validate.load_stats(log), fks, loaded)


STAGE_SCHEMA = "row_id bigint, cells array<string>, db_id string, table_name string"
LOG_SCHEMA = "db_id string, ok boolean, tables bigint, rows bigint, error string"


def refuse_existing(spark: SparkSession, target: str, replace: bool) -> None:
    """Loading replaces what a target holds, in any store, only when told to."""
    if not replace and child_names(spark, target):
        raise FileExistsError(f"{target} exists; pass replace=True to reload")


def isolated(load_one, name_of):
    """``load_one`` with any error turned into the database's log row."""
    def run(db):
        try:
            return load_one(db)
        except Exception as exc:  # noqa: BLE001 - one database must not end the load
            text = str(exc).strip()
            return (name_of(db), False, 0, 0, text.splitlines()[0] if text else type(exc).__name__), None
    return run


def typed_cell(cid: int, spark_type: str):
    """A text cell as its column's type; bytes arrive as ``\\x`` and hex."""
    cell = F.col("cells")[cid]
    if spark_type == "binary":
        return F.when(cell.startswith("\\x"), F.unhex(F.expr(f"substr(cells[{cid}], 3)"))).otherwise(
            F.encode(cell, "UTF-8"))
    return F.expr(f"try_cast(cells[{cid}] AS {spark_type})")


def first_key_error(frames: dict[str, DataFrame], keys: KeyMetadata) -> str | None:
    """The first table (by name) whose primary key is violated, as an error text."""
    if not keys.primary_keys:
        return None
    bad = (validate.pk_check(frames, keys.primary_keys).where("verdict <> 'ok'")
           .orderBy("table_name").limit(1).collect())
    return f"{bad[0]['table_name']}: primary key {bad[0]['verdict']}" if bad else None


POINTER = "CURRENT.json"


def db_folder(target: str, db_id: str) -> str:
    return f"{target.rstrip('/')}/{sanitize_text(db_id)}"


def clashing_names(db_ids: list[str]) -> dict[str, str]:
    """Databases that would share a folder with another one: name -> why it is refused."""
    by_folder: dict[str, set] = {}
    for d in db_ids:
        by_folder.setdefault(sanitize_text(d), set()).add(d)
    return {d: f"its folder {folder} would also hold {', '.join(sorted(names - {d}))}"
            for folder, names in by_folder.items() if len(names) > 1 for d in names}


def held_by_another(spark: SparkSession, target: str, db_id: str) -> str | None:
    """Why a database may not replace what its folder holds: that came from another name."""
    there = read_pointer(spark, f"{db_folder(target, db_id)}/{POINTER}")
    if there and there["db_id"] != db_id:
        return f"its folder {sanitize_text(db_id)} holds {there['db_id']}"
    return None


def write_tables(spark: SparkSession, frames: dict[str, DataFrame], target: str,
                 db_id: str, keys: KeyMetadata) -> tuple[dict, int]:
    """Write every table of one database into a new version and publish it; row counts
    come from ``observe``."""
    folder, version = db_folder(target, db_id), f"v-{uuid.uuid4().hex[:12]}"
    n_rows, paths = 0, {}
    for t in sorted(frames):
        clean_t = sanitize_text(t)
        obs = Observation(f"load_{db_id}_{t}")
        paths[clean_t] = f"{folder}/{version}/{clean_t}"
        frames[t].observe(obs, F.count(F.lit(1)).alias("n")).write.parquet(paths[clean_t])
        n_rows += int(obs.get.get("n", 0))
    before = read_pointer(spark, f"{folder}/{POINTER}")
    write_pointer(spark, f"{folder}/{POINTER}", {
        "db_id": db_id, "version": version, "tables": sorted(paths), "rows": n_rows,
        "primary_keys": {t: list(c) for t, c in keys.primary_keys.items()},
        "foreign_keys": [[f.table, list(f.columns), f.ref_table, list(f.ref_columns)] for f in keys.foreign_keys]})
    keep = {version, before["version"]} if before else {version}
    for name in child_names(spark, folder):
        if name.startswith("v-") and name not in keep:
            delete_path(spark, f"{folder}/{name}")
    return paths, n_rows


def open_database(spark: SparkSession, target: str, db_id: str) -> Database:
    """A loaded database as its pointer has it now; later loads do not change what was opened."""
    folder = db_folder(target, db_id)
    there = read_pointer(spark, f"{folder}/{POINTER}")
    if there is None:
        raise LookupError(f"{target} holds no database {db_id}")
    keys = KeyMetadata({t: tuple(c) for t, c in there["primary_keys"].items()},
                       [ForeignKey(t, tuple(c), r, tuple(rc)) for t, c, r, rc in there["foreign_keys"]])
    return Database(sanitize_text(db_id), {t: f"{folder}/{there['version']}/{t}" for t in there["tables"]}, keys)


def load_databases(spark: SparkSession, databases: list[Database], target: str, *,
                   replace: bool = False, parallelism: int = 8) -> LoadResult:
    """A6-A9 for databases that are already typed (parquet folders).

    Per database: names cleaned (B2) and checked for collisions (B3), primary
    keys checked (B5); a failing database is reported and not written, the
    others load in parallel; foreign keys are checked after the writes (B6).
    """
    refuse_existing(spark, target, replace)
    names_of = [db.name for db in databases]
    refused = clashing_names(names_of)
    refused |= {d: f"{n} databases have this name" for d, n in Counter(names_of).items() if n > 1}

    def load_one(db: Database):
        error = refused.get(db.name) or held_by_another(spark, target, db.name)
        if error is not None:
            return (db.name, False, 0, 0, error), None
        tables = db.tables(spark)
        names = [(db.name, t, c) for t, df in tables.items() for c in df.columns]
        names += [(db.name, "", t) for t in tables]
        coll = validate.name_collisions(spark.createDataFrame(
            names, "db_id string, table_name string, raw_name string")).limit(1).collect()
        if coll:
            return (db.name, False, 0, 0, "column or table names collide after cleaning"), None
        error = first_key_error(tables, db.keys)
        if error is not None:
            return (db.name, False, 0, 0, error), None
        frames = {t: df.toDF(*[sanitize_text(c) for c in df.columns]) for t, df in tables.items()}
        keys = KeyMetadata(
            {sanitize_text(t): tuple(sanitize_text(c) for c in v) for t, v in db.keys.primary_keys.items()
             if t in tables},
            [ForeignKey(sanitize_text(f.table), tuple(map(sanitize_text, f.columns)),
                        sanitize_text(f.ref_table), tuple(map(sanitize_text, f.ref_columns)))
             for f in db.keys.foreign_keys if f.table in tables and f.ref_table in tables])
        paths, n_rows = write_tables(spark, frames, target, db.name, keys)
        return (db.name, True, len(tables), n_rows, None), Database(sanitize_text(db.name), paths, keys)

    logs, loaded = [], {}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for db, (row, out) in zip(databases, pool.map(isolated(load_one, lambda d: d.name), databases)):
            logs.append(row)
            if out is not None:
                loaded[db.name] = out
    log = spark.createDataFrame(logs, LOG_SCHEMA)
    fk_parts = [validate.fk_check(d.tables(spark), d.keys.foreign_keys).withColumn("db_id", F.lit(n))
                for n, d in loaded.items() if d.keys.foreign_keys]
    fks = (reduce(DataFrame.unionByName, fk_parts) if fk_parts else
           spark.createDataFrame([], "db_id string, fk_name string, status string"))
    return LoadResult(log, validate.load_stats(log), fks, loaded)


def register_in_catalog(spark: SparkSession, db: Database, namespace: str | None = None,
                        replace: bool = False, location: str | None = None) -> Database:
    """Make a loaded database one catalog namespace (one per db_id): each table
    an external parquet table at its loaded path.  The namespace lives in the
    database's own folder (not the working directory's warehouse) unless
    ``location`` says otherwise.  Recreating an existing namespace drops it,
    so that needs ``replace=True``."""
    ns = namespace or db.name
    loc = location or sorted(db.paths.values())[0].rstrip("/").rsplit("/", 1)[0]
    exists = ns in [d.name for d in spark.catalog.listDatabases()]
    if exists and not replace:
        raise FileExistsError(f"namespace {ns} exists; pass replace=True to recreate it")
    if exists:
        spark.sql(f"DROP DATABASE `{ns}` CASCADE")
    spark.sql(f"CREATE DATABASE `{ns}` LOCATION '{loc}'")
    for t, path in sorted(db.paths.items()):
        spark.sql(f"CREATE TABLE `{ns}`.`{t}` USING parquet LOCATION '{path}'")
    return Database(ns, {t: f"{ns}.{t}" for t in db.paths}, db.keys, namespace=ns)


def sanitize_text(name: str) -> str:
    """The B2 rule for one identifier on the driver (table and database names)."""
    import re

    from sqlgauge.functions.names import DIGIT_PREFIX, EMPTY_IDENT, IDENT_KEEP
    s = re.sub(f"[^{IDENT_KEEP}]", "_", name.strip().lower())
    if not s:
        s = EMPTY_IDENT
    if s[0].isdigit():
        s = DIGIT_PREFIX + s
    return s
