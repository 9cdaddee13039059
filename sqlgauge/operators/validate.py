"""Load-time validation jobs (B3-B7): collisions, casts, primary and foreign keys.

All checks are aggregates over whole tables; none collects a group:

* keys are checked by ``groupBy(key).count()`` -- partial aggregation on the
  map side collapses a hot key before the shuffle;
* a foreign key pre-aggregates the child by its key columns and joins the
  result with the parent's key counts; both sides come out of an aggregate
  hash-partitioned by the key, so the join adds no exchange, and a key
  holding a third of the child rows is one row by then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions.names import sanitize
from sqlgauge.sources.tables import Database, ForeignKey


def name_collisions(names: DataFrame, db_col: str = "db_id", table_col: str = "table_name",
                    raw_col: str = "raw_name") -> DataFrame:
    """Cleaned names that more than one raw name maps to, per table.

    Returns db, table, clean_name, n_raw (distinct raw names), and the
    smallest and largest raw name as examples (bounded output per group).
    """
    clean = names.select(db_col, table_col, F.col(raw_col).alias("raw"),
                         sanitize(F.col(raw_col)).alias("clean_name"))
    per_raw = clean.groupBy(db_col, table_col, "clean_name", "raw").agg(F.count(F.lit(1)).alias("k"))
    return (per_raw.groupBy(db_col, table_col, "clean_name")
            .agg(F.count(F.lit(1)).alias("n_raw"), F.min("raw").alias("first_raw"),
                 F.max("raw").alias("last_raw"))
            .where(F.col("n_raw") > 1))


def cast_audit(df: DataFrame, targets: dict[str, str], table: str = "") -> DataFrame:
    """Per column, values that do not fit the target type.

    Values are read as text (as a loader sees them): a value fails when it is
    not NULL and ``try_cast`` gives NULL.  One pass over the table for all
    columns, then unpivoted to one row per column.
    """
    aggs = []
    for c, t in targets.items():
        raw = F.col(c).cast("string")
        bad = raw.isNotNull() & F.expr(f"try_cast(CAST(`{c}` AS STRING) AS {t})").isNull()
        aggs += [F.count(raw).alias(f"v__{c}"), F.count(F.when(bad, 1)).alias(f"b__{c}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("target_type"),
                     F.col(f"v__{c}").alias("n_values"), F.col(f"b__{c}").alias("n_bad"))
            for c, t in targets.items()]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select(
        F.lit(table).alias("table_name"), "r.*")


def pk_check(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Primary key unique and not null, one row per table.

    n_rows, n_null_key (rows with a NULL key part), n_dup_keys (key values
    seen more than once), n_dup_rows (rows carrying them), verdict.
    """
    parts = []
    for t in sorted(tables):
        pk = keys.get(t)
        if not pk:
            continue
        df = tables[t]
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
        per_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per_key.agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("n_null_key"),
            F.count(F.when(~any_null & (F.col("n") > 1), 1)).alias("n_dup_keys"),
            F.coalesce(F.sum(F.when(~any_null & (F.col("n") > 1), F.col("n"))), F.lit(0))
            .alias("n_dup_rows"),
        ).select(F.lit(t).alias("table_name"), F.lit(", ".join(pk)).alias("key_columns"),
                 F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                 F.col("n_null_key").cast("bigint").alias("n_null_key"),
                 F.col("n_dup_keys").cast("bigint").alias("n_dup_keys"),
                 F.col("n_dup_rows").cast("bigint").alias("n_dup_rows")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("verdict", F.when(F.col("n_null_key") > 0, F.lit("null key"))
                          .when(F.col("n_dup_keys") > 0, F.lit("duplicate key"))
                          .otherwise(F.lit("ok")))


def _parent_keys(parent: DataFrame, refs: tuple[str, ...]) -> DataFrame:
    """k0, k1, ..., pn: how often each whole key stands in a parent table."""
    # A key with a NULL part is no key: it is neither found nor a duplicate.
    keys = parent.dropna(subset=list(refs)).groupBy(*refs).agg(F.count(F.lit(1)).alias("pn"))
    return keys.toDF(*[f"k{i}" for i in range(len(refs))], "pn")


def _child_keys(child: DataFrame, cols: tuple[str, ...], fk: int) -> DataFrame:
    """fk, k0, k1, ..., cn: how often each key stands in a child table."""
    keys = child.groupBy(*cols).agg(F.count(F.lit(1)).alias("cn"))
    return keys.toDF(*[f"k{i}" for i in range(len(cols))], "cn").withColumn("fk", F.lit(fk))


def fk_check(tables: dict[str, DataFrame], fks: list[ForeignKey]) -> DataFrame:
    """Foreign keys, best effort: accepted when every child row whose key
    parts are all set finds a parent and the parent key is unique; else
    skipped with a reason (MATCH SIMPLE: a row with a NULL part passes).

    Each parent key is aggregated once, and the keys of all its children are
    joined to it together.
    """
    fks = [fk for fk in fks if fk.table in tables and fk.ref_table in tables]
    spark = next(iter(tables.values())).sparkSession
    parents: dict[tuple, list[int]] = {}
    for i, fk in enumerate(fks):
        parents.setdefault((fk.ref_table, tuple(fk.ref_columns)), []).append(i)
    found, doubled, of_parent = [], [], {}
    for number, ((ref_table, refs), members) in enumerate(parents.items()):
        keys = _parent_keys(tables[ref_table], refs)
        doubled.append(keys.agg(F.count(F.when(F.col("pn") > 1, 1)).alias("n_parent_dup_keys"))
                       .withColumn("parent", F.lit(number)))
        by_type: dict[tuple, list[DataFrame]] = {}  # keys of one type can be joined together
        for i in members:
            of_parent[i] = number
            c = _child_keys(tables[fks[i].table], tuple(fks[i].columns), i)
            by_type.setdefault(tuple(t for _, t in c.dtypes), []).append(c)
        names = [f"k{j}" for j in range(len(refs))]
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in names])
        for children in by_type.values():
            orphan = whole & F.col("pn").isNull()
            found.append(reduce(DataFrame.unionByName, children).join(keys, names, "left").groupBy("fk").agg(
                F.sum("cn").alias("n_child_rows"), F.sum(F.when(whole, F.col("cn"))).alias("n_checked"),
                F.sum(F.when(orphan, F.col("cn"))).alias("n_orphan_rows"),
                F.count(F.when(orphan, 1)).alias("n_orphan_keys")))
    rows = [(i, of_parent[i], fk.name, fk.table, ", ".join(fk.columns), fk.ref_table, ", ".join(fk.ref_columns))
            for i, fk in enumerate(fks)]
    listed = spark.createDataFrame(rows, "fk int, parent int, fk_name string, table_name string, columns string, "
                                         "ref_table string, ref_columns string")
    none = spark.createDataFrame([], "fk int, n_child_rows bigint, n_checked bigint, n_orphan_rows bigint, "
                                     "n_orphan_keys bigint")
    counts = ["n_child_rows", "n_checked", "n_orphan_rows", "n_orphan_keys", "n_parent_dup_keys"]
    doubles = reduce(DataFrame.unionByName, doubled) if doubled else spark.createDataFrame(
        [], "n_parent_dup_keys bigint, parent int")
    out = (listed.join(reduce(DataFrame.unionByName, found, none), "fk", "left").join(doubles, "parent", "left")
           .select("fk_name", "table_name", "columns", "ref_table", "ref_columns",
                   *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts]))
    status = (F.when(F.col("n_parent_dup_keys") > 0, F.lit("skipped"))
              .when(F.col("n_orphan_rows") > 0, F.lit("skipped")).otherwise(F.lit("accepted")))
    reason = (F.when(F.col("n_parent_dup_keys") > 0, F.lit("referenced key is not unique"))
              .when(F.col("n_orphan_rows") > 0,
                    F.concat(F.col("n_orphan_rows").cast("string"), F.lit(" row(s) without parent")))
              .otherwise(F.lit(None).cast("string")))
    return out.withColumn("status", status).withColumn("reason", reason)


def load_plan(spark: SparkSession, databases: list[Database]) -> DataFrame:
    """A9/B7 log without writing: per database, would the load succeed?

    A database fails as a whole when a table's primary key is violated or
    two column names collide after cleaning (the table cannot be created);
    foreign keys never fail it.  Returns db_id, ok, tables, rows, error.
    """
    logs = []
    for db in databases:
        tables = db.tables(spark)
        pk = pk_check(tables, db.keys.primary_keys)
        col_rows = [(db.name, t, c) for t, df in tables.items() for c in df.columns]
        cols = spark.createDataFrame(col_rows, "db_id string, table_name string, raw_name string")
        coll = name_collisions(cols).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_coll"))
        no_pk = [t for t in tables if not db.keys.primary_keys.get(t)]
        counts = pk.select("table_name", "n_rows", "verdict")
        for t in no_pk:
            counts = counts.unionByName(tables[t].agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
                                        .select(F.lit(t).alias("table_name"), "n_rows",
                                                F.lit("ok").alias("verdict")))
        per = counts.join(coll, "table_name", "left")
        bad = (F.coalesce(F.col("verdict"), F.lit("ok")) != "ok") | (F.coalesce("n_coll", F.lit(0)) > 0)
        first_error = F.min(F.when(bad, F.concat(F.col("table_name"), F.lit(": "), F.when(
            F.coalesce("n_coll", F.lit(0)) > 0, F.lit("column names collide")).otherwise(F.col("verdict")))))
        logs.append(per.agg(
            F.count(F.lit(1)).alias("tables"), F.sum("n_rows").alias("rows"),
            F.count(F.when(bad, 1)).alias("n_bad"), first_error.alias("error"),
        ).select(F.lit(db.name).alias("db_id"), (F.col("n_bad") == 0).alias("ok"),
                 F.col("tables").cast("bigint").alias("tables"),
                 F.col("rows").cast("bigint").alias("rows"), "error"))
    return reduce(DataFrame.unionByName, logs)


def load_stats(load_log: DataFrame) -> DataFrame:
    """Databases loaded / failed, and tables and rows of the loaded ones."""
    return load_log.agg(
        F.count(F.when(F.col("ok"), 1)).cast("bigint").alias("databases"),
        F.count(F.when(~F.col("ok"), 1)).cast("bigint").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("tables"))), F.lit(0)).cast("bigint").alias("tables"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("rows"))), F.lit(0)).cast("bigint").alias("rows"))
