"""Catalog profiling (C1-C13): tables, columns, keys, counts, samples, schema text.

Column lists come from each table's schema (driver metadata, no job).  Row
counts are one job over all tables (parquet answers a bare count from
footers).  Samples are a ``limit`` per table: the unordered form reads only
the first splits; ordering by key is repeatable but scans the table
(a per-partition top-k, no shuffle).  Texts are assembled with ordered
``collect_list`` + ``array_join`` per table and per database; each group is
bounded by the number of columns or sample rows, never by data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.functions.text import cell_text, render
from sqlgauge.sources.tables import Database

# ---- fixed values: schema-text formats ----
DDL_TEMPLATE = "CREATE TABLE {table} (\n{body}\n);"
COLUMN_TEMPLATE = "  {name} {type}{not_null}"
NOT_NULL = " NOT NULL"
PRIMARY_KEY_TEMPLATE = "  PRIMARY KEY ({columns})"
FOREIGN_KEY_TEMPLATE = "  FOREIGN KEY ({columns}) REFERENCES {ref_table} ({ref_columns})"
DDL_LINE_SEP = ",\n"
KEY_COLUMN_SEP = ", "
SAMPLE_TEMPLATE = "/* {n} example row(s):\n{header}\n{body}\n*/"
CELL_SEP = " | "
SAMPLE_ROW_SEP = "\n"
NULL_TEXT = "None"
DDL_SAMPLE_SEP = "\n"
TABLE_SEP = "\n\n"
MIN_TEMPLATE = "{table}({columns})"
MIN_COLUMN_SEP = ", "
MIN_LINE_SEP = "\n"
# ---- end of fixed values ----

COLUMN_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("is_nullable", T.BooleanType(), False),
    T.StructField("column_default", T.StringType(), True),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("pk_position", T.IntegerType(), True),
])
FK_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("fk_name", T.StringType(), False),
    T.StructField("columns", T.ArrayType(T.StringType()), False),
    T.StructField("ref_table", T.StringType(), False),
    T.StructField("ref_columns", T.ArrayType(T.StringType()), False),
])


def list_schemas(spark: SparkSession) -> DataFrame:
    """User databases of the catalog, sorted (no system namespaces)."""
    names = sorted(d.name for d in spark.catalog.listDatabases()
                   if d.name not in ("information_schema", "global_temp"))
    return spark.createDataFrame([(n,) for n in names], "schema_name string")


def list_tables(spark: SparkSession, schema: str) -> DataFrame:
    """Base tables of a catalog database, sorted; views excluded."""
    names = sorted(t.name for t in spark.catalog.listTables(schema)
                   if (t.tableType or "").upper() not in ("VIEW", "TEMPORARY")
                   and not t.isTemporary)
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def type_text(dt: T.DataType) -> str:
    return dt.simpleString().upper()


def columns(spark: SparkSession, db: Database) -> DataFrame:
    """C3 + C4: one row per column; only key columns are NOT NULL."""
    rows = []
    for t in sorted(db.paths):
        pk = db.keys.primary_keys.get(t, ())
        for i, f in enumerate(db.read(spark, t).schema.fields, start=1):
            pos = pk.index(f.name) + 1 if f.name in pk else None
            rows.append((db.name, t, f.name, type_text(f.dataType), pos is None, None, i, pos))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def foreign_keys(spark: SparkSession, db: Database) -> DataFrame:
    """Foreign keys with column order kept, one row per constraint."""
    rows = [(db.name, fk.table, fk.name, list(fk.columns), fk.ref_table, list(fk.ref_columns))
            for fk in db.keys.foreign_keys if fk.table in db.paths and fk.ref_table in db.paths]
    return spark.createDataFrame(rows, FK_SCHEMA)


def row_counts(spark: SparkSession, db: Database) -> DataFrame:
    """Exact row count per table, all tables in one job."""
    parts = [db.read(spark, t).select(F.lit(db.name).alias("db_id"), F.lit(t).alias("table_name"))
             .groupBy("db_id", "table_name").agg(F.count(F.lit(1)).alias("row_count"))
             for t in sorted(db.paths)]
    return reduce(DataFrame.unionByName, parts)


def _order_cols(df: DataFrame, pk: tuple[str, ...]) -> list:
    rest = [c for c in df.columns if c not in pk]
    return [F.col(c).asc_nulls_last() for c in (*pk, *rest)
            if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]


def _smallest_keys(df: DataFrame, pk: tuple[str, ...], limit: int) -> DataFrame:
    """The rows of the ``limit`` smallest keys.

    The keys are found on the key columns alone; as literals in the filter they
    reach the scan, which then reads the other columns where they can stand.
    """
    if not pk:
        return df
    keys = df.select(*pk).orderBy(*[F.col(c).asc_nulls_last() for c in pk]).limit(limit).distinct().collect()
    hit = F.lit(False)
    for k in keys:  # at most ``limit``
        hit = hit | reduce(lambda a, b: a & b, [
            F.col(c).isNull() if k[c] is None else F.col(c) == F.lit(k[c]) for c in pk])
    return df.where(hit)


def samples(spark: SparkSession, db: Database, limit: int = 3,
            order_by_key: bool = False) -> DataFrame:
    """Up to ``limit`` rows per table as text cells; limit <= 0 gives none.

    Cells render like Python's ``str()`` of a fetched value for NULL ('None') and
    for lists of floats.
    ``order_by_key`` sorts by primary key, then every other column, so the
    choice is repeatable even when the key has duplicates.
    """
    schema = ("db_id string, table_name string, sample_pos int, "
              "cells array<string>")
    if limit <= 0:
        return spark.createDataFrame([], schema)
    parts = []
    for t in sorted(db.paths):
        df = db.read(spark, t)
        cells = F.array(*[cell_text(F.col(f.name), f.dataType, NULL_TEXT) for f in df.schema.fields])
        if order_by_key:
            pk = db.keys.primary_keys.get(t, ())
            picked = _smallest_keys(df, pk, limit).orderBy(*_order_cols(df, pk)).limit(limit)
            # The numbering windows below see at most ``limit`` rows.
            picked = picked.select(cells.alias("cells"),
                                   F.row_number().over(Window.orderBy(*_order_cols(df, pk)))
                                   .alias("sample_pos"))
        else:
            picked = df.limit(limit).select(cells.alias("cells"),
                                            F.monotonically_increasing_id().alias("_m"))
            picked = picked.select("cells", F.row_number().over(Window.orderBy("_m"))
                                   .alias("sample_pos"))
        parts.append(picked.select(F.lit(db.name).alias("db_id"), F.lit(t).alias("table_name"),
                                   F.col("sample_pos").cast("int"), "cells"))
    return reduce(DataFrame.unionByName, parts)


def _ordered_join(order_col: str, text_col: str, sep: str):
    """Texts of a group joined by ``sep`` in ``order_col`` order (bounded groups only)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t")))), lambda x: x["t"]), sep)


def _place(kind: int, position):
    """Sort position of a line: columns, then the key, then foreign keys."""
    return F.struct(F.lit(kind).alias("kind"), position.cast("int").alias("position")).alias("o")


def ddl_text(spark: SparkSession, db: Database, cols: DataFrame | None = None) -> DataFrame:
    """(db_id, table_name, ddl) -- CREATE TABLE text per table."""
    cols = columns(spark, db) if cols is None else cols
    col_lines = cols.select(
        "db_id", "table_name", _place(0, F.col("ordinal")),
        render(COLUMN_TEMPLATE, name=F.col("column_name"), type=F.upper("data_type"),
               not_null=F.when(~F.col("is_nullable"), F.lit(NOT_NULL)).otherwise(F.lit("")))
        .alias("line"))
    pk = (cols.where(F.col("pk_position").isNotNull())
          .groupBy("db_id", "table_name")
          .agg(_ordered_join("pk_position", "column_name", KEY_COLUMN_SEP).alias("k"))
          .select("db_id", "table_name", _place(1, F.lit(0)),
                  render(PRIMARY_KEY_TEMPLATE, columns=F.col("k")).alias("line")))
    fks = foreign_keys(spark, db)
    fk_rank = F.row_number().over(Window.partitionBy("db_id", "table_name").orderBy("fk_name"))
    fk_lines = fks.select(
        "db_id", "table_name", _place(2, fk_rank),
        render(FOREIGN_KEY_TEMPLATE, columns=F.array_join("columns", KEY_COLUMN_SEP),
               ref_table=F.col("ref_table"), ref_columns=F.array_join("ref_columns", KEY_COLUMN_SEP))
        .alias("line"))
    lines = col_lines.unionByName(pk).unionByName(fk_lines.select("db_id", "table_name", "o", "line"))
    body = lines.groupBy("db_id", "table_name").agg(_ordered_join("o", "line", DDL_LINE_SEP).alias("b"))
    return body.select("db_id", "table_name",
                       render(DDL_TEMPLATE, table=F.col("table_name"), body=F.col("b")).alias("ddl"))


def sample_text(spark: SparkSession, db: Database, limit: int = 3,
                order_by_key: bool = False, cols: DataFrame | None = None) -> DataFrame:
    """C11: (db_id, table_name, sample_block); tables without rows are absent."""
    cols = columns(spark, db) if cols is None else cols
    header = (cols.groupBy("db_id", "table_name")
              .agg(_ordered_join("ordinal", "column_name", CELL_SEP).alias("header")))
    rows = samples(spark, db, limit, order_by_key).select(
        "db_id", "table_name", "sample_pos", F.array_join("cells", CELL_SEP).alias("row_text"))
    body = (rows.groupBy("db_id", "table_name")
            .agg(F.count(F.lit(1)).alias("n"),
                 _ordered_join("sample_pos", "row_text", SAMPLE_ROW_SEP).alias("body")))
    return body.join(header, ["db_id", "table_name"]).select(
        "db_id", "table_name",
        render(SAMPLE_TEMPLATE, n=F.col("n").cast("string"), header=F.col("header"),
               body=F.col("body")).alias("sample_block"))


def schema_text(spark: SparkSession, db: Database, include_samples: bool = True,
                limit: int = 3, order_by_key: bool = False,
                cols: DataFrame | None = None) -> DataFrame:
    """(db_id, schema_text): DDL (+ samples) per table by name, blank line between."""
    cols = columns(spark, db) if cols is None else cols
    ddl = ddl_text(spark, db, cols)
    if include_samples:
        smp = sample_text(spark, db, limit, order_by_key, cols)
        ddl = ddl.join(smp, ["db_id", "table_name"], "left").select(
            "db_id", "table_name",
            F.when(F.col("sample_block").isNotNull(),
                   F.concat(F.col("ddl"), F.lit(DDL_SAMPLE_SEP), F.col("sample_block")))
            .otherwise(F.col("ddl")).alias("block"))
    else:
        ddl = ddl.select("db_id", "table_name", F.col("ddl").alias("block"))
    return ddl.groupBy("db_id").agg(
        _ordered_join("table_name", "block", TABLE_SEP).alias("schema_text"))


def schema_text_min(spark: SparkSession, db: Database, cols: DataFrame | None = None) -> DataFrame:
    """(db_id, schema_text_min): ``table(col, col)`` per line."""
    cols = columns(spark, db) if cols is None else cols
    per_table = cols.groupBy("db_id", "table_name").agg(
        _ordered_join("ordinal", "column_name", MIN_COLUMN_SEP).alias("c"))
    lines = per_table.select("db_id", "table_name",
                             render(MIN_TEMPLATE, table=F.col("table_name"), columns=F.col("c"))
                             .alias("line"))
    return lines.groupBy("db_id").agg(
        _ordered_join("table_name", "line", MIN_LINE_SEP).alias("schema_text_min"))


def profile(spark: SparkSession, db: Database, sample_limit: int = 3,
            include_row_count: bool = True, order_by_key: bool = False) -> DataFrame:
    """One row per table: columns, primary key, foreign keys, count, samples."""
    cols = columns(spark, db)
    col_struct = F.struct("ordinal", "column_name", "data_type", "is_nullable",
                          "column_default", F.col("pk_position").isNotNull().alias("is_primary_key"))
    per = cols.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(col_struct)).alias("columns"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pk_position").isNotNull(),
                                                       F.struct("pk_position", "column_name")))),
                    lambda x: x["column_name"]).alias("primary_key"))
    fks = foreign_keys(spark, db).groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("fk_name", "columns", "ref_table", "ref_columns")))
        .alias("foreign_keys"))
    out = per.join(fks, ["db_id", "table_name"], "left").withColumn(
        "foreign_keys", F.coalesce("foreign_keys", F.array().cast(
            "array<struct<fk_name:string,columns:array<string>,ref_table:string,ref_columns:array<string>>>")))
    if include_row_count:
        out = out.join(row_counts(spark, db), ["db_id", "table_name"], "left")
    else:
        out = out.withColumn("row_count", F.lit(None).cast("bigint"))
    smp = samples(spark, db, sample_limit, order_by_key).groupBy("db_id", "table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_pos", "cells"))),
                    lambda x: x["cells"]).alias("sample_rows"))
    return out.join(smp, ["db_id", "table_name"], "left").withColumn(
        "sample_rows", F.coalesce("sample_rows", F.array().cast("array<array<string>>")))
