"""Benchmark-format JSON: schema descriptions and examples.

Schema file: a list of ``{db_id, table_names_original[], column_names_original
[[table_index, name]], column_types[], primary_keys[], foreign_keys[[a, b]]}``;
index -1 is the synthetic ``*`` column.  Examples: ``{db_id, question, query}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.functions.querylog import with_complexity
from sqlgauge.session import path_exists

EXAMPLE_SCHEMA = "db_id string, question string, query string"


def read_schema_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per database, in file order (``file_pos``)."""
    df = spark.read.option("multiLine", True).json(path)
    return df.withColumn("file_pos", F.monotonically_increasing_id())


def schema_columns(dbs: DataFrame) -> DataFrame:
    """A4: (db_id, table_pos, table_name, col_pos, column_name, column_type).

    Skips index -1; a missing type is '?'; a table without columns keeps one
    row with NULL column (left join from the table list).
    """
    tables = dbs.select("db_id", F.posexplode("table_names_original").alias("table_pos", "table_name"))
    cols = dbs.select("db_id", "column_types",
                      F.posexplode("column_names_original").alias("idx", "pair"))
    cols = cols.select(
        "db_id", F.col("idx").alias("col_pos"),
        F.col("pair")[0].cast("int").alias("table_pos"), F.col("pair")[1].alias("column_name"),
        F.coalesce(F.try_element_at("column_types", F.col("idx") + 1), F.lit("?")).alias("column_type"),
    ).where(F.col("table_pos") >= 0)
    return tables.join(cols, ["db_id", "table_pos"], "left")


def read_examples(spark: SparkSession, dev_path: str | None, train_path: str | None) -> DataFrame:
    """A5: dev examples then train examples; a missing file (of any store) is empty."""
    parts = []
    for split, p in (("dev", dev_path), ("train", train_path)):
        if p and path_exists(spark, p):
            df = spark.read.option("multiLine", True).schema(EXAMPLE_SCHEMA).json(p)
        else:
            df = spark.createDataFrame([], EXAMPLE_SCHEMA)
        parts.append(df.withColumn("split", F.lit(split))
                     .withColumn("split_order", F.lit(0 if split == "dev" else 1))
                     .withColumn("file_pos", F.monotonically_increasing_id()))
    return parts[0].unionByName(parts[1])


def dataset_size(dbs: DataFrame, examples: DataFrame) -> DataFrame:
    """Databases, tables, dev, train, total examples."""
    a = dbs.agg(F.count(F.lit(1)).alias("databases"),
                F.coalesce(F.sum(F.size("table_names_original")), F.lit(0)).alias("tables"))
    b = examples.agg(F.count(F.when(F.col("split") == "dev", 1)).alias("dev"),
                     F.count(F.when(F.col("split") == "train", 1)).alias("train"),
                     F.count(F.lit(1)).alias("total"))
    return a.unionByName(b, allowMissingColumns=True).agg(
        *[F.max(c).cast("bigint").alias(c) for c in ("databases", "tables", "dev", "train", "total")])


def database_structure(dbs: DataFrame, show: int = 2) -> DataFrame:
    """Per database (file order): table count, FK count, and for the first
    ``show`` databases a ``table(col:type, ...)`` line per table."""
    cols = schema_columns(dbs)
    per_table = cols.groupBy("db_id", "table_pos", "table_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("column_name").isNotNull(),
            F.struct("col_pos", F.concat_ws(":", "column_name", "column_type").alias("t"))))),
            lambda s: s["t"]), ", ").alias("cols"))
    listing = per_table.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("table_pos", F.concat(F.col("table_name"), F.lit("("), F.col("cols"), F.lit(")"))
                 .alias("t")))), lambda s: s["t"]), "\n").alias("listing"))
    base = dbs.select("db_id", "file_pos", F.size("table_names_original").alias("n_tables"),
                      F.coalesce(F.size("foreign_keys"), F.lit(0)).alias("n_foreign_keys"))
    rank = F.row_number().over(Window.orderBy("file_pos"))   # one row per database: metadata
    out = base.join(listing, "db_id", "left").withColumn("pos", rank)
    return out.select("db_id", "n_tables", "n_foreign_keys",
                      F.when(F.col("pos") <= show, F.col("listing")).alias("listing"), "pos")


def first_examples(examples: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` examples (dev before train, file order) with tier label."""
    top = examples.orderBy("split_order", "file_pos").limit(n)
    return with_complexity(top, "query").select("db_id", "question", "query", "tier", "label")
