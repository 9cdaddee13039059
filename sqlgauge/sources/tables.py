"""A directory of parquet tables seen as one database, plus its key metadata.

Spark's default catalog keeps no primary or foreign keys, so keys live in
plain metadata (here for the driver's test tables; loaders build the same
shape from SQLite declarations).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


@dataclass(frozen=True)
class ForeignKey:
    table: str
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"fk_{self.table}_{'_'.join(self.columns)}_{self.ref_table}"


@dataclass
class KeyMetadata:
    primary_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)


# Columns of the driver's test tables, in order.
TEST_COLUMNS = {t: tuple(c.split()) for t, c in {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}.items()}

# Declared keys of the driver's test tables.
TEST_KEYS = KeyMetadata(
    primary_keys={
        "region": ("r_regionkey",),
        "nation": ("n_nationkey",),
        "customer": ("c_custkey",),
        "supplier": ("s_suppkey",),
        "part": ("p_partkey",),
        "orders": ("o_orderkey",),
        "lineitem": ("l_orderkey", "l_linenumber"),
        "events": ("event_id",),
        "documents": ("doc_id",),
        "labels": ("doc_id",),
        "conversations": ("conv_id", "turn"),
        "embeddings": ("vec_id",),
        "pages": ("page_id",),
        "benchmark": ("item_id",),
    },
    foreign_keys=[
        ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
        ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
        ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
        ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
        ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
        ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
        ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
        ForeignKey("events", ("user_id",), "customer", ("c_custkey",)),
        ForeignKey("labels", ("doc_id",), "documents", ("doc_id",)),
        # Reverse direction on purpose: most documents carry no label.
        ForeignKey("documents", ("doc_id",), "labels", ("doc_id",)),
    ],
)


@dataclass
class Database:
    """A named database: table name -> parquet path, with key metadata."""

    name: str
    paths: dict[str, str]
    keys: KeyMetadata = field(default_factory=KeyMetadata)
    namespace: str | None = None      # set when the tables live in a catalog namespace
    _frames: dict = field(default_factory=dict, repr=False, compare=False)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table as a DataFrame; one file listing and footer read per session."""
        key = (id(spark), table)
        if key not in self._frames:
            self._frames[key] = (spark.table(f"`{self.namespace}`.`{table}`") if self.namespace
                                 else spark.read.parquet(self.paths[table]))
        return self._frames[key]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {t: self.read(spark, t) for t in sorted(self.paths)}

    def register(self, spark: SparkSession) -> SparkSession:
        """Expose every table by its unqualified name: the current database
        of the session for a catalog namespace, else one temp view per table."""
        if self.namespace:
            spark.catalog.setCurrentDatabase(self.namespace)
            return spark
        for t in self.paths:
            self.read(spark, t).createOrReplaceTempView(t)
        return spark


def parquet_dir_database(sf_dir: str, name: str = "testdb",
                         tables: list[str] | None = None,
                         keys: KeyMetadata | None = None) -> Database:
    names = tables or TABLE_NAMES
    paths = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in names}
    return Database(name, paths, keys if keys is not None else TEST_KEYS)



def catalog_database(spark: SparkSession, namespace: str,
                     keys: KeyMetadata | None = None) -> Database:
    """A catalog namespace as a Database (base tables only, views excluded)."""
    tables = [t.name for t in spark.catalog.listTables(namespace)
              if not t.isTemporary and (t.tableType or "").upper() != "VIEW"]
    return Database(namespace, {t: f"{namespace}.{t}" for t in tables},
                    keys or KeyMetadata(), namespace=namespace)
