"""A Spark data source over a directory of SQLite databases (A1-A3).

Layout: ``<path>/<folder>/<db_id>.sqlite``, any number of files per folder.
Files are taken in sorted order; ``only`` keeps one database id, ``limit`` the
first N files -- both applied while planning.  ``part`` picks what is read:

* ``tables``       -- (db_id, table_name, n_rows): user tables, ``sqlite_%`` excluded
* ``columns``      -- (db_id, table_name, cid, column_name, declared, not_null, default, pk_position)
* ``foreign_keys`` -- (db_id, table_name, fk_id, seq, column_name, ref_table, ref_column)
* ``rows``         -- (db_id, table_name, row_id, cells array<string>): every row
  of every table, values as text the way a loader receives them
* ``errors``       -- (db_id, error): files that cannot be read as a database

A file that cannot be read gives no rows in the other parts; one that breaks
while its rows are read gives a row without table name, with the error as its
only cell.  Rows are split into input partitions by (file, table, ``chunk_rows``
rows in rowid order), so a large table is read by many tasks.  With
``spark.sql.python.filterPushdown.enabled`` on, filters on ``db_id`` /
``table_name`` (equality, IN) are pushed down: files and tables they exclude
are never planned.  Files open
read-only by URI.  Each task reads its own file; the path must be visible to
executors (a shared mount), like any file source.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMAS = {
    "tables": "db_id string, table_name string, n_rows bigint",
    "columns": ("db_id string, table_name string, cid int, column_name string, declared string, "
                "not_null boolean, column_default string, pk_position int"),
    "foreign_keys": ("db_id string, table_name string, fk_id int, seq int, column_name string, "
                     "ref_table string, ref_column string"),
    "rows": "db_id string, table_name string, row_id bigint, cells array<string>",
    "errors": "db_id string, error string",
}


def list_files(path: str, only: str | None = None, limit: int | None = None) -> list[tuple[str, str]]:
    """(db_id, file) pairs, sorted; ``only`` and ``limit`` as the loader takes them."""
    out = []
    if os.path.isdir(path):
        for d in sorted(os.listdir(path)):
            folder = os.path.join(path, d)
            if os.path.isdir(folder):
                out += [(f.removesuffix(".sqlite"), os.path.join(folder, f))
                        for f in sorted(os.listdir(folder)) if f.endswith(".sqlite")]
    if only:
        out = [p for p in out if p[0] == only]
    if limit:
        out = out[:limit]
    return out


def connect(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def user_tables(conn: sqlite3.Connection) -> list[str]:
    cur = conn.execute("SELECT name FROM sqlite_master WHERE type='table' "
                       "AND name NOT LIKE 'sqlite_%' ORDER BY name")
    return [r[0] for r in cur.fetchall()]


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def cell_text(v) -> str | None:
    """A stored value as loader text: NULL stays NULL, bytes as ``\\x`` and hex."""
    if v is None:
        return None
    if isinstance(v, bytes):
        return "\\x" + v.hex()
    return str(v)


def chunk_starts(conn: sqlite3.Connection, table: str, chunk: int) -> list[int]:
    """The rowid of every ``chunk``-th row: cuts by rows, however wide the ids spread."""
    q, starts = _q(table), []
    row = conn.execute(f"SELECT min(rowid) FROM {q}").fetchone()
    while row is not None and row[0] is not None:
        starts.append(row[0])
        row = conn.execute(f"SELECT rowid FROM {q} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?",
                           (row[0], chunk)).fetchone()
    return starts


class _Part(InputPartition):
    def __init__(self, db_id: str, file: str, table: str | None = None,
                 lo: int | None = None, hi: int | None = None):
        super().__init__((db_id, file, table, lo, hi))
        self.db_id, self.file, self.table, self.lo, self.hi = db_id, file, table, lo, hi


class SqliteDirReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.part = options.get("part", "rows")
        self.only = options.get("only")
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.chunk = int(options.get("chunk_rows", 1_000_000))
        self.keep = {"db_id": None, "table_name": None}   # pushed-down value sets

    def _kept(self, key: str, value: str) -> bool:
        return self.keep[key] is None or value in self.keep[key]

    def partitions(self):
        files = [(d, f) for d, f in list_files(self.path, self.only, self.limit) if self._kept("db_id", d)]
        if self.part != "rows":
            return [_Part(d, f) for d, f in files] or [_Part("", "")]
        parts = []
        for d, f in files:
            try:
                with connect(f) as conn:
                    for t in user_tables(conn):
                        if not self._kept("table_name", t):
                            continue
                        try:
                            starts = chunk_starts(conn, t, self.chunk)
                        except sqlite3.OperationalError:      # WITHOUT ROWID table
                            parts.append(_Part(d, f, t))
                            continue
                        parts += [_Part(d, f, t, a, b) for a, b in zip(starts, [*starts[1:], None])]
            except sqlite3.DatabaseError:  # told by the ``errors`` part
                continue
        return parts or [_Part("", "")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.file:
            return
        conn = None
        try:
            conn = connect(partition.file)
            yield from getattr(self, "_" + self.part)(conn, partition)
        except sqlite3.DatabaseError as exc:
            if self.part == "rows":
                yield (partition.db_id, None, None, [str(exc)])
        finally:
            if conn is not None:
                conn.close()

    def _errors(self, conn, p):
        try:
            for t in user_tables(conn):
                conn.execute(f"PRAGMA table_info({_q(t)})").fetchall()
        except sqlite3.DatabaseError as exc:
            yield (p.db_id, str(exc))

    def _tables(self, conn, p):
        for t in user_tables(conn):
            n = conn.execute(f"SELECT count(*) FROM {_q(t)}").fetchone()[0]
            yield (p.db_id, t, n)

    def _columns(self, conn, p):
        for t in user_tables(conn):
            for cid, name, decl, notnull, dflt, pk in conn.execute(f"PRAGMA table_info({_q(t)})"):
                yield (p.db_id, t, cid, name, decl, bool(notnull),
                       None if dflt is None else str(dflt), pk or None)

    def _foreign_keys(self, conn, p):
        for t in user_tables(conn):
            for row in conn.execute(f"PRAGMA foreign_key_list({_q(t)})"):
                fk_id, seq, ref_table, frm, to = row[0], row[1], row[2], row[3], row[4]
                yield (p.db_id, t, fk_id, seq, frm, ref_table, to)

    def _rows(self, conn, p):
        t = _q(p.table)
        if p.lo is None:
            cur = conn.execute(f"SELECT NULL, * FROM {t}")
        elif p.hi is None:
            cur = conn.execute(f"SELECT rowid, * FROM {t} WHERE rowid >= ?", (p.lo,))
        else:
            cur = conn.execute(f"SELECT rowid, * FROM {t} WHERE rowid >= ? AND rowid < ?", (p.lo, p.hi))
        for r in cur:
            yield (p.db_id, p.table, r[0], [cell_text(v) for v in r[1:]])


class SqliteDirPushdownReader(SqliteDirReader):
    """The reader with filter pushdown (used when the session enables it)."""

    def pushFilters(self, filters):
        """Equality / IN on db_id and table_name prune files and tables while
        planning; Spark still applies every filter after the scan."""
        for f in filters:
            col = f.attribute[0] if len(f.attribute) == 1 else None
            if col in self.keep and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keep[col] = values if self.keep[col] is None else self.keep[col] & values
            yield f


class SqliteDirSource(DataSource):
    """``spark.read.format("sqlite_dir").option("part", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_dir"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "rows")]

    def reader(self, schema) -> DataSourceReader:
        opts = dict(self.options)
        if opts.get("pushdown", "false").lower() == "true":
            return SqliteDirPushdownReader(opts)
        return SqliteDirReader(opts)


def register(spark) -> None:
    from sqlgauge.session import ship_package
    ship_package(spark)
    spark.dataSource.register(SqliteDirSource)


def read(spark, path: str, part: str = "rows", only: str | None = None,
         limit: int | None = None, chunk_rows: int | None = None):
    register(spark)
    # Spark accepts a reader with pushFilters only when this is enabled.
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    r = spark.read.format("sqlite_dir").option("part", part).option("pushdown", pushdown)
    if only:
        r = r.option("only", only)
    if limit:
        r = r.option("limit", str(limit))
    if chunk_rows:
        r = r.option("chunk_rows", str(chunk_rows))
    return r.load(path)
