"""Corpora derived by SQL from the test tables.

The test tables hold no SQL text, no code fences and no SQLite declarations,
so the text operators run on corpora derived row by row from ``events``:
every event yields one query string, one model-style response, one declared
column type and one raw column name.  The derivation is plain SQL text that
Spark and DuckDB both run identically, so the oracle can rebuild it.

Only ``chr()``, ``||``, ``CASE``, ``%`` and ``CAST(.. AS STRING)`` are used:
Spark reads ``'it''s'`` as two adjacent literals (``its``) and DuckDB does
not expand ``\\n``, so quotes and newlines come from ``chr``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Query templates of every tier and of the odd shapes; {n} is the event id.
QUERY_TEMPLATES = [
    "SELECT crate_no, colour FROM crate WHERE crate_no < {n}",
    "SELECT p.slot, q.slot FROM rack p, rack q WHERE q.floor_no = p.floor_no AND p.slot > {n}",
    "SELECT d.town, r.km FROM depot d RIGHT JOIN route r ON r.depot_id = d.depot_id",
    "SELECT shift, min(load_kg) FROM trip GROUP BY shift HAVING min(load_kg) < {n}",
    "SELECT driver FROM trip WHERE trip_id IN (SELECT trip_id FROM fine)",
    "SELECT town FROM depot EXCEPT SELECT town FROM closed_depot",
    "SELECT town FROM depot INTERSECT SELECT town FROM fair EXCEPT SELECT town FROM closed_depot",
    "SELECT trip_id, row_number() OVER (PARTITION BY shift ORDER BY load_kg) FROM trip",
    "WITH late AS (SELECT trip_id FROM trip WHERE delay_min > {n}) SELECT trip_id FROM late",
    "SELECT body FROM memo WHERE body = 'count(x), union or having: that''s all'",
    "SELECT driver FROM trip LIMIT 3, {n}",
    "     ",
]
# Response wrappers; {q} is the query, \n a newline.
RESPONSE_WRAPPERS = [
    "{q}",
    "```sql\n{q};\n```",
    "The statement, as asked:\n```\n{q}\n```\nIt scans each table once.",
    "{q};;",
    "```SQL\n{q}",
    "```sqlx\n{q}\n```",
]
# Declared column types, in SQLite style; the last slot is NULL.
DECLARED_TYPES = [
    "INTEGER", "int", "BIGINT UNSIGNED", "VARCHAR(255)", "nchar(10)", "CLOB",
    "TEXT", "BLOB", "", "REAL", "FLOAT", "double precision", "NUMERIC(10,2)",
    "decimal", "MONEY", "BOOLEAN", "DATE", "DATETIME", "POINT", "INTERVAL",
    "FLOATING POINT", "NUMBER", "year", None,
]
# Raw column-name shapes; {e} event type, {n} event id.
NAME_SHAPES = [
    "{e}_id", " {E} Name ", "{n}{e}", "{e}-{n}", "Order Total ($)", "", "   ",
    "{E}.{e}", "Prix {e} €", "_{e}_",
]


# Questions on the test databases, in words of their tables and columns; {n} is the event id.
QUESTION_TEMPLATES = [
    ("shop", "Highest totalprice per orderpriority since {n}"),
    ("shop", "acctbal of each customer by mktsegment"),
    ("shop", "How do returnflag and linestatus of lineitem {n} go together?"),
    ("shop", "Which nation lies in which region, by name?"),
    ("shop", "supplier with an acctbal under {n}"),
    ("shop", "brand, size and retailprice of part {n}"),
    ("shop", "events per user id and event type"),
    ("corpus", "lang and source of documents, with their chars"),
    ("corpus", "url of page {n}, with its html"),
    ("corpus", "role and turn in conversations"),
    ("corpus", "Which labels say toxic, and of what quality?"),
    ("corpus", "What will the weather be?"),
]


def _sql_text(template: str, subs: dict[str, str]) -> str:
    """Render a template as a SQL string expression (chr for quote/newline)."""
    out: list[str] = []
    buf = ""
    i = 0
    while i < len(template):
        ch = template[i]
        if ch == "{":
            j = template.index("}", i)
            key = template[i + 1:j]
            if buf:
                out.append("'" + buf + "'")
                buf = ""
            out.append(subs[key])
            i = j + 1
            continue
        if ch == "'":
            if buf:
                out.append("'" + buf + "'")
                buf = ""
            out.append("chr(39)")
        elif ch == "\n":
            if buf:
                out.append("'" + buf + "'")
                buf = ""
            out.append("chr(10)")
        else:
            buf += ch
        i += 1
    if buf:
        out.append("'" + buf + "'")
    if not out:
        return "''"
    return " || ".join(out)


def _case(selector: str, branches: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches))
    return f"CASE {selector} {whens} END"


N_TEXT = "CAST(event_id AS STRING)"


def query_expr() -> str:
    return _case("event_id % 12", [_sql_text(t, {"n": N_TEXT}) for t in QUERY_TEMPLATES])


def response_expr(query_sql: str = "query") -> str:
    wraps = [_sql_text(w, {"q": query_sql}) for w in RESPONSE_WRAPPERS]
    return _case("CAST(floor(event_id / 12) AS BIGINT) % 6", wraps)


def query_log_sql() -> str:
    """SQL (Spark and DuckDB) for the derived query log: one row per event."""
    return (
        "SELECT log_id, event_type AS source, query, " + response_expr("query") +
        " AS response FROM (SELECT event_id, event_id AS log_id, event_type, "
        + query_expr() + " AS query FROM events) q"
    )


def questions_sql() -> str:
    """One question per event: (example_id, db_id, question)."""
    pick = f"event_id % {len(QUESTION_TEMPLATES)}"
    return ("SELECT event_id AS example_id, " + _case(pick, [f"'{db}'" for db, _ in QUESTION_TEMPLATES])
            + " AS db_id, " + _case(pick, [_sql_text(t, {"n": N_TEXT}) for _, t in QUESTION_TEMPLATES])
            + " AS question FROM events")


def scored_sql(offset: int, left_out: int) -> str:
    """A scored run of all events but every ``left_out``-th: (strategy, example_id, correct)."""
    return (f"SELECT event_type AS strategy, event_id AS example_id, (event_id * 7 + {offset}) % 5 < 2 AS correct "
            f"FROM events WHERE event_id % {left_out} <> 0")


def calls_sql() -> str:
    """One prompt per event: (example_id, strategy, system, user_text)."""
    return ("SELECT CAST(log_id AS STRING) AS example_id, source AS strategy, 'Answer.' AS system, "
            f"query AS user_text FROM ({query_log_sql()}) l")


def declarations_sql() -> str:
    """Derived declared column types: (column_id, declared)."""
    branches = ["NULL" if d is None else _sql_text(d, {}) for d in DECLARED_TYPES]
    return ("SELECT event_id AS column_id, "
            + _case(f"event_id % {len(DECLARED_TYPES)}", branches)
            + " AS declared FROM events")


def raw_names_sql() -> str:
    """Derived raw identifiers: (db_id, table_name, column_id, raw_name).

    Database is the event type, table is the user id bucket; many raw names
    sanitize to the same identifier within one table, which B3 reports.
    """
    subs = {"e": "event_type", "E": "upper(event_type)", "n": N_TEXT}
    branches = [_sql_text(s, subs) for s in NAME_SHAPES]
    return ("SELECT event_type AS db_id, 't' || CAST(user_id % 50 AS STRING) AS table_name, "
            "event_id AS column_id, "
            + _case(f"event_id % {len(NAME_SHAPES)}", branches)
            + " AS raw_name FROM events")


def _with_events(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """``dealt``: the rows are dealt to the session's shuffle partitions first. A file's row group
    is read by one task, and few ids fill one, so costly work on the texts would keep few tasks busy."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    if dealt:
        events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The events DataFrame is bound as a SQL argument: no named view, one
    # lineage, and column pruning reaches the parquet reader.
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=events)


def query_log(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return _with_events(spark, sf_dir, query_log_sql(), dealt)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_events(spark, sf_dir, questions_sql())


def scored(spark: SparkSession, sf_dir: str, offset: int, left_out: int) -> DataFrame:
    return _with_events(spark, sf_dir, scored_sql(offset, left_out))


def call_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_events(spark, sf_dir, calls_sql())


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_events(spark, sf_dir, declarations_sql())


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_events(spark, sf_dir, raw_names_sql())


def query_log_copies(spark: SparkSession, sf_dir: str, copies: int = 10) -> DataFrame:
    """A larger derived log: every event yields ``copies`` entries, each with
    its own id (event_id * copies + j) run through the same templates."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    grown = events.selectExpr(
        f"explode(sequence(event_id * {copies}, event_id * {copies} + {copies - 1})) AS event_id",
        "event_type")
    return spark.sql(query_log_sql().replace("FROM events", "FROM {events}"), events=grown)
