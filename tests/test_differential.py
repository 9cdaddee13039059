"""Spark's text operators against the DuckDB oracle on random adversarial strings.

Random token soups (quotes doubled and unbalanced, fences with and without
tags, semicolons, newlines, clause words in odd places) are classified and
cleaned by both engines; every row must agree.  ASCII only: DuckDB's RE2
treats \\b as ASCII while Python and Java (?U) treat it as Unicode.
"""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from sqlgauge import oracle
from sqlgauge.functions import querylog as Q

TOKENS = ["select", "SELECT", "from", "FROM", "where", "group", "by", "order", "having", "join",
          "union", "intersect", "except", "with", "as", "over", "(", ")", ",", "count", "sum(",
          "max (", "t", "a", "b", "x", "'", "''", "'it''s'", '"', '""', "'join'", '"select"',
          "```", "```sql", "```SQL\n", "```sqlite", ";", ";;", " ", "  ", "\n", "\t", "limit 1, 2",
          "rank() over (", "group_concat(", "string_agg (", "selects", "joined", "_join", "from,"]


def _strings(n: int, seed: int = 11) -> list[str]:
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 25)
        out.append(" ".join(rnd.choice(TOKENS) for _ in range(k)) if rnd.random() < 0.7
                   else "".join(rnd.choice(TOKENS) for _ in range(k)))
    return out


def test_spark_equals_duckdb(spark):
    texts = _strings(3000)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "log_id long, query string")
    got = (Q.with_complexity(df, "query")
           .select("log_id", "tier", F.array_join("features", ",").alias("features"),
                   Q.strip_literals(F.col("query")).alias("stripped"),
                   Q.extract_sql(F.col("query")).alias("extracted"))
           .collect())
    mine = {r["log_id"]: (r["tier"], r["features"], r["stripped"], r["extracted"]) for r in got}

    import pandas as pd
    con = duckdb.connect()
    con.register("src_df", pd.DataFrame(rows, columns=["log_id", "query"]))
    sql = (f"WITH {oracle.classify_cte('SELECT log_id, query FROM src_df')[1:]} "
           f"SELECT log_id, tier, features, {oracle.strip_literals_sql('query')} AS stripped, "
           f"{oracle.extract_sql_expr('query')} AS extracted FROM cls")
    theirs = {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}
    bad = [(i, texts[i], mine[i], theirs[i]) for i in mine if mine[i] != theirs[i]]
    assert not bad, bad[:3]


NAME_BITS = ["a", "B", "z", "9", "0", "_", "-", ".", " ", "\t", "\n", "É", "ü", "€", "ß", "$", "(", ")",
             "Order", "ID", "naïve", "x1", "__"]
DECL_BITS = ["INT", "int", "CHAR", "var", "CLOB", "TEXT", "BLOB", "REAL", "FLOA", "DOUB", "NUMERIC",
             "DECIMAL", "MONEY", "BOOL", "DATE", "(", ")", "10", ",", " ", "unsigned", "point"]


def test_names_and_types_equal_duckdb(spark):
    import pandas as pd
    from sqlgauge.functions.names import map_type, sanitize
    rnd = random.Random(5)
    names = ["".join(rnd.choice(NAME_BITS) for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    decls = ["".join(rnd.choice(DECL_BITS) for _ in range(rnd.randint(0, 4))) for _ in range(3000)]
    rows = [(i, names[i], decls[i] if i % 17 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, raw string, decl string")
    mine = {r["i"]: (r["c"], r["t"]) for r in
            df.select("i", sanitize(F.col("raw")).alias("c"), map_type(F.col("decl")).alias("t")).collect()}
    con = duckdb.connect()
    con.register("src_df", pd.DataFrame(rows, columns=["i", "raw", "decl"]))
    theirs = {r[0]: (r[1], r[2]) for r in con.execute(
        f"SELECT i, {oracle.sanitize_sql('raw')}, {oracle.map_type_sql('decl')} FROM src_df").fetchall()}
    bad = [(i, rows[i][1:], mine[i], theirs[i]) for i in mine if mine[i] != theirs[i]]
    assert not bad, bad[:3]
