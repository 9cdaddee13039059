"""Classifier, literal stripping and SQL extraction."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import querylog as Q


def classify(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, query string")
    rows = Q.with_complexity(df, "query").orderBy("i").collect()
    return [(r["tier"], list(r["features"])) for r in rows]


def one(spark, text):
    return classify(spark, [text])[0]


# One query per tier and feature, over tables of our own.
SHAPES = [
    ("SELECT call_sign, flag FROM vessel WHERE draft_m BETWEEN 2 AND 7 ORDER BY flag DESC", 1, set()),
    ("SELECT DISTINCT soil FROM plot", 1, set()),
    ("SELECT v.flag FROM vessel v LEFT OUTER JOIN docking d USING (vessel_no)", 2, {"join"}),
    ("SELECT v.flag FROM vessel v, docking d, berth b WHERE d.vessel_no = v.vessel_no", 2, {"join"}),
    ("SELECT min(height_m), max(height_m) FROM tree", 3, {"aggregate"}),
    ("SELECT kind, sum(height_m) FROM tree GROUP BY kind HAVING sum(height_m) < 9", 3,
     {"aggregate", "group_by", "having"}),
    ("SELECT kind FROM tree WHERE plot_no IN (SELECT plot_no FROM plot WHERE soil = 'clay')", 4, {"subquery"}),
    ("SELECT label FROM berth INTERSECT SELECT soil FROM plot", 4, {"subquery", "set_operation"}),
    ("SELECT tree_no, lead(height_m) OVER (ORDER BY tree_no) FROM tree", 5, {"window_function"}),
    ("WITH wide AS (SELECT 2 AS w) SELECT w FROM wide", 5, {"cte"}),
    ("SELECT label FROM berth WHERE label = 'inner join, group by, over ('", 1, set()),
]


@pytest.mark.parametrize("sql,tier,feats", SHAPES)
def test_tier_and_features_of_each_shape(spark, sql, tier, feats):
    got_tier, got = one(spark, sql)
    assert got_tier == tier and set(got) == feats


def test_text_without_words_is_the_lowest_tier(spark):
    assert classify(spark, [None, "\t", ""]) == [(1, [])] * 3


# Behaviours to keep (SURVEY D).
KEEP = [
    ("SELECT x FROM a UNION SELECT x FROM b", 4, ["subquery", "set_operation"]),
    ("SELECT x FROM a UNION SELECT x FROM b UNION SELECT x FROM c", 5,
     ["subquery", "set_operation", "deep_nesting"]),
    ("SELECT x FROM t LIMIT 1, 2", 2, ["join"]),
    ("SELECT EXTRACT(year FROM d), x FROM t", 2, ["join"]),
    ("SELECT x, rank() OVER w FROM t WINDOW w AS (ORDER BY x)", 1, []),
    ("WITH c AS MATERIALIZED (SELECT 1) SELECT * FROM c", 4, ["subquery"]),
    ("SELECT x FROM t -- join me", 2, ["join"]),
    ("SELECT * FROM t WHERE note = 'please join, it''s over (now)'", 1, []),
    ('SELECT "join" FROM t', 1, []),
    ("SELECT group_concat(x) FROM t", 3, ["aggregate"]),
    ("SELECT count (x) FROM t GROUP  BY y", 3, ["aggregate", "group_by"]),
    ("SELECT max_x FROM t", 1, []),
    ("select a from t where b in (select c from u where d in (select e from v))", 5,
     ["subquery", "deep_nesting"]),
    ("SELECT a FROM t1, (SELECT b FROM t2) s", 4, ["subquery"]),
    ("SELECT a FROM t ORDER BY a, b", 1, []),
]


@pytest.mark.parametrize("sql,tier,feats", KEEP)
def test_behaviours(spark, sql, tier, feats):
    assert one(spark, sql) == (tier, feats)


def test_labels(spark):
    df = spark.createDataFrame([("SELECT 1",), ("SELECT a FROM x JOIN y",)], "query string")
    labels = [r["label"] for r in Q.with_complexity(df).collect()]
    assert labels == [Q.TIER_LABELS[1], Q.TIER_LABELS[2]]


STRIP = [
    ("'a''b'", "''"),
    ("'a' 'b'", "'' ''"),
    ("'a'''", "''"),
    ("'a'' b", "''' b"),
    ("'abc", "'abc"),
    ("x = 'it''s' AND y = \"q\"\"r\"", "x = '' AND y = \"\""),
    ("'a'''b'", "''b'"),
    ("a \x01 b = 'x'", "a \x01 b = ''"),
    ("\x01\x01 'p''q' \x02b \x01 \"r\"", "\x01\x01 '' \x02b \x01 \"\""),
    ("'\x01' || \x02a\x02", "'' || \x02a\x02"),
]


@pytest.mark.parametrize("text,want", STRIP)
def test_strip_literals(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(Q.strip_literals(F.col("s")).alias("o")).first()["o"] == want


def test_long_literals_do_not_overflow(spark):
    long_lit = "SELECT * FROM t WHERE x = '" + "a" * 800_000 + "' OR y JOIN z"
    many_quotes = "SELECT * FROM t WHERE x = '" + "''" * 200_000 + "'"
    got = classify(spark, [long_lit, many_quotes])
    assert got == [(2, ["join"]), (1, [])]
    df = spark.createDataFrame([(many_quotes,)], "s string")
    assert df.select(Q.strip_literals(F.col("s")).alias("o")).first()["o"] == \
        "SELECT * FROM t WHERE x = ''"


EXTRACT = [
    ("SELECT 1", "SELECT 1"),
    ("```sql\nSELECT 1;\n```", "SELECT 1"),
    ("Here it is:\n```\nSELECT 1\n```\nDone.", "SELECT 1"),
    ("SELECT 1;;", "SELECT 1"),
    ("```SQL\nSELECT 1", "```SQL\nSELECT 1"),
    ("```sqlite\nSELECT 1\n```", "ite\nSELECT 1"),
    ("a; ;", "a;"),
    ("", ""),
    (None, ""),
    ("```sql\n```", ""),
    ("  \t SELECT 2 \n", "SELECT 2"),
    ("x ```sql\nA\n``` y ```sql\nB\n```", "A"),
]


@pytest.mark.parametrize("text,want", EXTRACT)
def test_extract_sql(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(Q.extract_sql(F.col("t")).alias("o")).first()["o"] == want


def test_derived_corpus_tiers(spark):
    from sqlgauge.sources import derived
    log = derived.query_log(spark, "/root/testdata/sf0.001")
    rows = Q.with_complexity(log).where("log_id < 12").orderBy("log_id").collect()
    assert [r["tier"] for r in rows] == [1, 2, 2, 3, 4, 4, 5, 5, 5, 1, 2, 1]


def test_derived_copies(spark):
    from sqlgauge.sources import derived
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    big = derived.query_log_copies(spark, sf, 10)
    assert big.count() == 10 * n and big.select("log_id").distinct().count() == 10 * n


def test_feature_counts_classifies_a_row_once(spark, tmp_path):
    from sqlgauge.operators import querylog as QL
    rows = [("SELECT a FROM t JOIN u ON t.i = u.i",), ("SELECT count(a) FROM t",), ("SELECT a FROM t",), ("",), (None,)]
    spark.createDataFrame(rows, "query string").write.parquet(str(tmp_path / "log"))
    counts = QL.feature_counts(QL.classify_log(spark.read.parquet(str(tmp_path / "log"))))
    # An inferred filter on the array repeats the classification, every regex in it, at the scan.
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "RLIKE" in x]
    assert plan.count("RLIKE(") == len(set(re.findall(r"RLIKE\([^ ]+, (.*?)\) ELSE", plan)))
    assert {r["feature"]: r["n"] for r in counts.collect()} == {"join": 1, "aggregate": 1}
    # A NULL inside an array is a value; a NULL or empty array holds none.
    odd = spark.createDataFrame([(["a", None, "a"],), ([],), (None,)], "features array<string>")
    assert {r["feature"]: r["n"] for r in QL.feature_counts(odd).collect()} == {"a": 2, None: 1}


def test_log_is_dealt_to_all_tasks(spark):
    from sqlgauge.sources import derived
    sf = "/root/testdata/sf0.001"  # one row group
    log, plain = derived.query_log(spark, sf, dealt=True), derived.query_log(spark, sf)
    sizes = [r["count"] for r in log.groupBy(F.spark_partition_id()).count().collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == n and max(sizes) - min(sizes) <= n
    assert log.exceptAll(plain).count() == 0 and plain.exceptAll(log).count() == 0
