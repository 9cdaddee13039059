"""Type map, sanitizer, collisions, cast audit, key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlgauge.functions.names import map_type, sanitize
from sqlgauge.operators import validate as V
from sqlgauge.sources.tables import ForeignKey

TYPES = [
    ("INTEGER", "BIGINT"), ("int", "BIGINT"), ("VARCHAR(20)", "TEXT"), ("CLOB", "TEXT"),
    ("TEXT", "TEXT"), ("BLOB", "BYTEA"), ("", "TEXT"), (None, "TEXT"), ("REAL", "DOUBLE PRECISION"),
    ("FLOAT", "DOUBLE PRECISION"), ("double", "DOUBLE PRECISION"), ("NUMERIC(10,2)", "NUMERIC"),
    ("DECIMAL", "NUMERIC"), ("MONEY", "NUMERIC"), ("BOOLEAN", "BOOLEAN"), ("DATE", "TEXT"),
    ("DATETIME", "TEXT"), ("POINT", "BIGINT"), ("INTERVAL", "BIGINT"),
    ("FLOATING POINT", "BIGINT"), ("NUMBER", "TEXT"), ("CHARINT", "BIGINT"), ("BLOB TEXT", "TEXT"),
]


def test_type_map(spark):
    df = spark.createDataFrame(TYPES, "decl string, want string")
    got = df.select("want", map_type(F.col("decl")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


NAMES = [
    ("Student ID", "student_id"), ("  Name ", "name"), ("1st", "_1st"), ("", "col"),
    ("   ", "col"), ("a-b.c", "a_b_c"), ("Prix €", "prix__"), ("_x_", "_x_"), ("ÉCOLE", "_cole"),
    ("\tTab\n", "tab"), (None, None), ("9", "_9"),
]


def test_sanitize(spark):
    df = spark.createDataFrame(NAMES, "raw string, want string")
    got = df.select("want", sanitize(F.col("raw")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_name_collisions(spark):
    df = spark.createDataFrame(
        [("d", "t", "Order Id"), ("d", "t", "order_id"), ("d", "t", "order-id"), ("d", "t", "x"),
         ("d", "u", "Order Id"), ("d", "t", "order_id")],
        "db_id string, table_name string, raw_name string")
    rows = V.name_collisions(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["table_name"], r["clean_name"], r["n_raw"]) == ("t", "order_id", 3)


def test_cast_audit(spark):
    df = spark.createDataFrame([("1", "x", None), ("2", "3.5", None), (None, "4", "true")],
                               "a string, b string, c string")
    got = {r["column_name"]: (r["n_values"], r["n_bad"])
           for r in V.cast_audit(df, {"a": "BIGINT", "b": "BIGINT", "c": "BOOLEAN"}, "t").collect()}
    assert got == {"a": (2, 0), "b": (3, 2), "c": (1, 0)}


def test_pk_check(spark):
    ok = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    dup = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1)], "a int, b int")
    nul = spark.createDataFrame([(1, None), (2, 1)], "a int, b int")
    rows = {r["table_name"]: r for r in V.pk_check(
        {"ok": ok, "dup": dup, "nul": nul}, {"ok": ("a", "b"), "dup": ("a", "b"), "nul": ("a", "b")}).collect()}
    assert rows["ok"]["verdict"] == "ok"
    assert (rows["dup"]["n_dup_keys"], rows["dup"]["n_dup_rows"], rows["dup"]["verdict"]) == (1, 3, "duplicate key")
    assert (rows["nul"]["n_null_key"], rows["nul"]["verdict"]) == (1, "null key")


def test_fk_check(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    uparent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1,), (1,), (3,), (None,)], "f int")
    good = spark.createDataFrame([(1,), (None,), (2,)], "f int")
    rows = {r["fk_name"]: r for r in V.fk_check(
        {"p": parent, "u": uparent, "c": child, "g": good},
        [ForeignKey("c", ("f",), "u", ("k",)), ForeignKey("g", ("f",), "u", ("k",)),
         ForeignKey("g", ("f",), "p", ("k",))]).collect()}
    c = rows["fk_c_f_u"]
    assert (c["n_child_rows"], c["n_checked"], c["n_orphan_rows"], c["n_orphan_keys"], c["status"]) == \
        (4, 3, 1, 1, "skipped")
    g = [r for r in rows.values() if r["table_name"] == "g"]
    by_parent = {r["ref_table"]: r for r in g}
    assert by_parent["u"]["status"] == "accepted"
    assert by_parent["p"]["reason"] == "referenced key is not unique"


def test_test_tables_keys(spark):
    """FIXTURES 3: lineitem fails its key, forward FKs hold, documents->labels has orphans."""
    from sqlgauge import registry as R
    pk = {r["table_name"]: r for r in R.q_pk_check(spark, "/root/testdata/sf0.01").collect()}
    assert pk["lineitem"]["verdict"] == "duplicate key" and pk["lineitem"]["n_dup_keys"] == 11785
    assert all(r["verdict"] == "ok" for t, r in pk.items() if t != "lineitem")
    fk = R.q_fk_check(spark, "/root/testdata/sf0.01").collect()
    skipped = [r["fk_name"] for r in fk if r["status"] == "skipped"]
    assert sorted(skipped) == ["fk_any_order_k_known_customer", "fk_documents_doc_id_labels",
                               "fk_known_customer_k_known_order"]
    st = R.q_load_stats(spark, "/root/testdata/sf0.01").first()
    assert (st["databases"], st["failed"], st["tables"]) == (1, 1, 6)
