"""SQLite directory source, loader, and catalog profile of what was loaded (A1-A9, C)."""

from __future__ import annotations

import os
import sqlite3

import pytest

from sqlgauge.operators import catalog as C
from sqlgauge.operators import load as L
from sqlgauge.operators.load import load_sqlite_dir
from sqlgauge.sources import sqlite as S


def test_source_parts(spark, sample_dir):
    tables = S.read(spark, sample_dir, "tables").orderBy("db_id", "table_name").collect()
    assert [(r["db_id"], r["table_name"], r["n_rows"]) for r in tables] == [
        ("harbor", "berth", 3), ("harbor", "docking", 7), ("harbor", "vessel", 5),
        ("orchard", "plot", 3), ("orchard", "tree", 5)]
    assert S.read(spark, sample_dir, "rows").count() == 23
    only = S.read(spark, sample_dir, "tables", only="orchard").count()
    first = S.read(spark, sample_dir, "tables", limit=1).count()
    assert (only, first) == (2, 3)
    cols = S.read(spark, sample_dir, "columns").where("table_name = 'berth'").orderBy("cid").collect()
    assert [(c["column_name"], c["declared"], c["pk_position"]) for c in cols] == [
        ("berth_no", "INTEGER", 1), ("label", "TEXT", None), ("depth_m", "REAL", None)]
    fks = S.read(spark, sample_dir, "foreign_keys").collect()
    assert sorted((r["table_name"], r["column_name"], r["ref_table"]) for r in fks) == [
        ("docking", "berth_no", "berth"), ("docking", "vessel_no", "vessel"), ("tree", "plot_no", "plot")]


def test_rowid_chunks(spark, sample_dir):
    df = S.read(spark, sample_dir, "rows", chunk_rows=2)
    assert df.rdd.getNumPartitions() >= 9
    assert sorted(r["row_id"] for r in df.where("table_name = 'docking'").collect()) == list(range(101, 108))


def test_load_and_profile(spark, sample_dir, tmp_path):
    res = load_sqlite_dir(spark, sample_dir, str(tmp_path / "wh"))
    log = {r["db_id"]: r for r in res.log.collect()}
    assert log["harbor"]["ok"] and log["harbor"]["rows"] == 15 and log["orchard"]["rows"] == 8
    st = res.stats.first()
    assert (st["databases"], st["failed"], st["tables"], st["rows"]) == (2, 0, 5, 23)
    assert {r["status"] for r in res.foreign_keys.collect()} == {"accepted"}
    harbor = res.databases["harbor"]
    assert dict(harbor.read(spark, "berth").dtypes) == {"berth_no": "bigint", "label": "string", "depth_m": "double"}
    prof = {r["table_name"]: r for r in C.profile(spark, harbor, 2).collect()}
    assert list(prof["vessel"]["primary_key"]) == ["vessel_no"]
    refs = {(tuple(fk["columns"]), fk["ref_table"]) for fk in prof["docking"]["foreign_keys"]}
    assert refs == {(("vessel_no",), "vessel"), (("berth_no",), "berth")}
    assert prof["vessel"]["row_count"] == 5 and len(prof["vessel"]["sample_rows"]) == 2
    text = C.schema_text(spark, harbor, True, 3).first()["schema_text"]
    assert "CREATE TABLE vessel" in text and "FOREIGN KEY" in text and "example row" in text
    assert C.samples(spark, harbor, 0).count() == 0


def test_failing_database_is_isolated(spark, tmp_path):
    root = tmp_path / "src"
    for db, dup in (("good", False), ("bad", True)):
        (root / db).mkdir(parents=True)
        conn = sqlite3.connect(root / db / f"{db}.sqlite")
        conn.execute("CREATE TABLE t (id INTEGER, v TEXT)")  # no declared key
        conn.execute("CREATE TABLE k (id INTEGER PRIMARY KEY, n INTEGER)")
        conn.executemany("INSERT INTO k VALUES (?, ?)", [(1, 10), (2, 20)])
        if dup:
            conn.execute("INSERT INTO t VALUES (1, 'x')")
            conn.execute("CREATE TABLE z (\"A b\" INTEGER, \"a_b\" INTEGER)")  # collide after cleaning
        conn.commit()
        conn.close()
    res = load_sqlite_dir(spark, str(root), str(tmp_path / "wh"))
    log = {r["db_id"]: r for r in res.log.collect()}
    assert log["good"]["ok"] and not log["bad"]["ok"]
    assert "collide" in log["bad"]["error"]
    assert not os.path.exists(tmp_path / "wh" / "bad")
    st = res.stats.first()
    assert (st["databases"], st["failed"]) == (1, 1)


def test_bad_values_fail_the_database(spark, tmp_path):
    root = tmp_path / "src"
    (root / "d").mkdir(parents=True)
    conn = sqlite3.connect(root / "d" / "d.sqlite")
    conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    conn.executemany("INSERT INTO t VALUES (?, ?)", [(1, 10), (2, "ten")])
    conn.commit()
    conn.close()
    res = load_sqlite_dir(spark, str(root), str(tmp_path / "wh"))
    r = res.log.first()
    assert not r["ok"] and "does not fit BIGINT" in r["error"]


def test_load_parquet_databases(spark, tmp_path):
    from sqlgauge.operators.load import load_databases
    from sqlgauge.sources.tables import parquet_dir_database
    sf = "/root/testdata/sf0.001"
    shop = parquet_dir_database(sf, name="shop", tables=["orders", "lineitem", "customer"])
    corpus = parquet_dir_database(sf, name="corpus", tables=["documents", "labels"])
    res = load_databases(spark, [shop, corpus], str(tmp_path / "wh"))
    log = {r["db_id"]: r for r in res.log.collect()}
    assert not log["shop"]["ok"] and log["shop"]["error"] == "lineitem: primary key duplicate key"
    assert log["corpus"]["ok"] and log["corpus"]["tables"] == 2
    n = spark.read.parquet(f"{sf}/documents.parquet").count() + spark.read.parquet(f"{sf}/labels.parquet").count()
    assert log["corpus"]["rows"] == n
    assert not (tmp_path / "wh" / "shop").exists()
    fk = {r["fk_name"]: r["status"] for r in res.foreign_keys.collect()}
    assert fk == {"fk_labels_doc_id_documents": "accepted", "fk_documents_doc_id_labels": "skipped"}
    with pytest.raises(FileExistsError):
        load_databases(spark, [corpus], str(tmp_path / "wh"))


def test_catalog_listing(spark, tmp_path):
    """User databases sorted; base tables only (views excluded)."""
    loc = str(tmp_path / "ns")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sg_listing LOCATION '{loc}'")
    try:
        spark.range(3).write.mode("overwrite").saveAsTable("sg_listing.b_table")
        spark.range(2).write.mode("overwrite").saveAsTable("sg_listing.a_table")
        spark.sql("CREATE OR REPLACE VIEW sg_listing.v AS SELECT * FROM sg_listing.a_table")
        assert "sg_listing" in [r["schema_name"] for r in C.list_schemas(spark).collect()]
        assert [r["table_name"] for r in C.list_tables(spark, "sg_listing").collect()] == ["a_table", "b_table"]
    finally:
        spark.sql("DROP DATABASE IF EXISTS sg_listing CASCADE")


def test_fk_without_target_columns_uses_parent_key(spark, tmp_path):
    root = tmp_path / "src"
    (root / "d").mkdir(parents=True)
    conn = sqlite3.connect(root / "d" / "d.sqlite")
    conn.execute("CREATE TABLE parent (a INTEGER, b INTEGER, PRIMARY KEY (a, b))")
    conn.execute("CREATE TABLE child (id INTEGER PRIMARY KEY, x INTEGER, y INTEGER, "
                 "FOREIGN KEY (x, y) REFERENCES parent)")
    conn.executemany("INSERT INTO parent VALUES (?, ?)", [(1, 1), (1, 2)])
    conn.executemany("INSERT INTO child VALUES (?, ?, ?)", [(1, 1, 2), (2, 1, 3), (3, None, 9)])
    conn.commit()
    conn.close()
    fks = S.read(spark, str(root), "foreign_keys").collect()
    assert all(r["ref_column"] is None for r in fks)          # what SQLite reports
    res = load_sqlite_dir(spark, str(root), str(tmp_path / "wh"))
    fk = res.foreign_keys.first()
    assert (fk["columns"], fk["ref_columns"]) == ("x, y", "a, b")
    # (1,3) has no parent; (NULL, 9) passes (MATCH SIMPLE)
    assert (fk["n_child_rows"], fk["n_checked"], fk["n_orphan_rows"], fk["status"]) == (3, 2, 1, "skipped")


def test_filter_pushdown_prunes_partitions(spark, sample_dir):
    from pyspark.sql import functions as F
    key = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(key)
    try:
        plain = S.read(spark, sample_dir, "rows", chunk_rows=2)
        n_all = plain.rdd.getNumPartitions()
        assert plain.where(F.col("db_id") == "orchard").count() == 8      # works without pushdown
        spark.conf.set(key, "true")
        rows = S.read(spark, sample_dir, "rows", chunk_rows=2)
        one = rows.where((F.col("db_id") == "orchard") & F.col("table_name").isin("tree"))
        assert one.count() == 5
        assert one.rdd.getNumPartitions() < n_all
    finally:
        spark.conf.set(key, old)


# ---- nothing is lost ----

def _db(root, folder, name, script, rows=()):
    (root / folder).mkdir(exist_ok=True)
    conn = sqlite3.connect(root / folder / f"{name}.sqlite")
    conn.executescript(script)
    for sql, values in rows:
        conn.execute(sql, values)
    conn.commit()
    conn.close()


def test_every_file_of_a_folder_is_listed(tmp_path):
    _db(tmp_path, "a", "one", "CREATE TABLE t (x INTEGER)")
    _db(tmp_path, "a", "two", "CREATE TABLE t (x INTEGER)")
    (tmp_path / "a" / "notes.txt").write_text("no database")
    assert [d for d, _ in S.list_files(str(tmp_path))] == ["one", "two"]


def test_partitions_follow_rows_not_ids(tmp_path):
    _db(tmp_path, "a", "a", "CREATE TABLE t (id INTEGER PRIMARY KEY)",
        [("INSERT INTO t VALUES (?)", (i,)) for i in (1, 2, 3, 50_000_000_000)])
    reader = S.SqliteDirReader({"path": str(tmp_path), "chunk_rows": "2"})
    parts = reader.partitions()
    assert len(parts) == 2
    assert sorted(r[2] for p in parts for r in reader.read(p)) == [1, 2, 3, 50_000_000_000]


def test_blobs_keep_their_bytes(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    _db(src, "a", "a", "CREATE TABLE t (id INTEGER PRIMARY KEY, b BLOB)",
        [("INSERT INTO t VALUES (?, ?)", v) for v in ((1, b"\x00\xff"), (2, None), (3, "text"), (4, b""))])
    res = L.load_sqlite_dir(spark, str(src), str(tmp_path / "out"))
    got = {r["id"]: None if r["b"] is None else bytes(r["b"]) for r in res.databases["a"].tables(spark)["t"].collect()}
    assert got == {1: b"\x00\xff", 2: None, 3: b"text", 4: b""}


def test_an_unreadable_file_is_one_failed_database(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    _db(src, "good", "good", "CREATE TABLE t (x INTEGER); INSERT INTO t VALUES (1)")
    (src / "bad").mkdir()
    (src / "bad" / "bad.sqlite").write_bytes(b"this is no database file at all" * 100)
    res = L.load_sqlite_dir(spark, str(src), str(tmp_path / "out"))
    log = {r["db_id"]: r for r in res.log.collect()}
    assert log["good"]["ok"] and log["good"]["rows"] == 1
    assert not log["bad"]["ok"] and log["bad"]["error"].startswith("cannot be read")


def test_any_error_stays_in_its_database(spark, tmp_path, monkeypatch):
    from sqlgauge.sources.tables import parquet_dir_database
    sf = "/root/testdata/sf0.001"
    good = parquet_dir_database(sf, name="good", tables=["region"])
    bad = parquet_dir_database(sf, name="bad", tables=["nation"])
    bad.paths["nation"] = f"{tmp_path}/nowhere"
    res = L.load_databases(spark, [bad, good], str(tmp_path / "out"))
    log = {r["db_id"]: r for r in res.log.collect()}
    assert log["good"]["ok"] and not log["bad"]["ok"] and log["bad"]["error"]


def test_reload_needs_replace_and_drops_stale_tables(spark, tmp_path):
    from sqlgauge.sources.tables import parquet_dir_database
    sf, out = "/root/testdata/sf0.001", f"file:{tmp_path}/out"
    L.load_databases(spark, [parquet_dir_database(sf, name="d", tables=["region", "nation"])], out)
    one = parquet_dir_database(sf, name="d", tables=["region"])
    with pytest.raises(FileExistsError):
        L.load_databases(spark, [one], out)
    L.load_databases(spark, [one], out, replace=True)
    assert sorted(L.open_database(spark, out, "d").paths) == ["region"]


def _small(name, sf="/root/testdata/sf0.001", tables=("region", "nation")):
    from sqlgauge.sources.tables import parquet_dir_database
    return parquet_dir_database(sf, name=name, tables=list(tables))


def test_names_that_become_one_folder_are_refused(spark, tmp_path):
    out = f"file:{tmp_path}/out"
    res = L.load_databases(spark, [_small("A-b"), _small("a_b"), _small("ok"), _small("twice"), _small("twice")], out)
    log = {r["db_id"]: r for r in res.log.collect()}
    assert log["ok"]["ok"] and sorted(res.databases) == ["ok"]
    assert "a_b" in log["A-b"]["error"] and "A-b" in log["a_b"]["error"]
    assert log["twice"]["error"] == "2 databases have this name"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["ok"]
    # A later load does not take over the folder of another name either.
    assert L.load_databases(spark, [_small("A-b")], out, replace=True).log.first()["ok"]
    log = L.load_databases(spark, [_small("a_b")], out, replace=True).log.first()
    assert not log["ok"] and log["error"] == "its folder a_b holds A-b"


def test_two_files_of_one_name_are_refused_by_name(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for folder, name in (("x", "a"), ("y", "a"), ("z", "b")):
        _db(src, folder, name, "CREATE TABLE t (x INTEGER PRIMARY KEY); INSERT INTO t VALUES (1)")
    log = {r["db_id"]: r for r in L.load_sqlite_dir(spark, str(src), str(tmp_path / "out")).log.collect()}
    assert log["b"]["ok"] and log["a"]["error"] == "2 files hold a database of this name"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b"]


def test_a_load_that_fails_midway_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    out = f"file:{tmp_path}/out"
    L.load_databases(spark, [_small("d")], out)
    opened = L.open_database(spark, out, "d")
    real = L.Observation

    def broken(name):
        if name.endswith("region"):  # the second of two tables
            raise OSError("the store went away")
        return real(name)

    monkeypatch.setattr(L, "Observation", broken)
    log = L.load_databases(spark, [_small("d", "/root/testdata/sf0.01")], out, replace=True).log.first()
    assert not log["ok"] and "went away" in log["error"]
    assert L.open_database(spark, out, "d").paths == opened.paths
    assert {t: df.count() for t, df in L.open_database(spark, out, "d").tables(spark).items()} == {
        "nation": 25, "region": 5}
    monkeypatch.undo()
    # Readers of the replaced version still find it; what failed and what is older goes.
    L.load_databases(spark, [_small("d", tables=["region"])], out, replace=True)
    assert sorted(L.open_database(spark, out, "d").paths) == ["region"]
    assert opened.tables(spark)["nation"].count() == 25
    assert len([p for p in (tmp_path / "out" / "d").iterdir() if p.name.startswith("v-")]) == 2
    L.load_databases(spark, [_small("d")], out, replace=True)
    assert len([p for p in (tmp_path / "out" / "d").iterdir() if p.name.startswith("v-")]) == 2
    keys = L.open_database(spark, out, "d").keys
    assert keys.primary_keys["nation"] == ("n_nationkey",) and keys.foreign_keys[0].ref_table == "region"
    with pytest.raises(LookupError):
        L.open_database(spark, out, "none")
