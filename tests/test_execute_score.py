"""Read-only guard, batch execution, timeout, multiset scoring."""

from __future__ import annotations

import random
import re

import pytest

from sqlgauge.operators import execute as X
from sqlgauge.operators import score as S
from sqlgauge.plans import guard
from sqlgauge.sources.tables import parquet_dir_database

SF = "/root/testdata/sf0.001"

REFUSE = [
    "INSERT INTO orders SELECT * FROM orders",
    "WITH x AS (SELECT 1) INSERT INTO orders SELECT * FROM orders",
    "FROM orders INSERT INTO a SELECT * INSERT INTO b SELECT *",
    "CREATE TABLE t AS SELECT 1", "DROP TABLE orders", "SET spark.sql.ansi.enabled=false",
    "CACHE TABLE orders", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1",
    "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END",
    "SELECT reflect('java.lang.System', 'exit', '0')",
    "SELECT * FROM orders WHERE o_orderkey IN (SELECT java_method('java.lang.Math', 'abs', 1))",
    "WITH x AS (SELECT reflect('java.util.UUID', 'randomUUID') r) SELECT * FROM x",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "USE default", "DELETE FROM orders WHERE 1 = 1", "ANALYZE TABLE orders COMPUTE STATISTICS",
    "REFRESH TABLE orders", "SHOW TABLES", "EXPLAIN SELECT 1",
    "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT r_regionkey FROM "
    "IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`'))",
    "DECLARE x INT", "SET VAR x = 1", "CREATE TEMPORARY VIEW v AS SELECT 1",
    "LOAD DATA LOCAL INPATH '/tmp/x' INTO TABLE orders",
]

# Generous statement limit for tests that are not about timeouts
# (a busy machine must not turn a verdict into a timeout).
LIMIT = 120_000


@pytest.mark.parametrize("sql", REFUSE)
def test_guard_refuses(spark, sql):
    db = parquet_dir_database(SF, tables=["orders", "customer"])
    s = X.run_session(spark, db)
    with pytest.raises(guard.GuardError):
        guard.guarded_sql(s, sql, db=db)


def test_guard_allows_queries(spark):
    db = parquet_dir_database(SF, tables=["orders", "customer"])
    s = X.run_session(spark, db)
    for q in ["SELECT * FROM orders", "WITH x AS (SELECT o_orderkey FROM orders) SELECT count(*) FROM x",
              "SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
              "SELECT count(*) FROM IDENTIFIER('orders')", "SELECT * FROM range(3)",
              "SELECT * FROM VALUES (1), (2)", "SELECT * FROM orders TABLESAMPLE (10 PERCENT)",
              "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r"]:
        guard.guarded_sql(s, q, db=db)


def _runs(spark, rows):
    return spark.createDataFrame(rows, "run_id string, db_id string, sql string")


def test_run_batch_errors_and_empty(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    runs = _runs(spark, [("ok", "shop", "SELECT count(*) FROM orders"),
                         ("bad", "shop", "SELECT nope FROM orders"),
                         ("empty", "shop", "   "),
                         ("ro", "shop", "DROP TABLE orders"),
                         ("nodb", "other", "SELECT 1"),
                         ("div", "shop", "SELECT 1 / (o_orderkey - o_orderkey) FROM orders")])
    rr = X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
    ex = {r["run_id"]: r for r in rr.executions.collect()}
    assert ex["ok"]["success"] and ex["ok"]["n_rows"] == 1
    assert not ex["bad"]["success"] and "\n" not in ex["bad"]["error"]
    assert ex["empty"]["success"] and ex["empty"]["n_rows"] == 0
    assert ex["ro"]["error_class"] == "READ_ONLY"
    assert ex["nodb"]["error_class"] == "SCHEMA_NOT_FOUND"
    assert not ex["div"]["success"]          # runtime error (ANSI) is data too
    assert {r["run_id"] for r in rr.results.collect()} == {"ok"}


def test_timeout(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    runs = _runs(spark, [("slow", "shop", "SELECT count(*) FROM lineitem a JOIN lineitem b "
                                          "ON a.l_orderkey <> b.l_orderkey")])
    rr = X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=1)
    r = rr.executions.first()
    assert r["timed_out"] and not r["success"] and r["error_class"] == "TIMEOUT"


CASES = [
    ("a_b_order", [("a",), ("b",)], [("b",), ("a",)], True),
    ("dup", [("a",), ("a",)], [("a",)], False),
    ("empty", [], [], True),
    ("empty_vs_one", [], [("z",)], False),
    ("int_vs_double", [(1,)], [(1.0,)], False),
    ("null_vs_none", [(None,)], [("None",)], True),
    ("swapped_cols", [("a", "b")], [("b", "a")], False),
    ("extra_col", [("a",)], [("a", "extra")], False),
    ("same_multiset_big", [(i % 7,) for i in range(200)], [(i % 7,) for i in reversed(range(200))], True),
    ("same_counts_diff", [(1,), (2,), (2,)], [(1,), (1,), (2,)], False),
]


def _values_sql(rows):
    if not rows:
        return "SELECT 1 AS c WHERE false"
    def lit(v):
        if v is None:
            return "CAST(NULL AS STRING)"
        if isinstance(v, str):
            return f"'{v}'"
        return repr(v) if isinstance(v, float) else str(v)
    return " UNION ALL ".join("SELECT " + ", ".join(lit(v) for v in r) for r in rows)


def test_multiset_scoring(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    runs, pairs = [], []
    for name, gold, gen, _ in CASES:
        runs += [(f"{name}_g", "shop", _values_sql(gold)), (f"{name}_n", "shop", _values_sql(gen))]
        pairs.append((name, f"{name}_g", f"{name}_n"))
    # Scoring semantics, not timeouts: allow for a busy machine.
    rr = X.run_batch(spark, _runs(spark, runs), {"shop": db}, out_dir=str(tmp_path / "r"),
                     timeout_ms=120_000)
    p = spark.createDataFrame(pairs, "example_id string, gold_run_id string, gen_run_id string")
    got = {r["example_id"]: r for r in S.verdicts(p, rr.executions, rr.results).collect()}
    for name, _, _, want in CASES:
        assert got[name]["correct"] is want, name
        assert got[name]["reason"] == ("result sets match" if want else "result sets differ")


def test_failure_verdicts(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    runs = _runs(spark, [("g_ok", "shop", "SELECT 1"), ("g_bad", "shop", "SELECT nope FROM orders"),
                         ("n_bad", "shop", "SELECT nada FROM orders")])
    rr = X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
    p = spark.createDataFrame([("a", "g_bad", "g_ok"), ("b", "g_ok", "n_bad")],
                              "example_id string, gold_run_id string, gen_run_id string")
    got = {r["example_id"]: r for r in S.verdicts(p, rr.executions, rr.results).collect()}
    assert got["a"]["reason"].startswith("gold query failed: ") and got["a"]["verdict"] == "gold_failed"
    assert got["b"]["reason"].startswith("generated query failed: ")
    assert not got["a"]["correct"] and not got["b"]["correct"]


def test_strict_null_rendering(spark):
    df = X.positional(spark.sql("SELECT CAST(NULL AS STRING) AS a, 'None' AS b, 1.0D, true AS a"))
    cells = df.select(X.render_cells(df).alias("c")).first()["c"]
    assert list(cells) == ["None", "None", "1.0", "true"]
    strict = df.select(X.render_cells(df, strict_null=True).alias("c")).first()["c"]
    assert strict[0] is None


def test_a_stuck_run_blocks_nothing(spark, tmp_path, monkeypatch):
    import time as _time
    real = X._run_one

    def stuck(spark_, r, *a):
        if r.run_id.startswith("stuck"):
            _time.sleep(40)       # a job that never honours its cancel
        return real(spark_, r, *a)

    monkeypatch.setattr(X, "_run_one", stuck)
    monkeypatch.setattr(X, "CANCEL_GRACE_S", 0.5)
    db = parquet_dir_database(SF, name="shop")
    runs = _runs(spark, [(f"stuck{k}", "shop", "SELECT 1") for k in range(3)] + [("z_fine", "shop", "SELECT 2")])
    t0 = _time.time()
    rr = X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=3000, parallelism=1)
    ex = {r["run_id"]: r for r in rr.executions.collect()}
    assert _time.time() - t0 < 35
    assert all(ex[f"stuck{k}"]["timed_out"] and ex[f"stuck{k}"]["error_class"] == "TIMEOUT" for k in range(3))
    assert ex["z_fine"]["success"]


def test_a_late_job_is_stopped_and_commits_nothing(spark, tmp_path):
    import os
    import time as _time
    sc = spark.sparkContext
    slow = spark.range(400).repartition(400).mapInPandas(_sleepy, "row string")
    for limit in (1, 1500):
        path = str(tmp_path / f"late{limit}")
        t0 = _time.time()
        assert X.timed_write(spark, slow, path, limit)
        assert _time.time() - t0 < 25          # the whole job takes 400 x 0.5 s on 8 cores
        assert not os.path.exists(path)
        deadline = _time.time() + 10
        while sc.statusTracker().getActiveJobsIds() and _time.time() < deadline:
            _time.sleep(0.2)
        assert not sc.statusTracker().getActiveJobsIds()
    assert not X.timed_write(spark, spark.range(3).selectExpr("string(id) AS row"), str(tmp_path / "ok"), LIMIT)


def _sleepy(batches):
    import time as _time
    for b in batches:
        _time.sleep(0.5)
        yield b.rename(columns={"id": "row"}).astype(str)


def test_dialect_hints(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    runs = _runs(spark, [
        ("d1", "shop", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders"),
        ("d2", "shop", "SELECT * FROM customer WHERE c_name ~ 'Customer#0+1$'"),
        ("d3", "shop", "SELECT * FROM orders FETCH FIRST 3 ROWS ONLY"),
        ("d4", "shop", "SELECT * FROM generate_series(1, 3)"),
        ("ok", "shop", "SELECT 1")])
    rr = X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
    got = {r["run_id"]: r["dialect_hint"] for r in X.with_dialect_hints(rr.executions).collect()}
    assert got["d1"].startswith("DISTINCT ON") and got["d2"].startswith("regex operator")
    assert got["d3"].startswith("FETCH FIRST") and got["d4"].startswith("generate_series")
    assert got["ok"] is None


def test_every_run_has_its_own_time_and_outcome(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    good = [(f"g{i}", "shop", f"SELECT o_orderkey + {i} AS k FROM orders WHERE o_orderkey % 5 = {i}")
            for i in range(5)]
    runs = good + [("boom", "shop", "SELECT 1 / (o_orderkey - o_orderkey) FROM orders"),
                   ("bad", "shop", "SELECT nope FROM orders"), ("empty", "shop", "")]
    rr = X.run_batch(spark, _runs(spark, runs), {"shop": db}, out_dir=str(tmp_path / "r"),
                     parallelism=2, timeout_ms=LIMIT)
    ex = {r["run_id"]: r for r in rr.executions.collect()}
    assert not ex["boom"]["success"] and not ex["bad"]["success"] and ex["empty"]["success"]
    n_orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert sum(ex[f"g{i}"]["n_rows"] for i in range(5)) == n_orders
    assert len({ex[f"g{i}"]["result_path"] for i in range(5)}) == 5 and all(ex[f"g{i}"]["ms"] > 0 for i in range(5))
    got = rr.results.groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in got} == {f"g{i}": ex[f"g{i}"]["n_rows"] for i in range(5)
                                                      if ex[f"g{i}"]["n_rows"]}
    fp = {r["run_id"]: r for r in S.fingerprints(rr.results).collect()}
    assert all((fp[k]["fp_a"], fp[k]["fp_b"]) == (ex[k]["fp_a"], ex[k]["fp_b"]) for k in fp)


def test_log_rows_are_flushed_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "LOG_ROWS", 2)
    db = parquet_dir_database(SF, name="shop")
    runs = [(f"g{i}", "shop", f"SELECT {i} AS x") for i in range(5)]
    rr = X.run_batch(spark, _runs(spark, runs), {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
    assert rr.executions.count() == 5
    assert sorted(json_rows(rr.results)) == [[str(i)] for i in range(5)]


def test_scoring_moves_rows_once(spark):
    """Rows are exchanged once, by team and row, after they were counted where they lie."""
    res = spark.createDataFrame([("a", "x"), ("b", "x")], "run_id string, row string")
    pairs = spark.createDataFrame([("a", "b")], "gold_run_id string, gen_run_id string")
    df = S.compare_runs(pairs, res)
    assert df.first()["equal"]
    exact = S.exactly_equal(pairs, res)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(team#\d+, row#", exact)) == 1
    assert not re.search(r"Exchange hashpartitioning\((run_id|row)#", exact)


@pytest.mark.parametrize("team,sent", [(8, 10**6), (3, 10**6), (2, 0)])
def test_counts_of_many_runs_equal_brute_force(spark, monkeypatch, team, sent):
    from collections import Counter
    monkeypatch.setattr(S, "TEAM", team)
    monkeypatch.setattr(S, "SENT_MEMBERS", sent)
    rng = random.Random(6)
    base = [f"r{k % 7}" for k in range(30)]
    runs = {f"g{k}": rng.sample(base, len(base) - k % 2) for k in range(3)}
    for k in range(25):
        rows = rng.sample(base, len(base))
        if k % 3 == 1:  # as many rows, one of them another one
            rows[0] = rows[-1] if rows[0] != rows[-1] else "r9"
        runs[f"n{k}"] = rows[:-1] if k % 5 == 4 else rows
    runs["none"] = []
    res = spark.createDataFrame([(r, x) for r, rows in runs.items() for x in rows], "run_id string, row string")
    pairs = [(g, n) for g in ("g0", "g1", "none") for n in runs] * 2
    df = spark.createDataFrame(pairs, "gold_run_id string, gen_run_id string")
    got = {(r["gold_run_id"], r["gen_run_id"]): r["equal"] for r in S.compare_runs(df, res.repartition(6)).collect()}
    assert got == {(g, n): Counter(runs[g]) == Counter(runs[n]) for g, n in pairs}
    # Runs whose fingerprints agree by chance are told apart by their rows.
    exact = {(r["gold_run_id"], r["gen_run_id"]): r["exact"] for r in S.exactly_equal(
        df.distinct().where("gold_run_id = 'g0' AND gen_run_id NOT IN ('g0', 'none')"), res).collect()}
    assert exact == {("g0", n): Counter(runs["g0"]) == Counter(runs[n]) for n in runs if n not in ("g0", "none")}
    assert S.compare_runs(df.limit(0), res).count() == 0


def test_the_guard_walks_any_depth(spark):
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    deep = catalyst.expressions.Literal.TrueLiteral()
    for _ in range(3000):  # far deeper than Python's own stack allows
        deep = catalyst.expressions.Not(deep)
    plan = catalyst.plans.logical.Filter(deep, catalyst.plans.logical.OneRowRelation())
    guard._Walker(spark, False).walk(plan)
    nested = "SELECT 1 AS a"
    for _ in range(60):
        nested = f"SELECT a FROM ({nested}) t"
    guard.check_parsed(spark, nested)
    with pytest.raises(guard.GuardError):
        guard.check_parsed(spark, nested.replace("SELECT 1 AS a", "SELECT reflect('java.lang.Math', 'abs', 1) AS a"))


def json_rows(df):
    import json
    return [json.loads(r["row"]) for r in df.collect()]


def test_the_exchange_carries_one_count_per_compared_run(spark):
    """A team's rows travel under a short number, with one count per run that is compared with the gold one."""
    res = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "run_id string, row string")
    pairs = spark.createDataFrame([("a", "b")], "gold_run_id string, gen_run_id string")
    plan = S.exactly_equal(pairs, res)._jdf.queryExecution().optimizedPlan().toString()
    counts = next(line for line in plan.splitlines() if re.search(r"Aggregate \[team#\d+, row#", line))
    assert len(re.findall(r" AS d\d+#", counts)) == 1 and "gold_run_id" not in counts
    assert "run_id#" in plan and re.search(r"run_id#\d+ IN \(a,b\)|run_id#\d+ = a", plan)  # c's files are not read


def test_result_rows_are_written_small(spark, tmp_path):
    db = parquet_dir_database(SF, name="shop")
    X.run_batch(spark, _runs(spark, [("g", "shop", "SELECT * FROM orders")]), {"shop": db}, out_dir=str(tmp_path / "r"),
                timeout_ms=LIMIT)
    assert list((tmp_path / "r").rglob("results/run_id=g/*.zstd.parquet"))


def test_only_a_statements_own_failure_is_a_row(spark, tmp_path):
    """What the machines fail has no outcome: the batch ends, and nothing waits for it."""
    db = parquet_dir_database(SF, name="shop")
    own = ["SELECT 1 / (o_orderkey - o_orderkey) FROM orders", "SELECT CAST(o_orderstatus AS INT) FROM orders",
           "SELECT (SELECT n_name FROM nation) FROM orders", "SELECT sequence(1, o_orderkey, -1) FROM orders",
           "SELECT raise_error('no') FROM orders", "SELECT repeat(o_orderstatus, 2000000000) FROM orders WHERE false"]
    runs = _runs(spark, [(f"r{k}", "shop", q) for k, q in enumerate(own)])
    ex = X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "own"), timeout_ms=LIMIT).executions.collect()
    assert sorted(r["run_id"] for r in ex if not r["success"]) == ["r0", "r1", "r2", "r3", "r4"]
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "results").write_text("a file where the results should go")
    runs = _runs(spark, [("a", "shop", "SELECT o_orderkey FROM orders"), ("b", "shop", "select o_orderkey from orders"),
                         ("c", "shop", "SELECT n_name FROM nation")])
    with pytest.raises(X.RunLost):
        X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "full"), timeout_ms=LIMIT)


def test_a_damaged_table_is_not_the_statements_failure(spark, tmp_path):
    for t in ("fine", "damaged"):
        spark.range(20_000).selectExpr(f"id * 7919 % 20011 AS {t}_id").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    [part] = (tmp_path / "damaged.parquet").glob("part-*")
    data = part.read_bytes()
    part.write_bytes(data[:4] + bytes(len(data) // 2) + data[4 + len(data) // 2:])  # its schema can be read
    for crc in (tmp_path / "damaged.parquet").glob(".part-*.crc"):
        crc.unlink()
    db = parquet_dir_database(str(tmp_path), name="shop", tables=["fine", "damaged"])
    runs = _runs(spark, [("a", "shop", "SELECT * FROM damaged"), ("b", "shop", "SELECT * FROM fine")])
    with pytest.raises(X.RunLost):
        X.run_batch(spark, runs, {"shop": db}, out_dir=str(tmp_path / "r"), timeout_ms=LIMIT)
