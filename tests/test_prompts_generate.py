"""Prompt strategies, model calls in Python workers, cost (E, F)."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from sqlgauge.operators import generate as G
from sqlgauge.operators import prompts as P


def _inputs(spark):
    ex = spark.createDataFrame([("e1", "db", "How many?"), ("e2", "db", "Which?")],
                               "example_id string, db_id string, question string")
    texts = spark.createDataFrame([("db", "CREATE TABLE t (\n  a INT\n);", "t(a)")],
                                  "db_id string, schema_text string, schema_text_min string")
    return ex, texts


def test_prompt_set(spark):
    ex, texts = _inputs(spark)
    ps = {(r["example_id"], r["strategy"]): r for r in P.build_prompts(ex, texts).collect()}
    assert len(ps) == 8
    z = ps[("e1", "zero_shot")]
    assert "t(a)" in z["user"] and "CREATE TABLE" not in z["user"] and "How many?" in z["user"]
    assert z["max_tokens"] == 512 and z["system"] == P.SYSTEM
    f = ps[("e1", "few_shot")]
    assert f["user"].endswith("Request: How many?\nStatement:") and "LEFT ANTI JOIN parcel" in f["user"]
    c = ps[("e2", "chain_of_thought")]
    assert c["max_tokens"] == 900 and c["system"] == P.SYSTEM_COT and "CREATE TABLE" in c["user"]


def test_unknown_strategy(spark):
    ex, texts = _inputs(spark)
    with pytest.raises(KeyError):
        P.build_prompts(ex, texts, ["nope"])


def test_registered_strategy(spark):
    ex, texts = _inputs(spark)
    P.register_strategy("terse", P.Template("sys", "{question} -> {schema_min}"))
    try:
        r = P.build_prompts(ex, texts, ["terse"]).where("example_id = 'e1'").first()
        assert r["user"] == "How many? -> t(a)"
    finally:
        P.STRATEGIES.pop("terse")


class EchoClient:
    """A stand-in model: answers with a fenced query naming the strategy's budget."""

    def generate(self, system, user, max_tokens, temperature):
        return f"  ```sql\nSELECT {max_tokens};\n```  ", len(user), 7


def test_generate_in_workers_and_cost(spark):
    ex, texts = _inputs(spark)
    ps = P.build_prompts(ex, texts)
    gen = G.generate(ps, EchoClient, "model-m", partitions=3)
    prices = G.price_table(spark)
    out = G.generations(ps, gen, prices).collect()
    assert len(out) == 8
    r = [x for x in out if x["strategy"] == "chain_of_thought"][0]
    assert r["sql"] == "SELECT 900" and r["response"].startswith("```sql")
    assert r["cost_usd"] == pytest.approx(r["input_tokens"] / 1e6 * 3 + 7 / 1e6 * 15)
    unknown = G.generations(ps, G.generate(ps, EchoClient, "other", 2), prices).first()
    assert unknown["cost_usd"] == 0.0


def test_generate_once_resumes(spark, tmp_path):
    ex, texts = _inputs(spark)
    ps = P.build_prompts(ex, texts)
    path = str(tmp_path / "gen")
    G.generate_once(spark, ps.where("example_id = 'e1'"), EchoClient, "model-s", path)
    out = G.generate_once(spark, ps, EchoClient, "model-s", path)
    assert out.count() == 8
    assert out.groupBy("example_id", "strategy").count().where("count > 1").count() == 0


class FlakyClient:
    """Fails on every prompt of example e2 until the marker file exists."""

    def __init__(self, marker):
        self.marker = marker

    def generate(self, system, user, max_tokens, temperature):
        import os
        if "Which?" in user and not os.path.exists(self.marker):
            raise RuntimeError("upstream overloaded\nretry later")
        return "SELECT 1", 10, 2


def test_failed_calls_are_data_and_resume(spark, tmp_path):
    import functools
    ex, texts = _inputs(spark)
    ps = P.build_prompts(ex, texts)
    marker = str(tmp_path / "ok")
    factory = functools.partial(FlakyClient, marker)
    path = str(tmp_path / "gen")
    first = G.generate_once(spark, ps, factory, "model-s", path, partitions=2).collect()
    errs = [r for r in first if r["error"]]
    assert len(first) == 8 and len(errs) == 4 and errs[0]["error"] == "upstream overloaded"
    cost = G.generations(ps, spark.read.parquet(path), G.price_table(spark))
    assert cost.where("error IS NOT NULL AND cost_usd <> 0").count() == 0
    open(marker, "w").close()          # the upstream recovers
    second = G.generate_once(spark, ps, factory, "model-s", path, partitions=2).collect()
    assert len(second) == 8 and not [r for r in second if r["error"]]


def test_similar_shots_come_from_the_most_similar_questions(spark):
    from sqlgauge.operators import prompts as PR
    solved = spark.createDataFrame([
        ("a", "How tall are the plum trees?", "SQL_A"), ("b", "Plum trees by plot", "SQL_B"),
        ("c", "Which vessels docked in the night?", "SQL_C"), ("d", "Docked vessels per berth?", "SQL_D")],
        "example_id string, question string, gold_sql string")
    asked = spark.createDataFrame([("a", "db", "How tall are the plum trees?"), ("x", "db", "vessels that docked"),
                                   ("y", None, None)], "example_id string, db_id string, question string")
    got = {r["example_id"]: r["shots"] for r in PR.similar_shots(asked, solved, 1).collect()}
    assert got["a"].endswith("SQL_B") and got["x"].endswith("SQL_D") and set(got) == {"a", "x", "y"}
    texts = spark.createDataFrame([("db", "CREATE TABLE t (x)", "t(x)")],
                                  "db_id string, schema_text string, schema_text_min string")
    ps = {r["example_id"]: r for r in PR.build_similar_prompts(asked, texts, solved, 2).collect()}
    assert len(ps) == 3 and ps["x"]["strategy"] == "similar_shot"
    assert "SQL_C" in ps["x"]["user"] and "CREATE TABLE t (x)" in ps["x"]["user"]


class CountedClient:
    """Notes every call in a file; one call, the first time it is made, kills its task's process."""

    def __init__(self, calls, die_at=None):
        self.calls, self.die_at = calls, die_at

    def generate(self, system, user, max_tokens, temperature):
        import os
        if user == self.die_at and not os.path.exists(f"{self.calls}-died"):
            open(f"{self.calls}-died", "w").close()
            os._exit(1)
        with open(self.calls, "a") as f:
            f.write(user + "\n")
        return f"answer to {user}", len(user), 3


def event_prompts(spark, n=300):
    from sqlgauge.sources import derived
    calls = derived.call_prompts(spark, "/root/testdata/sf0.001").orderBy(F.col("example_id").cast("int")).limit(n)
    return calls.select("example_id", "strategy", "system", F.concat("example_id", F.lit(" ? "), F.trim("user_text"))
                        .alias("user"), F.lit(8).alias("max_tokens"))


LOGGED_RUN = """
import functools, sys
sys.path[:0] = [{tests!r}, {root!r}]
from pyspark.sql import SparkSession
from test_prompts_generate import CountedClient, event_prompts
from sqlgauge.operators import generate as G
G.LOGGED_CALLS = 4
spark = (SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "50").getOrCreate())
out = G.generate_once(spark, event_prompts(spark), functools.partial(CountedClient, {calls!r}, {die!r}), "m",
                      {path!r}, partitions=3)
print(out.where("error IS NULL").count())
"""


def test_a_task_that_is_run_again_calls_nothing_twice(spark, tmp_path):
    """Its worker dies after some calls; the repeated task takes those from the log."""
    import os
    import subprocess
    import sys
    here = os.path.dirname(os.path.abspath(__file__))
    die = event_prompts(spark).collect()[150]["user"]
    calls = str(tmp_path / "calls")
    code = LOGGED_RUN.format(tests=here, root=os.path.dirname(here), calls=calls, die=die, path=f"file:{tmp_path}/gen")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert done.stdout.split()[-1:] == ["300"], done.stderr[-3000:]
    made = open(calls).read().splitlines()
    assert os.path.exists(f"{calls}-died")
    # Calls that ran beside the fatal one, four at most, were not logged yet.
    assert set(made) == {r["user"] for r in event_prompts(spark).collect()} and len(made) <= 300 + 4
    assert not os.path.exists(f"{tmp_path}/gen-calls") or not os.listdir(f"{tmp_path}/gen-calls")


def test_a_job_that_fails_leaves_its_calls_to_the_next(spark, tmp_path):
    import functools
    ps, calls, path = event_prompts(spark, 120), str(tmp_path / "calls"), f"file:{tmp_path}/gen"
    die = ps.collect()[60]["user"]
    with pytest.raises(Exception):  # one attempt per task here: the job ends
        G.generate_once(spark, ps, functools.partial(CountedClient, calls, die), "m", path, partitions=1)
    before = len(open(calls).read().splitlines())
    out = G.generate_once(spark, ps, functools.partial(CountedClient, calls), "m", path, partitions=5)
    assert out.count() == 120 and out.where("response IS NULL").count() == 0
    made = open(calls).read().splitlines()
    assert before >= 32 and len(set(made)) == 120 and len(made) <= 120 + G.LOGGED_CALLS
    assert G.salvage_calls(spark, path) == 0
    # Nothing is left to ask.
    G.generate_once(spark, ps, functools.partial(CountedClient, calls), "m", path)
    assert len(open(calls).read().splitlines()) == len(made)


def test_another_prompt_or_model_is_another_call(spark):
    ps = event_prompts(spark, 3)
    key = lambda df, m="m", t=0.0: {r[0] for r in df.select(G.prompt_key(m, t)).collect()}
    base = key(ps)
    assert len(base) == 3 and key(ps) == base
    for other in (key(ps, "n"), key(ps, "m", 0.5), key(ps.withColumn("system", F.lit(None).cast("string"))),
                  key(ps.withColumn("user", F.concat("user", F.lit(" "))))):
        assert not base & other
