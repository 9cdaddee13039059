"""The corpus pipeline and the registration of the optional queries."""

import random

import pytest

import corpus_pipeline as CP
from llm_samples import SF_CHECK, prose
from sqlgauge.llm import queries as Q


NAMES = [f"op{n}_" for n in range(1, 11)]


def test_one_query_per_operator_and_the_pipeline():
    import __spark_entry__ as E
    keys = E.queries()
    assert "pipeline" in keys
    for n in NAMES:
        assert sum(k.startswith(n) for k in keys) == 1
    assert set(Q.oracle_sql()) <= set(Q.queries())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(4)
    items = [(k, prose(rng, 30) + f" item{k}") for k in range(5)]
    docs = [(i, f"{prose(rng, 80)} unique{i}", "en", "s") for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s") for i in range(5)]                      # copies
    docs += [(200 + i, docs[i][1] + " more", "en", "s") for i in range(5)]            # near copies
    docs += [(300 + k, f"{prose(rng, 30)} {t} {prose(rng, 30)}", "en", "s") for k, (_, t) in enumerate(items)]
    docs += [(400, None, "en", "s"), (401, "", None, None), (402, "123 456", None, "s"), (None, prose(rng, 50), "en", "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    left = []
    for name, stage in CP.STAGES:
        out = stage(spark, docs, tables)
        if name != CP.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
        left.append({r.doc_id for r in out.select("doc_id").collect()})
    every = set(range(60)) | {100 + i for i in range(5)} | {200 + i for i in range(5)} | {300 + k for k in range(5)} | {None}
    assert left[0] == every
    assert left[1] == set(range(60)) | {300 + k for k in range(5)} | {None}
    assert left[2] == left[3] == set(range(60)) | {None}


def test_run_writes_token_ids(spark, tables):
    out = CP.run(spark, tables)
    assert {"doc_id", "text", "ids", "n_tokens", "decodes"} <= set(out.columns)
    assert out.count() == 61 and out.where("NOT decodes OR size(ids) <> n_tokens").count() == 0


def test_extra_columns_and_empty_tables(spark, tables):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for c in ("ids", "kept", "_gone", "_leaked", "_language", "component_id", "lang_pred"):
        docs = docs.withColumn(c, F.lit("x"))
    for _, stage in CP.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.where("kept = 'x' AND _gone = 'x' AND _language = 'x'").count() > 0
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert CP.STAGES[-1][1](spark, docs.limit(0), tables).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    kept = CP.language_stage(spark, docs, SF_CHECK)
    assert kept.count() >= 0.99 * docs.where("text RLIKE '[A-Za-z]'").count()


def test_the_near_duplicate_stage_joins_its_index_by_key(spark, monkeypatch):
    """The index's entries look like one a document to Spark; they never go to the driver."""
    from sqlgauge.llm import graph

    class Seen(Exception):
        pass

    def spy(self, df, name):
        raise Seen(name, df._jdf.queryExecution().sparkPlan().toString())

    monkeypatch.setattr(graph.Scratch, "written", spy)
    docs = spark.createDataFrame([(k, f"the same {k % 3} words stand in here again and again") for k in range(9)],
                                 "doc_id bigint, text string")
    with pytest.raises(Seen) as seen:
        CP.near_duplicate_stage(spark, docs, None)
    name, plan = seen.value.args
    assert name == "members" and "SortMergeJoin [entry" in plan and "BroadcastHashJoin [entry" not in plan
