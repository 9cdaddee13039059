"""The corpus pipeline: languages, near-duplicates, benchmark leaks, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Defined results, of every stage: extra columns pass through; an empty table stays
empty; null and empty texts are rejected by the language stage; rows without
doc_id are never near-duplicates nor named as leaks and pass on.
"""

from __future__ import annotations

from sqlgauge.llm import decontam, langid, near_dup, piece_bpe
from sqlgauge.llm.graph import written
from sqlgauge.llm.queries import prepare, tokenizer_path

#: Near-duplicates: word 5-shingles, similarity 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
PIECE_MODEL = "piece_bpe_32k.model"


def language_stage(spark, docs, sf_dir):
    """Documents whose language is recognised; the model learns from the labels of ``docs``."""
    prepare(spark)
    return langid.accepted(docs, langid.train(docs))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates: the smallest doc_id."""
    prepare(spark)
    return near_dup.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def leak_stage(spark, docs, sf_dir):
    """Documents that leak no benchmark item."""
    prepare(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_stage(spark, docs, sf_dir):
    """All documents with their piece ids, the ids' number and whether they decode to the text."""
    prepare(spark)
    coded = piece_bpe.with_pieces(docs, tokenizer_path(PIECE_MODEL))
    facts = piece_bpe.digests()
    return (coded.withColumn("n_tokens", facts["n_tokens"])
            .withColumn("decodes", coded["decoded"] == coded["text"]).drop("decoded"))


STAGES = [
    ("language identification", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", leak_stage),
    ("piece encoding", piece_stage),
]

#: Python tokenizers and the fitted language model are no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
