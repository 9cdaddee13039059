"""Queries of the training-data operators: name -> callable, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlgauge.llm import decontam as DC
from sqlgauge.llm import exact_dedup as ED
from sqlgauge.llm import exact_topk as TK
from sqlgauge.llm import hard_negatives as HN
from sqlgauge.llm import html_main as HM
from sqlgauge.llm import langid as LI
from sqlgauge.llm import license_scan as LS
from sqlgauge.llm import near_dup as ND
from sqlgauge.llm import piece_bpe as PB
from sqlgauge.llm import token_align as TA
from sqlgauge.llm import token_counts as TC
from sqlgauge.llm import token_store as TS
from sqlgauge.llm import warc_zip as WZ
from sqlgauge.session import ship_package

END_ID = 2
TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Rows of an Arrow batch; texts are long, and a task holds a few batches at once.
ARROW_ROWS = 2000


def prepare(spark) -> None:
    """Make the package importable on executors and keep Arrow batches small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def _table(spark, sf: str, name: str):
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontamination(spark, sf):
    found = DC.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "covered_tokens", "coverage",
                        F.size("tiles").alias("n_tiles"))


def op2_language_id(spark, sf):
    docs = _table(spark, sf, "documents")
    model = LI.train(docs)
    out = LI.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", LI.held_out(F.col("doc_id")).alias("held_out"),
                      F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
                      F.col("language.rejected").alias("rejected"))


def op3_piece_round_trip(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    coded = PB.with_pieces(docs, tokenizer_path("piece_bpe_32k.model"))
    d = PB.digests()
    return coded.select("doc_id", *[c.alias(k) for k, c in d.items()])


def op4_token_counts(spark, sf):
    docs = _table(spark, sf, "documents")
    return TC.count_documents(docs, tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op5_token_store(spark, sf):
    docs = _table(spark, sf, "documents")
    store = TS.write_store(docs, tokenizer_path("byte_bpe_50k.json"), END_ID)
    return TS.read_store(spark, store)


def op6_exact_top_k(spark, sf):
    return TK.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_warc_packages(spark, sf):
    packages = WZ.write_packages(_table(spark, sf, "pages"))
    return WZ.read_packages(spark, packages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_main_text(spark, sf):
    return HM.extract_pages(_table(spark, sf, "pages"))


def op9_license_scan(spark, sf):
    return LS.licensed_documents(spark.read.parquet(f"{sf}/documents.parquet"))


def op10_near_duplicates(spark, sf):
    return ND.near_duplicates(_table(spark, sf, "documents"), words=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_exact_duplicates(spark, sf):
    return ED.exact_duplicates(_table(spark, sf, "documents"))


def op12_token_alignment(spark, sf):
    docs = _table(spark, sf, "documents")
    return TA.cross_alignment(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_hard_negatives(spark, sf):
    rows = _table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return HN.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_language_id": op2_language_id,
        "op3_piece_round_trip": op3_piece_round_trip,
        "op4_token_counts": op4_token_counts,
        "op5_token_store": op5_token_store,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_warc_packages": op7_warc_packages,
        "op8_main_text": op8_main_text,
        "op9_license_scan": op9_license_scan,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_exact_duplicates": op11_exact_duplicates,
        "op12_token_alignment": op12_token_alignment,
        "op13_hard_negatives": op13_hard_negatives,
    }


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(1 + ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT)
                          // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32) AS INTEGER), 1)), '') AS payload_digest
      FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM m
"""

NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[]
                               WHEN len(words) = 1 THEN [words[1]]
                               ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                          END) AS s FROM w)),
n AS (SELECT w.doc_id, CAST(count(sh.s) AS BIGINT) AS n_shingles
      FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both
  FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.both >= 80 * (na.n_shingles + nb.n_shingles - p.both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
SELECT n.doc_id, n.n_shingles, min(r.seen) AS component_id, n.doc_id = min(r.seen) AS kept
FROM n JOIN reach r ON r.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


HARD_NEGATIVE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS slot
  FROM s WHERE same QUALIFY slot <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.slot ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
       AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE n <= 10
"""

EXACT_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_top_k": TOP_K_SQL,
        "op7_warc_packages": WARC_SQL,
        "op9_license_scan": LS.oracle(),
        "op10_near_duplicates": NEAR_DUP_SQL,
        "op11_exact_duplicates": EXACT_SQL,
        "op13_hard_negatives": HARD_NEGATIVE_SQL,
    }
