"""Retrieval (P2): a vector index beside the exact search, BM25 ranking, schema context.

Vectors: rows are dealt into lists around centroids fitted on a bounded sample; a
query is compared with the lists whose centroids are nearest to it. How many lists
that takes is not guessed but read off an exact search of a few rows.

Texts: an inverted index (term, document, weight) that holds only the terms that the
queries use, joined with the queries on term. A document's postings stay in one
partition, so scores are added up where they arise and only the best of each
partition are moved; a query set too large to send to all tasks is joined by
shuffle instead, with the postings of common terms split over several partitions.

Tables of a question: BM25 over table and column names, then every table that the
chosen ones refer to, directly or not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.operators.extend import best_of_tiles, top_k_similar, unit_rows
from sqlgauge.session import ship_package, work_path, written

# ------------------------------------------------------------ vector index

SAMPLE_ROWS = 20_000      # rows that centroids are fitted on (the smallest id hashes)
MAX_LISTS = 4_096         # centroids are sent to every task: at most this many
CHUNK_ROWS = 2_048        # rows of a list that are compared at a time; longer lists are split
QUERY_ROWS = 1_024        # queries of a list that are compared at a time
OUT_ROWS = 8_192          # vectors that a task sends out at a time
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.97      # of the exact search's results, over the calibration queries


@dataclass(frozen=True)
class VectorIndex:
    """Lists of unit vectors, written as chunks (list, part, ids, vectors)."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int           # lists that reach TARGET_RECALL on the calibration queries

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def _pick(df: DataFrame, rows: int) -> DataFrame:
    return df.orderBy(F.xxhash64("id"), "id").limit(rows)


def fit_centroids(vectors: DataFrame, lists: int) -> np.ndarray:
    """Unit centroids of a sample of (id, vec) by Spark ML's k-means with cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = written(_pick(vectors.where(F.exists("vec", lambda x: x != 0)), SAMPLE_ROWS)
                     .select(array_to_vector("vec").alias("features")), "index-sample")
    if not sample.limit(1).count():
        return np.zeros((0, 0))
    model = KMeans(k=lists, seed=11, maxIter=10, initSteps=1, distanceMeasure="cosine").fit(sample)
    return unit_rows(pd.Series(model.clusterCenters()))


def _nearest_lists(centroids: np.ndarray, probes: int, with_vec: bool = True):
    """(list, id, vec, place): the ``probes`` nearest lists of each vector, nearest first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            # Each vector goes out once per list, so a block has few of them if the lists are many.
            step = max(1, OUT_ROWS // probes)
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                m = unit_rows(part["vec"])
                order = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :probes]
                n = order.shape[1]
                out = {"list": order.ravel(), "id": np.repeat(part["id"].to_numpy(), n)}
                if with_vec:
                    out["vec"] = [v for v in m for _ in range(n)]
                yield pd.DataFrame(out | {"place": np.tile(np.arange(n), len(m))})
    return run


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    whole = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~whole)
            .select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))


def build_index(corpus: DataFrame, id_col: str = "id", vec_col: str = "vec", lists: int | None = None,
                k: int = 5, path: str | None = None) -> VectorIndex:
    """Index every row of ``corpus`` (vectors of one length); rows without id, vector or with
    a null or non-finite component are left out.

    ``probes`` is set by an exact search of CALIBRATION_QUERIES rows for their ``k`` best:
    the number of lists that holds TARGET_RECALL of what it finds.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    rows = _vectors(corpus, id_col, vec_col)
    kind = rows.schema["id"].dataType.simpleString()
    lists = lists or max(1, min(MAX_LISTS, math.isqrt(rows.count())))
    centroids = fit_centroids(rows, lists)
    path = path or work_path(spark, "vector-index")
    listed = f"list int, id {kind}, vec array<double>, place int"
    if not len(centroids):  # no vector to fit on: one list holds all
        dealt = rows.select(F.lit(0).alias("list"), "id", "vec")
    else:
        dealt = rows.mapInPandas(_nearest_lists(centroids, 1), listed).drop("place")
    dealt = written(dealt, "index-rows")
    sizes = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK_ROWS).cast("bigint")).alias("part")
    (dealt.join(sizes, "list").select("list", part, "id", "vec").groupBy("list", "part")
     .agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
     .select("list", "part", F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vecs"))
     .write.mode("overwrite").parquet(path))
    probes = len(centroids) and _calibrate(rows, dealt, centroids, k)
    return VectorIndex(spark, path, centroids, probes)


def _calibrate(rows: DataFrame, dealt: DataFrame, centroids: np.ndarray, k: int) -> int:
    asked = written(_pick(rows, CALIBRATION_QUERIES), "calibration")
    exact = top_k_similar(asked.toDF("qid", "qvec"), rows, k + 1).where("qid <> id").select("qid", "id")
    kind = rows.schema["id"].dataType.simpleString()
    order = asked.mapInPandas(_nearest_lists(centroids, len(centroids), with_vec=False),
                              f"list int, id {kind}, place int")
    places = (exact.join(dealt.select("id", "list"), "id")
              .join(order.select(F.col("id").alias("qid"), "list", "place"), ["qid", "list"])
              .groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())  # at most one row per list
    counts = np.zeros(len(centroids))
    for r in places:
        counts[r["place"]] = r["n"]
    reached = np.cumsum(counts) >= TARGET_RECALL * counts.sum()
    return int(np.argmax(reached)) + 1


def search_index(index: VectorIndex, queries: DataFrame, k: int = 5, query_id: str = "qid",
                 query_vec: str = "qvec", probes: int | None = None) -> DataFrame:
    """qid, rank, id, score: the k best rows by cosine of each query's nearest lists.

    A hot list is several chunks and its queries several blocks; a chunk meets each
    block that probes its list once, and only k rows per query leave the meeting.
    """
    q = _vectors(queries, query_id, query_vec)
    kind = q.schema["id"].dataType.simpleString()
    cid = index.chunks().schema["ids"].dataType.elementType.simpleString()
    probes = probes or index.probes
    if len(index.centroids):
        asked = q.mapInPandas(_nearest_lists(index.centroids, probes),
                              f"list int, id {kind}, vec array<double>, place int")
    else:
        asked = q.select(F.lit(0).alias("list"), "id", "vec")
    blocks = max(1, -(-q.count() // QUERY_ROWS))
    packed = (asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("list", "block")
              .agg(F.collect_list(F.struct("id", "vec")).alias("q"))
              .select("list", F.col("q.id").alias("qids"), F.col("q.vec").alias("qvecs")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, vecs, qids, qvecs in zip(pdf["ids"], pdf["vecs"], pdf["qids"], pdf["qvecs"]):
                order = np.argsort(ids, kind="stable")
                m, asked_m = np.stack(vecs)[order], np.stack(qvecs)
                best, scores = best_of_tiles(unit_rows(pd.Series(list(asked_m))), np.asarray(ids)[order], m, k)
                yield pd.DataFrame({"qid": np.repeat(np.asarray(qids), best.shape[1]), "id": best.ravel(),
                                    "score": scores.ravel()})

    met = (index.chunks().join(packed, "list").select("ids", "vecs", "qids", "qvecs")
           .mapInPandas(meet, f"qid {kind}, id {cid}, score double"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc())
    return (met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("qid").alias(query_id), "rank", "id", "score"))


def others(found: DataFrame, k: int, query_id: str = "qid") -> DataFrame:
    """The k best without the query's own row."""
    w = Window.partitionBy(query_id).orderBy("rank")
    return (found.where(F.col(query_id) != F.col("id")).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def recall(found: DataFrame, exact: DataFrame, query_id: str = "qid") -> DataFrame:
    """One row: n_queries, n_expected, n_found of ``exact``'s (query, id) pairs."""
    hit = found.select(query_id, "id").withColumn("hit", F.lit(True))
    return (exact.select(query_id, "id").join(hit, [query_id, "id"], "left")
            .agg(F.count_distinct(query_id).alias("n_queries"), F.count(F.lit(1)).alias("n_expected"),
                 F.count("hit").alias("n_found")))


# -------------------------------------------------------------------- BM25

#: The usual saturation and length parameters; scores are whole millionths.
K1, B, UNIT = 1.2, 0.75, 1_000_000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[\p{L}\p{N}]+"
SENT_TERMS = 1_000_000    # (query, term) rows that are sent to all tasks; more are joined by shuffle
SPLIT_ROWS = 50_000       # postings of a term that one partition of the shuffled join takes, about
PAIR_ROWS = 2_000_000     # (document, query, term) rows that one task adds up, about


def words(text: Column) -> Column:
    """array<string>: runs of letters and digits, A-Z lower-cased (none of a null text)."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def query_terms(queries: DataFrame, id_col: str, text_col: str, group: str | None = None) -> DataFrame:
    """grp, qid, term, times: the terms of each query."""
    grp = F.col(group) if group else F.lit("")
    return (queries.where(F.col(id_col).isNotNull())
            .select(grp.alias("grp"), F.col(id_col).alias("qid"), F.explode(words(F.col(text_col))).alias("term"))
            .groupBy("grp", "qid", "term").agg(F.count(F.lit(1)).alias("times")))


def weighted_postings(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str,
                      group: str | None = None) -> DataFrame:
    """grp, term, id, n, weight: what each document gives a query for each ``wanted`` (grp, term).

    ``n`` is the number of documents with the term. The inverse frequency is the classic one,
    ln((N - n + 0.5) / (n + 0.5)), never below zero: terms of at least half of the documents weigh
    nothing and have no postings. Documents without words count in N.
    """
    grp = F.col(group) if group else F.lit("")
    texts = docs.where(F.col(id_col).isNotNull()).select(grp.alias("grp"), F.col(id_col).alias("id"),
                                                         words(F.col(text_col)).alias("words"))
    sizes = texts.groupBy("grp").agg(F.count(F.lit(1)).alias("all"), F.avg(F.size("words")).alias("mean"))
    # One row per document and wanted term; a document's rows stay in one partition from here on.
    found = (texts.select("grp", "id", F.size("words").alias("len"), F.explode("words").alias("term"))
             .join(wanted, ["grp", "term"], "left_semi")
             .repartition("id").groupBy("id", "grp", "len", "term").agg(F.count(F.lit(1)).alias("times")))
    found = written(found, "postings")
    frequency = found.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n")).join(sizes, "grp")
    idf = F.log((F.col("all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rare = frequency.where(2 * F.col("n") < F.col("all")).select("grp", "term", "n", "mean", idf.alias("idf"))
    times = F.col("times").cast("double")
    weight = F.col("idf") * times * (K1 + 1) / (times + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return found.join(rare, ["grp", "term"]).select(
        "grp", "term", "id", "n", F.floor(weight * UNIT).cast("bigint").alias("weight"))


def rank_documents(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "qid",
                   query_text: str = "text", doc_id: str = "id", doc_text: str = "text",
                   group: str | None = None, sent_terms: int | None = None) -> DataFrame:
    """qid, rank, id, score: the k best documents of each query by BM25, ties to the smaller id.

    Only documents that score above zero are ranked, and with ``group`` only those of the
    query's group. Ids are unique; rows without id take no part.
    """
    sent_terms = SENT_TERMS if sent_terms is None else sent_terms
    asked = written(query_terms(queries, query_id, query_text, group), "query-terms")
    postings = weighted_postings(docs, asked.select("grp", "term").distinct(), doc_id, doc_text, group)
    if asked.count() <= sent_terms:
        # A common term meets many queries: partitions are as many as the pairs need, whatever the postings take.
        per_term = asked.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("q"))
        n = postings.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("p")).join(F.broadcast(per_term), ["grp", "term"]) \
            .agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0
        parts = max(-(-n // PAIR_ROWS), int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pairs = postings.repartition(parts, "id").join(F.broadcast(asked), ["grp", "term"])
    else:
        splits = F.ceil(F.col("n") / SPLIT_ROWS).cast("int")
        per_term = postings.groupBy("grp", "term").agg(F.first("n").alias("n"))
        spread = asked.join(per_term.withColumn("splits", splits), ["grp", "term"]).select(
            "grp", "term", "qid", F.col("times"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"))
        dealt = postings.withColumn("part", F.pmod(F.xxhash64("id"), splits).cast("int"))
        pairs = dealt.join(spread, ["grp", "term", "part"])
    scores = (pairs.groupBy("id", "qid").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))
              .where("score > 0"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc())
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("qid").alias(query_id), "rank", F.col("id").alias(doc_id), "score"))


# ---------------------------------------------------------- schema context

def table_texts(columns: DataFrame) -> DataFrame:
    """db_id, table_name, text: the words of each table's and its columns' names.

    ``columns`` is the catalog's column list (``catalog.columns``), one row per column.
    """
    names = columns.select("db_id", "table_name", F.col("ordinal").alias("o"), F.col("column_name").alias("name"))
    names = names.unionByName(columns.select("db_id", "table_name", F.lit(0).alias("o"),
                                             F.col("table_name").alias("name")).distinct())
    return (names.groupBy("db_id", "table_name")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda s: F.translate(
                s["name"], "_", " ")), " ").alias("text")))


def referred_tables(foreign_keys: DataFrame) -> DataFrame:
    """db_id, table_name, referred: every table that a table refers to, over any number of keys.

    Each round joins the pairs found so far with themselves, so paths double; the table is as
    large as the catalogs, not their data.
    """
    reach = written(foreign_keys.select("db_id", "table_name", F.col("ref_table").alias("referred")).distinct(),
                    "references")
    n = reach.count()
    while True:
        further = reach.select("db_id", F.col("table_name").alias("referred"), F.col("referred").alias("next"))
        reach = written(reach.unionByName(reach.join(further, ["db_id", "referred"]).select(
            "db_id", "table_name", F.col("next").alias("referred"))).distinct(), "references")
        n, before = reach.count(), n
        if n == before:
            return reach


def tables_for(questions: DataFrame, columns: DataFrame, foreign_keys: DataFrame, k: int = 3,
               question_id: str = "example_id", text_col: str = "question") -> DataFrame:
    """question id, db_id, table_name, rank: the k tables that fit a question best (rank 1..k) and the
    tables that these refer to (rank null), all of the question's own database."""
    texts = table_texts(columns).withColumn("id", F.struct("db_id", "table_name"))
    best = rank_documents(questions, texts, k, question_id, text_col, "id", "text", group="db_id")
    best = best.select(question_id, "id.db_id", "id.table_name", "rank")
    more = best.join(referred_tables(foreign_keys), ["db_id", "table_name"]).select(
        question_id, "db_id", F.col("referred").alias("table_name"), F.lit(None).cast("int").alias("rank"))
    return best.unionByName(more).groupBy(question_id, "db_id", "table_name").agg(F.min("rank").alias("rank"))


def schema_context(questions: DataFrame, columns: DataFrame, foreign_keys: DataFrame, ddl: DataFrame,
                   k: int = 3, question_id: str = "example_id", text_col: str = "question") -> DataFrame:
    """question id, tables (sorted), schema_text: the declarations (``catalog.ddl_text``) of the
    tables that a question needs; a question that fits none has no row."""
    chosen = tables_for(questions, columns, foreign_keys, k, question_id, text_col)
    block = F.array_sort(F.collect_list(F.struct("table_name", "ddl")))
    return (chosen.join(ddl, ["db_id", "table_name"]).groupBy(question_id).agg(block.alias("b"))
            .select(question_id, F.col("b.table_name").alias("tables"),
                    F.array_join("b.ddl", "\n\n").alias("schema_text")))
