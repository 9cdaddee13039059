"""Extensions promised by the benchmark's plan: cube (P1), exact top-k (P2), gain of one repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.functions import querylog as Q

# ---------------------------------------------------------------- P1: cube


DIMENSIONS = ["model", "strategy", "tier"]
SKETCH_K = 4_000  # latency sketches: some 32 KB of state per cell, however many runs it holds


def rank_error(k: int = SKETCH_K) -> float:
    """How far a sketch's quantile may lie from the asked rank, as a share of all values, with
    99 % confidence (the published bound of the KLL sketch): 0.0007 for k = 4,000."""
    return 2.296 / k ** 0.9723


def _timed(scored: DataFrame, executions: DataFrame | None) -> DataFrame:
    """Scored answers with the tier of their gold query and their run's milliseconds."""
    s = Q.with_complexity(scored, "gold_sql", tier_col="tier", features_col="_f", label_col=None)
    if executions is None:
        return s.withColumn("gen_ms", F.lit(None).cast("bigint"))
    ms = executions.select(F.col("run_id").alias("gen_run_id"), F.col("ms").cast("bigint").alias("gen_ms"))
    return s.join(ms, "gen_run_id", "left")


def _measures(n, correct, cost) -> list:
    """Number, correct answers, accuracy and cost from their sums."""
    return [n.alias("n"), correct.alias("n_correct"), F.round(F.lit(100.0) * correct / n, 2).alias("accuracy_pct"),
            F.round(cost, 6).alias("cost_usd")]


def benchmark_cube(scored: DataFrame, executions: DataFrame | None = None, latency: str = "exact") -> DataFrame:
    """Accuracy, cost and latency by model x strategy x tier, with all subtotals.

    ``tier`` is the complexity tier of the gold query.  Rollup rows carry
    NULL in the rolled-up dimensions (``grouping_id`` tells them apart).
    Latency percentiles come from the generated runs: ``exact`` ones hold every
    distinct value of a cell in one state; ``sketch`` takes those of
    ``latency_cells``, whose size does not grow, within ``rank_error``.
    """
    if latency == "sketch":
        return cube_of_cells(latency_cells(scored, executions))
    if latency != "exact":
        raise ValueError(f"latency is exact or sketch, not {latency!r}")
    ok = F.sum(F.col("correct").cast("bigint"))
    return _timed(scored, executions).cube(*DIMENSIONS).agg(
        F.grouping_id().alias("level"), *_measures(F.count(F.lit(1)), ok, F.sum("cost_usd")),
        F.percentile("gen_ms", 0.5).alias("p50_ms"), F.percentile("gen_ms", 0.95).alias("p95_ms"))


def latency_cells(scored: DataFrame, executions: DataFrame | None = None, k: int = SKETCH_K) -> DataFrame:
    """One row per model, strategy and tier: n, n_correct, cost, n_ms and a sketch of the latencies.

    Cells of several benchmarks can be put together (``unionByName``) and given to
    ``cube_of_cells``, so a history keeps these rows in place of its runs' latencies.
    """
    return _timed(scored, executions).groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"),
        F.sum("cost_usd").alias("cost"), F.count("gen_ms").alias("n_ms"),
        F.kll_sketch_agg_bigint("gen_ms", F.lit(k)).alias("sketch"))


def cube_of_cells(cells: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """The cube of ``latency_cells`` rows: subtotals merge sketches, no run is read again."""
    merged = cells.cube(*DIMENSIONS).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("_n"), F.sum("n_correct").alias("_ok"),
        F.sum("cost").alias("_cost"), F.sum("n_ms").alias("_timed"),
        F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("_s"))
    quantile = lambda q: F.when(F.col("_timed") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(q))).cast(
        "double")
    return merged.select(*DIMENSIONS, "level", *_measures(F.col("_n"), F.col("_ok"), F.col("_cost")),
                         quantile(0.5).alias("p50_ms"), quantile(0.95).alias("p95_ms"))


# ------------------------------------------------------- P2: similar top-k

CHUNK_VECTORS = 65_536   # corpus vectors that a task holds at once
TILE_VECTORS = 2_048     # of these, scored together


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """A matrix of unit-length rows (a zero vector stays zero)."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def best_of_tiles(q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of each query's k best rows of ``m``; ``ids`` ascend, so a
    stable sort breaks ties by id."""
    best_i, best_s = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
    for lo in range(0, len(ids), TILE_VECTORS):
        scores = q @ m[lo:lo + TILE_VECTORS].T
        at = np.broadcast_to(np.arange(lo, lo + scores.shape[1]), scores.shape)
        i, s = np.concatenate([best_i, at], axis=1), np.concatenate([best_s, scores], axis=1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best_i, best_s = np.take_along_axis(i, order, axis=1), np.take_along_axis(s, order, axis=1)
    return ids[best_i], best_s


def top_k_similar(queries: DataFrame, corpus: DataFrame, k: int = 5,
                  query_id: str = "qid", query_vec: str = "qvec",
                  corpus_id: str = "id", corpus_vec: str = "vec",
                  query_block: int = 1024) -> DataFrame:
    """Exact cosine top-k corpus rows for every query vector, in one corpus pass.

    The queries are written once under the shared folder.  Each task holds one
    chunk of its corpus partition and reads the queries block by block (a matrix
    product per block and tile), so neither side is gathered anywhere and any
    number of queries costs one scan.  A task emits k rows per query and chunk;
    ``row_number`` with a limit, which Spark applies before the shuffle as well,
    keeps the best.  Ties in score are broken by corpus id.
    """
    from sqlgauge.session import child_names, ship_package, work_path

    spark = queries.sparkSession
    ship_package(spark)
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("qvec"))
    folder = work_path(spark, "query-vectors")
    q.where(F.col("qvec").isNotNull()).write.parquet(folder)
    files = [f"{folder}/{n}" for n in child_names(spark, folder) if n.endswith(".parquet")]
    c = corpus.select(F.col(corpus_id).alias("cid"), F.col(corpus_vec).alias("cvec")).dropna(subset=["cvec"])
    kinds = f"qid {q.schema['qid'].dataType.simpleString()}, cid {c.schema['cid'].dataType.simpleString()}"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                rows += len(pdf)
            if rows >= CHUNK_VECTORS:
                yield from search_chunk(pd.concat(held), files, k, query_block)
                held, rows = [], 0
        if rows:
            yield from search_chunk(pd.concat(held), files, k, query_block)

    cand = c.mapInPandas(score, f"{kinds}, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid").asc())
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("qid").alias(query_id), "rank", F.col("cid").alias(corpus_id), "score"))


def search_chunk(corpus: pd.DataFrame, files: list[str], k: int, query_block: int) -> Iterator[pd.DataFrame]:
    """The best rows of one chunk for every query of the files."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    corpus = corpus.sort_values("cid", kind="stable")
    ids, m = corpus["cid"].to_numpy(), unit_rows(corpus["cvec"])
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else
                                              "file://" + uri[len("file:"):])
        with system.open_input_file(path) as f:
            for block in pq.ParquetFile(f).iter_batches(query_block):
                pdf = block.to_pandas()
                if not len(pdf):
                    continue
                best, scores = best_of_tiles(unit_rows(pdf["qvec"]), ids, m, k)
                yield pd.DataFrame({"qid": np.repeat(pdf["qid"].to_numpy(), best.shape[1]),
                                    "cid": best.ravel(), "score": scores.ravel()})


def label_centroids(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label with Spark ML's ``Summarizer``: a JVM aggregate
    over whole vectors with map-side partials -- no explode into one row per
    dimension, and each group's state is one vector."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    means = v.groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(label, vector_to_array("_m").alias("centroid"))


# --------------------------------------------------------- P3: repair gain

def repair_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accuracy before and after re-prompting failures, per strategy.

    ``after`` holds re-scored rows for the failed (example, strategy) pairs.
    """
    a = after.select("example_id", "strategy", F.col("correct").alias("fixed"))
    j = before.join(a, ["example_id", "strategy"], "left")
    now = F.col("correct") | F.coalesce(F.col("fixed"), F.lit(False))
    return j.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("bigint")).alias("correct_before"),
        F.sum(now.cast("bigint")).alias("correct_after"),
    ).withColumn("gain", F.col("correct_after") - F.col("correct_before"))
