"""Operator 6: exact top-k inner products of a query set against all vectors.

Queries are packed into blocks of QUERY_BLOCK vectors in the shared folder. Each
task holds one chunk of the vectors, reads the query blocks one after another
and multiplies block by tile (one matrix product each), keeping k per query from
every tile by partial selection. The chunks' lists are then merged in a tree:
each level joins the lists of FAN neighbouring partitions, so no group is larger
than FAN times k, whatever the number of vectors.

Components are quantised to floor(scale * x); scores are exact integers (the
product runs in the narrowest float type that holds every partial sum exactly,
else in Python integers, clipped to 64 bits).

Defined results: vectors that are null or hold a null or non-finite component,
and rows without id, take no part; only vectors of equal length are compared;
rows that share a query's id are never its results; of several query rows with
one id the smallest vector counts; equal candidate rows each take a rank; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.session import work_path

QUERY_BLOCK = 1024
TILE = 4096
CHUNK = 131_072  # vectors that a task holds at once
FAN = 16


def vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, quantised matrix) of the usable rows, one pair per vector length."""
    ids, lists = batch.column(0), batch.column(1)
    usable = ~(ids.is_null() if lists.null_count == 0 else
               pc.or_(ids.is_null(), lists.is_null())).to_numpy(zero_copy_only=False)
    if not usable.any():
        return
    keep = pa.array(usable)
    ids = ids.filter(keep).to_numpy()
    lists = lists.filter(keep)
    length = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        m = flat[V.ranges(start[rows], length[rows])].reshape(len(rows), d)
        good = np.isfinite(m).all(axis=1)
        if good.any():
            yield ids[rows[good]], np.floor(scale * m[good])


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products (rows of q by rows of c)."""
    most = max(1.0, np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]))
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], dtype=object)
    exact = whole(q).reshape(q.shape) @ whole(c).reshape(c.shape).T
    return np.clip(exact, -2**63, 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best: higher score first, then smaller id.

    ``ids`` ascend, so among equal scores the earlier position wins.
    """
    n = scores.shape[1]
    if n > 4 * k and np.abs(scores).max() < 2**62 // n:
        ranked = scores * n - np.arange(n)
        top = np.argpartition(ranked, n - k, axis=1)[:, n - k:]
        order = np.argsort(-np.take_along_axis(ranked, top, axis=1), axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1)
    return np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)[:, :k]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (query, id, score) rows of one query block against one chunk (ids ascending)."""
    best_s = np.zeros((len(q), 0), dtype=np.int64)
    best_i = np.zeros((len(q), 0), dtype=np.int64)
    best_own = np.zeros((len(q), 0), dtype=bool)
    for lo in range(0, len(ids), TILE):
        part = ids[lo:lo + TILE]
        scores = products(q, c[lo:lo + TILE])
        own = q_ids[:, None] == part[None, :]
        if own.any():
            scores[own] = max(-2**63, int(scores.min()) - 1)  # last, and marked by ``own``
        top = select(scores, part, min(k, len(part)))
        s = np.concatenate([best_s, np.take_along_axis(scores, top, axis=1)], axis=1)
        i = np.concatenate([best_i, part[top]], axis=1)
        o = np.concatenate([best_own, np.take_along_axis(own, top, axis=1)], axis=1)
        order = np.lexsort((i, ~s, o), axis=1)[:, :k]
        best_s, best_i, best_own = (np.take_along_axis(x, order, axis=1) for x in (s, i, o))
    keep = ~best_own
    return np.repeat(q_ids, keep.sum(axis=1)), best_i[keep], best_s[keep]


def _pack_queries(folder: str, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        rows: list[tuple[str, int, int]] = []

        def put(d: int) -> None:
            ids = np.concatenate([x for x, _ in held[d]])
            m = np.concatenate([y for _, y in held.pop(d)])
            for lo in range(0, len(ids), QUERY_BLOCK):
                a, b = ids[lo:lo + QUERY_BLOCK], m[lo:lo + QUERY_BLOCK]
                uri = storage.task_file(folder, "queries", ".bin")
                storage.write_bytes(uri, a.astype("<i8").tobytes() + b.astype("<f8").tobytes())
                rows.append((uri, len(a), d))

        for batch in batches:
            for ids, m in vectors(batch, scale):
                held.setdefault(m.shape[1], []).append((ids, m))
                if sum(len(x) for x, _ in held[m.shape[1]]) >= QUERY_BLOCK:
                    put(m.shape[1])
        for d in list(held):
            put(d)
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.int64())], ["uri", "n", "dim"])
    return run


def _search_chunks(listed: list[tuple[str, int, int]], scale: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def search(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            chunk = {}
            for d, parts in held.items():
                ids, m = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
                order = np.argsort(ids, kind="stable")
                chunk[d] = ids[order], m[order]
            for uri, n, d in listed:
                if d not in chunk:
                    continue
                body = storage.read_bytes(uri)
                q_ids = np.frombuffer(body, dtype="<i8", count=n)
                q = np.frombuffer(body, dtype="<f8", offset=8 * n).reshape(n, d)
                qi, vi, s = search_block(q_ids, q, *chunk[d], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(qi), part, np.int32)), pa.array(qi), pa.array(vi), pa.array(s)],
                    ["part", "query_id", "vec_id", "score"])

        held: dict[int, list] = {}
        rows = 0
        for batch in batches:
            for ids, m in vectors(batch, scale):
                held.setdefault(m.shape[1], []).append((ids, m))
                rows += len(ids)
            if rows >= CHUNK:
                yield from search(held)
                held, rows = {}, 0
        yield from search(held)
    return run


def top_k(corpus: DataFrame, is_query: Column, k: int, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    queries = (corpus.where(is_query)
               .select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
               .where("id IS NOT NULL AND vec IS NOT NULL")
               .where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
               .groupBy("id").agg(F.min("vec").alias("vec")))
    folder, listing = storage.base_folder(spark, "queries"), work_path(spark, "query-blocks")
    (queries.mapInArrow(_pack_queries(folder, scale), "uri string, n bigint, dim bigint")
     .write.parquet(listing))
    # One row per block of queries: a file listing.
    listed = [(r.uri, r.n, r.dim) for r in spark.read.parquet(listing).orderBy("uri").toLocalIterator()]
    found = rows.mapInArrow(_search_chunks(listed, scale, k),
                            "part int, query_id bigint, vec_id bigint, score bigint")
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("worse"), "vec_id"))), 1, k)
    top = found.groupBy("query_id", F.expr(f"part div {FAN}").alias("part")).agg(best.alias("top"))
    parts, merged = max(1, rows.rdd.getNumPartitions() // FAN + 1), F.flatten(F.collect_list("top"))
    while True:
        parts = -(-parts // FAN)
        top = (top.groupBy("query_id", F.expr(f"part div {FAN}").alias("part"))
               .agg(F.slice(F.sort_array(merged), 1, k).alias("top")))
        if parts <= 1:
            break
    return (top.select("query_id", F.posexplode("top").alias("pos", "hit"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id",
                    F.bitwise_not(F.col("hit.worse")).alias("score")))
