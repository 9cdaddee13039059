"""Operator 13: hard negatives from scores of a residue-number-system matrix product.

Components are quantised to floor(scale * x). A matrix product of them is computed
modulo several small primes: the residues, centred around zero, are multiplied in
float32, where every partial sum stays below 2**24 and so is exact, and the signed
scores follow from the residues by Chinese remaindering. As many primes are taken as
the largest possible score needs.

Mining runs twice over the vectors. Anchors are packed into block files of the shared
folder; each task holds one chunk of the vectors, reads the blocks one after another
and multiplies block by tile. The first run keeps each anchor's best rows of its own
label, its positives; the second knows the positives' scores and keeps, for every
(anchor, positive), the best rows of other labels inside the window of scores that the
positive sets. What the chunks find is merged in a tree, FAN neighbouring chunks at a
time, so no group grows with the table.

Defined results: rows with a null id, label or vector, or any null or non-finite
component (before or after scaling) take no part; only vectors of equal length are
compared; rows that share an anchor's id are never its results; of several anchor rows
with one id the smallest (label, vector) counts; equal rows each take a rank (a positive that
stands in the table twice has its negatives twice), ties go to the smaller id; scores beyond 64 bits are clipped; a positive without any row in its
window has no rows in the result, nor has an anchor without positives; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm.graph import written
from sqlgauge.session import work_path

ANCHOR_BLOCK = 512
TILE = 4096
CHUNK = 131_072  # vectors that a task holds at once
FAN = 16
PANEL = 1024     # columns that are multiplied before residues are reduced
LEAST, MOST = -2**63, 2**63 - 1


def moduli(bound: int, columns: int) -> list[int]:
    """Primes whose product exceeds 2 * bound, largest first; residues of ``columns``
    columns multiply exactly in float32. None if all such primes are too few (some 400 digits)."""
    half = isqrt((2**24 - 1) // max(1, columns))
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound:
        while p > 1 and any(p % d == 0 for d in range(2, isqrt(p) + 1)):
            p -= 1
        if p < 2:
            return []
        found.append(p)
        product *= p
        p -= 1
    return found


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p, centred around zero."""
    r = np.fmod(m, p)
    half = p // 2
    r[r > half] -= p
    r[r < -half] += p  # half of 2 is 1: -1 and 1 are the same residue
    return r.astype(np.float32)


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these residues (0..p-1), smallest magnitude first."""
    whole = 1
    for p in primes:
        whole *= p
    kind = np.int64 if whole < 2**62 else object
    x, product = parts[0].astype(kind), primes[0]
    for r, p in zip(parts[1:], primes[1:]):
        step = (r - x) % p * pow(product, -1, p) % p
        x = x + step * product
        product *= p
    x = np.where(x > whole // 2, x - whole, x)
    return x if kind is np.int64 else np.clip(x, LEAST, MOST).astype(np.int64)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of q by rows of c) of whole numbers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    bound = int(np.abs(q).max()) * int(np.abs(c).max()) * q.shape[1]
    primes = moduli(max(1, bound), min(PANEL, q.shape[1]))
    if not primes:
        a, b = (np.array([[int(x) for x in r] for r in m.tolist()], dtype=object) for m in (q, c))
        return np.clip(a @ b.T, LEAST, MOST).astype(np.int64)
    parts = []
    for p in primes:
        a, b = residues(q, p), residues(c, p)
        total = np.zeros((len(q), len(c)), dtype=np.int64)
        for lo in range(0, q.shape[1], PANEL):
            total += (a[:, lo:lo + PANEL] @ b[:, lo:lo + PANEL].T).astype(np.int32) % p
        parts.append(total % p)
    return reconstruct(parts, primes)


def pick(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(scores, ids, taken) of each row's k best allowed columns; ``ids`` ascend."""
    n = scores.shape[1]
    if n > 4 * k and max(abs(int(scores.min())), abs(int(scores.max()))) < 2**61 // n:
        ranked = np.where(allowed, scores * n - np.arange(n), LEAST)
        top = np.argpartition(ranked, n - k, axis=1)[:, n - k:]
        order = np.argsort(-np.take_along_axis(ranked, top, axis=1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, axis=1)
    else:
        top = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores, ~allowed), axis=1)[:, :k]
    return np.take_along_axis(scores, top, axis=1), ids[top], np.take_along_axis(allowed, top, axis=1)


def merge(a: tuple, b: tuple, k: int) -> tuple:
    """The k best of two selections, row by row."""
    s, i, o = (np.concatenate(x, axis=1) for x in zip(a, b))
    order = np.lexsort((i, ~s, ~o), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (s, i, o))


def usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, quantised matrix) of rows (id, label, vector), one triple per vector length."""
    ids, labels, lists = batch.columns[:3]
    here = np.ones(batch.num_rows, dtype=bool)
    for c in (ids, labels, lists):
        here &= ~c.is_null().to_numpy(zero_copy_only=False)
    if not here.any():
        return
    ids, labels, lists = (c.filter(pa.array(here)) for c in (ids, labels, lists))
    ids, labels = ids.to_numpy(), labels.to_numpy()
    length = lists.value_lengths().to_numpy()
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        with np.errstate(over="ignore"):
            m = np.floor(scale * flat[V.ranges(start[rows], length[rows])].reshape(len(rows), d))
        good = np.isfinite(m).all(axis=1)
        if good.any():
            yield ids[rows[good]], labels[rows[good]], m[good]


class Block:
    """Anchors of one vector length: ids, labels, matrix, and each one's positives (0 to k of them)."""

    def __init__(self, ids, labels, m, n, pos_ids, pos_scores):
        self.ids, self.labels, self.m = ids, labels, m
        self.n, self.pos_ids, self.pos_scores = n, pos_ids, pos_scores

    def to_bytes(self) -> bytes:
        head = np.array([*self.m.shape, self.pos_ids.shape[1]], dtype="<i8")
        parts = [head, self.ids, self.labels, self.n, self.pos_ids, self.pos_scores]
        return b"".join(p.astype("<i8").tobytes() for p in parts) + self.m.astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, body: bytes) -> Block:
        rows, d, k = np.frombuffer(body, "<i8", 3).tolist()
        flat = np.frombuffer(body, "<i8", 3 * rows + 2 * rows * k, 24)
        ids, labels, n = flat[:rows], flat[rows:2 * rows], flat[2 * rows:3 * rows]
        pos = flat[3 * rows:].reshape(2, rows, k)
        m = np.frombuffer(body, "<f8", offset=24 + flat.nbytes).reshape(rows, d)
        return cls(ids, labels, m, n, pos[0], pos[1])


def _pack(folder: str, scale: float, k: int):
    """Anchor rows (id, label, vector, positives) -> block files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        listed: list[tuple[str, int]] = []

        def put(d: int) -> None:
            ids, labels, m, pos = (np.concatenate(x) for x in zip(*held.pop(d)))
            for lo in range(0, len(ids), ANCHOR_BLOCK):
                s = slice(lo, lo + ANCHOR_BLOCK)
                block = Block(ids[s], labels[s], m[s], pos[s, 0], pos[s, 1:k + 1], pos[s, k + 1:])
                uri = storage.task_file(folder, "anchors", ".bin")
                storage.write_bytes(uri, block.to_bytes())
                listed.append((uri, d))

        for batch in batches:
            known = {r["id"]: r["positives"] or [] for r in batch.select(["id", "positives"]).to_pylist()}
            for ids, labels, m in usable(batch, scale):
                pos = np.zeros((len(ids), 2 * k + 1), dtype=np.int64)
                for row, found in zip(pos, map(known.__getitem__, ids.tolist())):
                    row[0] = len(found)
                    row[1:len(found) + 1] = [p["vec_id"] for p in found]
                    row[k + 1:k + 1 + len(found)] = [p["score"] for p in found]
                held.setdefault(m.shape[1], []).append((ids, labels, m, pos))
                if sum(len(x[0]) for x in held[m.shape[1]]) >= ANCHOR_BLOCK:
                    put(m.shape[1])
        for d in list(held):
            put(d)
        c = list(zip(*listed)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64())], ["uri", "dim"])
    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores n with low * score <= 100 * n <= high * score (low, high in percent)."""
    return max(LEAST, -(-low * score // 100)), min(MOST, high * score // 100)


def positives_of(block: Block, tiles: Iterator[tuple], k: int) -> Iterator[tuple]:
    """(slot, anchor row, scores, ids, taken): the best rows of the anchors' own labels."""
    best = None
    for ids, labels, scores in tiles:
        allowed = (labels[None, :] == block.labels[:, None]) & (ids[None, :] != block.ids[:, None])
        found = pick(scores, allowed, ids, min(k, len(ids)))
        best = found if best is None else merge(best, found, k)
    if best is not None:
        yield 0, *best


def negatives_of(block: Block, tiles: Iterator[tuple], k: int, low: int, high: int) -> Iterator[tuple]:
    """The same for the best rows of other labels inside each positive's window."""
    slots = range(int(block.n.max(initial=0)))
    bounds = [np.array([window(s, low, high) if j < n else (1, 0) for s, n in
                        zip(block.pos_scores[:, j].tolist(), block.n.tolist())]) for j in slots]
    best: dict[int, tuple] = {}
    for ids, labels, scores in tiles:
        other = (labels[None, :] != block.labels[:, None]) & (ids[None, :] != block.ids[:, None])
        for j in slots:
            allowed = other & (scores >= bounds[j][:, :1]) & (scores <= bounds[j][:, 1:])
            found = pick(scores, allowed, ids, min(k, len(ids)))
            best[j] = merge(best[j], found, k) if j in best else found
    for j, found in best.items():
        yield j, *found


FOUND = "part int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def _search(listed: list[tuple[str, int]], scale: float, select):
    """Chunks of vectors against all anchor blocks; ``select(block, tiles)`` keeps what counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def search(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            chunk = {}
            for d, parts in held.items():
                ids, labels, m = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(ids, kind="stable")
                chunk[d] = ids[order], labels[order], m[order]
            for uri, d in listed:
                if d not in chunk:
                    continue
                block = Block.from_bytes(storage.read_bytes(uri))
                ids, labels, m = chunk[d]
                tiles = ((ids[lo:lo + TILE], labels[lo:lo + TILE], products(block.m, m[lo:lo + TILE]))
                         for lo in range(0, len(ids), TILE))
                for j, scores, found, taken in select(block, tiles):
                    row = np.nonzero(taken)[0]
                    pos = (block.pos_ids[row, j], block.pos_scores[row, j]) if block.pos_ids.shape[1] else (
                        np.zeros(len(row), np.int64),) * 2
                    cols = [*(np.full(len(row), x, np.int32) for x in (part, j)), block.ids[row], *pos, found[taken], scores[taken]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                                     [f.split()[0] for f in FOUND.split(", ")])

        held: dict[int, list] = {}
        rows = 0
        for batch in batches:
            for ids, labels, m in usable(batch, scale):
                held.setdefault(m.shape[1], []).append((ids, labels, m))
                rows += len(ids)
            if rows >= CHUNK:
                yield from search(held)
                held, rows = {}, 0
        yield from search(held)
    return run


def _best(found: DataFrame, keys: list[str], k: int, partitions: int) -> DataFrame:
    """``keys``, top: the k best (score down, vec_id up) of each key, merged in a tree."""
    hit = F.struct(F.bitwise_not("score").alias("worse"), "vec_id")
    part = F.expr(f"part div {FAN}").alias("part")
    top = found.groupBy(*keys, part).agg(F.slice(F.sort_array(F.collect_list(hit)), 1, k).alias("top"))
    parts = max(1, partitions // FAN + 1)
    while True:
        parts = -(-parts // FAN)
        top = top.groupBy(*keys, part).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if parts <= 1:
            return top.drop("part")


def hard_negatives(corpus: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10,
                   low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label",
                   vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A positive's negatives score from ``low`` to ``high`` percent of its own score.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                         F.col(vec_col).alias("vec"), is_anchor.alias("is_anchor"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    anchors = written(rows.where("is_anchor AND id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
                      .where(finite).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("a"))
                      .select("id", "a.label", "a.vec"), "anchors")
    rows = rows.select("id", "label", "vec")
    parts = rows.rdd.getNumPartitions()
    folder = storage.base_folder(spark, "anchor-blocks")
    hits = "array<struct<worse: bigint, vec_id: bigint>>"

    def search(packed: DataFrame, k: int, select) -> DataFrame:
        listing = work_path(spark, "anchor-listing")
        packed.mapInArrow(_pack(folder, scale, k), "uri string, dim bigint").write.parquet(listing)
        # One row per block of anchors: a file listing.
        listed = [(r.uri, r.dim) for r in spark.read.parquet(listing).orderBy("uri").toLocalIterator()]
        return rows.mapInArrow(_search(listed, scale, select), FOUND)

    first = search(anchors.withColumn("positives", F.expr(f"CAST(NULL AS {hits})")), 0,
                   lambda block, tiles: positives_of(block, tiles, n_positives))
    positives = _best(first, ["anchor_id"], n_positives, parts)
    known = anchors.join(positives.select(F.col("anchor_id").alias("id"), F.transform("top", lambda t: F.struct(
        t.vec_id.alias("vec_id"), F.bitwise_not(t.worse).alias("score"))).alias("positives")), "id")
    second = search(known, n_positives, lambda block, tiles: negatives_of(block, tiles, n_negatives, low, high))
    top = _best(second, ["anchor_id", "slot", "positive_id", "positive_score"], n_negatives, parts)
    return (top.select("anchor_id", "positive_id", "positive_score", F.posexplode("top").alias("pos", "hit"))
            .select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("hit.vec_id").alias("negative_id"), "positive_score",
                    F.bitwise_not(F.col("hit.worse")).alias("negative_score")))
