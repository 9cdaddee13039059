"""Operator 1: benchmark decontamination by greedy string tiling.

Texts become lower-case word tokens: runs of letters, marks and digits of Unicode, and each
character of a script without blanks (Chinese, Japanese, Thai, ...). Documents
are joined with benchmark items on shared seeds of MIN_MATCH tokens. Each joined
pair is tiled: Karp-Rabin hashes of all unmarked windows find matches, the longest
ones are marked first and never overlap, and the window length is halved until
MIN_MATCH. An item counts as leaked where its tiles cover at least COVERAGE of its
tokens, in whatever order its parts stand in the document.

The benchmark is dealt into blocks of about BLOCK_ITEM_BYTES, files of the shared folder
that tasks write and read; the driver sees their names. A task holds some documents and
reads the blocks one after another, so documents are scanned once and never shuffled,
whatever the benchmark's size. Shared seeds are looked up for about HELD_HITS hits at a
time, of some documents or of some items of one document, also where all items share one.

Defined results: null and empty texts and items have no tokens and are in no
result; items shorter than MIN_MATCH are found as a whole; repeated documents and
items each have their own rows; rows without id keep a null id; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm.graph import fresh
from sqlgauge.session import work_path

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_ITEM_BYTES = 16 << 20
CHUNK_BYTES = 64 << 20  # texts of documents that a task holds while it reads the blocks
HELD_HITS = 1 << 20
FILTER_BITS = 22

_U = np.uint64
_PLACE = V.place_keys(64)


def tokens(column: pa.Array, limit: int = V.BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, tokens before each row) of blocks of texts."""
    raw, off = V.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for lo, hi in V.blocks(off, limit):
        data, o = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        start, end, before = V.unicode_words(data, o)
        yield lo, hi, V.byte_hash(data, start, end), before


def grams(token: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens from each position (rows are not looked at)."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n, dtype=_U)
    for k in range(size):
        total += token[k:k + n] * _PLACE[k]
    return V.mix(total)


class RollingHash:
    """Karp-Rabin hashes of windows of any length over one token array."""

    def __init__(self, token: np.ndarray):
        self.up = V.power("up", len(token) + 1)
        self.down = V.power("down", len(token) + 1)
        self.sums = np.zeros(len(token) + 1, dtype=_U)
        np.cumsum(V.mix(token) * self.up[:len(token)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return V.mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    held = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(held[size:] == held[:len(held) - size])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (item position, document position, length), longest first.

    Ties go to the smaller item position, then to the smaller document position.
    """
    least = min(least, len(item))
    if least == 0 or len(doc) < least:
        return []
    in_item, in_doc = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    roll_item, roll_doc = RollingHash(item), RollingHash(doc)
    size = least
    while size * 2 <= min(len(item), len(doc)):
        size *= 2
    tiles: list[tuple[int, int, int]] = []
    while True:
        found = [(-length, i, d) for length, i, d in
                 _matches(item, doc, in_item, in_doc, roll_item, roll_doc, size)]
        marked, several = False, len(found) > 1
        # Longest first; what an earlier tile of this pass has cut is searched again.
        while found:
            length, i, d = heappop(found)  # a sorted list is a heap
            length = -length
            if not in_item[i:i + length].any() and not in_doc[d:d + length].any():
                same = item[i:i + length] == doc[d:d + length]
                if not same.all():  # windows that only share a hash: what matches of them
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        if b - a >= size:
                            heappush(found, (a - b, i + a, d + a))
                    continue
                in_item[i:i + length] = True
                in_doc[d:d + length] = True
                tiles.append((i, d, length))
                marked = True
                if several and length > size:
                    break
        if not marked:
            if size == least:
                return tiles
            size = max(least, size // 2)


def _matches(item, doc, in_item, in_doc, roll_item, roll_doc, size) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``size`` unmarked tokens as (length, item, doc), longest first."""
    free_i, free_d = _free_windows(in_item, size), _free_windows(in_doc, size)
    if len(free_i) == 0 or len(free_d) == 0:
        return []
    hash_i, hash_d = roll_item.windows(size)[free_i], roll_doc.windows(size)[free_d]
    order = np.argsort(hash_i, kind="stable")
    lo = np.searchsorted(hash_i[order], hash_d, side="left")
    n = np.searchsorted(hash_i[order], hash_d, side="right") - lo
    at_d = np.repeat(free_d, n)
    at_i = free_i[order[V.ranges(lo, n)]]
    if len(at_i) == 0:
        return []
    # Runs along a diagonal are one match, of its windows' number plus size - 1.
    order = np.lexsort((at_i, at_d - at_i))
    at_i, at_d = at_i[order], at_d[order]
    new = np.ones(len(at_i), dtype=bool)
    new[1:] = (np.diff(at_i) != 1) | (np.diff(at_d) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at_i))) + size - 1
    order = np.lexsort((at_d[first], at_i[first], -length))
    return [(int(length[k]), int(at_i[first[k]]), int(at_d[first[k]])) for k in order]


class ItemBlock:
    """Token hashes and seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list, least: int):
        self.ids, self.least = ids, least
        self.items = [token[a:b] for _, _, token, before in tokens(pa.array(texts, pa.string()))
                      for a, b in zip(before[:-1], before[1:])]
        self.sizes = sorted({min(least, len(x)) for x in self.items if len(x)})
        self.seeds, self.ordered = {}, {}
        for size in self.sizes:
            rows = [(grams(x, size), k) for k, x in enumerate(self.items)
                    if len(x) and min(least, len(x)) == size]
            keys = np.concatenate([g for g, _ in rows])
            item = np.concatenate([np.full(len(g), k) for g, k in rows])
            place = np.concatenate([np.arange(len(g)) for g, _ in rows])
            order = np.argsort(keys, kind="stable")
            present = np.zeros(1 << FILTER_BITS, dtype=bool)
            present[(keys & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.seeds[size] = keys[order], item[order], place[order], present
            rank = np.cumsum(np.concatenate([[0], np.diff(keys[order]) != 0]))
            self.ordered[size] = rank * len(self.items) + item[order]

    def hits(self, token: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
        """(row, item, document positions, item positions, seed size) of joined pairs."""
        for size in self.sizes:
            keys, item, place, present = self.seeds[size]
            g = grams(token, size)
            at = np.flatnonzero(present[(g & _U((1 << FILTER_BITS) - 1)).astype(np.int64)])
            if len(at) == 0:
                continue
            row = np.searchsorted(before, at, side="right") - 1
            inside = at + size <= before[row + 1]
            at, row = at[inside], row[inside]
            lo = np.searchsorted(keys, g[at], side="left")
            n = np.searchsorted(keys, g[at], side="right") - lo
            at, row, lo, n = at[n > 0], row[n > 0], lo[n > 0], n[n > 0]
            total, begin = np.cumsum(n), 0
            while begin < len(at):  # whole documents, of a bounded number of hits
                end = int(np.searchsorted(total, total[begin] - n[begin] + HELD_HITS, side="right"))
                first = int(np.searchsorted(row, row[min(end, len(row) - 1)], side="left"))
                if end < len(at):
                    end = first if first > begin else int(np.searchsorted(row, row[begin], side="right"))
                s = slice(begin, end)
                count = int(total[end - 1] - total[begin] + n[begin])
                for lo_, n_ in self._item_ranges(size, lo[s], n[s], -(-count // HELD_HITS)):
                    yield from _pairs(row[s], at[s], item, place, lo_, n_, size)
                begin = end

    def _item_ranges(self, size: int, lo: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple]:
        """The hits (start, number) of each position, for one range of items after another."""
        if parts == 1:
            yield lo, n
            return
        ordered = self.ordered[size]  # seeds in order of (key, item)
        base = ordered[lo] - ordered[lo] % len(self.items)
        for a, b in zip(bounds := [len(self.items) * k // parts for k in range(parts + 1)], bounds[1:]):
            first = np.searchsorted(ordered, base + a)
            yield first, np.searchsorted(ordered, base + b) - first


def _pairs(row, at, item, place, lo, n, size) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """The hits of each (row, item)."""
    pick = V.ranges(lo, n)
    if len(pick) == 0:
        return
    r, d, i, p = np.repeat(row, n), np.repeat(at, n), item[pick], place[pick]
    order = np.lexsort((i, r))
    r, d, i, p = r[order], d[order], i[order], p[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(i) != 0)])).tolist()
    for a, b in zip(cut, [*cut[1:], len(r)]):
        yield int(r[a]), int(i[a]), d[a:b], p[a:b], size


RESULT = ("doc_id bigint, item_id bigint, item_tokens bigint, covered_tokens bigint, coverage double, "
          "tiles array<struct<item_at: bigint, doc_at: bigint, n_tokens: bigint>>")
_TILE = pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("n_tokens", pa.int64())])


def scan(block: ItemBlock, doc_ids: pa.Array, texts: pa.Array, coverage: float) -> Iterator[tuple]:
    """Leaks of one block of items in a batch of documents."""
    ids = doc_ids.to_pylist()
    for lo, _, token, before in tokens(texts):
        for row, k, d, p, size in block.hits(token, before):
            item = block.items[k]
            # Seeds bound what tiles can cover: every tile consists of seeds.
            reach = np.zeros(len(item) + 1, dtype=np.int64)
            seeds = np.unique(p)
            reach[seeds] += 1
            np.subtract.at(reach, seeds + size, 1)
            if np.count_nonzero(np.cumsum(reach[:-1])) < coverage * len(item):
                continue
            first, last = int(d.min()), int(d.max()) + size
            tiles = greedy_tiles(item, token[first:last], block.least)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(item):
                shift = first - int(before[row])
                yield (ids[lo + row], block.ids[k], len(item), covered, covered / len(item),
                       [(i, at + shift, n) for i, at, n in sorted(tiles)])


def _write_items(folder: str):
    """Each partition of items becomes a block file; its name is listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        uris = []
        if held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            uris.append(storage.task_file(folder, "items", ".arrow"))
            storage.write_bytes(uris[0], sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string())], ["uri"])
    return run


def item_files(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[str]:
    """The block files of a benchmark's items, of about ``limit`` bytes each."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    listing = work_path(spark, "item-listing")
    dealt = rows.repartitionById(max(1, -(-size // limit)), F.pmod(F.xxhash64("i", "t"), F.lit(
        max(1, -(-size // limit)))).cast("int"))
    dealt.mapInArrow(_write_items(storage.base_folder(spark, "items")), "uri string").write.parquet(listing)
    # One name per block.
    return [r.uri for r in spark.read.parquet(listing).orderBy("uri").toLocalIterator()]


def _read_items(uri: str, least: int) -> ItemBlock:
    table = pa.ipc.open_stream(storage.read_bytes(uri)).read_all()
    return ItemBlock(table["i"].to_pylist(), table["t"].to_pylist(), least)


def _find(uris: list[str], least: int, coverage: float):
    """Leaks of all blocks in a task's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: ItemBlock | None = None  # a benchmark of one block is read once

        def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kept
            for uri in uris:
                block = kept or _read_items(uri, least)
                kept = block if len(uris) == 1 else None
                for batch in held:
                    found = list(scan(block, batch.column(0), batch.column(1), coverage))
                    if found:
                        c = list(zip(*found))
                        tiles = pa.array([[dict(zip(("item_at", "doc_at", "n_tokens"), t)) for t in x]
                                          for x in c[5]], pa.list_(_TILE))
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.float64()), tiles],
                            ["doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "tiles"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES or len(uris) == 1:
                yield from search(held)
                held, size = [], 0
        yield from search(held)
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", block_bytes: int = BLOCK_ITEM_BYTES) -> DataFrame:
    """One row per document and benchmark item that it leaks, with the tiles."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    uris = item_files(benchmark, item_col, item_text_col, block_bytes)
    return rows.mapInArrow(_find(uris, least, coverage), RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that leak any item (rows without id stay)."""
    name = fresh(docs, "_leaked")
    leaked = find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(name))
    return docs.join(leaked.distinct(), F.col(id_col).cast("bigint") == F.col(name), "left_anti")
