"""Operator 10: near-duplicates by a multi-index Hamming join of MinHash signatures.

Every distinct shingle set gets a signature of SLOTS min-hashes, b = 16 bits
each. The signature is split into CHUNKS of WIDTH slots. If two signatures differ
in at most CHUNKS * (ERRORS + 1) - 1 slots, some chunk differs in at most ERRORS
(pigeonhole), so each chunk is indexed once per choice of ERRORS slots left out,
by the b-bit values of the others. Sets that share an index entry are candidates:
all pairs within that distance. The join's threshold is that distance, 31 of 80
slots: a pair of similarity 0.8 exactly lies farther apart about three times in
100,000, one of 0.83 once in a million.

Candidates are confirmed on the full shingle sets. Groups of copies never expand
into pairs: equal sets are one node; entries are first linked to one centre each
(a star, in a few rounds with other centres), and only entries that still hold
several components compare the rest: pair by pair where an entry has at most HOT
sets, else as matrix products of blocks of sets, from which only links come back.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text
shorter than the shingle is one shingle; null, empty and blank texts have no
shingles and link with nothing; rows that share a doc_id are one document (of any
of its texts when links are confirmed); a row without doc_id links with nothing
and has a null component; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm.graph import Scratch, by_key, fresh, merge_components, written

CHUNKS, WIDTH, ERRORS, BITS = 16, 5, 1, 16
SLOTS = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1  # the farthest at which two signatures surely share an entry
STAR_ROUNDS = 2
HOT = 32           # entries with more sets are compared in blocks, with the same result
BLOCK = 128        # sets of a block, about
BLOCK_SHINGLES = 1 << 20  # and their shingles together, about
COLUMNS = 16_384   # shared shingles of two blocks that are multiplied at a time

_U = np.uint64
_seeds = np.random.RandomState(77).randint(0, 2**31, size=(4, SLOTS)).astype(_U)
_MULTIPLY = (_seeds[0] << _U(33)) | (_seeds[1] << _U(2)) | _U(1)
_FLIP = (_seeds[2] << _U(33)) | (_seeds[3] << _U(1))
_PLACE = V.place_keys(128)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, offsets of each row)."""
    start, end, before = V.words(data, off)
    rows = len(off) - 1
    n_words = np.diff(before)
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    cut = np.concatenate([[0], np.cumsum(count)])
    if cut[-1] == 0:
        return np.zeros(0, _U), np.zeros(rows + 1, np.int64)
    word = V.byte_hash(data, start, end, lower=True)
    first = V.ranges(before[:-1], count)
    length = np.repeat(np.minimum(n_words, size), count)
    total = length.astype(_U)
    for k in range(size):
        has = k < length
        if has.all():
            total += word[first + k] * _PLACE[k]
        else:
            total[has] += word[first[has] + k] * _PLACE[k]
    total = V.mix(total)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        total[a:b].sort()
    keep = np.ones(len(total), dtype=bool)
    keep[1:] = total[1:] != total[:-1]
    keep[cut[:-1][count > 0]] = True
    return total[keep], np.concatenate([[0], np.cumsum(keep)])[cut]


def signatures(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """b-bit signatures of non-empty rows: (rows, SLOTS) of uint16."""
    starts = cut[:-1]
    out = np.empty((len(starts), SLOTS), dtype=np.uint16)
    for j in range(SLOTS):
        least = np.minimum.reduceat((sets ^ _FLIP[j]) * _MULTIPLY[j], starts)
        out[:, j] = (V.mix(least) & _U((1 << BITS) - 1)).astype(np.uint16)
    return out


def index_entries(sig: np.ndarray) -> np.ndarray:
    """One 64-bit entry per chunk and slot left out: (rows, CHUNKS * WIDTH)."""
    wide = sig.astype(_U)
    out = np.empty((len(sig), CHUNKS * WIDTH), dtype=_U)
    for c in range(CHUNKS):
        for left_out in range(WIDTH):
            packed = np.zeros(len(sig), dtype=_U)
            for s in range(WIDTH):
                if s != left_out:
                    packed = (packed << _U(BITS)) | wide[:, c * WIDTH + s]
            kind = c * WIDTH + left_out
            out[:, kind] = V.mix(packed + _PLACE[kind])
    return out


SIGNED = "struct<n_shingles: bigint, set_a: bigint, set_b: bigint, signature: binary>"


def signed_text(text: Column, size: int) -> Column:
    """struct: set size, 128-bit identity of the set, signature (null if empty)."""
    def run(column: pa.Array) -> pa.Array:
        raw, off = V.text_bytes(column)
        n = np.zeros(len(off) - 1, np.int64)
        ident = np.zeros((2, len(n)), dtype=_U)
        sig: list = [None] * len(n)
        for lo, hi in V.blocks(off):
            sets, cut = shingles(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], size)
            n[lo:hi] = np.diff(cut)
            full = np.flatnonzero(np.diff(cut))
            if len(full) == 0:
                continue
            starts = np.append(cut[:-1][full], cut[-1])
            for k, s in enumerate((sets, V.mix(sets + _PLACE[120]))):
                ident[k, lo + full] = np.add.reduceat(V.mix(s ^ _PLACE[k]), starts[:-1])
            for r, row in zip(full.tolist(), signatures(sets, starts)):
                sig[lo + r] = row.tobytes()
        cols = [pa.array(n), pa.array(ident[0].view(np.int64)), pa.array(ident[1].view(np.int64)),
                pa.array(sig, pa.binary())]
        return pa.StructArray.from_arrays(cols, ["n_shingles", "set_a", "set_b", "signature"])
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SIGNED)(text)


def shingle_sets(text: Column, size: int) -> Column:
    """array<bigint>: the distinct shingle hashes of each text."""
    def run(column: pa.Array) -> pa.Array:
        raw, off = V.text_bytes(column)
        parts, cuts, total = [], [np.zeros(1, np.int64)], 0
        for lo, hi in V.blocks(off):
            sets, cut = shingles(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], size)
            parts.append(sets.view(np.int64))
            cuts.append(total + cut[1:])
            total += len(sets)
        flat = np.concatenate([np.zeros(0, np.int64), *parts])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(flat))
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(text)


def entries(signature: Column) -> Column:
    """array<bigint>: the index entries of a signature."""
    def run(column: pa.Array) -> pa.Array:
        rows = len(column)
        sig = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(rows, SLOTS)
        flat = index_entries(sig).view(np.int64).ravel()
        width = CHUNKS * WIDTH
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)),
                                        pa.array(flat))
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(signature)


def slots_apart(x: Column, y: Column) -> Column:
    """In how many slots two signatures differ."""
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(len(c), SLOTS)
                for c in (left, right))
        return pa.array((a != b).sum(axis=1).astype(np.int32))
    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(x, y)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are within DISTANCE."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("ga"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("gb"))
    return (pairs.join(by_key(left), "a").join(by_key(right), "b")
            .where(slots_apart(F.col("ga"), F.col("gb")) <= DISTANCE).select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return (pairs.join(by_key(left), "a").join(by_key(right), "b")
            .where(100 * both.cast("bigint") >= percent * either.cast("bigint")).select("a", "b"))


def _ratio(x: str, y: str, percent: int) -> Column:
    """Whether set sizes allow the similarity at all."""
    return (100 * F.least(x, y) >= percent * F.greatest(x, y))


def _common(x: tuple, y: tuple) -> np.ndarray:
    """Sizes of the intersections of all sets of block x with all of block y."""
    shared = np.intersect1d(x[3], y[3])
    total = np.zeros((len(x[0]), len(y[0])), dtype=np.float32)

    def parts(block, lo, hi):
        token = np.searchsorted(shared, block[3])
        inside = token < len(shared)
        inside[inside] = shared[token[inside]] == block[3][inside]
        inside &= (token >= lo) & (token < hi)
        row = np.repeat(np.arange(len(block[0])), np.diff(block[2]))
        m = np.zeros((len(block[0]), hi - lo), dtype=np.float32)
        m[row[inside], token[inside] - lo] = 1
        return m

    for lo in range(0, len(shared), COLUMNS):
        hi = min(len(shared), lo + COLUMNS)
        total += parts(x, lo, hi) @ parts(y, lo, hi).T
    return total.astype(np.int64)


def spanning(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of the links (left, right) that join components not yet joined before them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for k, (p, q) in enumerate(zip(left.tolist(), right.tolist())):
        p, q = find(p), find(q)
        if p != q:
            root[p] = q
            kept.append(k)
    return kept


def block_links(x: tuple, y: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the sets of two blocks: a spanning forest of the components they join."""
    both = _common(x, y)
    either = np.diff(x[2])[:, None] + np.diff(y[2])[None, :] - both
    i, j = np.nonzero((100 * both >= percent * either) & (x[1][:, None] != y[1][None, :]))
    one = spanning(x[1][i], y[1][j])
    return x[0][i[one]], y[0][j[one]]


def _write_blocks(folder: str):
    """Each row (block, sets) becomes a file of the shared folder; its name is listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = []
            for k in range(batch.num_rows):
                block = batch.column(1)[k].values
                sets = block.field("shingles")
                off = sets.offsets.to_numpy().astype("<i8")
                parts = [np.array([len(block)], "<i8"), block.field("node").to_numpy(),
                         block.field("component").to_numpy(), off - off[0], sets.flatten().to_numpy()]
                uris.append(storage.task_file(folder, "block", ".bin"))
                storage.write_bytes(uris[-1], b"".join(p.astype("<i8").tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(uris, pa.string())], ["block", "uri"])
    return run


def _read_block(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, components, set offsets, shingles)."""
    flat = np.frombuffer(storage.read_bytes(uri), dtype="<i8")
    n = int(flat[0])
    return flat[1:n + 1], flat[n + 1:2 * n + 1], flat[2 * n + 1:3 * n + 2], flat[3 * n + 2:]


def _meet(percent: int):
    """Rows (x, y) of block files -> links between their sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, tuple] | None = None
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is None or held[0] != x:
                    held = x, _read_block(x)
                a, b = block_links(held[1], held[1] if x == y else _read_block(y), percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                                 ["a", "b"])
    return run


def _hot_links(hot: DataFrame, at: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links inside entries with many sets, compared block by block.

    A set belongs to one block, of the sets with the same smallest entry; those of
    an entry's largest component stand in blocks apart from the others. Two blocks
    meet if they share an entry and are not both of that entry's largest component,
    so a large group is compared with what is not in it, never with itself. Blocks
    are files; only their names are joined, and only links leave a comparison.
    """
    spark = at.sparkSession
    rows = at.join(hot.select("entry"), "entry").select("entry", "node", "component", "n")
    shares = rows.groupBy("entry", "component").agg(F.count(F.lit(1)).alias("k"))
    main = scratch.written(shares.groupBy("entry").agg(F.max(F.struct("k", "component")).alias("m"))
                   .select("entry", F.col("m.component").alias("main")), "main")
    rows = scratch.written(rows.join(main, "entry"), "hot")
    home = rows.groupBy("node").agg(F.min(F.struct("entry", "main")).alias("home"),
                                    F.first("component").alias("component"), F.first("n").alias("n"))
    home = scratch.written(home.select("node", "component", "n", F.col("home.entry").alias("home"),
                               (F.col("component") == F.col("home.main")).alias("is_main")), "homes")
    sizes = home.groupBy("home", "is_main").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("bigint")
    block = F.struct("home", "is_main", F.pmod(F.xxhash64("node"), blocks).alias("part"))
    dealt = scratch.written(home.join(sizes, ["home", "is_main"]).select("node", "component", block.alias("block")), "dealt")
    folder = storage.base_folder(spark, "near-blocks")
    scratch.paths.append(folder)
    files = scratch.written(dealt.join(by_key(sets), "node").groupBy("block")
                    .agg(F.collect_list(F.struct("node", "component", "shingles")).alias("sets"))
                    .mapInArrow(_write_blocks(folder), "block struct<home: bigint, is_main: boolean, part: bigint>,"
                                                       " uri string"), "block-files")
    # Of each entry and block: whether all of the block's sets here are of the entry's largest component.
    there = scratch.written(rows.join(by_key(dealt.select("node", "block")), "node").groupBy("entry", "block")
                    .agg(F.min(F.col("component") == F.col("main")).alias("of_main"))
                    .join(files, "block").select("entry", "of_main", "uri"), "block-entries")
    met = (there.where("NOT of_main").select("entry", F.col("uri").alias("p"))
           .join(there.select("entry", F.col("uri").alias("q")), "entry")
           .select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
    return met.mapInArrow(_meet(percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``kept`` marks the smallest doc_id of each component (and rows without id).
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    signed = written(base.select("doc_id", signed_text(F.col("_text"), words).alias("s"))
                     .select("doc_id", "s.*"), "signed")
    ident = ["n_shingles", "set_a", "set_b"]
    nodes = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*ident)
                    .agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature")), "nodes")

    index = nodes.select("node", F.explode(entries(F.col("signature"))).alias("entry"))
    shared = (index.groupBy("entry").agg(F.min("node").alias("lo"), F.max("node").alias("hi"),
                                         F.count(F.lit(1)).alias("size")).where("lo < hi"))
    sizes = nodes.select("node", F.col("n_shingles").alias("n"))
    members = scratch.written(index.join(by_key(shared.select("entry", "lo", "size")), "entry").join(sizes, "node")
                      .select("entry", "node", "n", "lo", "size"), "members")
    ids = members.select("node").distinct()
    sets = scratch.written(base.join(by_key(ids), F.col("doc_id") == F.col("node"), "left_semi")
                   .dropDuplicates(["doc_id"])
                   .select(F.col("doc_id").alias("node"),
                           shingle_sets(F.col("_text"), words).alias("shingles")), "sets")

    labels, tested, at = None, None, members.withColumn("component", F.col("node"))

    def test(pairs: DataFrame) -> DataFrame:
        nonlocal tested
        if tested is not None:
            pairs = pairs.join(by_key(tested), ["a", "b"], "left_anti")
        pairs = scratch.written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        return scratch.written(_confirmed(_near(pairs, nodes), sets, percent), "links")

    for round_ in range(STAR_ROUNDS):
        centres = (at.groupBy("entry").agg(
            F.min("component").alias("c_lo"), F.max("component").alias("c_hi"),
            F.min(F.struct(F.xxhash64("node", F.lit(round_)), F.col("node").alias("centre"),
                           F.col("n").alias("centre_n"), F.col("component").alias("centre_c"))).alias("m"))
            .where("c_lo < c_hi").select("entry", "m.centre", "m.centre_n", "m.centre_c"))
        found = at.join(by_key(centres), "entry").where(
            (F.col("component") != F.col("centre_c")) & _ratio("n", "centre_n", percent))
        new = test(found.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
                   .distinct())
        labels = merge_components(labels, new, scratch)
        at = (members.join(by_key(labels), "node", "left")
              .withColumn("component", F.coalesce("component", "node")))

    # What still holds several components: all pairs, in a join or in blocks.
    at = scratch.written(at, "labelled")
    mixed = scratch.written(at.groupBy("entry").agg(F.min("component").alias("c_lo"), F.max("component").alias("c_hi"),
                                            F.first("size").alias("size"))
                    .where("c_lo < c_hi").select("entry", "size"), "mixed")
    few = at.join(by_key(mixed.where(F.col("size") <= HOT).select("entry")), "entry")
    other = few.select("entry", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("component").alias("c_y"))
    pairs = (few.select("entry", F.col("node").alias("x"), "n", "component").join(other, "entry")
             .where((F.col("component") < F.col("c_y")) & _ratio("n", "n_y", percent))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    new = test(pairs)
    hot = scratch.written(_hot_links(mixed.where(F.col("size") > HOT), at, sets, percent, scratch), "links")
    labels = merge_components(labels, new.unionByName(hot))
    scratch.clear()

    named = nodes.join(by_key(labels), "node", "left").select(
        *ident, F.coalesce("component", "node").alias("component_id"))
    alone = F.coalesce("component_id", "doc_id")
    out = (signed.select("doc_id", *ident).join(named, ident, "left")
           .select("doc_id", "n_shingles",
                   F.when(F.col("doc_id").isNotNull(), alone).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of documents that another of their group stands for."""
    name = fresh(docs, "_gone")
    gone = (near_duplicates(docs, words, percent, id_col, text_col).where("NOT kept")
            .select(F.col("doc_id").alias(name)))
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col(name), "left_anti")
