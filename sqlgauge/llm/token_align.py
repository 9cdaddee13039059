"""Operator 12: alignment of two tokenizers' tokens, by fragments that compose.

A text (with a space before it) is cut into groups wherever a token of A and a token of B
end at the same byte. Within a byte range, what is known of that is a *fragment*: an open
head (tokens up to the first common end), closed groups, and an open tail (tokens after
the last common end); without a common end all tokens are head. Fragments compose: the
tail of the left and the head of the right make one group. The operation is associative,
so fragments of neighbouring ranges are joined in any grouping.

Both libraries encode; texts are cut where no token of either can cross, and each
distinct span is encoded once and reused. Texts of at most LONG_BYTES are aligned many
at a time. A longer one is cut into pieces at
places where both tokenizers surely have a boundary (before a space between two words);
the pieces are dealt to all tasks, each becomes fragments of RANGE_BYTES, and these are
composed inside the task and then across tasks in a tree of FAN neighbours a level.

A and B tokens whose byte ranges overlap are linked. The links of each document are kept
as (pair, count); their corpus-wide sums are added up inside each task before the shuffle.
The summed table, which grows with the vocabularies and not with the corpus, is read by
each task if it has at most TABLE_PAIRS rows, else joined.

Defined results: null and empty texts, and texts whose joined tokens of A or of B differ
from the spaced text (those that hold U+2581), have no tokens: zeros and an empty digest;
strings of added tokens are plain text; repeated rows and null ids keep their own rows, and
each counts in the sums; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import piece_bpe as PB
from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm.byte_split import ByteSplitter, byte_alphabet
from sqlgauge.llm.graph import Scratch, written
from sqlgauge.session import child_names, work_path

LONG_BYTES = 1 << 16     # longer texts are cut into pieces of about this size
RANGE_BYTES = 1 << 13    # byte range of a fragment
FAN = 16
TABLE_PAIRS = 4_000_000  # pairs of the summed table that a task reads whole (64 MB)
HELD_PAIRS = 1_000_000   # distinct pairs that a task gathers before it hands them on
BANK_SPANS = 300_000     # spans of each tokenizer that a worker keeps

Open = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids and end offsets of A, of B

_aligners: dict[tuple[str, str], "Aligner"] = {}


def none_open() -> Open:
    return (np.zeros(0, np.int64),) * 4


def both(x: Open, y: Open) -> Open:
    return tuple(np.concatenate(p) for p in zip(x, y))


def part(x: Open, low: int, high: int) -> Open:
    """The tokens that end in (low, high]."""
    out = []
    for ids, ends in (x[:2], x[2:]):
        lo, hi = np.searchsorted(ends, [low, high], side="right")
        out += [ids[lo:hi], ends[lo:hi]]
    return tuple(out)


def add_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


@dataclass
class Closed:
    """Closed groups: their text (each ends with ';'), token and group numbers, linked pairs."""

    text: str = ""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    keys: np.ndarray = None
    counts: np.ndarray = None

    def __post_init__(self):
        if self.keys is None:
            self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def join(parts: list[Closed]) -> Closed:
        return Closed("".join(p.text for p in parts), *(sum(getattr(p, f) for p in parts)
                                                        for f in ("n_a", "n_b", "n_groups")),
                      *add_counts(np.concatenate([p.keys for p in parts]), np.concatenate([p.counts for p in parts])))


@dataclass
class Fragment:
    """What is known of a byte range; ``cut``: some common end lies in it."""

    head: Open
    cut: bool = False
    body: Closed = None
    tail: Open = None
    valid: bool = True

    def __post_init__(self):
        self.body = Closed() if self.body is None else self.body
        self.tail = none_open() if self.tail is None else self.tail


class Groups:
    """Groups and links of tokens whose first start and last end are common ends."""

    def __init__(self, tokens: Open):
        self.a, a_end, self.b, b_end = tokens
        self.common = np.intersect1d(a_end, b_end, assume_unique=True)
        self.of_a, self.of_b = np.searchsorted(self.common, a_end), np.searchsorted(self.common, b_end)
        # The starts of the first tokens are equal and lie before all ends.
        start_a, start_b = (np.concatenate([[-1], e[:-1]]) for e in (a_end, b_end))
        lo = np.searchsorted(b_end, start_a, side="right")
        n = np.searchsorted(start_b, a_end, side="left") - lo
        self.link_a, self.link_b = np.repeat(np.arange(len(self.a)), n), V.ranges(lo, n)

    def codes(self, size: int) -> np.ndarray:
        """Tokens in the order of the groups' text: id, plus 0, 1 or 2 times ``size`` for what follows it."""
        more_a, more_b = (np.append(g[1:] == g[:-1], False) for g in (self.of_a, self.of_b))
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        at_a = np.arange(len(self.a)) + np.searchsorted(self.of_b, self.of_a, side="left")
        at_b = np.arange(len(self.b)) + np.searchsorted(self.of_a, self.of_b, side="right")
        out[at_a] = self.a + np.where(more_a, 0, size)
        out[at_b] = self.b + np.where(more_b, 0, 2 * size)
        return out


class Aligner:
    """Tokens of both tokenizers, their groups and links."""

    def __init__(self, path_a: str, path_b: str):
        self.splitter = ByteSplitter(path_a)
        self.library = self.splitter.library
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.bank = V.SpanBank(self._spans, limit=BANK_SPANS)
        self.coder = PB.coder(path_b)
        self.bank_b = V.SpanBank(self._spans_b, limit=BANK_SPANS)
        if not (self.coder.prefix and self.coder.breaks_at_space):
            raise ValueError(f"{path_b}: needs a model that puts a space before texts and never merges across one")
        letters = byte_alphabet()
        surface_a = [b""] * self.library.get_vocab_size()
        for piece, k in self.library.get_vocab().items():
            plain = piece.encode() in self.splitter.added
            surface_a[k] = piece.encode() if plain else bytes(letters[c] for c in piece)
        self.surfaces = [self._flat(surface_a), self._flat(self.coder.surface)]
        self.size = max(len(surface_a), len(self.coder.surface))
        self.n_b = len(self.coder.surface)
        self.shown = [str(k) + end for end in ",|;" for k in range(self.size)]

    @staticmethod
    def _flat(surface: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in surface])
        return np.frombuffer(b"".join(surface), dtype=np.uint8), np.cumsum(size) - size, size

    def _spans(self, spans: list[bytes]) -> list[list[int]]:
        got = self.library.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)
        return [e.ids for e in got]

    def _spans_b(self, spans: list[bytes]) -> list[list[int]]:
        """The library's ids of spans, each after a character that merges with none of them."""
        c = self.coder
        return [ids[c.skip:] for ids in c.library.encode([c.context + s.decode() for s in spans], num_threads=1)]

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[Open, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all rows, A tokens before each row, B tokens before each row, rows whose
        joined tokens are their bytes). Rows hold their leading space and no U+2581."""
        starts, ends, before, _, _ = self.splitter.cut(data, off, added=False)
        pre = V.prefix_hash(data)
        at, size = self.bank.lookup(data, pre, starts, ends)
        a = self.bank.values[V.ranges(at, size)].astype(np.int64)
        cut_a = np.concatenate([[0], np.cumsum(size)])[before]
        starts = self.coder.cuts(data, off)
        at, size = self.bank_b.lookup(data, pre, starts, np.append(starts[1:], len(data)))
        b = self.bank_b.values[V.ranges(at, size)].astype(np.int64)
        cut_b = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, off)]
        valid = np.ones(len(off) - 1, dtype=bool)
        out = []
        for ids, cut, (flat, first, length) in zip((a, b), (cut_a, cut_b), self.surfaces):
            n = length[ids]
            end = np.cumsum(n)
            reach = np.concatenate([[0], end])[cut]
            valid &= np.diff(reach) == np.diff(off)
            if (reach == off).all():
                wrong = np.flatnonzero(flat[V.ranges(first[ids], n)] != data)
                valid[np.searchsorted(off, wrong, side="right") - 1] = False
            else:  # some row differs in length: each row by itself
                for r in np.flatnonzero(valid).tolist():
                    own = ids[cut[r]:cut[r + 1]]
                    valid[r] = np.array_equal(flat[V.ranges(first[own], length[own])], data[off[r]:off[r + 1]])
            out += [ids, end]
        return tuple(out), cut_a, cut_b, valid

    def text(self, codes: np.ndarray) -> str:
        shown = self.shown
        return "".join([shown[c] for c in codes.tolist()])

    def close(self, tokens: Open) -> Closed:
        """Whole groups."""
        if len(tokens[0]) == 0:
            return Closed()
        g = Groups(tokens)
        keys = g.a[g.link_a] * self.n_b + g.b[g.link_b]
        return Closed(self.text(g.codes(self.size)), len(g.a), len(g.b), len(g.common),
                      *add_counts(keys, np.ones(len(keys), dtype=np.int64)))

    def fragment(self, tokens: Open) -> Fragment:
        common = np.intersect1d(tokens[1], tokens[3], assume_unique=True)
        if len(common) == 0:
            return Fragment(tokens)
        first, last = int(common[0]), int(common[-1])
        return Fragment(part(tokens, -1, first), True, self.close(part(tokens, first, last)),
                        part(tokens, last, np.iinfo(np.int64).max))

    def compose(self, f: Fragment, g: Fragment) -> Fragment:
        valid = f.valid and g.valid
        if not f.cut:
            return Fragment(both(f.head, g.head), g.cut, g.body, g.tail, valid)
        if not g.cut:
            return Fragment(f.head, True, f.body, both(f.tail, g.head), valid)
        middle = self.close(both(f.tail, g.head))
        return Fragment(f.head, True, Closed.join([f.body, middle, g.body]), g.tail, valid)

    def compose_all(self, fragments: list[Fragment]) -> Fragment:
        while len(fragments) > 1:
            pairs = zip(fragments[::2], fragments[1::2])
            rest = fragments[-1:] if len(fragments) % 2 else []
            fragments = [self.compose(f, g) for f, g in pairs] + rest
        return fragments[0] if fragments else Fragment(none_open())

    def whole(self, f: Fragment) -> Closed:
        """A fragment of a whole text: its head is a group, nothing is left open."""
        if not f.valid:
            return Closed()
        if len(f.tail[0]) or len(f.tail[2]):
            raise ValueError("tokens after the last common end of a text")
        return Closed.join([self.close(f.head), f.body])

    def ranges(self, tokens: Open, start: int, end: int) -> list[Fragment]:
        """Fragments of byte ranges; ``tokens`` end in (start, end]."""
        bounds = [start, *range(start - start % RANGE_BYTES + RANGE_BYTES, end, RANGE_BYTES), end]
        return [self.fragment(part(tokens, lo, hi)) for lo, hi in zip(bounds, bounds[1:])]

    def cuts(self, data: bytes) -> list[int]:
        """Where a long text (with its space) is cut: before a space that stands between two words."""
        out, at = [0], LONG_BYTES
        beside = self.coder.beside
        while (at := data.find(b" ", at)) >= 0:
            if (at + 1 < len(data) and data[at - 1:at].isalnum() and data[at + 1:at + 2].isalpha()
                    and not beside[data[at - 1], 0x20]):
                out.append(at)
                at += LONG_BYTES
            else:
                at += 1
        return [*out, len(data)]


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


ALIGNED = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, links binary")
_ALIGNED = [f.split()[0] for f in ALIGNED.split(", ")]


def sha(text: str) -> str:
    return hashlib.sha256(text[:-1].encode()).hexdigest() if text else ""


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _ALIGNED)


def row_of(row: int, doc_id: int | None, c: Closed, show) -> tuple:
    return row, doc_id, c.n_a, c.n_b, c.n_groups, int(c.counts.sum()), show(c.text), packed(c.keys, c.counts)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs and their counts, compressed."""
    import zstandard
    body = np.concatenate([np.diff(keys, prepend=0), counts]).astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, where each row's start and end) of a column of packed links."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    keys, counts, cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
    for body in column.to_pylist():
        flat = np.frombuffer(unpack(body), dtype="<i8")
        n = len(flat) // 2
        keys.append(np.cumsum(flat[:n]))
        counts.append(flat[n:])
        cut.append(cut[-1] + n)
    return np.concatenate(keys), np.concatenate(counts), np.array(cut)


def _align_short(path_a: str, path_b: str, show):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = V.text_bytes(batch.column(1))
            for lo, hi in V.blocks(off):
                found = [Closed()] * (hi - lo)
                texts = [raw[a:b].tobytes() for a, b in zip(off[lo:hi], off[lo + 1:hi + 1])]
                full = [k for k, t in enumerate(texts) if t and PB.MARK.encode() not in t]
                for k, c in zip(full, align_block(al, [b" " + texts[k] for k in full])):
                    found[k] = c
                yield _batch([row_of(row + k, ids[lo + k], c, show) for k, c in enumerate(found)])
                row += hi - lo
    return run


def align_block(al: Aligner, texts: list[bytes]) -> list[Closed]:
    """Whole texts (spaced, non-empty) at once."""
    if not texts:
        return []
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens, cut_a, cut_b, valid = al.tokens(data, off)
    if not valid.all():
        good = iter(align_block(al, [t for t, v in zip(texts, valid) if v]))
        return [next(good) if v else Closed() for v in valid]
    g = Groups(tokens)
    codes = g.codes(al.size)
    groups = np.searchsorted(g.common, off, side="right")
    cut = np.searchsorted(g.link_a, cut_a)
    keys = g.a[g.link_a] * al.n_b + g.b[g.link_b]
    out = []
    for r in range(len(texts)):
        k = np.sort(keys[cut[r]:cut[r + 1]])
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out.append(Closed(al.text(codes[cut_a[r] + cut_b[r]:cut_a[r + 1] + cut_b[r + 1]]),
                          int(cut_a[r + 1] - cut_a[r]), int(cut_b[r + 1] - cut_b[r]),
                          int(groups[r + 1] - groups[r]), k[first], np.diff(np.append(first, len(k)))))
    return out


PIECES = "row bigint, doc_id bigint, no bigint, start bigint, text string"
FRAGMENTS = "row bigint, doc_id bigint, no bigint, fragment binary"


def _pieces(path_a: str, path_b: str):
    """Long texts, with their space, in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row += 1
                data = b" " + text.as_py().encode()
                cuts = al.cuts(data)
                n = len(cuts) - 1
                cols = [[-row] * n, [doc_id] * n, list(range(n)), cuts[:-1],
                        [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]]
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["row", "doc_id", "no", "start", "text"])
    return run


def _fragment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()]
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      ["row", "doc_id", "no", "fragment"])


def _piece_fragments(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc_id, no, start = (batch.column(c)[k].as_py() for c in range(4))
                data = np.frombuffer(batch.column(4)[k].as_py().encode(), dtype=np.uint8)
                (a, a_end, b, b_end), _, _, valid = al.tokens(data, np.array([0, len(data)]))
                if valid[0]:
                    tokens = a, a_end + start, b, b_end + start
                    f = al.compose_all(al.ranges(tokens, start, start + len(data)))
                else:
                    f = Fragment(none_open(), valid=False)
                yield _fragment_batch([(row, doc_id, no, pickle.dumps(f))])
    return run


def _compose(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for batch in batches:
            for k in range(batch.num_rows):
                row, doc_id, no = (batch.column(c)[k].as_py() for c in range(3))
                parts = sorted((p["no"], p["fragment"]) for p in batch.column(3)[k].as_py())
                f = al.compose_all([pickle.loads(p) for _, p in parts])
                yield _fragment_batch([(row, doc_id, no, pickle.dumps(f))])
    return run


def _finish(path_a: str, path_b: str, show):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for batch in batches:
            for row, doc_id, f in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                yield _batch([row_of(row, doc_id, al.whole(pickle.loads(f)), show)])
    return run


def _align_long(long: DataFrame, path_a: str, path_b: str, show, scratch: Scratch) -> DataFrame:
    pieces = scratch.written(long.mapInArrow(_pieces(path_a, path_b), PIECES), "pieces")
    last = pieces.agg(F.max("no")).first()[0] or 0
    parts = scratch.written(pieces.repartition("row", "no").mapInArrow(_piece_fragments(path_a, path_b), FRAGMENTS),
                            "fragments")
    while last > 0:
        last //= FAN
        parts = (parts.groupBy("row", "doc_id", F.expr(f"no div {FAN}").alias("at"))
                 .agg(F.collect_list(F.struct("no", "fragment")).alias("parts"))
                 .mapInArrow(_compose(path_a, path_b), FRAGMENTS))
    return parts.mapInArrow(_finish(path_a, path_b, show), ALIGNED)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``, written: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and
    ``links``, the distinct linked pairs with their counts (``unpacked``); ``row`` is unique.

    ``with_groups`` gives the groups' text in place of its digest.
    """
    show = (lambda text: text[:-1]) if with_groups else sha
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce((F.octet_length("text") > LONG_BYTES) & ~F.col("text").contains(PB.MARK), F.lit(False))
    out = rows.where(~is_long).mapInArrow(_align_short(path_a, path_b, show), ALIGNED)
    scratch = Scratch(docs.sparkSession)
    out = written(out.unionByName(_align_long(rows.where(is_long), path_a, path_b, show, scratch)), "aligned")
    scratch.clear()
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the links of some rows at a time."""
    def put(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more = unpacked(batch.column(0))
        keys, counts = add_counts(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))
        if len(keys) >= HELD_PAIRS:
            yield put(keys, counts)
            keys, counts = keys[:0], counts[:0]
    yield put(keys, counts)


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair, a_id, b_id, n (links that hold the pair), best (the most of its B id), written."""
    n_b = aligner(path_a, path_b).n_b
    sums = written(aligned.select("links").mapInArrow(_sums, "pair bigint, n bigint")
                   .groupBy("pair").agg(F.sum("n").alias("n"))
                   .select("pair", F.expr(f"pair div {n_b}").alias("a_id"), F.expr(f"pair % {n_b}").alias("b_id"), "n"),
                   "pair-sums")
    most = sums.groupBy("b_id").agg(F.max("n").alias("most"))
    return sums.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, " \
         "count_sum bigint, groups_sha256 string"
_SCORED = [f.split()[0] for f in SCORED.split(", ")]


def _score(uris: list[str]):
    """n_best and count_sum of each row, by the summed table's files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for uri in uris:
            with storage.open_input(uri) as f:
                tables.append(pq.read_table(f, columns=["pair", "n", "best"]))
        table = pa.concat_tables(tables) if tables else pa.table({"pair": [], "n": [], "best": []})
        pairs = table["pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, n, best = pairs[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order]
        for batch in batches:
            keys, counts, cut = unpacked(batch.column("links"))
            at = np.searchsorted(pairs, keys)
            total, good = (np.concatenate([[0], np.cumsum(x)])[cut] for x in (counts * n[at], counts * best[at]))
            extra = {"n_best": pa.array(np.diff(good)), "count_sum": pa.array(np.diff(total))}
            yield pa.RecordBatch.from_arrays([extra[c] if c in extra else batch.column(c) for c in _SCORED], _SCORED)
    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per pair of each row's links."""
    for batch in batches:
        keys, counts, cut = unpacked(batch.column(1))
        row = np.repeat(batch.column(0).to_numpy(), np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(keys), pa.array(counts)], ["row", "pair", "counts"])


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    aligned = align(docs, path_a, path_b, id_col, text_col)
    pairs = pair_counts(aligned, path_a, path_b)
    path = work_path(spark, "pair-counts")
    pairs.write.parquet(path)
    pairs = spark.read.schema(pairs.schema).parquet(path)
    if pairs.count() <= TABLE_PAIRS:
        uris = [f"{path}/{name}" for name in child_names(spark, path) if name.endswith(".parquet")]
        return aligned.mapInArrow(_score(uris), SCORED)
    linked = aligned.select("row", "links").mapInArrow(_spread, "row bigint, pair bigint, counts bigint")
    scores = (linked.join(pairs.select("pair", "n", "best"), "pair").groupBy("row")
              .agg(F.sum(F.when(F.col("best"), F.col("counts"))).alias("n_best"),
                   F.sum(F.col("counts") * F.col("n")).alias("count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return aligned.join(scores, "row", "left").select(
        *[zero(c) if c in ("n_best", "count_sum") else F.col(c) for c in _SCORED])
