"""Operator 3: SentencePiece encoding and decoding of merge-type vocabularies.

Encoding keeps an agenda (a heap) of adjacent symbol pairs whose union is a
piece, ordered by the piece's score and then by position. The best pair is
merged, the pairs it makes with its neighbours join the agenda, and entries
whose symbols have changed meanwhile are skipped. What no piece covers becomes
byte pieces.

No merge crosses two neighbouring characters that stand side by side in no piece
of the vocabulary, so texts are cut there and each distinct span is encoded once
and reused. The library checks every new span of every Arrow batch, in a context
that cannot merge with it; a difference raises.

Defined results: a null or empty text has no ids and decodes to an empty text;
extra columns are left alone (``with_pieces`` replaces columns of its two output
names); very long words cost n log n.
"""

from __future__ import annotations

import codecs
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import textvec as V

MARK = "▁"  # stands for a space inside pieces
NARROW = 384  # characters below this are cut by a table of neighbours, others at spaces
UNKNOWN_TEXT = " ⁇ "

_coders: dict[tuple[str, bool], "PieceCoder"] = {}


def _each_byte(err):
    return "�" * (err.end - err.start), err.end


codecs.register_error("sqlgauge-each-byte", _each_byte)


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        plain = (model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback
                 and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
                 and norm.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
                 and {p.type for p in model.pieces} <= {1, 2, 3, 6})
        if not plain:
            raise ValueError(f"{path}: needs a merge-type model with byte pieces and no normalization")
        self.check = check
        self.prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(len(model.pieces), dtype=bool)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[3:-1], 16)
                self.byte_ids[b] = i
                self.is_byte[i] = True
                self.surface.append(bytes([b]))
            else:
                self.surface.append({1: p.piece.replace(MARK, " "), 2: UNKNOWN_TEXT, 3: ""}[p.type].encode())
        self.starts_with_space = [p.type == 1 and p.piece.startswith(MARK) for p in model.pieces]
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == 3}
        # Which characters stand side by side in some piece (a space as itself).
        self.beside = np.zeros((NARROW, NARROW), dtype=bool)
        self.breaks_at_space = True
        for piece in self.ids:
            plain = piece.replace(MARK, " ")
            for a, b in zip(plain, plain[1:]):
                if ord(a) < NARROW and ord(b) < NARROW:
                    self.beside[ord(a), ord(b)] = True
                elif b == " ":
                    self.breaks_at_space = False
        self.context = next(c for c in "\n\r\x01" if not any(c in p for p in self.ids))
        self.skip = len(self.library.encode(self.context))
        self.bank = V.SpanBank(self._new_spans)

    def merge(self, symbols: list[str]) -> list[str]:
        """Agenda of adjacent pairs, best score first, leftmost first among equals."""
        cost = self.cost
        agenda = []
        for i in range(len(symbols) - 1):
            union = symbols[i] + symbols[i + 1]
            c = cost.get(union)
            if c is not None:
                agenda.append((c, i, i + 1, union))
        if not agenda:
            return symbols
        heapify(agenda)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, j, union = heappop(agenda)
            if not symbols[i] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(union):
                continue
            symbols[i], symbols[j] = union, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = union + symbols[k]
                c = cost.get(right)
                if c is not None:
                    heappush(agenda, (c, i, k, right))
            k = before[i]
            if k >= 0:
                left = symbols[k] + union
                c = cost.get(left)
                if c is not None:
                    heappush(agenda, (c, k, i, left))
        return [s for s in symbols if s]

    def span_ids(self, span: str) -> list[int]:
        ids = self.ids
        out = []
        for s in self.merge(list(span.replace(" ", MARK))):
            i = ids.get(s)
            if i is None:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def _new_spans(self, spans: list[bytes]) -> list[list[int]]:
        texts = [s.decode() for s in spans]
        out = [self.span_ids(t) for t in texts]
        if self.check:
            want = self.library.encode([self.context + t for t in texts], num_threads=1)
            for text, a, b in zip(texts, out, want):
                if a != b[self.skip:]:
                    raise RuntimeError(f"ids differ from the library for {text[:200]!r}: {a[:50]} {b[:50]}")
        return out

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions where spans start: rows, and neighbours no piece has."""
        cp, at = V.code_points(data)
        edge = np.zeros(len(cp) + 1, dtype=bool)
        edge[np.searchsorted(at, off)] = True
        first = edge[:-1]
        left, right = cp[:-1], cp[1:]
        narrow = (left < NARROW) & (right < NARROW)
        cut = np.zeros(len(left), dtype=bool)
        cut[narrow] = ~self.beside[left[narrow], right[narrow]]
        if self.breaks_at_space:
            cut |= ~narrow & (right == 0x20)
        first[1:] |= cut
        return at[:-1][first]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, id offsets of each text)."""
        raw, off = V.text_bytes(column)
        parts, cuts, total = [], [np.zeros(1, np.int64)], 0
        for lo, hi in V.blocks(off):
            data, o = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            body = data.tobytes()
            if MARK.encode() in body:
                texts = [body[a:b].replace(MARK.encode(), b" ") for a, b in zip(o[:-1], o[1:])]
                o = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            if self.prefix:
                full = np.diff(o) > 0
                data = np.insert(data, o[:-1][full], 0x20)
                o = o + np.concatenate([[0], np.cumsum(full)])
            if len(data) == 0:
                cuts.append(np.full(hi - lo, total, dtype=np.int64))
                continue
            starts = self.cuts(data, o)
            ends = np.append(starts[1:], len(data))
            at, size = self.bank.lookup(data, V.prefix_hash(data), starts, ends)
            ids = self.bank.values[V.ranges(at, size)]
            parts.append(ids)
            running = np.concatenate([[0], np.cumsum(size)])
            cuts.append(total + running[np.searchsorted(starts, o[1:])])
            total += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate(cuts)

    def encode(self, text: str) -> list[int]:
        ids, _ = self.encode_column(pa.array([text]))
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become one U+FFFD each."""
        surface = self.surface
        if not self.controls.isdisjoint(ids):
            return self._decode_parts(ids)
        body = b"".join([surface[i] for i in ids])
        if self.prefix:
            # The space that encoding put first; control ids before it show nothing.
            lead = next((i for i in ids if surface[i]), None)
            if lead is not None and self.starts_with_space[lead]:
                body = body[1:]
        try:
            return body.decode()
        except UnicodeDecodeError:
            return body.decode(errors="sqlgauge-each-byte")


    def _decode_parts(self, ids: list[int]) -> str:
        """Ids with control ids among them: those end a run of byte pieces."""
        parts, run = [], []
        for i in [*ids, next(iter(self.controls))]:
            if i in self.controls:
                if run:
                    text = b"".join([self.surface[x] for x in run])
                    if self.prefix and not parts and self.starts_with_space[run[0]]:
                        text = text[1:]
                    parts.append(text.decode(errors="sqlgauge-each-byte"))
                run = []
            else:
                run.append(i)
        return "".join(parts)


def coder(path: str, check: bool = True) -> PieceCoder:
    if (path, check) not in _coders:
        _coders[path, check] = PieceCoder(path, check)
    return _coders[path, check]


def encode(text: Column, path: str, check: bool = True) -> Column:
    """array<int>: the ids of each text."""
    def run(column: pa.Array) -> pa.Array:
        ids, cuts = coder(path, check).encode_column(column)
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each id array (null: empty)."""
    def run(column: pa.Array) -> pa.Array:
        c = coder(path)
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        return pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])], pa.string())
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def with_pieces(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                decoded_col: str = "decoded", check: bool = True) -> DataFrame:
    """``docs`` with the ids of each text and the text that these ids decode to."""
    coded = docs.withColumn(ids_col, encode(F.col(text_col), path, check))
    return coded.withColumn(decoded_col, decode(F.col(ids_col), path))


def digests(ids_col: str = "ids", decoded_col: str = "decoded") -> dict[str, Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of rows of ``with_pieces``."""
    decimal = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return {"n_tokens": F.size(ids_col).cast("bigint"), "ids_sha256": F.sha2(decimal, 256),
            "decoded_sha256": F.sha2(F.col(decoded_col), 256)}
