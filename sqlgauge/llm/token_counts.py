"""Operator 4: exact token counts of every prefix by dynamic programming.

For a pre-token of n bytes, the encoding of its first e bytes ends with exactly
one token t such that t is compatible with the last token of what stands before
it (the two, encoded together, stay these two). So last[e] and count[e] follow
from last[s] and count[s] of a shorter prefix, and one pass gives the count at
*every* prefix. A text's prefix counts are the running totals of its pre-tokens
plus the counts inside the pre-token that the prefix cuts. Truncation ("the
longest prefix of at most k tokens") and budget questions read that array;
nothing is encoded again.

Three kinds of prefix are cut otherwise by themselves than inside a longer text
and get their own value: white space before text, contractions of three
characters, and added tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import textvec as V
from sqlgauge.llm.byte_split import ByteSplitter, byte_alphabet

#: Contractions whose proper prefix is cut into a quote and a letter.
LONG_CONTRACTIONS = (b"'re", b"'ve", b"'ll")
PAIR_MEMO = 2_000_000

_counters: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Prefix token counts for one byte-level BPE file."""

    def __init__(self, path: str):
        self.splitter = ByteSplitter(path)
        model = self.splitter.spec["model"]
        letters = byte_alphabet()
        as_bytes = lambda piece: bytes(letters[c] for c in piece)
        added = {t["content"] for t in self.splitter.spec["added_tokens"]}
        ids = {as_bytes(p): i for p, i in model["vocab"].items() if p not in added}
        self.pieces = {i: b for b, i in ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.id_ranks = {(ids[a], ids[b]): r for (a, b), r in self.ranks.items()}
        self.made_by = {ids[a + b]: (ids[a], ids[b], r) for (a, b), r in self.ranks.items()}
        if len(self.made_by) != len(self.ranks):
            raise ValueError(f"{path}: two merges make the same token")
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self._build_trie({b: i for b, i in ids.items() if len(self.merge(b)) == 1})
        self.bank = V.SpanBank(self.all_span_counts)

    def _build_trie(self, ids: dict[bytes, int]) -> None:
        """States for reading bytes: ``ends[state]`` lists the tokens that end here, longest first."""
        self.step, own, order, back = {}, [None], [(0, 0, 0)], [0]
        for piece, token in ids.items():
            node = 0
            for byte in piece:
                child = self.step.get(node << 8 | byte)
                if child is None:
                    child = self.step[node << 8 | byte] = len(own)
                    own.append(None)
                    back.append(0)
                    order.append((child, node, byte))
                node = child
            own[node] = (token, len(piece))
        depth = [0] * len(own)
        for child, node, _ in order[1:]:
            depth[child] = depth[node] + 1
        self.back, self.ends = back, [()] * len(own)
        for child, node, byte in sorted(order[1:], key=lambda x: depth[x[0]]):
            back[child] = self._next(back[node], byte) if node else 0
            self.ends[child] = ((own[child],) if own[child] else ()) + self.ends[back[child]]

    def _next(self, state: int, byte: int) -> int:
        """The state after ``byte``: the longest start of a token that still ends here."""
        found = self.step.get(state << 8 | byte)
        if found is None:
            found = self._next(self.back[state], byte) if state else 0
        return found

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging by rank: for the tokens themselves and for rare ties."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which it is merged away) along one edge of a token's merges."""
        found = self.spines.get((token, side))
        if found is None:
            found, until, at = [], 1 << 40, token
            while True:
                found.append((at, until))
                if at not in self.made_by:
                    break
                until = self.made_by[at][2]
                at = self.made_by[at][side]
            self.spines[token, side] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left right`` encodes to exactly these two tokens.

        They do unless some part at the end of ``left`` and some part at the start
        of ``right`` stand next to each other when the merge of both is due.
        """
        ranks = self.id_ranks
        for x, x_until in self._spine(left, 1):
            for y, y_until in self._spine(right, 0):
                due = ranks.get((x, y))
                if due is not None and due <= x_until and due <= y_until:
                    if due == x_until or due == y_until:  # the same merge twice: leftmost first
                        a, b = self.pieces[left], self.pieces[right]
                        return self.merge(a + b) == [a, b]
                    return False
        return True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of each non-empty prefix (in bytes) of one pre-token."""
        return self.all_prefix_counts([piece])[0]

    def all_prefix_counts(self, pieces: list[bytes]) -> list[list[int]]:
        """``prefix_counts`` of many pieces; what neighbours in sorted order share is kept."""
        out: list = [None] * len(pieces)
        step, ends, pairs = self.step, self.ends, self.pairs
        before, last, count, states = b"", [-1], [0], [0]
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[k]
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            del last[same + 1:], count[same + 1:], states[same + 1:]
            state = states[same]
            for end in range(same + 1, len(piece) + 1):
                byte = piece[end - 1]
                after = step.get(state << 8 | byte)
                state = self._next(state, byte) if after is None else after
                for token, size in ends[state]:
                    if size == end:
                        break
                    key = last[end - size] << 24 | token
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) >= PAIR_MEMO:
                            pairs.clear()
                        ok = pairs[key] = self.fits(last[end - size], token)
                    if ok:
                        break
                else:
                    raise ValueError(f"no token ends at byte {end} of {piece[:80]!r}")
                last.append(token)
                count.append(count[end - size] + 1)
                states.append(state)
            before = piece
            out[k] = count[1:]
        return out

    def all_span_counts(self, spans: list[bytes]) -> list[list[int]]:
        plain = self.all_prefix_counts([s for s in spans if s not in self.splitter.added])
        plain.reverse()
        out = [[1] * len(s) if s in self.splitter.added else plain.pop() for s in spans]
        for span, counts in zip(spans, out):
            if span in LONG_CONTRACTIONS:
                counts[1] = 2
        return out

    def block_counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of the prefix that ends after each byte, tokens of each row)."""
        starts, ends, before, (run_start, run_end), special = self.splitter.cut(data, off)
        if len(starts) == 0:
            return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
        pre = V.prefix_hash(data)
        at, size = self.bank.lookup(data, pre, starts, ends)
        inside = self.bank.values[V.ranges(at, size)].astype(np.int64)
        span_end = np.cumsum(ends - starts)
        totals = inside[span_end - 1]
        running = np.concatenate([[0], np.cumsum(totals)])
        tokens = running[before[1:]] - running[before[:-1]]
        row = np.searchsorted(before, np.arange(len(starts)), side="right") - 1
        base = running[:-1] - running[before[row]]
        counts = np.repeat(base, ends - starts) + inside
        if len(run_end):
            # A prefix that ends with all of the white space: one run, cut as one.
            at, size = self.bank.lookup(data, pre, run_start, run_end)
            ahead = np.where(run_start == off[np.searchsorted(off, run_start, side="right") - 1], 0,
                             counts[run_start - 1])
            counts[run_end - 1] = ahead + self.bank.values[at + size - 1]
        raw = data.tobytes() if special else b""
        for s, e in special:
            # Prefixes that end inside an added token are ordinary text so far.
            r = int(np.searchsorted(off, s, side="right")) - 1
            lo = max([off[r], *(b for a, b in special if off[r] <= a < s)])
            part = np.frombuffer(raw[lo:e], dtype=np.uint8)
            plain, _ = self._plain(part)
            ahead = counts[lo - 1] if lo > off[r] else 0
            counts[s:e - 1] = ahead + plain[s - lo:e - 1 - lo]
        return counts, tokens

    def _plain(self, data: np.ndarray) -> tuple[np.ndarray, int]:
        """Prefix counts of one text whose added tokens count as ordinary text."""
        off = np.array([0, len(data)])
        starts, ends, _, (run_start, run_end), _ = self.splitter.cut(data, off, added=False)
        raw, counts, total = data.tobytes(), [], 0
        for inside in self.all_span_counts([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]):
            counts += [total + c for c in inside]
            total = counts[-1]
        for s, e in zip(run_start.tolist(), run_end.tolist()):
            counts[e - 1] = (counts[s - 1] if s else 0) + self.prefix_counts(raw[s:e])[-1]
        return np.array(counts, dtype=np.int64), total


def counter(path: str) -> PrefixCounter:
    """One counter per file and worker process."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _char_ends(data: np.ndarray) -> np.ndarray:
    """Positions of the bytes that end a character."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    return np.append(np.flatnonzero(lead)[1:] - 1, len(data) - 1)


def prefix_counts(text: Column, path: str) -> Column:
    """array<int>: the exact token count of the first k characters, k = 0..n.

    A null text counts as empty ([0])."""
    def run(column):
        import pyarrow as pa
        c = counter(path)
        raw, off = V.text_bytes(column)
        values, lengths = [], []
        for lo, hi in V.blocks(off):
            data, o = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            counts, _ = c.block_counts(data, o)
            ends = _char_ends(data)
            cut = np.searchsorted(ends, o[1:] - 1, side="right") if len(ends) else np.zeros(hi - lo, int)
            cut = np.concatenate([[0], cut])
            for a, b in zip(cut[:-1], cut[1:]):
                values += [np.zeros(1, np.int32), counts[ends[a:b]].astype(np.int32)]
                lengths.append(b - a + 1)
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *values]))
    return F.arrow_udf(_typed(run), "array<int>")(text)


def _typed(f):
    """Give a column function the Arrow type hints that ``arrow_udf`` reads."""
    f.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return f


COUNT_TYPE = "struct<n_bytes: bigint, n_tokens: bigint, fit_chars: bigint>"


def token_counts(text: Column, path: str, limit: int) -> Column:
    """struct of n_bytes, n_tokens and fit_chars of each text.

    ``fit_chars`` is the number of characters of the longest prefix whose exact
    count is at most ``limit``, read from the prefix counts. A null or empty text
    has zeros.
    """
    def run(column):
        import pyarrow as pa
        c = counter(path)
        raw, off = V.text_bytes(column)
        tokens, fit = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
        for lo, hi in V.blocks(off):
            data, o = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            counts, tokens[lo:hi] = c.block_counts(data, o)
            ends = _char_ends(data)
            within = counts[ends] <= limit
            # The last character of each row whose prefix still fits.
            row = np.searchsorted(o, ends, side="right") - 1
            first = np.searchsorted(row, np.arange(hi - lo))
            place = np.arange(len(ends)) - first[row] + 1 if len(ends) else np.zeros(0, np.int64)
            np.maximum.at(fit, lo + row[within], place[within])
        out = [pa.array(x) for x in (np.diff(off).astype(np.int64), tokens, fit)]
        return pa.StructArray.from_arrays(out, ["n_bytes", "n_tokens", "fit_chars"])
    return F.arrow_udf(_typed(run), COUNT_TYPE)(text)


def count_documents(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, fit_chars.

    Nulls count as empty texts; repeated rows and null ids keep their own rows;
    columns other than id and text are not read.
    """
    counted = docs.select(F.col(id_col), token_counts(F.col(text_col), path, limit).alias("_c"))
    return counted.select(id_col, "_c.n_bytes", "_c.n_tokens",
                          (F.col("_c.n_tokens") > limit).alias("over_limit"), "_c.fit_chars")
