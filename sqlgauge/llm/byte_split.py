"""Byte-level pre-tokens of whole blocks of texts, as the tokenizers library cuts them.

The library's byte-level pre-tokenizer splits by character class: an optional
single space followed by a run of letters, of numbers or of other visible
characters; English contractions; and white space, whose last character stays
with what follows. Here the same cuts come from one pass over an array of
character classes. Classes come from ``unicodedata``; a code point it does not
know is asked of the library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from sqlgauge.llm import textvec as V

SPACE, LETTER, NUMBER, OTHER, ASK = range(5)
#: White_Space of Unicode, and the contractions of the split.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
               0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: The last three bytes, at most, of white space characters.
_SPACE_ENDS = {n: [int.from_bytes(chr(c).encode(), "big") for c in WHITE_SPACE if len(chr(c).encode()) == n]
               for n in (1, 2, 3)}

_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        by_kind = {"L": LETTER, "N": NUMBER}
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            table[c] = ASK if kind == "Cn" else by_kind.get(kind[0], OTHER)
        table[list(WHITE_SPACE)] = SPACE
        _classes = table
    return _classes


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def splits_by_bytes(spec: dict) -> bool:
    """Whether a tokenizer file uses exactly the split of this module."""
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"]))


class ByteSplitter:
    """Cuts blocks of texts into pre-tokens; added tokens of the file stay whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if not splits_by_bytes(self.spec):
            raise ValueError(f"{path}: only byte-level BPE files without a normalizer are supported")
        self.library = Tokenizer.from_file(path)
        self.added = {t["content"].encode(): t["id"] for t in self.spec["added_tokens"]}
        self.table = _class_table().copy()

    def _classes_of(self, cp: np.ndarray) -> np.ndarray:
        kinds = self.table[cp]
        unknown = kinds == ASK
        if unknown.any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(cp[unknown]).tolist():
                parts = [p for p, _ in cut("a" + chr(c) + "1")]
                self.table[c] = (OTHER if len(parts) == 3 else
                                 LETTER if len(parts[1]) == 1 else NUMBER)
            kinds = self.table[cp]
        return kinds

    def added_spans(self, raw: bytes, off: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand (leftmost, then longest), inside one row each."""
        found = []
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                row = int(np.searchsorted(off, at, side="right")) - 1
                if at + len(content) <= off[row + 1]:
                    found.append((at, at + len(content)))
                at = raw.find(content, at + 1)
        found.sort(key=lambda x: (x[0], -x[1]))
        kept: list[tuple[int, int]] = []
        for s, e in found:
            if not kept or s >= kept[-1][1]:
                kept.append((s, e))
        return kept

    def cut(self, data: np.ndarray, off: np.ndarray, added: bool = True):
        """(byte starts, byte ends, spans before each row, ends of longer white
        space that stands before text with its start, added spans)."""
        n_bytes = len(data)
        none = np.zeros(0, dtype=np.int64)
        if n_bytes == 0:
            return none, none, np.zeros(len(off), np.int64), (none, none), []
        special = self.added_spans(data.tobytes(), off) if added else []
        bounds = np.unique(np.concatenate([off, np.array(special, dtype=np.int64).ravel()]))
        cp, at = V.code_points(data)
        kind = self._classes_of(cp)
        n = len(cp)
        edge = np.zeros(n + 1, dtype=bool)
        edge[np.searchsorted(at, bounds)] = True
        run = edge[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        run_start = np.flatnonzero(run)
        run_end = np.append(run_start[1:], n)
        space_before = np.zeros(n, dtype=bool)
        space_before[1:] = (cp[:-1] == 0x20) & ~edge[1:n]
        solid = kind != SPACE
        start[run & solid & space_before] = False
        # White space that text follows gives its last character away.
        before_text = (kind[run_start] == SPACE) & ~edge[run_end]
        start[run_end[before_text] - 1] = True
        long_run = before_text & (run_end - run_start >= 2)
        # Contractions: a lone quote that starts a pre-token, then their letters.
        quote = run_start[(run_end - run_start == 1) & (cp[run_start] == 0x27) & start[run_start]]
        for letters in CONTRACTIONS:
            width = len(letters)
            here = quote[quote + width < n]
            fits = np.ones(len(here), dtype=bool)
            for k, c in enumerate(letters, 1):
                fits &= (cp[here + k] == ord(c)) & ~edge[here + k]
            here = here[fits]
            start[here + 1] = False
            rest = here + width + 1
            start[rest[rest < n]] = True
        for s, e in special:
            a, b = np.searchsorted(at, [s, e])
            start[a:b] = False
            start[a] = True
        first = np.flatnonzero(start)
        starts = at[first]
        ends = np.append(starts[1:], n_bytes)
        return (starts, ends, np.searchsorted(starts, off),
                (at[run_start[long_run]], at[run_end[long_run]]), special)


def ends_in_space(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character before each position is white space."""
    value, found = np.zeros(len(end), dtype=np.int64), np.zeros(len(end), dtype=bool)
    for n, known in _SPACE_ENDS.items():
        value |= data[np.maximum(end - n, 0)].astype(np.int64) << 8 * (n - 1)
        found |= np.isin(value, known)
    return found


class SpanEncoder:
    """ids of pre-tokens by the library, which takes those of a block as one text of lines.

    A line break is a pre-token of its own between two that neither start with two
    white space characters nor end in one, so the ids of a line are those of its
    pre-token alone. White space is encoded span by span, as is everything if the ids
    of the line breaks do not add up (as added tokens that hold one would cause).
    """

    def __init__(self, library):
        self.library = library
        ids = library.encode("\n", add_special_tokens=False).ids
        self.line_break = ids[0] if len(ids) == 1 else None

    def _one_by_one(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = [data[s:e].tobytes().decode() for s, e in zip(start.tolist(), end.tolist())]
        rows = [e.ids for e in self.library.encode_batch_fast(spans, add_special_tokens=False)]
        size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(size.sum())), size

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, how many of each)."""
        space = ends_in_space(data, end)
        lines = np.flatnonzero(~space)
        if self.line_break is None or len(lines) < 2:
            return self._one_by_one(data, start, end)
        width = end[lines] - start[lines]
        text = np.full(int(width.sum()) + len(lines), 0x0A, dtype=np.uint8)
        text[V.ranges(np.cumsum(width + 1) - width - 1, width)] = data[V.ranges(start[lines], width)]
        got, = self.library.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)
        ids = np.array(got.ids, dtype=np.int32)
        breaks = np.flatnonzero(ids == self.line_break)
        if len(breaks) != len(lines) or breaks[-1] != len(ids) - 1:
            return self._one_by_one(data, start, end)
        size = np.zeros(len(start), dtype=np.int64)
        size[lines] = np.diff(breaks, prepend=-1) - 1
        blanks = np.flatnonzero(space)
        extra, size[blanks] = self._one_by_one(data, start[blanks], end[blanks])
        # Both parts, each span's ids at its place.
        flat = np.empty(int(size.sum()), dtype=np.int32)
        at = np.cumsum(size) - size
        flat[V.ranges(at[lines], size[lines])] = np.delete(ids, breaks)
        flat[V.ranges(at[blanks], size[blanks])] = extra
        return flat, size
