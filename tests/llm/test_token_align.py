"""Operator 12 against brute force with the libraries, and its fragments as a monoid."""

import hashlib
import pickle
import random
from collections import Counter

import numpy as np
import pytest

from llm_samples import documents, prose  # noqa: F401
from sqlgauge.llm import token_align as TA
from sqlgauge.llm.byte_split import byte_alphabet

P = pytest.importorskip("public_tokenizers")
PIECE, BYTE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "'re", "'s", "the ", "ing", "é", "ñ", "😀", "12", "_", ".", "!?", "<|endoftext|>",
             "<s>", "<0x41>", "\xa0", "日本", "Straße "]
    out = [None, "", " ", "a", "<|endoftext|>", "▁", "x ▁y", "日本語 😀", "\x00\x85​", "naïve  café\n\n"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    out += [prose(rng, 3000), "x" * 9000, "日" * 4000, "a b" * 3000 + "▁", " ".join(rng.choice(parts) for _ in range(5000))]
    return out


@pytest.fixture(scope="module")
def rows():
    all_texts = texts()
    return [*enumerate(all_texts), (3, all_texts[3]), (None, all_texts[-1])]


def encoded(text):
    """[(id, start, end)] of A and of B over the spaced text; none if bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer
    if "a" not in encoded.__dict__:
        encoded.a, encoded.b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
        encoded.a.encode_special_tokens = True
        encoded.letters = byte_alphabet()
    if not text:
        return [], []
    data = (" " + text).encode()
    a = [(i, bytes(encoded.letters[c] for c in encoded.a.id_to_token(i)))
         for i in encoded.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in encoded.b.encode(text):
        piece = encoded.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if encoded.b.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return [], []
    out = []
    for tokens in (a, b):
        at, spans = 0, []
        for i, x in tokens:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(rows):
    docs, totals = [], Counter()
    for doc_id, text in rows:
        a, b = encoded(text)
        links, k = [], 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            m = k
            while m < len(b) and b[m][1] < e:
                links.append((i, b[m][0]))
                m += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        at_a = at_b = 0
        for end in ends:
            one = [[], []]
            while at_a < len(a) and a[at_a][2] <= end:
                one[0].append(str(a[at_a][0]))
                at_a += 1
            while at_b < len(b) and b[at_b][2] <= end:
                one[1].append(str(b[at_b][0]))
                at_b += 1
            groups.append(",".join(one[0]) + "|" + ",".join(one[1]))
        totals.update(links)
        text = ";".join(groups)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    best = {}
    for (_, b), n in totals.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((d, na, nb, ng, len(links), sum(totals[x] == best[x[1]] for x in links),
                    sum(totals[x] for x in links), h) for d, na, nb, ng, links, h in docs), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(documents, rows):
    df = documents(rows).repartition(5)
    got = TA.cross_alignment(df, BYTE, PIECE)
    assert got.columns == TA._SCORED
    assert result(got) == brute(rows)


def test_long_texts_and_a_joined_table_give_the_same(documents, rows, monkeypatch):
    monkeypatch.setattr(TA, "LONG_BYTES", 200)
    monkeypatch.setattr(TA, "RANGE_BYTES", 7)
    monkeypatch.setattr(TA, "FAN", 3)
    monkeypatch.setattr(TA, "TABLE_PAIRS", 0)
    monkeypatch.setattr(TA, "HELD_PAIRS", 50)
    TA._aligners.clear()
    assert result(TA.cross_alignment(documents(rows).repartition(3), BYTE, PIECE)) == brute(rows)


def test_groups_and_an_empty_table(documents):
    rows = [(1, "hello world"), (2, None)]
    got = {r.doc_id: r for r in TA.align(documents(rows), BYTE, PIECE, with_groups=True).collect()}
    a, b = encoded("hello world")
    shown = got[1].groups_sha256.replace("|", ",").replace(";", ",").split(",")
    assert sorted(shown) == sorted(str(i) for i, _, _ in a + b)
    assert hashlib.sha256(got[1].groups_sha256.encode()).hexdigest() == brute(rows[:1])[0][-1]
    assert got[2].groups_sha256 == "" and got[2].n_a == 0
    assert TA.cross_alignment(documents([]), BYTE, PIECE).count() == 0


def test_fragments_compose_in_any_grouping():
    al = TA.Aligner(BYTE, PIECE)
    rng = random.Random(9)
    for text in [t for t in texts() if t and "▁" not in t][-60:]:
        data = np.frombuffer((" " + text[:600]).encode(errors="ignore"), dtype=np.uint8)
        tokens, _, _, valid = al.tokens(data, np.array([0, len(data)]))
        assert valid.all()
        want = al.close(tokens)
        bounds = [0, *sorted(rng.sample(range(1, len(data)), min(len(data) - 1, rng.randint(0, 30)))), len(data)]
        parts = [al.fragment(TA.part(tokens, lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
        while len(parts) > 1:  # any two neighbours, in any order
            k = rng.randrange(len(parts) - 1)
            parts[k:k + 2] = [al.compose(*pickle.loads(pickle.dumps(parts[k:k + 2])))]
        got = al.whole(parts[0])
        assert (got.text, got.n_a, got.n_b, got.n_groups) == (want.text, want.n_a, want.n_b, want.n_groups)
        assert (got.keys == want.keys).all() and (got.counts == want.counts).all()


def test_an_empty_range_is_neutral():
    al = TA.aligner(BYTE, PIECE)
    none = TA.Fragment(TA.none_open())
    data = np.frombuffer(b" some words here", dtype=np.uint8)
    f = al.fragment(al.tokens(data, np.array([0, len(data)]))[0])
    for g in (al.compose(none, f), al.compose(f, none)):
        assert al.whole(g).text == al.whole(f).text
    assert not al.compose(f, TA.Fragment(TA.none_open(), valid=False)).valid


def test_pieces_of_a_long_text_have_its_tokens(monkeypatch):
    monkeypatch.setattr(TA, "LONG_BYTES", 300)
    al = TA.Aligner(BYTE, PIECE)
    rng = random.Random(3)
    text = " ".join(rng.choice(texts()[10:70]) for _ in range(80)).replace("▁", "")
    data = b" " + text.encode()
    cuts = al.cuts(data)
    assert len(cuts) > 5 and cuts[0] == 0 and cuts[-1] == len(data)
    whole = al.tokens(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[0]
    apart = al.tokens(np.frombuffer(data, dtype=np.uint8), np.array(cuts))[0]
    assert whole[0].tolist() == apart[0].tolist() and whole[2].tolist() == apart[2].tolist()
