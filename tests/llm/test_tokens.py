"""Operators 3, 4 and 5 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from llm_samples import documents  # noqa: F401
from sqlgauge.llm import piece_bpe as PB
from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm import token_counts as TC
from sqlgauge.llm import token_store as TS

P = pytest.importorskip("public_tokenizers")
PIECE, BYTE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")

ODD = [None, "", " ", "  ", "a", "\n\n a\tb ", "it's we'll 'tis they''re 'r", "hi!!<|endoftext|>x <|endoftext|>",
       "<s>x</s> <0x41>", "▁ x▁▁y", "née Ññ ²½ Ⅷ 日本語 😀😀 é", "\x00\x1c\x85​�", "Ᲊᲊ7",
       "x" * 5000, "ab " * 3000, "word " * 50 + "\n" * 9 + "end", "the " * 7 + "  tail"]


def texts(seed=1, n=300):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'", "'re", "'s", "the ", "ing", "é", "ñ", "😀", "1", "22", "_",
             ".", ",", "!?", "<|endoftext|>", "<|end", "▁", "\xa0", "日"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    return out + [out[3], (None, "no id")]  # a repeated row, a null id


def test_pieces_equal_the_library(spark, documents, rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    coded = PB.with_pieces(documents(rows), PIECE, ids_col="piece_ids")
    got = coded.select("doc_id", "text", "piece_ids", "decoded", "ids", *[
        c.alias(k) for k, c in PB.digests("piece_ids").items()]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sp.encode(r.text or "")
        assert r.piece_ids == want and r.decoded == sp.decode(want)
        assert r.n_tokens == len(want) and r.ids == "x"
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()


def thue_morse(a, b):
    """1,024 letters and their complement: one polynomial hash mod 2**64 for every base."""
    return ["".join((a, b)[(bin(k).count("1") + flip) % 2] for k in range(1024)) for flip in (0, 1)]


@pytest.mark.parametrize("letters", ["ab", "et", "in", "os"])
def test_spans_of_one_hash_keep_their_own_values(letters):
    import sentencepiece
    from tokenizers import Tokenizer
    texts = thue_morse(*letters) * 2
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(texts)
    byte = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    column = pa.array(texts)
    ids, cuts = PB.coder(PIECE).encode_column(column)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == piece
    raw, off = V.text_bytes(column)
    assert [x.tolist() for x in TS.encoder(BYTE).encode(raw, off)] == byte
    for t, want in zip(texts, byte):  # one block each: the bank knows the other span
        one = np.frombuffer(t.encode(), dtype=np.uint8)
        assert TC.counter(BYTE).block_counts(one, np.array([0, len(one)]))[1].tolist() == [len(want)]


def test_a_bank_that_starts_anew_gives_the_same():
    calls = []
    bank = V.SpanBank(lambda spans: calls.append(len(spans)) or [[len(s), s[0]] for s in spans], limit=3)
    data = np.frombuffer(b"aabbbccddd" + thue_morse("a", "b")[0].encode() + thue_morse("a", "b")[1].encode(),
                         dtype=np.uint8)
    start = np.array([0, 2, 5, 7, 10, 1034])
    end = np.array([2, 5, 7, 10, 1034, 2058])
    for lo, hi in ((0, 2), (1, 4), (0, 6), (3, 6)):
        at, size = bank.lookup(data, V.prefix_hash(data), start[lo:hi], end[lo:hi])
        got = [bank.values[a:a + n].tolist() for a, n in zip(at, size)]
        assert got == [[e - s, data[s]] for s, e in zip(start[lo:hi], end[lo:hi])]


def test_spans_encoded_as_lines_have_the_ids_they_have_alone():
    from sqlgauge.llm.byte_split import WHITE_SPACE, ByteSplitter, SpanEncoder
    enc = TS.encoder(BYTE)
    rng = random.Random(11)
    parts = ["a", "Zoë", "12", "٣", "'", "s", "'ll", "re", "—", "你好", "か", "\u0378", "\U0001F600", "e\u0301",
             "<|endoftext|>", "<|endo", "\x00", "\x1f", "x" * 300, *map(chr, WHITE_SPACE), " ", " ", "\n"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        raw, off = V.text_bytes(pa.array(texts))
        start, end, *_ = ByteSplitter(BYTE).cut(raw, off)
        spans = [raw[s:e].tobytes().decode() for s, e in zip(start, end)]
        flat, size = SpanEncoder(enc.library)(raw, start, end)
        at = np.cumsum(size) - size
        assert [flat[a:a + n].tolist() for a, n in zip(at, size)] == \
            [e.ids for e in enc.library.encode_batch(spans, add_special_tokens=False)]


def test_line_breaks_that_do_not_add_up_are_encoded_span_by_span():
    from tokenizers import Tokenizer
    from sqlgauge.llm.byte_split import SpanEncoder
    library = Tokenizer.from_file(BYTE)
    library.add_tokens(["b\nc"])
    raw = np.frombuffer(b"abcd", dtype=np.uint8)
    start = np.arange(4)
    flat, size = SpanEncoder(library)(raw, start, start + 1)
    assert flat.tolist() == [i for c in "abcd" for i in library.encode(c).ids] and size.tolist() == [1] * 4


def test_a_bank_of_any_limit_gives_the_same():
    rng = random.Random(3)
    for limit in (1, 2, 7, 50, 10_000):
        bank = V.SpanBank(lambda spans: [list(s) for s in spans], limit=limit)
        for _ in range(40):
            spans = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))]
            data = np.frombuffer(b"".join(spans), dtype=np.uint8)
            end = np.cumsum([len(s) for s in spans])
            start = end - [len(s) for s in spans]
            at, size = bank.lookup(data, V.prefix_hash(data), start, end)
            assert [bytes(bank.values[a:a + n].tolist()) for a, n in zip(at, size)] == spans


def test_pieces_decode_any_ids():
    c = PB.coder(PIECE)
    rng = random.Random(2)
    n = c.library.get_piece_size()
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(n), rng.randrange(3, 259), rng.randrange(3), 28705, 259])
               for _ in range(rng.randint(0, 9))]
        assert c.decode(ids) == c.library.decode(ids)


def test_pieces_differing_from_the_library_raise():
    c = PB.PieceCoder(PIECE)
    c.cost.pop("in")
    with pytest.raises(RuntimeError, match="differ"):
        c.encode("inininin")


def test_whole_words_and_cut_words_agree():
    c = PB.coder(PIECE)
    for text in texts(5, 200):
        if text and "▁" not in text:
            assert c.span_ids(" " + text) == c.encode(text)


def test_every_prefix_count_equals_the_library(spark, rows):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(BYTE)
    few = [(i, t) for i, t in rows if t is None or len(t) <= 200]
    df = spark.createDataFrame(few, "doc_id bigint, text string")
    for r in df.select("text", TC.prefix_counts(F.col("text"), BYTE).alias("p")).collect():
        t = r.text or ""
        want = [len(e.ids) for e in tk.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
        assert r.p == want, t


def test_counts_limits_and_longest_prefix(spark, documents, rows):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(BYTE)
    text_of = {i: t or "" for i, t in rows}
    got = TC.count_documents(documents(rows), BYTE, 20).collect()
    assert len(got) == len(rows)
    for r in got:
        t = text_of[r.doc_id]
        n = len(tk.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20)
        fits = len(tk.encode(t[:r.fit_chars], add_special_tokens=False).ids)
        assert fits <= 20 and (n > 20 or r.fit_chars == len(t))
        if len(t) <= 200:
            assert all(len(tk.encode(t[:k], add_special_tokens=False).ids) > 20
                       for k in range(r.fit_chars + 1, len(t) + 1))


def test_neighbours_of_merges_agree_with_plain_merging():
    c = TC.counter(BYTE)
    rng = random.Random(4)
    ids = sorted(c.pieces)
    common = [i for i in ids if len(c.pieces[i]) <= 4][:3000]
    for _ in range(5000):
        a, b = rng.choice(common), rng.choice(common)
        if len(c.merge(c.pieces[a])) == len(c.merge(c.pieces[b])) == 1:
            assert c.fits(a, b) == (c.merge(c.pieces[a] + c.pieces[b]) == [c.pieces[a], c.pieces[b]])


def test_store_round_trip(spark, documents, rows):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(BYTE)
    store = TS.write_store(documents(rows), BYTE, 2, docs_per_shard=50)
    got = TS.read_store(spark, store, with_ids=True).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    text_of = dict(rows)
    for r in by_start:
        want = tk.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.start == at and r.n_tokens == len(want) and r.ids == want
        assert r.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        at += len(want)
    dictionary = storage.read_bytes(store.dictionary)
    shard = TS.ShardReader(store.shards[-1][0], dictionary)
    last = int(shard.index["doc_id"][-1])
    assert shard.find(last).tolist() == tk.encode(text_of[last] or "", add_special_tokens=False).ids + [2]
    with pytest.raises(KeyError):
        shard.find(10**9)
    with pytest.raises(ValueError, match="another dictionary"):
        TS.ShardReader(store.shards[0][0], dictionary + b"x")


def test_dictionary_helps_short_documents(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)))
                                for i in range(600)], "doc_id bigint, text string")
    trained = TS.train_dictionary(df, BYTE, "doc_id", "text", 2)
    assert len(trained) > 0
    size = lambda d: df.select(F.sum(F.length(TS.frames(F.col("text"), BYTE, 2, d)["frame"]))).first()[0]
    assert size(trained) < size(b"")


def test_empty_tables(spark, documents):
    empty = documents([])
    assert PB.with_pieces(empty, PIECE).count() == 0
    assert TC.count_documents(empty, BYTE, 5).count() == 0
    assert TS.read_store(spark, TS.write_store(empty, BYTE, 2)).count() == 0


def test_fallback_for_other_tokenizers(spark):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    df = spark.createDataFrame([(1, "Hello  big World"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in TS.read_store(spark, TS.write_store(df, path, 2), with_ids=True).collect()}
    assert got == {1: tk.encode("Hello  big World", add_special_tokens=False).ids + [2], 2: [2]}
