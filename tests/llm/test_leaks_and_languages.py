"""Operators 1 and 2: brute force, planted cases, held-out accuracy."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_samples import SF_CHECK, documents, prose  # noqa: F401
from sqlgauge.llm import decontam as DC
from sqlgauge.llm import langid as LI
from sqlgauge.llm import textvec as V


# ---- greedy string tiling ----

def slow_tiles(item, doc, least):
    """The textbook greedy tiling, one longest match at a time."""
    least = min(least, len(item))
    in_i, in_d, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and not in_i[i + n] and not in_d[d + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < max(least, 1):
            return tiles
        tiles.append((i, d, n))
        in_i[i:i + n] = [True] * n
        in_d[d:d + n] = [True] * n


@pytest.mark.parametrize("seed", range(6))
def test_tiles_equal_the_slow_tiling(seed):
    rng = random.Random(seed)
    for _ in range(30):
        alphabet = rng.choice([2, 4, 30])
        item = [rng.randrange(alphabet) for _ in range(rng.randint(1, 25))]
        doc = [rng.randrange(alphabet) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.6:
            a = rng.randrange(len(item))
            doc[5:5] = item[a:] + [99] + item[:a]
        got = DC.greedy_tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in slow_tiles(item, doc, 3))
        assert all(item[i:i + n] == doc[d:d + n] for i, d, n in got)
        used = [k for i, _, n in got for k in range(i, i + n)]
        assert len(used) == len(set(used))


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(15, 60)) + f" item{k}.") for k in range(30)] + [(90, None), (91, ""), (92, "Tiny one")]
    docs, want = [(1, None), (2, ""), (3, "tiny, ONE!"), (4, "tiny"), (4, "tiny")], {(3, 92)}
    for k in range(30):
        words = items[k][1].split()
        half = len(words) // 2
        for j, body in enumerate((words, words[half:] + ["x"] + words[:half], [w.upper() + "!!" for w in words],
                                  words[:len(words) // 4])):
            doc = 100 + 10 * k + j
            docs.append((doc, " ".join(prose(rng, 40).split() + body + prose(rng, 40).split())))
            if j < 3:
                want.add((doc, k))
    docs += [(1000 + k, prose(rng, 300)) for k in range(40)] + [(5000, prose(rng, 50_000) + " " + items[0][1]), (None, items[1][1])]
    want |= {(5000, 0), (None, 1)}
    return docs, items, want


def test_leaks_are_found_in_any_order_and_clean_text_is_left(spark, documents, leaks):
    docs, items, want = leaks
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = DC.find_leaks(documents(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        assert r.covered_tokens == sum(t.n_tokens for t in r.tiles) and r.coverage >= DC.COVERAGE
    again = DC.find_leaks(documents(docs), bench, block_bytes=300).collect()  # many blocks of items
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_decontaminated_rows(spark, documents, leaks):
    docs, items, want = leaks
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(docs)
    left = DC.decontaminate(df, bench)
    gone = {d for d, _ in want if d is not None}
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in gone)
    assert DC.decontaminate(df, bench.limit(0)).count() == len(docs)
    assert DC.find_leaks(documents([]), bench).count() == 0


def test_seed_bound_and_positions():
    block = DC.ItemBlock([7], ["a b c d e f g h i j"], 5)
    found = list(DC.scan(block, pa.array([1, 2]), pa.array(["z z a b c d e f g h i j z", "a b c d"]), 0.5))
    assert [(f[0], f[1], f[3], f[5]) for f in found] == [(1, 7, 10, [(0, 2, 10)])]


ZH = "请计算从一加到一百的所有整数之和，并说明你使用的方法。"
JA = "次の文章を読んで、主人公の気持ちを五十字以内で説明しなさい。"
TH = "จงหาผลรวมของจำนวนเต็มทั้งหมดตั้งแต่หนึ่งถึงหนึ่งร้อย"
EN = "how many red apples are left when seven of the twelve are eaten"


@pytest.mark.parametrize("item, doc, leaks", [
    (ZH, "前面有一些别的话" + ZH.rstrip("。") + "后面还有一些", True), (ZH, "今天天气很好，我们去公园散步。", False),
    (ZH, "说明你使用的方法" + "其他" + "请计算从一加到一百的所有整数之和", True),
    (JA, "これは前文です" + JA.rstrip("。") + "と書いてあった", True), (JA, "今日は天気がいいので散歩に行きましょう", False),
    (JA, "主人公の気持ちを五十字以内で説明しなさい　次の文章を読んで", True),
    (TH, "ข้อความก่อนหน้า" + TH + "ข้อความถัดไป", True), (TH, "วันนี้อากาศดีมาก", False),
    (EN, "x—" + EN.replace(" ", "\u00a0") + "—y", True), (EN, "“" + EN.replace(" ", "—") + "”", True),
    (EN, "a\u3000" + EN.replace(" ", "\u3000"), True), ("Über Größe é naïve Ñandú cœur", "x über…größe é, naïve ñandú cœur!", True),
])
def test_leaks_in_other_scripts_and_punctuation(item, doc, leaks):
    found = list(DC.scan(DC.ItemBlock([7], [item], 5), pa.array([1]), pa.array([doc]), 0.5))
    assert bool(found) == leaks


def test_unicode_words():
    texts = ["ab é", "x中文y1", "", "ไทย", "éa —b", "हिन्दी शब्द"]
    raw, off = V.text_bytes(pa.array(texts))
    start, end, before = V.unicode_words(raw, off)
    got = [raw[s:e].tobytes().decode() for s, e in zip(start, end)]
    assert [got[a:b] for a, b in zip(before, before[1:])] == [
        ["ab", "é"], ["x", "中", "文", "y1"], [], list("ไทย"), ["éa", "b"], ["हिन्दी", "शब्द"]]


# ---- languages ----

@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id bigint")
    for r in df.select("doc_id", LI.held_out(df.doc_id).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(corpus):
    model = LI.train(corpus)
    got = LI.predict(corpus, model).where(LI.held_out(corpus.doc_id)).select("lang", "language.*", "n_chars")
    rows = got.toPandas()
    assert len(rows) > 100
    assert (rows.iloc[:, 0] == rows.iloc[:, 1]).mean() > 0.95
    assert rows.score.between(0, 1).all()
    assert rows.rejected.mean() < 0.01


def test_predictions_ignore_everything_but_text(spark, corpus, documents):
    model = LI.train(corpus)
    rows = [(1, None), (2, ""), (3, "12 !! ..."), (4, "der die das und nicht"), (4, "der die das und nicht"),
            (None, "the of and"), (6, "é" * 70_000), (7, "日本語のテキスト" * 20)]
    df = documents(rows)
    got = LI.predict(df, model, out_col="guess").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.guess)
        assert r.guess.lang in {*model.languages, "und"} and r._language == "w"
    assert all(by[i].lang == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert by[4].lang == "de" and not by[4].rejected and by[7].rejected
    kept = LI.accepted(df, model)
    assert kept.columns == df.columns
    assert {4, None} <= {r.doc_id for r in kept.collect()} and 7 not in {r.doc_id for r in kept.collect()}


def test_no_labels_no_language(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    model = LI.train(df)
    r = LI.predict(df, model).first()
    assert r.language.lang == "und" and r.language.rejected
    assert LI.predict(df.limit(0), model).count() == 0


def test_training_is_bounded_and_repeatable(corpus):
    a, b = LI.train(corpus, train_docs=20), LI.train(corpus, train_docs=20)
    assert a.languages == b.languages and np.allclose(a.centroids, b.centroids)


ODD = ["Это предложение на русском языке.", "这是一个中文句子。", "한국어 문장입니다.", "ข้อความภาษาไทย", "x", "ok", "η ελληνική", "zzz"]


def _strange(rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ([base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)]
            + ["".join(rng.choices(letters, k=300)) for _ in range(20)]
            + [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
            + ["for (int i = 0; i < n; ++i) { struct foo *p = malloc(sizeof(*p)); p->next = head; }" * 2]
            + [x * 9 for x in ODD])


@pytest.mark.parametrize("odd", [0, 8])
def test_a_few_wrong_labels_do_not_switch_rejection_off(spark, corpus, odd):
    wrong = [(10**9 + k, ODD[k % len(ODD)] * 3, "en") for k in range(odd * 2) if zlib.crc32(str(10**9 + k).encode()) % 5]
    docs = corpus.select("doc_id", "text", "lang")
    model = LI.train(docs.unionByName(spark.createDataFrame(wrong[:odd], docs.schema)) if odd else docs)
    assert model.predict(pa.array(_strange(random.Random(3))))[2].all()
    kept = LI.predict(corpus, model).where(LI.held_out(corpus.doc_id)).toPandas().language
    assert np.mean([r["rejected"] for r in kept]) < 0.01


def test_every_label_is_learned(spark):
    rng = random.Random(4)
    rows = []
    for k in range(230):  # languages of their own alphabets
        low = 0x4E00 + 20 * k
        word = lambda: "".join(chr(low + rng.randrange(20)) for _ in range(rng.randint(2, 6)))
        rows += [(10 * k + j, " ".join(word() for _ in range(40)), f"l{k:03}") for j in range(7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = LI.train(df)
    assert set(model.languages) == {r[2] for r in rows}
    got = LI.predict(df, model).collect()
    assert np.mean([r.lang == r.language.lang for r in got]) > 0.95


def test_blocks_do_not_change_vectors():
    texts = ["Äpfel und Birnen", "", None, "a", "x1y2 z", "the  THE the"]
    whole = np.concatenate([t for _, _, t in LI.counts(pa.array(texts))])
    single = np.concatenate([t for x in texts for _, _, t in LI.counts(pa.array([x], pa.string()))])
    assert np.array_equal(whole, single)
    assert np.array_equal(whole[5], np.concatenate([t for _, _, t in LI.counts(pa.array(["The the!the"]))])[0])


def hits_of(block, texts):
    out = []
    for lo, _, token, before in DC.tokens(pa.array(texts)):
        out += [(lo + r, k, sorted(zip(d.tolist(), p.tolist())), size) for r, k, d, p, size in block.hits(token, before)]
    return sorted(out)


def test_a_seed_that_all_items_share_is_looked_up_in_parts(spark, documents, monkeypatch):
    call = "please answer the question below now"
    items = [(k, f"{call} alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k} eta{k}") for k in range(20_000)]
    text = " ".join([call] * 40) + " " + items[7][1] + " filler words " + " ".join([call] * 40)
    docs = [(1, text), (2, " ".join([call] * 60)), (3, "nothing shared"), (4, items[19_999][1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = DC.find_leaks(documents(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (4, 19_999)}
    block = DC.ItemBlock([k for k, _ in items[:500]], [t for _, t in items[:500]], DC.MIN_MATCH)
    texts = [t for _, t in docs] + [None, items[3][1]]
    whole = hits_of(block, texts)
    assert len(whole) > 1500
    for held in (1, 700, 5000, 60_000):
        monkeypatch.setattr(DC, "HELD_HITS", held)
        largest = []
        real = DC._pairs
        monkeypatch.setattr(DC, "_pairs", lambda row, at, item, place, lo, n, size: largest.append(int(n.sum())) or real(
            row, at, item, place, lo, n, size))
        assert hits_of(block, texts) == whole
        monkeypatch.setattr(DC, "_pairs", real)
        assert max(largest) <= max(held * 2, 250)


def test_windows_that_share_a_hash_make_no_tile():
    one = np.array([bin(k).count("1") % 2 for k in range(1024)], np.uint64) + np.uint64(5)
    two = np.uint64(11) - one  # the same sequence with the two tokens exchanged
    roll = [DC.RollingHash(x).windows(1024) for x in (one, two)]
    assert roll[0] == roll[1]  # what the test is about
    for i, d, n in DC.greedy_tiles(one, two, 5):
        assert (one[i:i + n] == two[d:d + n]).all()


def test_a_benchmark_of_many_blocks_scans_documents_once(spark, documents, leaks):
    docs, items, want = leaks
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = DC.find_leaks(documents(docs), bench, block_bytes=500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Exchange" not in plan
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
