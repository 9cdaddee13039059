"""Operator 11 against brute force, and its index under insertion, deletion and overflow."""

import hashlib
import random

import pytest

from llm_samples import documents, prose  # noqa: F401
from sqlgauge.llm import exact_dedup as ED


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text):
    return (text or "").translate(str.maketrans(CAPITALS, CAPITALS.lower()))


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[normal(t)] if x is not None]
        keep = max(ids, default=None)
        kept = keep is None or i == keep
        out.append((i, keep, len(groups[normal(t)]), kept, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [None, "", "", " ", "A", "a", "É", "é", "İ", "long " * 60_000, "LONG " * 60_000, "x\x00y", "X\x00Y"]
    for _ in range(40):
        base = prose(rng, rng.randint(1, 60))
        texts += [rng.choice([base, base.upper(), base.title()]) for _ in range(rng.randint(1, 6))]
    texts += ["the same text"] * 300 + [prose(rng, 12) for _ in range(400)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(5 * i + 2, texts[i]) for i in order]
    return out + [out[0], (None, "a"), (None, "only without an id"), (None, "only without an id"), (3, "A")]


def test_equals_brute_force(documents, rows, monkeypatch):
    assert rows_of(ED.exact_duplicates(documents(rows))) == brute(rows)
    monkeypatch.setattr(ED, "HELD_ROWS", 1)  # nothing is gathered before the shuffle
    assert rows_of(ED.exact_duplicates(documents(rows))) == brute(rows)


def test_kept_rows_stay_with_all_columns(documents, rows):
    df = documents(rows)
    left = ED.drop_exact_duplicates(df)
    kept = {(b[0], b[4]) for b in brute(rows) if b[3]}
    want = sorted([(i, t) for i, t in rows if (i, hashlib.sha256(normal(t).encode()).hexdigest()) in kept], key=str)
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == want
    assert left.columns == df.columns


def test_empty_table(documents):
    assert ED.exact_duplicates(documents([])).count() == 0
    assert ED.drop_exact_duplicates(documents([])).count() == 0


def test_batches_and_deletions_equal_a_rebuild(spark, documents, rows):
    rng = random.Random(4)
    index, live = ED.empty_index(spark, 3), []
    assert index.keys().count() == 0
    for k in range(3):
        index = index.insert(documents(rows[k::3]))
        live += rows[k::3]
        assert as_groups(index) == expected(live)
    before = index
    for _ in range(2):
        some = [i for i, _ in live if i is not None and rng.random() < 0.4] + [10**9]
        index = index.delete(spark.createDataFrame([(i,) for i in some], "doc_id bigint"))
        live = [(i, t) for i, t in live if i not in set(some)]
        assert as_groups(index) == expected(live)
    assert as_groups(before) == expected(rows)  # an earlier version still reads as it was
    index = index.insert(documents(rows))
    assert as_groups(index) == expected(live + rows)


def as_groups(index):
    rows = index.keys().collect()
    got = {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in rows}
    assert len(got) == len(rows)
    return got


def expected(live):
    return {b[4]: (b[1], b[2]) for b in brute(live)}


def keys(rng, n):
    return [rng.getrandbits(64) for _ in range(n)]


def test_filter_holds_what_is_inserted_and_forgets_what_is_deleted():
    rng = random.Random(1)
    f = ED.CuckooFilter(256)
    here = keys(rng, 900)
    assert all(map(f.insert, here)) and all(k in f for k in here)
    for k in here[:450]:
        assert f.delete(k)
    assert all(k in f for k in here[450:])
    assert sum(k in f for k in here[:450]) < 10 and sum(k in f for k in keys(rng, 5000)) < 20
    assert all(f.delete(k) for k in here[450:]) and not any(f.table)


def test_overflow_resizes_from_stored_keys(tmp_path):
    rng = random.Random(3)
    shard = ED.Shard(f"file://{tmp_path}", ED.CuckooFilter(4))
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, d in enumerate(digests):
        shard.insert(d, k, 1, 3, d)
    assert shard.resizes >= 8 and shard.filter.buckets >= 1024
    shard.insert(digests[7], 9000, 2, 3, digests[7])  # an early text: its content is read back
    uri, n = ED.Shard.save(shard)
    again = ED.Shard.load(f"file://{tmp_path}", uri)
    assert n == 3000 and again.filter.table == shard.filter.table
    for k in rng.sample(range(3000), 200):
        entry = again.find(digests[k], 3, digests[k])
        assert (entry.keep_id, entry.count) == ((9000, 3) if k == 7 else (k, 1))


def test_a_hit_is_verified_by_content(tmp_path):
    import zstandard
    pack = zstandard.ZstdCompressor().compress
    one = hashlib.sha256(b"one").digest()
    same_key = one[:8] + bytes(24)  # the same key and fingerprint, another text
    shard = ED.Shard(f"file://{tmp_path}")
    shard.insert(one, 1, 1, 3, pack(b"one"))
    shard.insert(same_key, 2, 1, 3, pack(b"two"))
    assert shard.false_hits == 1
    assert [len(v) for v in shard.entries.values()] == [2]
    shard.insert(one, 5, 1, 3, zstandard.ZstdCompressor(level=19).compress(b"one"))  # packed otherwise
    uri, _ = shard.save()
    shard = ED.Shard.load(f"file://{tmp_path}", uri)
    assert shard.find(one, 3, pack(b"one")).count == 2
    with pytest.raises(ValueError):
        shard.find(one, 3, pack(b"ono"))
    shard.revise(one, None, 0)
    assert shard.find(same_key, 3, pack(b"two")).keep_id == 2 and shard.find(one, 3, b"") is None
    shard.revise(same_key, None, 0)
    assert not any(shard.filter.table) and not shard.entries
