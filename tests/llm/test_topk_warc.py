"""Operators 6 and 7 against brute force and the standard library."""

import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile

import numpy as np
import pytest

from pyspark.sql import functions as F
from sqlgauge.llm import exact_topk as TK
from sqlgauge.llm import warc_zip as WZ


# ---- top-k ----

def brute(rows, k, every):
    vec = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in vec if i % every == 0}):
        for qv in [min(tuple(v) for i, v in vec if i == q)]:
            hits = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vec if i != q and len(v) == len(qv))
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(hits[:k])]
    return {q: h for q, h in out.items() if h}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.RandomState(2)
    rows = [(i, [float(x) for x in rng.randint(-3, 4, 6) / 8]) for i in range(300)]  # many ties
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    rows += [(1000, None), (1005, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1010, [float("nan")] * 6), (1015, [float("inf")] * 6),
             (None, rows[3][1]), (1020, [0.5, 0.25]), (1021, [0.5, 0.125]), (7, rows[8][1]), (2000, [3e30] * 6)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k_equals_brute_force(spark, vectors, k, monkeypatch):
    monkeypatch.setattr(TK, "FAN", 2)
    rows = [r for r in vectors if r[0] != 2000]
    df = (spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(7)
          .withColumn("rank", F.lit("x")).withColumn("score", F.lit("y")))
    got = {}
    for r in TK.top_k(df, F.col("vec_id") % 5 == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(h) for q, h in got.items()} == brute(rows, k, 5)


def test_tiles_chunks_and_blocks_do_not_change_results(spark, vectors, monkeypatch):
    rng = np.random.RandomState(4)
    q, c = rng.randint(-9, 9, (30, 8)).astype(float), rng.randint(-9, 9, (500, 8)).astype(float)
    ids = np.arange(500)
    whole = TK.search_block(ids[:30], q, ids, c, 5)
    monkeypatch.setattr(TK, "TILE", 13)
    for a, b in zip(whole, TK.search_block(ids[:30], q, ids, c, 5)):
        assert np.array_equal(a, b)


def test_products_are_exact_at_every_size():
    for most in (3, 2**20, 2**40, 2**60):
        q, c = np.array([[most, -most + 1, 1]], float), np.array([[1, most, 5], [-2, 3, most]], float)
        want = [[max(-2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in c] for x in q]
        assert TK.products(q, c).tolist() == want


def test_top_k_of_empty_and_unusable_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(0, None)], [(0, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert TK.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") % 50 == 0, 5).count() == 0


# ---- packages ----

PAGES = [(1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, "http://a/3 x\n", "<p>same</p>"),
         (2, None, None), (4, "http://a/4", ""), (6, "http://a/6", "é" * 100_000), (7, "http://a/7", "one\r\n\r\ntwo"),
         (5, "http://a/5", "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (8, "http://ä/8", "\x00\x1f")]


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        refers = top if len(body) >= least and top is not None and top != i else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_packages_round_trip(spark, least):
    df = (spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
          .withColumn("digest", F.lit("x")).withColumn("refers_to", F.lit("y")))
    packages = WZ.write_packages(df, least)
    got = WZ.read_packages(spark, packages, with_payload=True).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == expected(PAGES, least)
    html = {(i, len((h or "").encode())): (h or "").encode() for i, _, h in PAGES}
    for r in got:
        assert r.payload == (html[r.page_id, r.payload_bytes] if r.record_type == "response" else None)
        assert r.url is None or not any(c in r.url for c in " \r\n")


def test_empty_pages(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert WZ.read_packages(spark, WZ.write_packages(df)).count() == 0


class Bytes:
    """A source that counts what is read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += n
        return self.data[at:at + n]


def package(monkeypatch, tmp_path, n=300, limit=1 << 30, **zip_options):
    out = WZ.PackageWriter(f"file://{tmp_path}", limit)
    for k in range(n):
        out.add(k, f"http://x/{k}", f"page {k} ".encode() * 200, None)
    return [open(u.removeprefix("file://"), "rb").read() for u, _ in out.finish()]


def test_members_are_stored_and_standard(monkeypatch, tmp_path):
    data, = package(monkeypatch, tmp_path, 20)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        body = z.read(WZ.DATA)
    assert gzip.decompress(body).count(b"WARC/1.1\r\n") == 20
    assert [r.page_id for r in WZ.Package(Bytes(data)).records()] == list(range(20))


def test_one_record_reads_one_range(monkeypatch, tmp_path):
    data, = package(monkeypatch, tmp_path)
    source = Bytes(data)
    p = WZ.Package(source)
    entry = p.index()[123]
    before = source.read
    assert p.record(entry).page_id == 123
    assert source.read - before <= entry["length"] + 30


def test_packages_are_split_by_size(monkeypatch, tmp_path):
    parts = package(monkeypatch, tmp_path, 50, limit=1000)
    assert len(parts) > 5
    assert [r.page_id for d in parts for r in WZ.Package(Bytes(d)).records()] == list(range(50))


def test_zip64_directories(monkeypatch, tmp_path):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    data, = package(monkeypatch, tmp_path, 5)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert [r.page_id for r in WZ.Package(Bytes(data)).records()] == list(range(5))


def test_comments_and_false_end_marks(monkeypatch, tmp_path):
    data, = package(monkeypatch, tmp_path, 3)
    note = b"PK\x05\x06 a note " * 5
    end = data.rfind(b"PK\x05\x06")
    data = data[:end + 20] + struct.pack("<H", len(note)) + note
    assert [r.page_id for r in WZ.Package(Bytes(data)).records()] == [0, 1, 2]


def test_broken_packages_raise(monkeypatch, tmp_path):
    data, = package(monkeypatch, tmp_path, 3)
    with pytest.raises(ValueError):
        WZ.Package(Bytes(data[:-30]))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(WZ.DATA, b"x" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        WZ.Package(Bytes(packed.getvalue())).locate(WZ.DATA)
    raw = WZ.build_record(1, "u", b"body", WZ.digest_of(b"body"), None)
    with pytest.raises(ValueError, match="differs"):
        WZ.parse_record(raw.replace(b"body", b"BODY"))
