"""Operator 5: token ids as binary shards, one zstandard frame per document.

One dictionary, trained on a bounded sample of serialized id arrays, is shared
by all documents; each document is compressed by itself, so a short one can be
read alone. A shard is::

    magic (8) | id width (4) | dictionary SHA-256 (32) | frames | index | footer

The index holds doc_id, frame offset and token count of each document; the
footer holds the index position, the document count and the magic again.
Shards follow ascending doc_id, and documents inside a shard do too.

Texts are encoded by the tokenizers library. Byte-level BPE encodes pre-tokens
independently, so each distinct pre-token of a block is given to the library
once and its ids are reused; other tokenizer files encode whole texts.

Defined results: a null text is an empty text (its ids are the end id alone); an
empty table gives no shard and no rows; equal doc_ids keep a row each, in order
of their frames; a null doc_id comes first; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm.byte_split import ByteSplitter, SpanEncoder, splits_by_bytes
from sqlgauge.session import work_path

MAGIC = b"SGTOKID1"
HEAD = struct.Struct("<8sI32s")
FOOT = struct.Struct("<QQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u4")])

SAMPLE_DOCS = 1000            # documents whose ids train the dictionary
SAMPLE_BYTES = 8 << 20        # and their serialized bytes together, at most
DICT_BYTES = 64 << 10
DOCS_PER_SHARD = 65_536
LEVEL = 3

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """ids of many texts by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.splitter = ByteSplitter(path) if splits_by_bytes(spec) else None
        self.bank = V.SpanBank(SpanEncoder(self.library), by_arrays=True)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """The id array of each row."""
        for lo, hi in V.blocks(off):
            data, o = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            if self.splitter is None:
                texts = [data[a:b].tobytes().decode() for a, b in zip(o[:-1], o[1:])]
                for e in self.library.encode_batch(texts, add_special_tokens=False):
                    yield np.array(e.ids, dtype=np.int64)
                continue
            starts, ends, before, _, _ = self.splitter.cut(data, o)
            at, size = self.bank.lookup(data, V.prefix_hash(data), starts, ends)
            ids = self.bank.values[V.ranges(at, size)]
            cut = np.concatenate([[0], np.cumsum(size)])[before]
            for a, b in zip(cut[:-1], cut[1:]):
                yield ids[a:b]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str,
                     end_id: int) -> bytes:
    """A dictionary from at most SAMPLE_DOCS documents (the smallest id hashes).

    Too little data to train on gives an empty dictionary, which compresses
    without one.
    """
    import zstandard
    pick = (docs.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id")
            .limit(SAMPLE_DOCS).distinct())
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(pick), "_id", "left_semi")  # at most SAMPLE_DOCS ids
            .orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
            .select(frames(F.col("_text"), tokenizer, end_id, None).alias("f"))
            .select("f.frame"))
    samples, total = [], 0
    for row in rows.toLocalIterator():
        if total + len(row.frame) <= SAMPLE_BYTES:
            samples.append(bytes(row.frame))
            total += len(row.frame)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    import zstandard
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))


def _decompressor(dictionary: bytes):
    import zstandard
    if not dictionary:
        return zstandard.ZstdDecompressor()
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def frames(text: Column, tokenizer: str, end_id: int, dictionary: bytes | None) -> Column:
    """struct<n_tokens, frame>: each text's ids with the end id, serialized
    little-endian and compressed (not compressed if ``dictionary`` is None)."""
    def run(column: pa.Array) -> pa.Array:
        enc = encoder(tokenizer)
        kind = np.dtype(f"<u{enc.width}")
        pack = None if dictionary is None else _compressor(dictionary).compress
        raw, off = V.text_bytes(column)
        out, n = [], []
        for ids in enc.encode(raw, off):
            body = np.append(ids, end_id).astype(kind).tobytes()
            out.append(pack(body) if pack else body)
            n.append(len(ids) + 1)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                                          ["n_tokens", "frame"])
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<n_tokens: bigint, frame: binary>")(text)


@dataclass
class Store:
    """A written store: its shards (uri, token position of the first document, counts)."""

    folder: str
    dictionary: str
    shards: list[tuple[str, int, int, int]]  # uri, tokens before, documents, tokens


def write_store(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD) -> Store:
    """Encode and write ``docs`` in ascending id order; returns the store's shards.

    Shard bounds are id quantiles, found on the id column alone; only compressed
    frames are shuffled.
    """
    import hashlib
    spark = docs.sparkSession
    folder = storage.base_folder(spark, "token-store")
    dictionary = train_dictionary(docs, tokenizer, id_col, text_col, end_id)
    dict_uri = f"{folder}/dictionary.zdict"
    storage.write_bytes(dict_uri, dictionary)
    digest = hashlib.sha256(dictionary).digest()

    rows = docs.count()
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-rows // docs_per_shard), min(rows, floor))
    points = [i / n for i in range(1, n)]
    bounds = (docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), points, 100 * n)).first()[0]
              if points else None) or []
    cuts = np.unique(np.array(bounds, dtype=np.int64))

    def bucket_of(column: pa.Array) -> pa.Array:
        ids = np.asarray(column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
        return pa.array(np.searchsorted(cuts, ids, side="left").astype(np.int32))
    bucket_of.__annotations__ = {"column": pa.Array, "return": pa.Array}

    frame = frames(F.col(text_col), tokenizer, end_id, dictionary)
    ready = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), frame.alias("f"))
             .select("doc_id", "f.n_tokens", "f.frame",
                     F.arrow_udf(bucket_of, "int")(F.col("doc_id")).alias("shard"))
             .repartitionById(len(cuts) + 1, F.col("shard"))
             .sortWithinPartitions("shard", "doc_id", "frame"))
    width = encoder(tokenizer).width

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ShardWriter(folder, width, digest)
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for k in np.unique(shards).tolist():
                out.add(k, batch.filter(pa.array(shards == k)))
        yield out.finish()

    listing = work_path(spark, "token-store-shards")
    (ready.mapInArrow(write, "shard int, uri string, n_docs bigint, n_tokens bigint")
     .write.parquet(listing))
    shards, before = [], 0
    # One row per shard: the driver needs no more than a file listing would give it.
    for s in spark.read.parquet(listing).orderBy("shard").toLocalIterator():
        shards.append((s.uri, before, s.n_docs, s.n_tokens))
        before += s.n_tokens
    return Store(folder, dict_uri, shards)


class ShardWriter:
    """Writes the shards of one task; rows come shard by shard, in id order."""

    def __init__(self, folder: str, width: int, digest: bytes):
        self.folder, self.width, self.digest = folder, width, digest
        self.out, self.shard, self.done = None, None, []

    def _open(self, shard: int) -> None:
        self.shard, self.index, self.position = shard, [], HEAD.size
        self.uri = storage.task_file(self.folder, f"shard-{shard:07d}", ".tok")
        self.out = storage.open_output(self.uri)
        self.out.write(HEAD.pack(MAGIC, self.width, self.digest))

    def _close(self) -> None:
        if self.out is None:
            return
        table = np.concatenate(self.index)
        self.out.write(table.tobytes())
        self.out.write(FOOT.pack(self.position, len(table), MAGIC))
        self.out.close()
        self.done.append((self.shard, self.uri, len(table), int(table["n_tokens"].sum(dtype=np.int64))))
        self.out = None

    def add(self, shard: int, rows: pa.RecordBatch) -> None:
        if shard != self.shard:
            self._close()
            self._open(shard)
        blobs = rows.column("frame").to_pylist()
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs))
        self.out.write(b"".join(blobs))
        entry = np.zeros(len(blobs), dtype=INDEX)
        entry["no_id"] = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        entry["doc_id"] = rows.column("doc_id").fill_null(0).to_numpy()
        entry["offset"] = self.position + np.cumsum(sizes) - sizes
        entry["n_tokens"] = rows.column("n_tokens").to_numpy()
        self.index.append(entry)
        self.position += int(sizes.sum())

    def finish(self) -> pa.RecordBatch:
        """One row per shard written."""
        self._close()
        cols = list(zip(*self.done)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()),
             pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
            ["shard", "uri", "n_docs", "n_tokens"])


class ShardReader:
    """Random access to one shard: index first, then single frames."""

    def __init__(self, uri: str, dictionary: bytes):
        import hashlib
        self.file = storage.open_input(uri)
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        size = self.file.size()
        where, count, tail = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri}: not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, where), dtype=INDEX)
        self.ends = np.append(self.index["offset"][1:], where).astype(np.int64)
        self._unpack = _decompressor(dictionary).decompress

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: one range read."""
        at = int(self.index["offset"][k])
        body = self._unpack(self.file.read_at(int(self.ends[k]) - at, at))
        return np.frombuffer(body, dtype=f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray:
        ids = self.index["doc_id"]
        k = int(np.searchsorted(ids, doc_id))
        if k == len(ids) or ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.document(k)


def read_store(spark: SparkSession, store: Store, with_ids: bool = False) -> DataFrame:
    """Rows from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if with_ids else ""
    dictionary = storage.read_bytes(store.dictionary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(uri, dictionary)
                for lo in range(0, len(shard.index), 1000):
                    part = shard.index[lo:lo + 1000]
                    n = part["n_tokens"].astype(np.int64)
                    crc, ids = [], []
                    for k in range(lo, lo + len(part)):
                        got = shard.document(k)
                        if len(got) != n[k - lo]:
                            raise ValueError(f"{uri}: document {k} has {len(got)} ids")
                        crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                        if with_ids:
                            ids.append(got.astype(np.int64))
                    cols = [pa.array(part["doc_id"].astype(np.int64), mask=part["no_id"].astype(bool)),
                            pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())]
                    start += int(n.sum())
                    if with_ids:
                        cols.append(pa.array(ids, pa.list_(pa.int64())))
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.createDataFrame([(u, s) for u, s, _, _ in store.shards], "uri string, start bigint")
    return files.repartition(max(1, len(store.shards))).mapInArrow(read, schema)
