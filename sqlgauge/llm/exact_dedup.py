"""Operator 11: exact duplicates through a cuckoo-filter index of live digests.

The index is dealt into shards by digest. A shard holds a cuckoo filter (buckets of
four 16-bit fingerprints, two buckets per key), the stored keys (full SHA-256, the
document that stays, how many live documents have the text) and, in a content file,
the normalised text of every key, compressed. Inserting a text whose fingerprint is in
neither bucket makes a new key. A fingerprint that is there is only a hint: the stored
entries of that key are compared, digest first and then the whole content, and what
does not match is a key of its own. When a fingerprint finds no place within MAX_KICKS
moves, the filter doubles and is filled again from the stored keys. Deleting documents
lowers a key's count; at zero its fingerprint leaves the filter.

Texts are normalised, hashed and compressed once; copies inside a task's rows are one
row before the shuffle, so a text that a third of all documents share sends one row
per some thousand copies. A task holds one shard's keys, never its content: rows come
sorted by digest, so equal texts follow one another, and content of earlier versions is
read by offset. Every insertion or deletion writes a new version of the shards it
touches, under names of its own; only names that a finished job lists are read, so lost
executors and repeated tasks leave nothing behind that counts.

Defined results: texts are equal when identical after lower-casing A-Z; a null text is
an empty one, and empty texts are equal to each other; of equal texts the largest doc_id
stays; rows that share a doc_id keep a row each; a row without doc_id counts in its
group and stays only if no row of the group has one; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm import textvec as V
from sqlgauge.llm.graph import fresh, written
from sqlgauge.session import delete_path, work_path

BUCKET = 4             # fingerprints of a bucket
FIRST_BUCKETS = 1024   # of a new filter
MAX_KICKS = 200
SHARD_ROWS = 65_536    # digests of a shard, about; fewer while there are not MANY_SHARDS
SMALL_SHARD, MANY_SHARDS = 8_192, 10_000
HELD_BYTES = 32 << 20  # compressed texts that a task gathers before it hands them on
HELD_ROWS = 20_000
LEVEL = 1

_CAPITALS = bytes(range(65, 91))
_LOWER = bytes.maketrans(_CAPITALS, _CAPITALS.lower())


class CuckooFilter:
    """Fingerprints of 64-bit keys, each in one of two buckets."""

    def __init__(self, buckets: int = FIRST_BUCKETS, table: list[int] | None = None):
        self.mask = buckets - 1
        self.table = table if table is not None else [0] * (buckets * BUCKET)

    def places(self, key: int) -> tuple[int, int, int]:
        """(fingerprint, one bucket, the other); each bucket follows from the other."""
        print_ = (key >> 48) or 1  # 0 stands for an empty place
        one = key & self.mask
        return print_, one, one ^ (print_ * 0x9E3779B1 >> 7 & self.mask)

    def __contains__(self, key: int) -> bool:
        print_, one, two = self.places(key)
        return (print_ in self.table[one * BUCKET:one * BUCKET + BUCKET]
                or print_ in self.table[two * BUCKET:two * BUCKET + BUCKET])

    def _put(self, print_: int, bucket: int) -> bool:
        for k in range(bucket * BUCKET, bucket * BUCKET + BUCKET):
            if not self.table[k]:
                self.table[k] = print_
                return True
        return False

    def insert(self, key: int) -> bool:
        """False if no place was found; the filter must then be filled anew."""
        print_, one, two = self.places(key)
        if self._put(print_, one) or self._put(print_, two):
            return True
        bucket = two
        for kick in range(MAX_KICKS):
            k = bucket * BUCKET + (print_ + kick) % BUCKET
            print_, self.table[k] = self.table[k], print_
            bucket ^= print_ * 0x9E3779B1 >> 7 & self.mask
            if self._put(print_, bucket):
                return True
        return False

    def delete(self, key: int) -> bool:
        """Remove one fingerprint of a key that was inserted."""
        print_, *buckets = self.places(key)
        for b in buckets:
            for k in range(b * BUCKET, b * BUCKET + BUCKET):
                if self.table[k] == print_:
                    self.table[k] = 0
                    return True
        return False

    @property
    def buckets(self) -> int:
        return self.mask + 1


@dataclass
class Entry:
    """A stored key: its digest, what it stands for, and where its content lies."""

    digest: bytes
    keep_id: int | None
    count: int
    n_bytes: int
    uri: str
    offset: int
    size: int


_KEYS = pa.schema([("digest", pa.binary(32)), ("keep_id", pa.int64()), ("count", pa.int64()),
                   ("n_bytes", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()),
                   ("size", pa.int64())])


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


@dataclass
class Shard:
    """The filter and the stored keys of one shard, in a task's memory."""

    folder: str
    filter: CuckooFilter = field(default_factory=CuckooFilter)
    entries: dict[int, list[Entry]] = field(default_factory=dict)
    resizes: int = 0
    false_hits: int = 0

    def __post_init__(self) -> None:
        self._out, self._last = None, (None, b"")

    @classmethod
    def load(cls, folder: str, uri: str | None) -> Shard:
        shard = cls(folder)
        if uri:
            table = pa.ipc.open_stream(storage.read_bytes(uri)).read_all()
            for row in table.to_pylist():
                shard.entries.setdefault(key_of(row["digest"]), []).append(Entry(**row))
            prints = np.frombuffer(table.schema.metadata[b"filter"], dtype="<u2").tolist()
            shard.filter = CuckooFilter(len(prints) // BUCKET, prints)
        return shard

    def _close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None

    def save(self) -> tuple[str, int]:
        """(file of this version, its number of keys)."""
        self._close()
        rows = [vars(e) for es in self.entries.values() for e in es]
        prints = np.array(self.filter.table, dtype="<u2").tobytes()
        table = pa.Table.from_pylist(rows, _KEYS.with_metadata({b"filter": prints}))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        uri = storage.task_file(self.folder, "keys", ".arrow")
        storage.write_bytes(uri, sink.getvalue().to_pybytes())
        return uri, len(rows)

    def content(self, entry: Entry) -> bytes:
        if entry is self._last[0]:
            return self._last[1]
        if self._out is not None and entry.uri == self._uri:
            self._close()  # only a finished file can be read; what follows goes into another
        with storage.open_input(entry.uri) as f:
            return f.read_at(entry.size, entry.offset)

    def _register(self, key: int) -> None:
        """Put a key's fingerprint into the filter; resize from the stored keys while it overflows."""
        if self.filter.insert(key):
            return
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(self.filter.buckets * 2)
            if all(map(self.filter.insert, self.entries)):
                return

    def find(self, digest: bytes, n_bytes: int, content: bytes) -> Entry | None:
        """The stored entry of this very text: the filter's hits are verified."""
        key = key_of(digest)
        if key not in self.filter:
            return None
        for e in self.entries.get(key, ()):
            if e.digest == digest and e.n_bytes == n_bytes:
                stored = self.content(e)
                if stored != content and unpack(stored) != unpack(content):
                    raise ValueError(f"two texts have the SHA-256 {digest.hex()}")
                return e
        self.false_hits += 1
        return None

    def insert(self, digest: bytes, keep_id: int | None, count: int, n_bytes: int, content: bytes) -> None:
        found = self.find(digest, n_bytes, content)
        if found:
            found.keep_id, found.count = larger(found.keep_id, keep_id), found.count + count
            return
        if self._out is None:
            self._uri = storage.task_file(self.folder, "content", ".bin")
            self._out, self._at = storage.open_output(self._uri), 0
        self._out.write(content)
        entry = Entry(digest, keep_id, count, n_bytes, self._uri, self._at, len(content))
        self._at += len(content)
        self._last = entry, content
        key = key_of(digest)
        known = self.entries.setdefault(key, [])
        known.append(entry)
        if len(known) == 1:  # one fingerprint per key
            self._register(key)

    def revise(self, digest: bytes, keep_id: int | None, count: int) -> None:
        """What a key stands for after a deletion; nothing left takes it out of the filter."""
        key = key_of(digest)
        if key not in self.filter:
            raise KeyError(digest.hex())
        known = self.entries[key]
        entry = next(e for e in known if e.digest == digest)
        entry.keep_id, entry.count = keep_id, count
        if count == 0:
            known.remove(entry)
            if not known:
                del self.entries[key]
                self.filter.delete(key)


def unpack(content: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(content)


# One row per document (count null), and one per digest and some rows (count not null).
DIGESTS = "doc_id bigint, digest binary, n_bytes bigint, count bigint, content binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DIGESTS: every document's digest, and the distinct texts of some rows at a time."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    held: dict[bytes, list] = {}
    size = 0

    def batch(ids, digests, lengths, counts, contents) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, digests, lengths, counts, contents),
                                                                          kinds)],
                                          ["doc_id", "digest", "n_bytes", "count", "content"])

    def flush() -> Iterator[pa.RecordBatch]:
        rows = list(held.items())
        for lo in range(0, len(rows), 500):
            part = rows[lo:lo + 500]
            yield batch([v[0] for _, v in part], [d for d, _ in part], [v[2] for _, v in part],
                        [v[1] for _, v in part], [v[3] for _, v in part])

    for b in batches:
        ids = b.column(0).to_pylist()
        raw, off = V.text_bytes(b.column(1))
        found = []
        for k, doc_id in enumerate(ids):
            text = raw[off[k]:off[k + 1]].tobytes().translate(_LOWER)
            digest = hashlib.sha256(text).digest()
            found.append(digest)
            seen = held.get(digest)
            if seen:
                seen[0], seen[1] = larger(seen[0], doc_id), seen[1] + 1
            else:
                held[digest] = [doc_id, 1, len(text), pack(text)]
                size += len(held[digest][3])
                if size >= HELD_BYTES or len(held) >= HELD_ROWS:
                    yield from flush()
                    held, size = {}, 0
        none = [None] * len(ids)
        yield batch(ids, found, np.diff(off), none, none)
    yield from flush()


LISTING = "shard int, uri string, n_keys bigint, buckets bigint, resizes bigint, false_hits bigint"


def _apply(folder: str, uris: dict[int, str], change: str):
    """Rows of whole shards, sorted by shard and digest, are applied; each shard's new version is listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, done = None, None, []

        def close() -> None:
            if shard is not None:
                uri, n = shard.save()
                done.append((current, uri, n, shard.filter.buckets, shard.resizes, shard.false_hits))

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for which, *row in zip(*cols):
                if which != current:
                    close()
                    current, shard = which, Shard.load(folder, uris.get(which))
                getattr(shard, change)(*row)
        close()
        c = list(zip(*done)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[0], pa.int32()), pa.array(c[1], pa.string()), *(pa.array(x, pa.int64()) for x in c[2:])],
            ["shard", "uri", "n_keys", "buckets", "resizes", "false_hits"])
    return run


@dataclass(frozen=True)
class Index:
    """One version of an index: a shard listing (a written table) and its documents' digests."""

    spark: SparkSession
    folder: str
    shards: int
    listing: str | None = None
    members: tuple[str, ...] = ()

    def listed(self) -> DataFrame:
        """One row per shard: file, keys, buckets, and resizes and false hits of the last change."""
        if self.listing is None:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(self.listing)

    def documents(self) -> DataFrame:
        """doc_id, digest of every live document."""
        if not self.members:
            return self.spark.createDataFrame([], "doc_id bigint, digest binary")
        return self.spark.read.schema(DIGESTS).parquet(*self.members).where("count IS NULL").select("doc_id", "digest")

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard")

    def _changed(self, rows: DataFrame, change: str, members: tuple[str, ...]) -> Index:
        # File names of the shards: as many as there are tasks.
        uris = {r.shard: r.uri for r in self.listed().select("shard", "uri").toLocalIterator()}
        dealt = rows.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", "digest")
        new = dealt.mapInArrow(_apply(self.folder, uris, change), LISTING)
        if uris:
            new = written(new, "dedup-changed")
            new = new.unionByName(self.listed().join(new.select("shard"), "shard", "left_anti"))
        path = work_path(self.spark, "dedup-listing")
        new.write.parquet(path)
        return Index(self.spark, self.folder, self.shards, path, members)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """The index with all rows of ``docs``."""
        digests = _digest_rows(docs, id_col, text_col)
        return self._insert(digests)

    def _insert(self, digests: str) -> Index:
        rows = (self.spark.read.schema(DIGESTS).parquet(digests).where("count IS NOT NULL")
                .select(self._shard(), "digest", "doc_id", "count", "n_bytes", "content"))
        return self._changed(rows, "insert", (*self.members, digests))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> Index:
        """The index without the documents whose id is in ``ids`` (ids it does not hold change nothing)."""
        ids = ids.select(F.col(id_col).cast("bigint").alias("doc_id")).distinct()
        here = self.documents()
        path = work_path(self.spark, "dedup-members")
        (here.join(ids, "doc_id", "left_anti")
         .selectExpr("doc_id", "digest", "CAST(NULL AS bigint) n_bytes", "CAST(NULL AS bigint) count",
                     "CAST(NULL AS binary) content").write.parquet(path))
        after = Index(self.spark, self.folder, self.shards, self.listing, (path,))
        gone = here.join(ids, "doc_id", "left_semi").select("digest").distinct()
        left = (after.documents().join(gone, "digest", "left_semi").groupBy("digest")
                .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("count")))
        rows = gone.join(left, "digest", "left").select(
            self._shard(), "digest", "keep_id", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
        return self._changed(rows, "revise", (path,))

    def keys(self) -> DataFrame:
        """digest, keep_id, group_size of every live text, read from the shard files."""
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    table = pa.ipc.open_stream(storage.read_bytes(uri)).read_all()
                    cols = [table["digest"].cast(pa.binary()), table["keep_id"], table["count"]]
                    yield from (pa.Table.from_arrays(cols, ["digest", "keep_id", "group_size"])
                                .combine_chunks().to_batches())
        files = self.listed().select("uri").repartition(max(1, self.shards))
        return files.mapInArrow(read, "digest binary, keep_id bigint, group_size bigint")


def _digest_rows(docs: DataFrame, id_col: str, text_col: str) -> str:
    path = work_path(docs.sparkSession, "dedup-digests")
    (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
     .mapInArrow(_digests, DIGESTS).write.parquet(path))
    return path


def empty_index(spark: SparkSession, shards: int) -> Index:
    return Index(spark, storage.base_folder(spark, "dedup-index"), shards)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    All rows go into a new index, whose keys are then read back.
    """
    spark = docs.sparkSession
    digests = _digest_rows(docs, id_col, text_col)
    rows = spark.read.schema(DIGESTS).parquet(digests).where("count IS NOT NULL").count()
    shards = max(spark.sparkContext.defaultParallelism, min(MANY_SHARDS, -(-rows // SMALL_SHARD)),
                 -(-rows // SHARD_ROWS))
    index = empty_index(spark, shards)._insert(digests)
    # Written, so that Spark joins by the table's true size and the index can go.
    keys = written(index.keys(), "dedup-keys")
    for path in (index.folder, index.listing):
        delete_path(spark, path)
    return (index.documents().join(keys, "digest")
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a larger doc_id of the same text stands for."""
    id_, sha = fresh(docs, "_gone"), fresh(docs, "_sha")
    gone = (exact_duplicates(docs, id_col, text_col).where("NOT kept")
            .select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct())
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _CAPITALS.decode(), _CAPITALS.decode().lower())
    return docs.join(gone, (F.sha2(lower, 256) == F.col(sha))
                     & F.col(id_col).cast("bigint").eqNullSafe(F.col(id_)), "left_anti")
