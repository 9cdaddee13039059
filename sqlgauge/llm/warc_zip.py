"""Operator 7: WARC records in ZIP packages, and a reader that unpacks nothing.

A package is a ZIP file whose members are *stored* (not compressed): the archive
``archive/data.warc.gz`` (one gzip member per record) and its index
``indexes/index.cdx`` (one JSON line per record: offset, length, ...). The reader
parses the end-of-central-directory record, its ZIP64 forms and the central
directory itself, finds where the members' bytes start, reads the index and then
single records by their byte ranges.

Equal payloads are found on (page id, digest) alone: one aggregate per digest
(combined before the shuffle), of which only repeated digests are kept and
joined to the pages. The record with the largest page_id is the response;
the others are revisits that name it.

Defined results: a null html is an empty payload; a page without url has no
target header; control characters in a url are percent-encoded; rows that share
the responding page_id are all responses; a row without page_id may only revisit;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm import storage
from sqlgauge.llm.graph import written
from sqlgauge.session import work_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 48 << 20  # compressed records per package, at most (one record alone may be larger)
READ_BYTES = 4 << 20      # neighbouring records are fetched together up to this size
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- records ----

def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(rid: str) -> int | None:
    page = rid.strip("<>").split(":")[2]
    return int(page) if page else None


def _clean_url(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    revisit = refers_to is not None
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean_url(url)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in text.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


@dataclass
class Record:
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    """A record from its bytes; a response's digest is computed and compared."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    h = _headers(top)
    block = rest[:int(h["content-length"])]
    if len(block) != int(h["content-length"]):
        raise ValueError("a WARC record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)["content-length"]), h["warc-payload-digest"].partition(":")[2]
    response = h["warc-type"] == "response"
    if response and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
    return Record(page_of(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"],
                  None if response else page_of(h["warc-refers-to"]), size, digest,
                  payload if response else None)


# ---- packages ----

class PackageWriter:
    """Packages of one task: records gather until a package is full."""

    def __init__(self, folder: str, limit: int = PACKAGE_BYTES):
        self.folder, self.limit, self.done = folder, limit, []
        self._start()

    def _start(self) -> None:
        self.body, self.lines = io.BytesIO(), []

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        digest = digest_of(payload)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(build_record(page_id, url, payload, digest, refers_to)) + pack.flush()
        if self.lines and self.body.tell() + len(member) > self.limit:
            self._close()
        self.lines.append(json.dumps({
            "offset": self.body.tell(), "length": len(member), "filename": DATA.rpartition("/")[2],
            "digest": f"sha1:{digest}", "mime": "warc/revisit" if refers_to is not None else "text/html",
            "url": url}))
        self.body.write(member)

    def _close(self) -> None:
        if self.lines:
            uri = storage.task_file(self.folder, "pages", ".wacz")
            with storage.open_output(uri) as out, zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED) as z:
                z.writestr(DATA, self.body.getbuffer())
                z.writestr(INDEX, "".join(x + "\n" for x in self.lines))
            self.done.append((uri, len(self.lines)))
        self._start()

    def finish(self) -> list[tuple[str, int]]:
        self._close()
        return self.done


class _Stream:
    """What ``zipfile`` needs of a file that can only be written forwards."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


@dataclass
class Member:
    name: str
    start: int
    size: int


class Package:
    """A ZIP package read by ranges. ``source`` has ``size()`` and ``read_at(n, at)``."""

    END = struct.Struct("<4s4H2LH")
    END64 = struct.Struct("<4sQ2H2L4Q")
    FIND64 = struct.Struct("<4sLQL")
    ENTRY = struct.Struct("<4s6H3L5H2L")
    LOCAL = struct.Struct("<4s5H3L2H")

    def __init__(self, source):
        self.source = source
        self.members = {m[0]: m for m in self._directory()}

    def _read(self, at: int, n: int) -> bytes:
        data = self.source.read_at(n, at)
        if len(data) != n:
            raise ValueError("the package ends early")
        return data

    def _end(self) -> tuple[int, int, int]:
        """(entries, size, position) of the central directory."""
        total = self.source.size()
        reach = min(total, self.END.size + 0xFFFF)
        tail = self._read(total - reach, reach)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0:
            if at + self.END.size <= len(tail):
                _, _, _, _, count, size, start, note = self.END.unpack_from(tail, at)
                if at + self.END.size + note == len(tail):
                    break
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        end = total - reach + at
        if end >= self.FIND64.size:
            mark, _, where, _ = self.FIND64.unpack(self._read(end - self.FIND64.size, self.FIND64.size))
            if mark == b"PK\x06\x07":
                head = self.END64.unpack(self._read(where, self.END64.size))
                if head[0] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end record where its locator points")
                return head[7], head[8], head[9]
        return count, size, start

    def _directory(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(name, method, stored size, full size, local header) of each member."""
        count, size, start = self._end()
        data, at = self._read(start, size), 0
        for _ in range(count):
            e = self.ENTRY.unpack_from(data, at)
            if e[0] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method, packed, full = e[3], e[4], e[8], e[9]
            n_name, n_extra, n_note, local = e[10], e[11], e[12], e[16]
            at += self.ENTRY.size
            name = data[at:at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + n_name:at + n_name + n_extra]
            at += n_name + n_extra + n_note
            # ZIP64: 8-byte values, in this order, for each field that is all ones.
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<2H", extra)
                body, extra = extra[4:4 + n], extra[4 + n:]
                if kind == 1:
                    wide = iter(struct.unpack(f"<{len(body) // 8}Q", body[:len(body) // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
            yield name, method, packed, full, local

    def locate(self, name: str) -> Member:
        """Where a stored member's bytes lie."""
        _, method, packed, full, local = self.members[name]
        if method != 0 or packed != full:
            raise ValueError(f"{name} is not stored")
        head = self.LOCAL.unpack(self._read(local, self.LOCAL.size))
        if head[0] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        return Member(name, local + self.LOCAL.size + head[9] + head[10], full)

    def read(self, name: str) -> bytes:
        m = self.locate(name)
        return self._read(m.start, m.size)

    def index(self) -> list[dict]:
        """The index lines of all index members, with the archive member of each."""
        archives = {n.rpartition("/")[2]: n for n in self.members if n.startswith("archive/")}
        out = []
        for name in sorted(n for n in self.members if n.startswith("indexes/")):
            for line in self.read(name).decode().splitlines():
                if line.strip():
                    e = json.loads(line)
                    out.append(e | {"member": archives[e["filename"]]})
        return out

    def records(self) -> Iterator[Record]:
        """All records in index order, by ranges of neighbouring records."""
        places = {n: self.locate(n) for n in self.members if n.startswith("archive/")}
        group: list[dict] = []

        def fetch() -> Iterator[Record]:
            lo = group[0]["offset"]
            data = self._read(places[group[0]["member"]].start + lo,
                              group[-1]["offset"] + group[-1]["length"] - lo)
            for g in group:
                member = data[g["offset"] - lo:g["offset"] - lo + g["length"]]
                yield parse_record(zlib.decompress(member, 31))

        for e in self.index():
            if e["offset"] + e["length"] > places[e["member"]].size:
                raise ValueError("an index line points past its archive")
            if group and (e["member"] != group[0]["member"]
                          or e["offset"] != group[-1]["offset"] + group[-1]["length"]
                          or e["offset"] + e["length"] - group[0]["offset"] > READ_BYTES):
                yield from fetch()
                group = []
            group.append(e)
        if group:
            yield from fetch()

    def record(self, entry: dict) -> Record:
        """One record by its index entry: a single range read."""
        place = self.locate(entry["member"])
        return parse_record(zlib.decompress(self._read(place.start + entry["offset"], entry["length"]), 31))


# ---- Spark jobs ----

def payload_facts(html: Column) -> Column:
    """struct<payload_bytes, digest> of each payload."""
    def run(column: pa.Array) -> pa.Array:
        bodies = [(x or "").encode() for x in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([len(b) for b in bodies], pa.int64()),
             pa.array([digest_of(b) for b in bodies], pa.string())], ["payload_bytes", "digest"])
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<payload_bytes: bigint, digest: string>")(html)


def write_packages(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages; returns the packages (uri, n_records)."""
    spark = pages.sparkSession
    folder = storage.base_folder(spark, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    facts = (rows.select("page_id", payload_facts(F.col("html")).alias("f"))
             .select("page_id", "f.*").where(F.col("payload_bytes") >= min_payload))
    # Written, so that Spark knows its size and broadcasts it only if that is small.
    repeated = written(facts.groupBy("digest").agg(F.max("page_id").alias("keeper"),
                                                   F.count(F.lit(1)).alias("n"))
                       .where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "repeated")
    # Which pages revisit which, without their payloads; then payloads meet them by page, so that
    # a payload of very many pages is no hot key for the payloads themselves.
    revisits = written(facts.join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper")))
                       .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"),
                               F.col("keeper").alias("refers_to")).distinct(), "revisits")
    keyed = rows.withColumn("digest", payload_facts(F.col("html"))["digest"])
    ready = (keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")),
                        "left").select("page_id", "url", "html", "refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = PackageWriter(folder)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                out.add(page_id, url, (html or "").encode(), refers_to)
        cols = list(zip(*out.finish())) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())],
                                         ["uri", "n_records"])

    listing = work_path(spark, "warc-packages")
    ready.mapInArrow(write, "uri string, n_records bigint").write.parquet(listing)
    return spark.read.parquet(listing)


SCHEMA = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, url string")


def read_packages(spark: SparkSession, packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the packages, by index and range reads."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        names += ["payload"] * with_payload
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        held = []
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                for r in Package(storage.open_input(uri)).records():
                    held.append([getattr(r, n) for n in names])
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    n = max(1, packages.count())
    schema = SCHEMA + (", payload binary" if with_payload else "")
    return packages.select("uri").repartition(n).mapInArrow(read, schema)
