"""WARC records in ZIP packages: write, and read by ranges without extraction.

Writing: one record for each page. Of pages with equal payloads the one with
the smallest id is a ``response``, the others are ``revisit`` records that refer
to it and carry its HTTP header only. Each task writes one package with two
stored members: ``archive/data.warc.gz`` (each record a gzip member of its own, as
usual for WARC) and ``indexes/index.cdxj`` (a line for each record: id, type,
offset and length in the archive member). Directories are written as ZIP64. A package has a name of its own for each attempt, and only
the manifest that the job commits names packages, so lost executors and second
attempts leave no doubt which count.

Reading: the end record, the ZIP64 locator and end record, and the central
directory give the members; the index member gives records' places; records
are then read by range, in parallel, wherever they are. Payload digests are
checked.

Edge cases: a null html is an empty payload; a null url is left out and line
breaks in it are percent-encoded; null ids come back null (the least long
stands for them inside); of rows equal in id and payload one is the response
(least url first) and the others revisit it; payloads below ``min_bytes`` are
all responses; empty tables give empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches, input_bytes, new_path, partitions_for, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
NO_PAGE = -(1 << 63)
#: Effort of the records' compression.
LEVEL = 4
#: Bytes of records that one reading task takes at a time.
RANGE_BYTES = 32 << 20

# Fixed values of the ZIP format: signatures, and what says "see ZIP64".
LOCAL, CENTRAL, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x08074B50
END64, LOCATOR64, END = 0x06064B50, 0x07064B50, 0x06054B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED = 0


class Packager:
    """Writes stored members one after another to a stream, then the directory."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def open(self, name: str) -> None:
        """Sizes follow the data (flag 3), as 64-bit numbers."""
        raw = name.encode()
        self.name, self.start, self.crc, self.size = raw, self.at, 0, 0
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, STORED, 0, 33, 0, FULL32, FULL32, len(raw), 20) + raw
                  + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, raw: bytes) -> None:
        self.crc, self.size = zlib.crc32(raw, self.crc), self.size + len(raw)
        self._put(raw)

    def close_member(self) -> None:
        self._put(struct.pack("<IIQQ", DESCRIPTOR, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def finish(self) -> None:
        start = self.at
        for name, crc, size, at in self.members:
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, STORED, 0, 33, crc, FULL32, FULL32, len(name), 28, 0, 0, 0, 0, FULL32)
                      + name + struct.pack("<HHQQQ", 1, 24, size, size, at))
        size, end64, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of the stored members of a package."""
    tail_at = max(0, size - 22 - FULL16)
    tail = _read(f, tail_at, size - tail_at)
    k = tail.rfind(struct.pack("<I", END))
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    at = tail_at + k
    if FULL32 in (length, start) or count == FULL16:
        mark, _, end64, _ = struct.unpack("<IIQI", _read(f, at - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        head = struct.unpack("<IQHHIIQQQQ", _read(f, end64, 56))
        if head[0] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = head[7:10]
    raw, out, p = _read(f, start, length), {}, 0
    for _ in range(count):
        h = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, p)
        if h[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_note, place = h[4], h[8], h[9], h[10], h[11], h[12], h[16]
        name = raw[p + 46:p + 46 + n_name].decode()
        extra, e = raw[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values, those that are full above, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(values) if plain == FULL32 else plain
                packed = next(values) if packed == FULL32 else packed
                place = next(values) if place == FULL32 else place
            e += 4 + n
        if method == STORED:  # only stored members can be read by range
            own_name, own_extra = struct.unpack("<HH", _read(f, place + 26, 4))
            out[name] = (place + 30 + own_name + own_extra, packed)
        p += 46 + n_name + n_extra + n_note
    return out


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int) -> str:
    return f"<urn:page:{page}>"


def record(page: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}",
            "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)"""
    head, rest = raw.split(b"\r\n\r\n", 1)
    h = _headers(head)
    block = rest[:int(h["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size, digest = int(_headers(http)["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"broken record {h['WARC-Record-ID']}")
    page = lambda urn: None if (n := int(urn[10:-1])) == NO_PAGE else n
    return page(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None


def write_packages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The manifest (package, records) of the packages that hold ``pages``."""
    bounded_batches(spark)
    root = new_path(spark, "packages")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page"), "url",
                        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    names = rows.select("page", "digest", F.length("payload").alias("n")).distinct()
    # a null id counts as the largest: it is a response only among nulls
    firsts = names.groupBy("digest").agg(F.min_by("page", F.struct(F.col("page") == NO_PAGE, "page")).alias("first"))
    decided = names.join(firsts, "digest").select("page", "digest", F.when(F.col("n") >= min_bytes, F.col("first")).alias("first"))
    parts = partitions_for(spark, 4 * input_bytes(pages), 64 << 20)
    both = rows.repartition(parts, "page", "digest").join(decided.repartition(parts, "page", "digest"), ["page", "digest"])
    schema = pa.schema([("package", pa.string()), ("records", pa.int64())])

    def run(batches) -> Iterator[dict]:
        place, writer, index, last, out = "", None, [], None, None
        for b in batches:
            for page, digest, url, payload, first in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    fs, path = pafs.FileSystem.from_uri(root)
                    fs.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"
                    place, out = f"{root}/{name}", fs.open_output_stream(f"{path}/{name}")
                    writer = Packager(out)
                    writer.open(ARCHIVE)
                alone = first is None or (page == first and (page, digest) != last)
                last = (page, digest)
                raw = gzip.compress(record(page, url, payload, None if alone else first), LEVEL, mtime=0)
                index.append(json.dumps({"page": page, "type": "response" if alone else "revisit", "offset": writer.size, "length": len(raw)}))
                writer.write(raw)
        if writer is not None:
            writer.close_member()
            writer.open(INDEX)
            writer.write("".join(x + "\n" for x in index).encode())
            writer.close_member()
            writer.finish()
            out.close()
            yield {"package": [place], "records": [len(index)]}

    ordered = both.select("page", "digest", "url", "payload", "first").sortWithinPartitions("page", "digest", "url")
    return stored(spark, ordered.mapInArrow(batch_rows(run, schema), "package string, records long"), "manifest")


def _opened(package: str):
    fs, path = pafs.FileSystem.from_uri(package)
    return fs.open_input_file(path)


def read_packages(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records."""
    places = pa.schema([("package", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
    found = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def locate(batches) -> Iterator[dict]:
        for b in batches:
            for package in b.column(0).to_pylist():
                with _opened(package) as f:
                    members = directory(f, f.size())
                    data, (at, n) = members[ARCHIVE][0], members[INDEX]
                    lines = [json.loads(x) for x in _read(f, at, n).splitlines()]
                yield {"package": [package] * len(lines), "at": [data + x["offset"] for x in lines], "length": [x["length"] for x in lines]}

    def fetch(batches) -> Iterator[dict]:
        f, name = None, None
        for b in batches:
            rows = []
            for package, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if package != name:
                    if f is not None:
                        f.close()
                    f, name = _opened(package), package
                rows.append(parse_record(gzip.decompress(_read(f, at, n))))
            yield dict(zip(found.names, zip(*rows))) if rows else {c: [] for c in found.names}
        if f is not None:
            f.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = manifest.select("package").repartition(parts, "package").mapInArrow(batch_rows(locate, places), "package string, at long, length long")
    ranges = index.withColumn("range", F.floor(F.col("at") / RANGE_BYTES)).repartition(parts, "package", "range").sortWithinPartitions("package", "at")
    return ranges.select("package", "at", "length").mapInArrow(
        batch_rows(fetch, found), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(spark, write_packages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")))
