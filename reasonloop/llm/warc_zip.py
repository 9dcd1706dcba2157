"""WARC records in ZIP-packaged archives: a distributed writer and a range reader.

An archive is a ZIP file of two *stored* (uncompressed) members: ``archive/data.warc.gz``, one
gzip member per WARC record, and ``indexes/index.cdx``, one line per record with its offset
and length in the archive member. Sizes and offsets beyond 32 bits take ZIP64 fields.

* *Writing.* Payloads of ``MIN_DEDUP`` bytes or more that are equal are written once, as the
  response of the largest page id; the other pages become revisits that name it. Each task
  writes its archives under a name of its own attempt and returns what it wrote; only archives
  named in the manifest count, so a lost or repeated task leaves no wrong record.
* *Reading.* ``list_records`` reads only an archive's end record (ZIP64 locator and record where
  present), its central directory and its index member, and makes one row per run of records
  of about ``READ_BYTES``; these rows are dealt over all tasks, and ``read_records`` reads each run
  with one range read. Nothing is extracted, and a task holds one run.

Archives live in the session's shared folder and are opened with ``pyarrow.fs`` by URI. Null
html is an empty payload; a null page id is written as an empty id (a revisit if its payload
has another response, and never the response of others); repeated rows are each a record.
An empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

MIN_DEDUP = 1000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
_END, _END64, _LOC64, _CENTRAL, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


# ---- ZIP container ----------------------------------------------------------------------

class StoredZip:
    """Writes a ZIP of stored members to a stream, one member after the other."""

    def __init__(self, out, most32: int = _MAX32):
        self.out, self.at, self.entries, self.most32 = out, 0, [], most32

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Write a member; returns the offset of its first byte."""
        n = name.encode()
        big = len(data) >= self.most32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _MAX32 if big else len(data)
        head = self.at
        crc = zlib.crc32(data)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(n), len(extra)) + n + extra)
        start = self.at
        self._put(data)
        self.entries.append((n, crc, len(data), head))
        return start

    def close(self) -> int:
        """Write the directory; returns the archive's size."""
        begin = self.at
        for n, crc, size, head in self.entries:
            wide = [x for x in (size, size, head) if x >= self.most32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            s = _MAX32 if size >= self.most32 else size
            h = _MAX32 if head >= self.most32 else head
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, s, s,
                                             len(n), len(extra), 0, 0, 0, 0, h) + n + extra)
        size, count = self.at - begin, len(self.entries)
        if begin >= self.most32 or size >= self.most32 or count >= _MAX16:
            end64 = self.at
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, begin))
            self._put(_LOC64 + struct.pack("<IQI", 0, end64, 1))
        big = begin >= self.most32 or size >= self.most32
        c = min(count, _MAX16)
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, c, c, _MAX32 if big else size, _MAX32 if big else begin, 0))
        return self.at


def read_directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of an archive: name -> (offset of the data, length). ``f`` has ``seek`` and
    ``read``; only the end records, the directory and the local headers are read."""
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("not a ZIP archive: no end record")
    count, length, begin = struct.unpack("<HII", tail[at + 10:at + 20])
    if count == _MAX16 or length == _MAX32 or begin == _MAX32:
        loc = tail.rfind(_LOC64, 0, at)
        if loc < 0:
            raise ValueError("ZIP64 archive without a locator")
        end64 = struct.unpack("<Q", tail[loc + 8:loc + 16])[0]
        f.seek(end64)
        rec = f.read(56)
        if rec[:4] != _END64:
            raise ValueError("ZIP64 end record not found")
        count, length, begin = struct.unpack("<QQQ", rec[32:56])
    f.seek(begin)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, n, x, c, head = struct.unpack("<10xH8xIIHHH8xI", directory[at:at + 46])
        name = directory[at + 46:at + 46 + n].decode()
        extra, k = directory[at + 46 + n:at + 46 + n + x], 0
        while k + 4 <= len(extra):
            tag, ln = struct.unpack("<HH", extra[k:k + 4])
            if tag == 1:
                wide = list(struct.unpack(f"<{ln // 8}Q", extra[k + 4:k + 4 + ln // 8 * 8]))
                plain = wide.pop(0) if plain == _MAX32 else plain
                packed = wide.pop(0) if packed == _MAX32 else packed
                head = wide.pop(0) if head == _MAX32 else head
            k += 4 + ln
        at += 46 + n + x + c
        if method == 0:
            f.seek(head)
            local = f.read(30)
            if local[:4] != _LOCAL:
                raise ValueError("broken local header")
            ln, lx = struct.unpack("<HH", local[26:30])
            out[name] = (head + 30 + ln + lx, packed)
    return out


# ---- WARC records -----------------------------------------------------------------------

def record_uri(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def warc_record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One gzip member; a revisit (``refers_to`` set) carries no payload."""
    kind = "response" if payload is not None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id)}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if payload is None:
        lines += [f"WARC-Refers-To: <{record_uri(refers_to)}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a plain record; header names lower-cased."""
    head, _, rest = data.partition(b"\r\n\r\n")

    def fields(raw: bytes) -> dict[str, str]:
        out = {}
        for line in raw.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            out[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        return out

    warc = fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


# ---- Spark --------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_dedup: int = MIN_DEDUP, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as archives under ``folder``; returns the manifest (path, size)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
                     F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # payloads that occur again, with the page that keeps them; summed before the shuffle
    twins = (p.where(F.col("size") >= min_dedup).groupBy(F.col("digest").alias("d"))
             .agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").drop("n"))
    p = p.join(materialize(twins, "warc-twins").hint("merge"), F.col("digest") == F.col("d"), "left").drop("d")
    p = p.withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") != F.col("keeper")), F.col("keeper"))).drop("keeper")
    p = p.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        done, data, index, at = [], io.BytesIO(), [], 0

        def close() -> None:
            nonlocal data, index, at
            if index:
                c = TaskContext.get()
                name = f"part-{c.partitionId():06d}-{c.taskAttemptId()}-{len(done)}-{uuid.uuid4().hex[:8]}.wacz"
                with system.open_output_stream(f"{base}/{name}") as out:
                    z = StoredZip(out)
                    z.add(DATA, data.getvalue())
                    z.add(INDEX, "".join(index).encode())
                    done.append((f"{folder.rstrip('/')}/{name}", z.close()))
            data, index, at = io.BytesIO(), [], 0

        for b in batches:
            for i, url, page, digest, size, ref in zip(*(b.column(c).to_pylist() for c in
                                                         ("id", "url", "html", "digest", "size", "refers_to"))):
                rec = warc_record(i, url, None if page is None else page.encode(), digest, size, ref)
                data.write(rec)
                index.append(f"{at} {len(rec)} {record_uri(i)}\n")
                at += len(rec)
                if at >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
                                         names=["path", "size"])

    return materialize(p.mapInArrow(run, "path string, size long"), "warc-manifest")


def list_records(archives: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """(path, start, lengths): runs of neighbouring records of about ``read_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist()):
                system, inner = open_fs(path)
                with system.open_input_file(inner) as f:
                    members = read_directory(f, size)
                    origin = members[DATA][0]
                    f.seek(members[INDEX][0])
                    lines = f.read(members[INDEX][1]).decode().splitlines()
                at = np.array([[int(x) for x in line.split(" ", 2)[:2]] for line in lines], np.int64).reshape(-1, 2)
                cuts = np.flatnonzero(np.diff(at[:, 0] // read_bytes, prepend=-1))
                spans = [at[i:j] for i, j in zip(cuts, np.append(cuts[1:], len(at)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(spans), pa.string()), pa.array([origin + int(s[0, 0]) for s in spans], pa.int64()),
                     pa.array([s[:, 1].tolist() for s in spans], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    return archives.select("path", "size").mapInArrow(run, "path string, start long, lengths array<long>")


def read_records(runs: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload); the digest
    of a payload is checked against its header. Revisits have no payload; their size is the
    one their HTTP header names."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def number(uri: str) -> int | None:
            tail = uri.strip("<>").rpartition(":")[2]
            return int(tail) if tail else None

        for b in batches:
            for path, start, lengths in zip(*(b.column(c).to_pylist() for c in ("path", "start", "lengths"))):
                system, inner = open_fs(path)
                with system.open_input_file(inner) as f:
                    f.seek(start)
                    data = f.read(sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    warc, http, payload = parse_record(zlib.decompress(data[at:at + n], 31))
                    at += n
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    kind = warc["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: payload does not match its digest")
                    rows.append((number(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, digest,
                                 number(warc["warc-refers-to"]) if kind == "revisit" else None,
                                 len(payload) if kind == "response" else int(http["content-length"]),
                                 payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return runs.mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, "
                                 "refers_to long, payload_bytes long, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, **how) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads every record back."""
    manifest = write_archives(pages, scratch_path(spark, "warc"), **how)
    runs = materialize(list_records(manifest), "warc-runs")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_records(runs.repartition(tasks, F.xxhash64("path", "start")))
