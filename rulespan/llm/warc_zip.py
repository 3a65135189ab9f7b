"""Web archives packed in ZIP files, read in place.

A package holds stored (uncompressed) members: ``archive/data.warc.gz`` with one gzip member for
each WARC record, and ``indexes/index.cdxj`` with the offset and length of each record.  The reader
parses the end record, the ZIP64 end record where there is one, and the central
directory with its ZIP64 fields; finds where each stored member begins; reads the
indexes; and lets tasks read the ranges of the records that they parse.
Nothing is extracted.  An archive that no index lists is walked record by record, compressed or plain; an index
may be compressed as well.  Of packages by others, response and resource records are pages: the url is WARC-Target-URI, the html
their payload (of HTTP responses after chunks and compression, in the charset that is named, else UTF-8), and page_id is null; other records aren't pages.

Defined cases: page_id is of any type that casts to string and back; a null url or html stays null, an empty html is an empty
payload; repeated pages are records of their own; an empty table gives no package, and no
package no rows. Columns other than page_id, url and html aren't archived.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.shared import open_ranges, read_parquet_dir, ship, work_dir, write_file

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES, TASK_BYTES = 48 << 20, 64 << 20
GZIP = b"\x1f\x8b"
END, END64, LOCATOR64, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
DATE = "2024-01-01T00:00:00Z"


class BadPackage(ValueError):
    """The file isn't a ZIP file that can be read in place."""


# --- writing


def warc_record(page_id: str | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"X-Page: {json.dumps([page_id, url, html is None])}", f"Content-Length: {len(http) + len(body)}"]
    if url is not None and "\n" not in url and "\r" not in url:
        head.append(f"WARC-Target-URI: {url}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def zip_stored(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """A ZIP file of stored members, in parts. zip64: with ZIP64 fields even where they aren't needed."""
    out, central, at = [], [], 0
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        big = zip64 or size >= FULL32 or at >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        small = FULL32 if big else size
        local = struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(more), 0, 0, 0, 0, FULL32 if big else at) + raw + more)
        out += [local, *parts]
        at += len(local) + size
    directory = b"".join(central)
    n, big = len(members), zip64 or at >= FULL32 or len(members) >= FULL16
    out.append(directory)
    if big:
        out.append(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(directory), at))
        out.append(struct.pack("<IIQI", LOCATOR64, 0, at + len(directory), 1))
    out.append(struct.pack("<IHHHHIIH", END, 0, 0, FULL16 if big else n, FULL16 if big else n, FULL32 if big else len(directory), FULL32 if big else at, 0))
    return out


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Packs page_id, url and html; returns a table of the packages (path). Each task writes its own, whole or not at all."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or work_dir(spark, "warc")

    def run(batches):
        from pyspark import TaskContext

        task, seq, held, index, at = TaskContext.get().taskAttemptId(), 0, [], [], 0

        def flush():
            nonlocal seq, held, index, at
            path = f"{folder}/{task}-{seq}.wacz"
            write_file(path, zip_stored([(ARCHIVE, held), (INDEX, ["".join(index).encode()])], zip64))
            seq, held, index, at = seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for b in batches:
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                record = gzip.compress(warc_record(page, url, html), 6, mtime=0)
                index.append(f"{page} 20240101000000 {json.dumps({'url': url, 'filename': ARCHIVE, 'offset': at, 'length': len(record)})}\n")
                held.append(record)
                at += len(record)
                if at >= package_bytes:
                    yield flush()
        if held:
            yield flush()

    chosen = pages.select(pages["page_id"].cast("string").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return read_parquet_dir(spark, chosen.mapInArrow(run, "path string"), f"{work_dir(spark, 'warc-files')}/files")


# --- directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    offset: int  # of its data
    size: int


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    out = f.read(n)
    if len(out) != n:
        raise BadPackage(f"{n} bytes wanted at {at}, {len(out)} there")
    return out


def zip64_fields(extra: bytes, wanted: list[bool]) -> list[int]:
    """The 64-bit values of a ZIP64 extra field, for those fields that are full in the header."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            if n < 8 * sum(wanted):
                raise BadPackage("a ZIP64 field is too short")
            return [struct.unpack_from("<Q", extra, at + 4 + 8 * k)[0] for k in range(sum(wanted))]
        at += 4 + n
    if any(wanted):
        raise BadPackage("a ZIP64 field is missing")
    return []


def members(f) -> list[Member]:
    """From the end record, the ZIP64 end record and the central directory."""
    f.seek(0, 2)
    length = f.tell()
    tail_at = max(0, length - 22 - FULL16)
    tail = read_at(f, tail_at, length - tail_at)
    k = len(tail)
    while True:
        k = tail.rfind(struct.pack("<I", END), 0, k)
        if k < 0:
            raise BadPackage("no end record")
        if len(tail) - k >= 22 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
            break
        k += 3
    n, size, at = struct.unpack_from("<HII", tail, k + 10)
    if n == FULL16 or size == FULL32 or at == FULL32:
        kind, _, end64, _ = struct.unpack("<IIQI", read_at(f, tail_at + k - 20, 20))
        if kind != LOCATOR64:
            raise BadPackage("no ZIP64 locator")
        kind, *_, n, size, at = struct.unpack("<IQHHIIQQQQ", read_at(f, end64, 56))
        if kind != END64:
            raise BadPackage("no ZIP64 end record")
    directory, p, out = read_at(f, at, size), 0, []
    for _ in range(n):
        if len(directory) - p < 46:
            raise BadPackage("the central directory ends early")
        kind, _, _, _, method, _, _, _, packed, full, ln, le, lc, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
        if kind != CENTRAL:
            raise BadPackage("no central header")
        name = directory[p + 46 : p + 46 + ln].decode()
        wanted = [full == FULL32, packed == FULL32, where == FULL32]
        big = iter(zip64_fields(directory[p + 46 + ln : p + 46 + ln + le], wanted))
        full, packed, where = (next(big) if w else x for w, x in zip(wanted, (full, packed, where)))
        head = read_at(f, where, 30)
        if struct.unpack_from("<I", head)[0] != LOCAL:
            raise BadPackage("no local header")
        a, b = struct.unpack_from("<HH", head, 26)
        out.append(Member(name, method, where + 30 + a + b, packed))
        p += 46 + ln + le + lc
    return out


def records_of(path: str) -> list[tuple[str, int, int]]:
    """(path, offset in the package, length) of all records, from the index or by walking the archive."""
    with open_ranges(path) as f:
        found = {m.name: m for m in members(f)}
        archives = {n: m for n, m in found.items() if n.startswith("archive/")}
        if bad := [n for n, m in archives.items() if m.method != 0]:
            raise BadPackage(f"{bad[0]} is compressed as a whole")
        out, listed = [], set()
        for name, m in found.items():
            if name.startswith("indexes/") and m.method == 0:
                text = read_at(f, m.offset, m.size)
                for line in (gzip.decompress(text) if text[:2] == GZIP else text).decode().splitlines():
                    if "{" not in line:
                        continue
                    entry = json.loads(line[line.index("{") :])
                    if not {"filename", "offset", "length"} <= set(entry):
                        continue
                    where, at, n = str(entry["filename"]), int(entry["offset"]), int(entry["length"])
                    where = where if where in archives else f"archive/{where}"
                    if at + n > archives[where].size:
                        raise BadPackage("the index points behind the archive")
                    listed.add(where)
                    out.append((path, archives[where].offset + at, n))
        for name, m in archives.items():
            if name not in listed:
                out += [(path, m.offset + a, n) for a, n in walk(f, m)]
        return out


def walk(f, m: Member, step: int = 1 << 16):
    """(offset, length) of each record in an archive: its gzip members, or by the lengths that plain records name."""
    at = 0
    while at < m.size:
        start = read_at(f, m.offset + at, min(step, m.size - at))
        if start[:2] != GZIP:
            while b"\r\n\r\n" not in start:
                more = read_at(f, m.offset + at + len(start), min(step, m.size - at - len(start)))
                if not more:
                    raise BadPackage("a record is cut off")
                start += more
            head, _, _ = start.partition(b"\r\n\r\n")
            used = len(head) + 4 + int(header_fields(head)["content-length"]) + 4
            if at + used > m.size:
                raise BadPackage("a record is cut off")
            yield at, used
            at += used
            continue
        d, used = zlib.decompressobj(31), 0
        while not d.eof:
            chunk = read_at(f, m.offset + at + used, min(step, m.size - at - used))
            if not chunk:
                raise BadPackage("a record is cut off")
            d.decompress(chunk)
            used += len(chunk)
        used -= len(d.unused_data)
        yield at, used
        at += used


def header_fields(head: bytes) -> dict[str, str]:
    """Names in small letters; the first line, which is no field, is left out."""
    fields = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def http_payload(block: bytes) -> str:
    """The body of an HTTP response as text."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = header_fields(head)
    if fields.get("transfer-encoding", "").lower() == "chunked":
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:  # saved without its chunks
                parts = [body]
                break
            if n == 0:
                break
            parts.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(parts) or (body if body[:1] != b"0" else b"")
    coding = fields.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47 if "gzip" in coding else 15)
        except zlib.error:  # saved without its compression
            pass
    return decoded(body, fields.get("content-type", ""))


def decoded(body: bytes, kind: str) -> str:
    charset = kind.lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def parse_record(data: bytes) -> tuple | None:
    """(page_id as a string, url, html), or None of a record that isn't a page."""
    head, _, rest = (gzip.decompress(data) if data[:2] == GZIP else data).partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = rest[: int(fields["content-length"])]
    if own := fields.get("x-page"):
        page, url, no_html = json.loads(own)
        return page, url, None if no_html else block.partition(b"\r\n\r\n")[2].decode()
    kind, url = fields.get("warc-type"), fields.get("warc-target-uri", "").strip("<>")
    if kind == "response" and "http" in fields.get("content-type", "application/http"):
        return None, url, http_payload(block)
    return (None, url, decoded(block, fields.get("content-type", ""))) if kind == "resource" else None


def read_packages(spark: SparkSession, packages: DataFrame | list[str], page_type: str = "long", group_bytes: int = 4 << 20) -> DataFrame:
    """page_id, url, html of all records. packages: a table of paths, or a list. Directories are read first, so that what there is
    to read is known and written down, then ranges are spread over tasks by their bytes; neighbouring ranges of a package are read at once."""
    ship(spark)

    def index(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                groups, size, first = [], 0, None
                for _, at, n in sorted(records_of(path)):
                    if first is None or size >= group_bytes:
                        first, size = at, 0
                        groups.append([])
                    groups[-1].append((at, n))
                    size += n
                cols = pa.array([path] * len(groups), pa.string()), *(pa.array([[x[k] for x in g] for g in groups], pa.list_(pa.int64())) for k in (0, 1)), pa.array([sum(n for _, n in g) for g in groups], pa.int64())
                yield pa.RecordBatch.from_arrays(list(cols), names=["path", "at", "n", "bytes"])

    def load(batches):
        for b in batches:
            for path, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "at", "n"))):
                rows = []
                with open_ranges(path) as f:
                    k = 0
                    while k < len(at):
                        e = k
                        while e + 1 < len(at) and at[e + 1] == at[e] + n[e]:
                            e += 1
                        data = read_at(f, at[k], at[e] + n[e] - at[k])
                        found = (parse_record(data[at[j] - at[k] : at[j] - at[k] + n[j]]) for j in range(k, e + 1))
                        rows += [r for r in found if r is not None]
                        k = e + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["page_id", "url", "html"])

    if isinstance(packages, list):
        packages = spark.createDataFrame([(p,) for p in packages], "path string")
    cores, count = spark.sparkContext.defaultParallelism, packages.count()
    tasks = max(1, min(count, max(cores * 4, count // 16)))
    ranges = packages.select("path").repartition(tasks).mapInArrow(index, "path string, at array<long>, n array<long>, bytes long")
    ranges = read_parquet_dir(spark, ranges, f"{work_dir(spark, 'warc-ranges')}/ranges")
    total = ranges.agg(F.sum("bytes")).collect()[0][0] or 0
    slices = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    rows = ranges.drop("bytes").repartition(slices, F.col("path"), F.col("at")).mapInArrow(load, "page_id string, url string, html string")
    return rows.withColumn("page_id", F.col("page_id").cast(page_type))


def through_packages(pages: DataFrame) -> DataFrame:
    """page_id, url and html, written to packages and read back by ranges."""
    return read_packages(pages.sparkSession, write_packages(pages), pages.schema["page_id"].dataType.simpleString())
