"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: one record a page, each its own gzip member, in archives of about ARCHIVE_BYTES in a shared folder. Of records
with equal payloads of at least MIN_REVISIT bytes the one with the largest id is a response, the others revisit it.
Payload digests are counted before any join; the pages themselves are only shuffled when the list of repeated payloads is
larger than BROADCAST_BYTES. A task names its archives anew at each attempt and the manifest lists those of the
attempt that counted, so archives of lost attempts are never read.

Reading: member by member (or record by record where an archive isn't compressed), with gzip check sums, lengths, the
end of a record, block and payload digests checked. After a failure the reader looks for the next gzip magic or version
line, goes on there and logs the bytes between as a quarantined gap. The content of a member is salvaged the same way, by
version lines; a gap in it has the member's place. Of a member that breaks off, the content up to the break is read, and
records whose digest shows that they are whole are kept; the member is logged as a gap besides. A record that reaches the
end of a member cut short by the archive's end counts as cut short too.

Defined results: a null page text has an empty payload; pages that share an id and a repeated payload are responses if
theirs is the largest id; a null id is never the largest, and its page is a response; line breaks in URLs are
percent-encoded, null URLs left out; URLs and texts of any length that fits in a task's memory are written and read whole;
equal rows are a record each; extra columns, whatever their names, are ignored; an empty table writes no archive and reads
back empty; an unreadable archive is one gap, or an error where the manifest's number of records is to be met.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, require, sliced, small

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT = 1000
FIRST, CHUNK = 1 << 12, 1 << 18
LEVEL = 3
#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
MEMBER = re.compile(re.escape(MAGIC))
BLANK_LINE = re.compile(rb"\r?\n\r?\n")
CUT_SHORT = "gzip member is cut short"
START = re.compile(MEMBER.pattern + b"|" + VERSION.pattern)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


# ---------------------------------------------------------------- writing


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("revisit" if refers_to is not None else "response")]
    head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>")
    head += [f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block).hexdigest()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def filesystem(path: str):
    """(file system, path) that Python on an executor can open: local, HDFS and the object stores of Arrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages; the manifest (path, records, bytes) of the archives, a checkpoint."""
    require(pages, id_col, url_col, text_col)
    body = F.coalesce(pages[text_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    repeated = rows.where((F.col("n") >= MIN_REVISIT) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = cut(repeated.select(F.col("digest").alias("key"), "keeper"))
    if small(repeated, "key"):
        met = rows.join(F.broadcast(repeated), F.col("digest") == F.col("key"), "left")
    else:  # short pages keep keys of their own, so none gather in one task; a long repeated payload is split by AQE
        met = rows.withColumn("at", F.when(F.col("n") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat_ws(" ", "digest", F.xxhash64("id", "url").cast("string")))).join(repeated, F.col("at") == F.col("key"), "left")
    refers = F.when(F.col("id") != F.col("keeper"), F.col("keeper"))
    met = met.select(F.col("id").cast("string"), "url", "body", "digest", refers.cast("string").alias("refers"))

    def write(batches):
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name, out, records = None, None, 0
        done = []

        def close():
            size = out.tell()
            out.close()
            done.append((f"{folder}/{name}", records, size))

        for batch in sliced(batches, 2):
            for page_id, url, body, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member(record(page_id, url, body.encode(), digest, to)))
                records += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(met.mapInArrow(write, "path string, records long, bytes long"))


# ---------------------------------------------------------------- reading


class Bytes:
    """Random access to bytes in memory, or to an Arrow file through a window that moves on as it is read, so that a file
    read in order is fetched once. `fetched` counts the bytes taken from the file."""

    def __init__(self, data=None, file=None):
        self.data, self.file = data, file
        self.size = len(data) if file is None else file.size()
        self.at, self.window, self.fetched = 0, b"", 0

    def read(self, start: int, n: int) -> bytes:
        if self.file is None:
            return bytes(self.data[start : start + n])
        n = min(n, max(0, self.size - start))
        end = self.at + len(self.window)
        if not (self.at <= start and start + n <= end):
            kept = self.window[start - self.at :] if self.at <= start <= end else b""
            self.file.seek(start + len(kept))
            got = self.file.read(min(max(n - len(kept), CHUNK), self.size - start - len(kept)))
            self.fetched += len(got)
            self.at, self.window = start, kept + got
        return self.window[start - self.at : start - self.at + n]


def chunks(source: Bytes, start: int) -> Iterator[bytes]:
    """The bytes from start on, in pieces that grow from FIRST to CHUNK: most members and headers are short."""
    n = FIRST
    while chunk := source.read(start, n):
        yield chunk
        start += len(chunk)
        n = min(2 * n, CHUNK)


def inflate(source: Bytes, start: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at start, where it ends, and None; or the content before a failure, where the
    failure is, and what it is."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    for chunk in chunks(source, start):
        try:
            out.append(unpacker.decompress(chunk))
        except zlib.error as error:  # again up to this chunk, and then as far into it as it goes
            again = zlib.decompressobj(31)
            for before in chunks(source, start):
                if at == start:
                    break
                again.decompress(before)
                start += len(before)
            good, n = prefix(again, chunk)
            return b"".join([*out, good]), at + n, str(error)
        at += len(chunk)
        if unpacker.eof:
            return b"".join(out), at - len(unpacker.unused_data), None
    return b"".join(out), at, CUT_SHORT


def prefix(unpacker, chunk: bytes) -> tuple[bytes, int]:
    """What a failing chunk gives before the byte that fails, and where that byte is; found by halving."""
    out, at, end = [], 0, len(chunk)
    while end - at > 1:
        middle, before = (at + end) // 2, unpacker.copy()
        try:
            out.append(unpacker.decompress(chunk[at:middle]))
            at = middle
        except zlib.error:
            unpacker, end = before, middle
    return b"".join(out), at


def parse(source: Bytes, start: int) -> tuple[dict, int]:
    """The uncompressed record at start, and where it ends; ValueError if a check fails."""
    head = source.read(start, FIRST)
    if not (first := VERSION.match(head)):
        raise ValueError("no version line")
    seen = first.end() - 1
    while not (end := BLANK_LINE.search(head, seen)):
        if start + len(head) >= source.size:
            raise ValueError("record header is cut short")
        seen = max(seen, len(head) - 3)
        head += source.read(start + len(head), max(FIRST, len(head)))
    fields = {}
    for line in re.split(rb"\r?\n", head[first.end() : end.start()]):  # not splitlines(): URLs may hold other separators
        if not line:
            continue
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[key.strip().lower()] = value.strip(" \t")
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    at = start + end.end()
    n = int(length)
    if at + n > source.size:
        raise ValueError("record is cut short")
    block = source.read(at, n)
    tail = source.read(at + n, 4)
    if tail != b"\r\n\r\n":
        raise ValueError("record doesn't end where its length says")
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and len(want) == 45 and sha1(block).hexdigest() != want[5:].lower():
        raise ValueError("block digest differs")
    payload, declared = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if found := re.search(rb"(?im)^content-length:\s*([0-9]+)", http):
            declared = int(found[1])
    digest, checked = sha1(payload).hexdigest(), want.startswith("sha1:") and len(want) == 45
    want = fields.get("warc-payload-digest", "")
    stated = want[5:].lower() if want.startswith("sha1:") and len(want) == 45 else None
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        digest, n_payload = stated, declared
    else:
        n_payload = len(payload)
        if stated is not None and stated != digest:
            raise ValueError("payload digest differs")
        checked = checked or stated is not None
    return {"checked": checked, "id": fields.get("x-page-id"), "type": kind, "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": n_payload, "payload_digest": digest, "refers_to": fields.get("x-refers-to-page")}, at + n + 4


def next_start(source: Bytes, start: int, look: re.Pattern = START) -> int:
    """The next match of look, a gzip magic or version line, at or after start."""
    while start < source.size:
        chunk = source.read(start, CHUNK)
        if found := look.search(chunk):
            return start + found.start()
        if start + len(chunk) >= source.size:
            break
        start += len(chunk) - 16
    return source.size


def records_in(data: bytes, broken: str | None) -> Iterator[dict | str]:
    """The records of a member's content, and for each gap between them its reason."""
    source, at, lost = Bytes(data), 0, False
    while at < len(data):
        try:
            fields, end = parse(source, at)
            if broken and not fields["checked"]:
                raise ValueError("record without a digest in a broken gzip member")
            if broken == CUT_SHORT and end == len(data):
                raise ValueError(CUT_SHORT)
        except ValueError as error:
            end = next_start(source, at + 1, VERSION)
            if not lost:
                yield f"{error} (at byte {at} of the content)"
            lost = True
        else:
            yield fields
            lost = False
        at = end


def salvage(source: Bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, fields) and ("gap", start, end, reason), in order; neighbouring gaps are one."""
    at, gap = 0, None
    while at < source.size:
        found: Iterator[dict | str]
        if source.read(at, 3) == MAGIC:
            data, end, broken = inflate(source, at)
            found = records_in(data, broken)
            if broken:  # a member may begin before the failure shows, but what lies before it isn't read twice
                end = min(next_start(source, at + 1, MEMBER), next_start(source, max(end, at + 1)))
                found = chain(found, [broken])
        else:
            try:
                fields, end = parse(source, at)
                found = iter([fields])
            except ValueError as error:
                end = next_start(source, at + 1)
                found = iter([str(error)])
        for what in found:
            if isinstance(what, str):
                gap = (gap[0], end, gap[2]) if gap else (at, end, what)
                continue
            if gap:
                yield ("gap", *gap)
                gap = None
            yield "record", at, end, what
        at = end
    if gap:
        yield ("gap", *gap)


SCHEMA = "kind string, path string, start long, end long, reason string, id string, type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(spark: SparkSession, manifest: DataFrame, path_col: str = "path", with_payload: bool = True, records_col: str | None = None) -> DataFrame:
    """Records and gaps (`kind`) of the archives listed; one task reads an archive from start to end. With records_col, it
    is an error if an archive gives another number of records than its manifest row says."""

    def read(batches):
        for batch in batches:
            for path, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                size = n = 0
                try:
                    store, name = filesystem(path)
                    source = Bytes(file=store.open_input_file(name))
                except OSError as error:
                    if stated is not None:
                        raise
                    yield arrays([("gap", path, 0, None, str(error)[:200], *[None] * 7)])
                    continue
                for kind, start, end, what in salvage(source):
                    if kind == "gap":
                        rows.append((kind, path, start, end, what, *[None] * 7))
                    else:
                        w, n = what, n + 1
                        rows.append((kind, path, start, end, None, w["id"], w["type"], w["url"], w["payload_bytes"], w["payload_digest"], w["refers_to"], w["payload"] if with_payload else None))
                        size += len(w["payload"]) * with_payload
                    if len(rows) >= 2000 or size >= 16 << 20:
                        yield arrays(rows)
                        rows, size = [], 0
                if rows:
                    yield arrays(rows)
                if stated is not None and n != stated:
                    raise ValueError(f"{path}: {n} records read, {stated} written")

    def arrays(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    stated = F.lit(None) if records_col is None else manifest[records_col]
    return manifest.select(path_col, stated.cast("long").alias("_records")).mapInArrow(read, SCHEMA)
