"""WARC archives: a writer with revisit records, and a splittable reader.

The writer makes one gzip member for each record and one file for each partition, under a name of its own for each
attempt; only files whose task reported success are read. The reader gives each task a byte range. It looks for the
gzip magic, tests a candidate by decoding its record, walks on from member to member, and owns the records that start
inside its range. A walk that does not reach the end of the range through whole members began inside a payload or met
damage; which of the two is settled by a walk from the begin of the file.

Damage costs the members that it touches: the walk goes on at the next member that decodes to a record, and the bytes
between are reported as a span. A payload that holds an archive longer than a range, stored without compression, cannot
be told from the archive itself by a task whose range begins in it; neither can one in a damaged member.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm.common import saved, scratch_path, small_batches

MAGIC = b"\x1f\x8b\x08"
#: Namespace of our record ids: the upper half of their UUIDs.
SPACE = 0x7B1D5C3A9E824F60
REVISIT_LEAST = 1000
#: Recurring digests (about 100 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(SPACE << 64) | (page_id & (2**64 - 1)))}>"


def page_of(record: str | None) -> int | None:
    if not record or not record.startswith("<urn:uuid:"):
        return None
    n = uuid.UUID(record[10:-1]).int
    low = n & (2**64 - 1)
    return (low - 2**64 if low >= 2**63 else low) if n >> 64 == SPACE else None


def sha1_label(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record as a gzip member. refers: the page whose equal payload is stored, else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {record_id(page_id)}" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>")
    head.append("WARC-Date: 2024-01-01T00:00:00Z")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: {sha1_label(digest)}")
    head.append(f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).hexdigest())}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Parsed(NamedTuple):
    headers: dict[str, str]
    payload_length: int | None
    payload: bytes


def parse(data: bytes) -> Parsed | None:
    """The record in a member's bytes, None if they are not one."""
    if not data.startswith(b"WARC/"):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    block = rest[: int(length)]
    http, found, payload = block.partition(b"\r\n\r\n")
    if "application/http" not in headers.get("content-type", "") or not found:
        return Parsed(headers, None, block)
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return Parsed(headers, int(sizes[0]) if sizes and sizes[0].isdigit() else None, payload)


class Damage(NamedTuple):
    """Bytes of a file that belong to no whole record."""

    start: int
    stop: int


class Window:
    """Bytes of a file read block by block, forward only."""

    def __init__(self, handle, start: int, block: int = 1 << 20, step: int = 1 << 14):
        self.handle, self.block, self.step = handle, block, step
        self.base, self.data = start, b""
        self.broken = False  # a member that began like a record and did not end like one was met
        handle.seek(start)

    def upto(self, position: int) -> bool:
        """Reads on until `position` is known; False at the end of the file."""
        while self.base + len(self.data) <= position:
            more = self.handle.read(self.block)
            if not more:
                return False
            self.data += more
        return True

    def forget(self, position: int) -> None:
        """What lies before `position` is asked for no more."""
        if position - self.base >= self.block:
            self.data = self.data[position - self.base :]
            self.base = position

    def magic(self, at: int) -> int | None:
        """Where the next magic begins, from `at` on."""
        while self.upto(at + len(MAGIC) - 1):
            found = self.data.find(MAGIC, at - self.base)
            if found >= 0:
                return self.base + found
            at = self.base + len(self.data) - len(MAGIC) + 1
            self.forget(at)
        return None

    def member(self, at: int) -> tuple[Parsed, int] | None:
        """The record of the member at `at`, checked to its end, and where the next one begins; None if it is none."""
        self.forget(at)
        opened, out, pos = zlib.decompressobj(31), [], at
        while self.upto(pos):
            part = self.data[pos - self.base : pos - self.base + self.step]
            try:
                out.append(opened.decompress(part))
            except zlib.error:
                break
            if len(out) == 1 and not (b"WARC/"[: len(out[0])] == out[0][:5]):
                return None
            pos += len(part)
            if opened.eof:
                parsed = parse(b"".join(out))
                if parsed:
                    return parsed, pos - len(opened.unused_data)
                break
        self.broken |= bool(out and out[0])
        return None

    def next_member(self, at: int, stop: int) -> int | None:
        """Where the next member with a whole record begins, in [at, stop)."""
        while (found := self.magic(at)) is not None and found < stop:
            if self.member(found):
                return found
            at = found + 1
        return None


def walked(window: Window, at: int, stop: int, size: int) -> Iterator[tuple[int, Parsed] | Damage]:
    """From the member that begins at `at`: the records that start before `stop` with their places, and the damage
    that begins before it."""
    while at < min(stop, size):
        got = window.member(at)
        if got:
            yield at, got[0]
            at = got[1]
        else:
            on = window.next_member(at + 1, size)
            yield Damage(at, size if on is None else on)
            at = size if on is None else on


def owned[T](handle, size: int, start: int, stop: int, take: Callable[[Parsed], T] = lambda x: x) -> Iterator[T | Damage]:
    """What `take` makes of the records of a WARC file that start in [start, stop), and the damage that begins there.
    Damage that no whole member of the range precedes is reported only where the record's begin can still be read."""
    if start:
        window, kept = Window(handle, start), []
        at = window.next_member(start, stop)
        if not window.broken:
            for got in walked(Window(handle, at), at, stop, size) if at is not None else ():
                if isinstance(got, Damage):
                    break
                kept.append(take(got[1]))
            else:
                yield from kept
                return
    for got in walked(Window(handle, 0), 0, stop, size):
        if isinstance(got, Damage):
            if start <= got.start:
                yield got
        elif start <= got[0]:
            yield take(got[1])


WRITTEN = "path string, bytes long"


def write_warc(pages: DataFrame, root: str) -> DataFrame:
    """Writes page_id, url, html, digest, refers_to as WARC files under root (a URI); gives path and bytes of each."""
    small_batches(pages.sparkSession)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        path, size = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        out = None
        try:
            for batch in batches:
                for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out = out or store.open_output_stream(path, compression=None)
                    data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers)
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return saved(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(written, WRITTEN), "warc-files")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long, url string, path string, damaged_from long, damaged_bytes long"


def _row(r: Parsed) -> tuple:
    label = r.headers.get("warc-payload-digest", "")
    digest = base64.b32decode(label[5:]).hex() if label.startswith("sha1:") else None
    kind = r.headers.get("warc-type")
    if kind == "response" and digest is not None and hashlib.sha1(r.payload).hexdigest() != digest:
        kind = "damaged"
    return (page_of(r.headers.get("warc-record-id")), r.payload_length, digest, kind, page_of(r.headers.get("warc-refers-to")), len(r.payload), r.headers.get("warc-target-uri"))


def read_warc(files: DataFrame, root: str, split_bytes: int = 4 << 20, strict: bool = False) -> DataFrame:
    """The records of WARC files (path, bytes), each read by the task whose byte range holds its start.

    Damage loses no other record: bytes that belong to no whole record come back as a row of record_type `damaged` with
    path, damaged_from and damaged_bytes (null for records), a response whose payload is not that of its digest as a row
    of that type with its id. strict: either raises an error instead. An empty table gives an empty one.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in READ.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                with store.open_input_file(path) as handle:
                    for r in owned(handle, size, start, min(size, start + split_bytes), _row):
                        row = (None, None, None, "damaged", None, None, None, path, r.start, r.stop - r.start) if isinstance(r, Damage) else (*r, path, None, None)
                        if strict and row[3] == "damaged":
                            raise ValueError(f"damage in {path}: {row}")
                        rows.append(row)
                        if len(rows) >= 10_000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    # a range may hold thousands of records; every range is a task of its own
    return ranges.repartition(min(n, 10_000), F.xxhash64("path", "start")).mapInArrow(read, READ)


def with_revisits(pages: DataFrame, least: int = REVISIT_LEAST, most: int = BROADCAST_ROWS) -> DataFrame:
    """Adds digest (SHA-1 of the payload) and refers_to: the largest page id of those with this payload, if it is another's.
    The digests that recur are broadcast if they are at most `most`, else joined by a shuffle."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marked = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    # digests that recur; the rest of the table needs no partner
    counted = marked.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    repeated = saved(counted.where("n > 1").select("digest", "last"), "repeated")
    joined = marked.join(F.broadcast(repeated) if repeated.count() <= most else repeated, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when((F.col("payload_bytes") >= least) & (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Writes a record for each page and reads the archives back; see READ for the columns. Damage raises an error.

    Null html is an empty payload, a null url has no target header, a null page_id no id of ours (read back as null;
    its payload may still be stored under another's). Rows that share the largest page id are all responses. Extra
    columns are ignored; an empty table gives an empty one.
    """
    root = scratch_path(spark, "warc")
    files = write_warc(with_revisits(pages.select("page_id", "url", "html")), root)
    return read_warc(files, root, split_bytes, strict=True).drop("path", "damaged_from", "damaged_bytes")
