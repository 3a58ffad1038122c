"""WARC writing, revisits, and a salvage reader.

Archives are sequences of byte segments in a table (archive, seq, data), so that writing, shuffling and reading need no
file system but Spark's own; ``read_files`` takes real archives, ``write_files`` stores them.

The reader takes gzip members and plain records alike.  A record must have a version line, well-formed header lines, a
whole block, the closing blank lines and matching digests.  After a failed check it searches for the next place where a
gzip member or a version line begins a valid record, goes on there, and logs the bytes between as a quarantined gap.
Bytes are held once and looked at in place: time is linear in the archive, and memory that of the longest record.  A record
must fit a cell of a table to be returned, so a candidate of more than ``most`` bytes (``MOST``, 512 MB) is damaged: its
bytes are logged as a gap, not left out silently.

Defined results: null html is an empty payload; null url becomes an empty target; rows that share both the largest
page_id and the payload are all responses, other repeated rows all revisits; a null page_id never becomes the response of a
group and takes part as a revisit only if its group has another id; very long pages are whole records; an archive without
any valid record yields one gap; an empty table gives no archives; columns other than page_id, url and html are not read.
"""
from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_table

#: Smaller payloads are always stored in full.
MIN_REVISIT = 1000
#: Bytes of the longest record that is read.
MOST = 1 << 29
_ARCHIVE, _SLICE = 1 << 22, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, compress: bool = True) -> bytes:
    """A response with the payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"WARC-Target-URI: {quote(url or '', safe=_URL_SAFE)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    record = ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    if not compress:
        return record
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~"


class Damaged(ValueError):
    """The bytes here are no valid record."""


class Unfinished(Damaged):
    """The bytes at hand end before the record does; it may be known how many it needs."""

    def __init__(self, problem: str, need: int = 0):
        super().__init__(problem)
        self.need = need


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_BEGINNINGS = (_MAGIC, b"WARC/1.0\r\n", b"WARC/1.1\r\n")


def parse_record(data: bytes | bytearray, at: int = 0, seen: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at`` and its length in bytes.

    ``Unfinished`` says in ``need`` how many bytes from ``at`` on are wanted next; ``seen`` is where an earlier call had
    looked for the header's end in vain.
    """
    if not _VERSION.match(data, at):
        head = bytes(data[at : at + 10])
        if any(x.startswith(head) for x in _BEGINNINGS):
            raise Unfinished("version line")
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n", max(at, at + seen - 3))
    if end < 0:
        raise Unfinished("header")
    fields: dict[str, str] = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdecimal()) or not {"warc-type", "warc-record-id", "warc-date"} <= fields.keys():
        raise Damaged("header fields")
    begin = end + 4
    stop = begin + int(size[:20])
    if len(data) < stop + 4:
        raise Unfinished("block", stop + 4 - at)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("end of block")
    block = bytes(data[begin:stop])
    if "warc-block-digest" in fields and fields["warc-block-digest"] != sha1_label(block):
        raise Damaged("block digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        if "warc-payload-digest" in fields and fields["warc-payload-digest"] != sha1_label(payload):
            raise Damaged("payload digest")
        fields["payload-bytes"] = str(len(payload))
    else:
        m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        fields["payload-bytes"] = m[1].decode() if m else "0"
    return fields | {"payload": payload}, stop + 4 - at


class Member:
    """A gzip member under way: takes the bytes from where it begins, a slice at a time, as they come in."""

    def __init__(self, most: int):
        self.z, self.out, self.used, self.most = zlib.decompressobj(31), bytearray(), 0, most

    def feed(self, data: bytearray, at: int) -> tuple[dict, int]:
        """The record and the member's length; ``Unfinished`` if the bytes at hand end before the member does."""
        end = len(data)
        while at + self.used < end and not self.z.eof:
            piece = bytes(data[at + self.used : at + self.used + _SLICE])
            try:
                self.out += self.z.decompress(piece, max(1, self.most - len(self.out)))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            if not self.z.eof and (self.z.unconsumed_tail or len(self.out) >= self.most):
                raise Damaged("longer than a record may be")
            self.used += len(piece) - len(self.z.unused_data)
        if not self.z.eof:
            raise Unfinished("gzip member")
        try:
            fields, size = parse_record(self.out)
        except Unfinished as e:
            raise Damaged(str(e)) from None
        if size != len(self.out):
            raise Damaged("bytes after the record")
        return fields, self.used


def salvage(segments: Iterable[bytes], most: int = MOST) -> Iterator[tuple[str, int, int, dict]]:
    """("record", offset, length, fields) and ("gap", offset, length, {"reason"}) of an archive fed in pieces, in order.

    A candidate that is unfinished waits for more bytes; at the archive's end, or beyond ``most`` bytes, it is damaged.
    """
    it, held, base, more = iter(segments), bytearray(), 0, True
    at, gap, reason = 0, None, ""  # position in held; offset where the gap began

    def pull(bytes_: int) -> None:
        """Drop what is done with and hold that many bytes from ``at`` on, if there are as many."""
        nonlocal base, at, more
        del held[:at]
        base, at = base + at, 0
        while more and len(held) < bytes_:
            piece = next(it, None)
            more = piece is not None
            held.extend(piece or b"")

    while True:
        if at >= len(held):
            if more:
                pull(1)
                continue
            break
        member, seen = None, 0
        while True:  # one candidate, fed until it is decided
            try:
                if member is None and held.startswith(_MAGIC, at):
                    member = Member(most)
                fields, size = member.feed(held, at) if member else parse_record(held, at, seen)
                problem = None
            except Unfinished as e:
                size, problem = len(held) - at, str(e)
                seen = size if problem == "header" else 0
                if more and max(size, e.need) < most:
                    pull(max(e.need, 2 * size))
                    continue
            except Damaged as e:
                problem = str(e)
            break
        if problem is None:
            if gap is not None:
                yield "gap", gap, base + at - gap, {"reason": reason}
                gap = None
            yield "record", base + at, size, fields
            at += size
            continue
        if gap is None:
            gap, reason = base + at, problem
        at += 1
        while not (m := _BEGIN.search(held, at)):
            at = max(at, len(held) - 9) if more else len(held)  # a beginning may straddle the pieces
            if not more:
                break
            pull(len(held) - at + 1)
        at = m.start() if m else at
    if gap is not None:
        yield "gap", gap, base + at - gap, {"reason": reason}


# --- over DataFrames


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html (text, never null), refers_to.

    Only (digest, page_id) is shuffled to find the groups, with partial aggregation; the groups and the revisits are written
    tables with one row a key, so adaptive execution can split a hot digest, null ids of one digest too; the html moves once.
    """
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = slim.withColumn("digest", F.sha1("html"))
    large = keyed.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    groups = shared_table(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n"), "warc-groups")
    found = large.join(groups, "digest").where("page_id is null or page_id <> refers_to")
    revisits = shared_table(found.groupBy(F.col("page_id").alias("own"), F.col("digest").alias("same")).agg(F.max("refers_to").alias("refers_to")), "warc-revisits")
    return keyed.join(revisits, F.expr("page_id <=> own and digest = same"), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, compress: bool = True, archive_bytes: int = _ARCHIVE, segment_bytes: int = _ARCHIVE) -> DataFrame:
    """Segments (archive, seq, data) of archives with one record per row of ``mark_revisits``' result; a plain map.

    By default an archive is one segment, which ``read_archives(..., whole=True)`` takes row by row without a shuffle.
    """
    from pyspark import TaskContext

    target = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("data", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, seq, written, held, size = TaskContext.get().partitionId(), 0, 0, 0, [], 0

        def segment():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:05d}.warc" + ".gz" * compress]), pa.array([seq], pa.int64()), pa.array([b"".join(held)], pa.binary())], schema=target)

        for batch in it:
            for lo in range(0, batch.num_rows, 64):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)):
                    record = build_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, compress)
                    held.append(record)
                    size += len(record)
                    if size >= segment_bytes:
                        yield segment()
                        written, seq, held, size = written + size, seq + 1, [], 0
                        if written >= archive_bytes:
                            number, seq, written = number + 1, 0, 0
        if held:
            yield segment()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, seq bigint, data binary")


def read_archives(segments: DataFrame, with_payload: bool = True, whole: bool = False) -> DataFrame:
    """Records and gaps of all archives: kind, archive, offset, length, reason, record_type, page_id, url, payload_bytes,
    payload_digest (hex), refers_to and, if asked for, payload.  ``whole``: each row is an archive of its own."""
    names = ["kind", "archive", "offset", "length", "reason", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    ddl = "kind string, archive string, offset bigint, length bigint, reason string, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint"
    if with_payload:
        names, types, ddl = [*names, "payload"], [*types, pa.binary()], ddl + ", payload binary"
    target = pa.schema(list(zip(names, types)))

    def number(field: str | None) -> int | None:
        m = re.search(r"urn:page:(-?\d+)", field or "")
        return int(m[1]) if m else None

    def digest(field: str | None) -> str | None:
        return base64.b32decode(field.removeprefix("sha1:")).hex() if field and field.startswith("sha1:") else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, d) for batch in it for a, d in ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in range(batch.num_rows)))
        out, size = [], 0
        for archive, pieces in itertools.groupby(rows, key=lambda r: r[0]):
            for kind, offset, length, f in salvage(d for _, d in pieces):
                row = (kind, archive, offset, length, f.get("reason"), f.get("warc-type"), number(f.get("warc-record-id")), f.get("warc-target-uri"), int(f["payload-bytes"]) if kind == "record" else None, digest(f.get("warc-payload-digest")), number(f.get("warc-refers-to")))
                out.append((*row, f.get("payload")) if with_payload else row)
                size += length
                if len(out) >= 512 or size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    rows = segments if whole else segments.repartition("archive").sortWithinPartitions("archive", "seq")
    return rows.select("archive", "data").mapInArrow(run, ddl)


def read_files(spark: SparkSession, path: str, block_bytes: int = 1 << 23) -> DataFrame:
    """Segments (archive, seq, data) of real archive files, read as streams in blocks, a task a file.

    Files of a file system that Arrow opens are never held whole; those of others come as whole cells from Spark's reader.
    """
    files = spark.read.format("binaryFile").load(path)
    names = files.select(F.col("path").alias("archive"), "length")
    scheme = path.split("://")[0] if "://" in path else "file" if path.startswith("file:") or ":" not in path.split("/")[0] else path.split(":")[0]
    if scheme not in ("file", "s3", "gs", "hdfs"):
        return files.select(F.col("path").alias("archive"), F.lit(0).cast("bigint").alias("seq"), F.col("content").alias("data"))
    target = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("data", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in it:
            for archive in batch.column(0).to_pylist():
                store, name = (fs.LocalFileSystem(), archive.removeprefix("file:").replace("//", "/", 1)) if archive.startswith("file:") else fs.FileSystem.from_uri(archive)
                with store.open_input_stream(name, compression=None) as f:
                    for seq in itertools.count():
                        if not (data := f.read(block_bytes)):
                            break
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([seq], pa.int64()), pa.array([data], pa.binary())], schema=target)

    return names.mapInArrow(run, "archive string, seq bigint, data binary")


def write_files(segments: DataFrame, directory: str) -> None:
    """Store archives as files below ``directory``, a URI or, in local mode only, a plain folder."""
    if "://" not in directory and not segments.sparkSession.conf.get("spark.master", "").startswith("local"):
        raise ValueError("a cluster needs a URI that every executor can write")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        store.create_dir(root)
        rows = (r for batch in it for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for archive, pieces in itertools.groupby(rows, key=lambda r: r[0]):
            with store.open_output_stream(f"{root}/{archive}", compression=None) as f:
                for _, data in pieces:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([archive])], names=["archive"])

    segments.repartition("archive").sortWithinPartitions("archive", "seq").select("archive", "data").mapInArrow(run, "archive string").collect()
