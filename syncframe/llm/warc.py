"""WARC archives: written with a gzip member for each record, and read in order as streams."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import record_batch
from syncframe.llm.common import Workspace, text_of

BLOCK = 1 << 16  #: Bytes of an archive that are read at once.
PIECE = 1 << 20  #: Plain bytes that are held at once, apart from a header or a payload that the caller wants.

#: Fixed by the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http;msgtype=response"

ARCHIVES = "archive string, n_records long, n_bytes long"
RECORDS = (
    "archive string, at long, type string, record_id string, uri string, date string, refers_to string, block_bytes long, "
    "payload_bytes long, payload_digest string, problem string"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def page_uri(page_id: object) -> str:
    """The record id of a page; a null id has the empty name."""
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"


def page_of(record_id: Column) -> Column:
    """The page's id as text, as ``page_uri`` wrote it; null for the empty name."""
    return F.nullif(F.url_decode(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1)), F.lit(""))


# Writing


def _header(fields: list[tuple[str, object]], first: str) -> bytes:
    """A header block; what would break a line is percent-encoded."""
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    return "".join([f"{first}\r\n", *(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None), "\r\n"]).encode("utf-8", "surrogatepass")


def encode_record(record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> Iterator[bytes]:
    """The pieces of a record before compression: a response, or a revisit without the payload where another record has it.
    Either keeps the HTTP header, whose length is the payload's."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    body = payload if refers_to is None else b""
    block = hashlib.sha1(http)
    block.update(body)
    yield _header(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(block.digest())}"), ("WARC-Refers-To", refers_to),
            ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE), ("Content-Type", HTTP_RESPONSE), ("Content-Length", len(http) + len(body)),
        ],
        "WARC/1.1",
    )
    yield http
    yield body
    yield b"\r\n\r\n"


def write_member(out: BinaryIO, pieces: Iterable[bytes], level: int) -> int:
    """One gzip member with the pieces; its compressed size."""
    packer, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for piece in pieces:
        for k in range(0, len(piece), PIECE):
            size += out.write(packer.compress(piece[k : k + PIECE])) or 0
    return size + (out.write(packer.flush()) or 0)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_warc(records: DataFrame, folder: str, date: str, most_bytes: int = 1 << 28, level: int = 6) -> DataFrame:
    """Writes (record_id, uri, refers_to, digest, payload) to archives in ``folder``, which driver and executors share, and
    returns (archive, n_records, n_bytes), which is to be written by the caller.

    Each task writes archives of its own and begins another after ``most_bytes``, so that readers have many of bounded
    size.  An archive has its name only once it is whole; of two attempts of a task the first to end wins."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = _filesystem(folder)
        target.create_dir(top, recursive=True)
        task = TaskContext.get()
        out, part, path, name, rows, size, k = None, "", "", "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            if target.get_file_info(path).type.name == "NotFound":
                target.move(part, path)
            else:
                target.delete_file(part)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], names=["archive", "n_records", "n_bytes"])

        for batch in batches:
            for record_id, uri, refers, digest, payload in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{k:05d}.warc.gz"
                    path, name = f"{top}/{name}", f"{folder}/{name}"
                    part, rows, size, k = f"{path}.{task.taskAttemptId()}", 0, 0, k + 1
                    out = target.open_output_stream(part, compression=None)
                pieces = encode_record(record_id.as_py(), uri.as_py(), date, payload.as_py() or b"", digest.as_py(), refers.as_py())
                size += write_member(out, pieces, level)
                rows += 1
                if size >= most_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.select("record_id", "uri", "refers_to", "digest", "payload").mapInArrow(write, ARCHIVES)


# Reading


class Truncated(Exception):
    """The archive ends within a member."""


class Members:
    """The plain bytes of an archive's gzip members, one after the other, from blocks of compressed bytes."""

    def __init__(self, blocks: Iterable[bytes]):
        self.blocks, self.held, self.at, self.plain = iter(blocks), b"", 0, b""

    def begin(self) -> bool:
        """Goes to the next member; false at the archive's end."""
        while not self.held:
            block = next(self.blocks, None)
            if block is None:
                return False
            self.held = block
        self.start, self.packed, self.plain = self.at, zlib.decompressobj(31), b""
        return True

    def some(self) -> bytes:
        """The next plain bytes of the member, at most a piece; none at its end."""
        if self.plain:
            out, self.plain = self.plain, b""
            return out
        while not self.packed.eof:
            out = self.packed.decompress(self.held, PIECE)  # without input, what is still to come of earlier input
            rest = self.packed.unused_data if self.packed.eof else self.packed.unconsumed_tail
            self.at += len(self.held) - len(rest)
            self.held = rest
            if out:
                return out
            if not self.held and not self.packed.eof:
                self.held = next(self.blocks, b"")
                if not self.held:
                    raise Truncated
        return b""

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the mark, which is passed over; null if the member ends before."""
        got = bytearray()
        while piece := self.some():
            begin = max(0, len(got) - len(mark) + 1)
            got += piece
            end = got.find(mark, begin)
            if end >= 0:
                self.plain = bytes(got[end + len(mark) :])
                return bytes(got[:end])
        return None

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces, or as many as the member has."""
        while n > 0 and (piece := self.some()):
            if len(piece) > n:
                piece, self.plain = piece[:n], piece[n:]
            n -= len(piece)
            yield piece


def header_fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with white space continues the one before; the first of equal names counts."""
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t"):
            if name:
                fields[name] += " " + line.strip()
            continue
        key, colon, value = line.partition(":")
        name = key.strip().lower() if colon and key.strip().lower() not in fields else None
        if name:
            fields[name] = value.strip()
    return fields


def _same_digest(named: str | None, sha1: bytes) -> bool:
    """Whether a digest field agrees; one of another algorithm cannot be tested and passes."""
    algorithm, _, value = (named or "").partition(":")
    return algorithm.lower() != "sha1" or value.strip().upper() in (base32(sha1), sha1.hex().upper())


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def _record(members: Members, want_payload: bool) -> dict:
    """One member as a record."""
    found: dict = {"at": members.start}
    head = members.until(b"\r\n\r\n")
    if head is None or not head.startswith(b"WARC/"):
        return found | {"problem": "header"}
    fields = header_fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    length = _number(fields.get("content-length"))
    digest = fields.get("warc-payload-digest")
    found |= {
        "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to"), "block_bytes": length, "payload_digest": digest.partition(":")[2] if digest and ":" in digest else digest,
    }
    if length is None:
        return found | {"problem": "header"}
    block, payload, size, got, kept = hashlib.sha1(), hashlib.sha1(), 0, 0, []
    http, open_head = bytearray(), fields.get("content-type", "").replace(" ", "").startswith("application/http")
    for piece in members.exactly(length):
        block.update(piece)
        got += len(piece)
        if open_head:
            http += piece
            end = http.find(b"\r\n\r\n", max(0, len(http) - len(piece) - 3))
            if end < 0:
                continue
            piece, open_head = bytes(http[end + 4 :]), False
            del http[end:]
        payload.update(piece)
        size += len(piece)
        if want_payload:
            kept.append(piece)
    revisit = found["type"] == "revisit"
    if revisit:
        size = _number(header_fields(http.decode("utf-8", "replace").split("\r\n")[1:]).get("content-length")) if http else None
    elif found["payload_digest"] is None:
        found["payload_digest"] = base32(payload.digest())
    rest = bytes(members.plain)
    members.plain = b""
    while len(rest) <= 4 and (piece := members.some()):
        rest += piece
    if got < length or open_head or rest != b"\r\n\r\n":
        found["problem"] = "length"
    elif not _same_digest(fields.get("warc-block-digest"), block.digest()):
        found["problem"] = "block digest"
    elif not revisit and not _same_digest(digest, payload.digest()):
        found["problem"] = "payload digest"
    return found | {"payload_bytes": size, "payload": b"".join(kept) if want_payload and not revisit else None}


def read_records(blocks: Iterable[bytes], want_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in their order.

    A record that breaks a rule carries the first of: ``header`` (no WARC header or length), ``length`` (the block, its HTTP
    header or the end is not where the content length says), ``block digest``, ``payload digest``.  After a member that
    cannot be unpacked (``corrupt``) or that the archive cuts off (``truncated``) nothing more is read."""
    members = Members(blocks)
    while members.begin():
        try:
            found = _record(members, want_payload)
            while members.some():  # what a broken record has left
                pass
            yield found
        except zlib.error:
            yield {"at": members.start, "problem": "corrupt"}
            return
        except Truncated:
            yield {"at": members.start, "problem": "truncated"}
            return


def read_warc(archives: DataFrame, want_payload: bool = False, run_bytes: int = 4 << 20) -> DataFrame:
    """The records of archives (archive, n_bytes): archive, at (offset of its member), type, record_id, uri, date, refers_to,
    block_bytes, payload_bytes, payload_digest (bare), problem, and payload (binary) if wanted.

    An archive is read by one task as a stream; memory holds a block of it, a piece of a record and, if payloads are wanted,
    one of them and at most ``run_bytes`` of others.  A revisit has its payload's length from its HTTP header."""
    names = [c.split(" ")[0] for c in RECORDS.split(", ")] + ["payload"] * want_payload
    kinds = {"at": pa.int64(), "block_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            source, path = _filesystem(name)
            with source.open_input_stream(path, compression=None) as stream:
                run, size = [], 0
                for found in read_records(iter(lambda stream=stream: stream.read(BLOCK), b""), want_payload):
                    run.append(found | {"archive": name})
                    size += len(found.get("payload") or b"") + 512
                    if size >= run_bytes:
                        yield record_batch(schema, [[r.get(n) for r in run] for n in names])
                        run, size = [], 0
                if run:
                    yield record_batch(schema, [[r.get(n) for r in run] for n in names])

    # An archive for each task, the largest in no company.
    spread = archives.select("archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(read, RECORDS + (", payload binary" if want_payload else ""))


def archive_pages(
    df: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z",
    most_bytes: int = 1 << 28,
) -> DataFrame:
    """Writes pages as archives of ``work`` and returns the archives as ``write_warc`` does, written.

    The payload is the html in UTF-8, null as empty.  Of equal payloads (by SHA-1) of at least ``least`` bytes the page of
    smallest id is a response and the others are revisits of it; smaller payloads are always responses.  Rows that repeat
    both id and payload are the same record and are written as often; a null id never wins against an id, and a group of
    null ids alone has only responses.  Only ids and digests are shuffled to find the winners, and only digests that
    occur twice are joined, as a table whose large groups Spark can split.  An empty table gives no archive."""
    payload = text_of(html_col).cast("binary")
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    pages = pages.withColumn("sha", F.unhex(F.sha1("payload")))
    several = pages.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep is not null")
    winners = work.save(several.select("sha", "keep"), "winners")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    records = pages.join(winners, "sha", "left").select("page_id", "uri", F.when(F.col("keep").isNotNull(), refers).alias("refers"), "sha", "payload")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, refers = ([None if x is None else page_uri(x) for x in b.column(k).to_pylist()] for k in (0, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x or page_uri(None) for x in ids], pa.string()), b.column(1), pa.array(refers, pa.string()),
                    pa.array([base32(x) for x in b.column(3).to_pylist()], pa.string()), b.column(4),
                ],
                names=["record_id", "uri", "refers_to", "digest", "payload"],
            )

    named = records.mapInArrow(name, "record_id string, uri string, refers_to string, digest string, payload binary")
    return work.save(write_warc(named, f"{work.root}/warc", date, most_bytes), "archives", batch_bytes="8m")
