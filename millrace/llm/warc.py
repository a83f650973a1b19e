"""WARC archives: writing with revisit records, and a splittable reader.

Every record is a gzip member of its own, so a reader can start at any member.
The reader cuts archives into byte ranges; a task looks for gzip magic in its
range, takes a candidate for real only if its bytes inflate to a WARC header,
and owns the records whose first byte lies in its range, however far the last
one reaches. It also owns what stands behind its records and is none: a damaged
member, or other bytes, are told as a row of type ``error`` and the reader goes
on with the next record. An archive that isn't compressed is read by one task,
from record to record, as any bytes may stand in a payload.

Archives lie in a folder that all executors share. Each attempt of a writing
task has a file name of its own and reports it in its result, so the manifest
lists just the files of attempts that counted; a lost executor leaves at most a
file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_uneven, keep, new_path, small_or_not, table

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 100
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
GZIP_LEVEL = 4
MAGIC = b"\x1f\x8b\x08"
#: Bytes that are inflated at once.
STEP_BYTES = 8 << 10
#: Bytes of a member's start that are inflated to see whether it is a record.
PROBE_BYTES = 512
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive after which its task begins another.
ROLL_BYTES = 1 << 30
#: Record ids of pages: this and the page's id.
PAGE_URN = "urn:x-page:"

# Fixed value: the profile of revisits that have the payload of an earlier record.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_control = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of page ``first`` without."""
    name = lambda i: f"<{PAGE_URN}{i}>" if i is not None else f"<{uuid.uuid4().urn}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url:
        head.append(f"WARC-Target-URI: {_control.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id and refers_to of the pages whose payload a page of smaller id has already."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    light = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    light = keep(light.where((F.col("n") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull()), "payloads")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
    later = join_uneven(light, keep(firsts.where("copies > 1"), "firsts"), ["digest"], "copies")
    return later.where("page_id > refers_to").select("page_id", "refers_to").distinct()


def write(pages: DataFrame, path: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``path``: file, bytes and records of each.

    Of pages with equal payloads of at least 100 bytes the one with the least
    page_id is a response and the others revisit it. Null html is an empty
    payload, a null url is left out. Pages without page_id are responses; rows
    that repeat a page_id are records of their own, and repeats of the first
    page are responses too. No file is written for an empty partition; after
    ``ROLL_BYTES`` a task begins another file. Other columns are ignored.
    """
    # known by its written size: small enough it is broadcast, else both sides are shuffled
    known = small_or_not(keep(revisits(pages), "revisits"))
    all_ = pages.select("page_id", "url", "html")
    rows = all_.where("page_id is not null").join(known, "page_id", "left")
    # pages without id are no one key's of a shuffle
    rows = rows.unionByName(all_.where("page_id is null"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = "", None, 0

        def done() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["file", "bytes", "records"]
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, first in zip(*columns, strict=True):
                if out is None:
                    name, n = f"{path}/part-{uuid.uuid4().hex}.warc.gz", 0
                    system, at = file_system(name)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                payload = (html.as_py() or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                out.write(member(record(page_id.as_py(), url.as_py(), payload, digest, first.as_py())))
                n += 1
                if out.tell() >= ROLL_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return keep(rows.mapInArrow(run, "file string, bytes long, records long"), "manifest")


class Range:
    """The records that start in bytes [start, end) of an open file of gzip members."""

    def __init__(self, file, size: int, start: int, end: int) -> None:
        self.file, self.size, self.end = file, size, end
        self.base, self.data, self.pos = start, b"", 0  # data[pos] is the byte base + pos of the file

    @property
    def at(self) -> int:
        return self.base + self.pos

    def more(self) -> bool:
        """Reads on; false at the end of the file."""
        reached = self.base + len(self.data)
        if reached >= self.size:
            return False
        self.file.seek(reached)
        got = self.file.read(min(READ_BYTES, self.size - reached))
        self.base, self.data, self.pos = self.at, self.data[self.pos :] + got, 0
        return bool(got)

    def is_record(self) -> bool:
        """Whether what stands here inflates to a WARC header."""
        while len(self.data) - self.pos < PROBE_BYTES and self.more():
            pass
        try:
            return zlib.decompressobj(31).decompress(self.data[self.pos : self.pos + PROBE_BYTES], 5) == b"WARC/"
        except zlib.error:
            return False

    def find(self) -> bool:
        """Moves to the next start of a record before ``end``."""
        while self.at < self.end:
            k = self.data.find(MAGIC, self.pos)
            if k < 0:
                # the magic may be cut by the end of what is read
                self.pos = max(self.pos, len(self.data) - len(MAGIC) + 1)
                if not self.more():
                    return False
                continue
            self.pos = k
            if self.at < self.end and self.is_record():
                return True
            self.pos += 1
        return False

    def take(self) -> bytes:
        """What the member here holds; moves behind it."""
        start, packed, parts = self.at, zlib.decompressobj(31), []
        while not packed.eof:
            if self.pos == len(self.data) and not self.more():
                raise ValueError(f"the member at byte {start} has no end")
            fed = self.data[self.pos : self.pos + STEP_BYTES]
            parts.append(packed.decompress(fed))
            self.pos += len(fed) - len(packed.unused_data)
        return b"".join(parts)

    def go(self, to: int) -> None:
        """Moves to byte ``to`` of the file."""
        self.base, self.data, self.pos = to, b"", 0

    def gap(self) -> str | None:
        """Moves over bytes here that are no record, to the next one or the end of the file, and tells of them."""
        start, end = self.at, self.end
        if start >= self.size or self.is_record():
            return None
        self.end = self.size
        if not self.find():
            self.go(self.size)
        self.end, to = end, self.at
        if self.padding(start, to):
            return None
        return f"bytes {start} to {to} are no record"

    def padding(self, start: int, to: int) -> bool:
        """Whether bytes start to ``to`` are all zero, as some writers put between members."""
        self.file.seek(start)
        while start < to:
            got = self.file.read(min(READ_BYTES, to - start))
            if got.strip(b"\0"):
                return False
            start += len(got)
        return True

    def __iter__(self) -> Iterator[tuple[list[tuple[dict[str, str], bytes]], str | None]]:
        """Records of each member, and what is wrong with the bytes behind them or in their place."""
        if self.base > 0 and not self.find():
            # what stands here belongs to a member that starts before
            return
        if self.base == 0 and (fault := self.gap()):
            yield [], fault
        while self.at < min(self.end, self.size):
            start, found, fault = self.at, [], None
            try:
                found = list(parse(self.take()))
            except (ValueError, KeyError, zlib.error) as e:
                fault = f"the record at byte {start} is damaged: {e}"
                self.go(start + 1)
            behind = self.gap()
            yield found, fault or behind


def plain(file, size: int) -> Iterator[tuple[list[tuple[dict[str, str], bytes]], str | None]]:
    """As `Range`, for a file without compression: from record to record, to the first that is damaged."""
    at, held = 0, b""
    while at < size or held.strip(b"\r\n"):
        held = held.lstrip(b"\r\n")
        head, mark, rest = held.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head) if mark else None
        sound = not held or b"WARC/".startswith(held[:5]) or held.startswith(b"WARC/")
        n = int(told[1]) if told else 0
        if sound and not (mark and told and len(rest) >= n) and at < size:
            file.seek(at)
            got = file.read(min(max(READ_BYTES, n - len(rest)), size - at))
            at, held = at + len(got), held + got
            continue
        if not (sound and mark and told and len(rest) >= n):
            yield [], f"bytes {at - len(held)} to {size} are no whole records"
            return
        yield list(parse(held[: len(held) - len(rest) + n])), None
        held = rest[n:]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of the records of a member."""
    while data := data.lstrip(b"\r\n"):
        head, _, rest = data.partition(b"\r\n\r\n")
        # a line that begins with white space goes on with the one before
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if len(rest) < size:
            raise ValueError(f"the record {fields.get('warc-record-id')} is cut off")
        yield fields, rest[:size]
        data = rest[size:]


def payload_of(fields: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers, by lower-case name, and payload of a record's block."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def unchunked(payload: bytes) -> bytes | None:
    """What a chunked HTTP body holds; None if it isn't one."""
    parts, at = [], 0
    while True:
        line = payload.find(b"\r\n", at)
        size = re.fullmatch(rb"[ \t]*([0-9a-fA-F]+)[ \t]*(;.*)?", payload[at:line]) if line >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), line + 2
        if n == 0:
            return b"".join(parts)
        if payload[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(payload[at : at + n])
        at += n + 2


def _fits(payloads: list[bytes], digest: str) -> bool | None:
    """Whether one of the payloads has the recorded digest, in hex or base32; None where none is, or its algorithm isn't known."""
    name, _, value = digest.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return None
    found = [hashlib.new(name.lower(), p) for p in payloads]
    return any(value.lower() == f.hexdigest() or value.upper().rstrip("=") == base64.b32encode(f.digest()).decode().rstrip("=") for f in found)


def _page(name: str | None) -> int | None:
    """The page_id in a record id; None in those of other writers."""
    found = re.fullmatch(rf"<?{PAGE_URN}(-?\d+)>?", name or "")
    return int(found[1]) if found else None


READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_id string, url string, html string, fits boolean, error string"
)


def read(manifest: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Responses and revisits in the archives of ``manifest`` (file, bytes), and what can't be read: a row each.

    Returns page_id, payload_bytes, payload_digest (SHA-256 in hex: of the
    payload itself for responses, as recorded for revisits), record_type,
    refers_to, record_id, refers_to_id, url, html (null for revisits, and if
    ``payloads`` is false; what is no UTF-8 is replaced), fits (whether the
    payload has its recorded digest; null where none is or it isn't known) and
    error. Chunked HTTP bodies are put together; such a payload fits if it does
    so either way.

    A member that is damaged or cut off, and bytes between members that are
    none (but zeros), are a row of record_type ``error`` that tells the file and
    the bytes; what follows is read. Archives that aren't compressed are read
    too, up to the first damaged record, whose row tells the rest.

    Archives of other writers are read too: page_id and refers_to are null
    where a record id isn't a page's, the digest of a revisit is null where
    SHA-256 isn't recorded, its payload_bytes where no length is. Records of
    other types (warcinfo, request, metadata and so on) are left out, members
    with several records read whole. An empty manifest, and an empty file, have
    no rows.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = manifest.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    n = max(1, splits.count())
    splits = splits.repartition(min(n, 100_000), F.xxhash64("file", "start"))

    def row(fields: dict[str, str], block: bytes) -> tuple:
        name, kind, first = fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-refers-to")
        recorded = fields.get("warc-payload-digest", "")
        http, payload = payload_of(fields, block)
        html = digest = fits = None
        if kind == "response":
            whole = unchunked(payload) if "chunked" in http.get("transfer-encoding", "").lower() else None
            fits = _fits([payload] if whole is None else [whole, payload], recorded)
            payload = payload if whole is None else whole
            digest, n_bytes = hashlib.sha256(payload).hexdigest(), len(payload)
            html = payload.decode("utf-8", "replace") if payloads else None
        else:
            told = http.get("content-length", "")
            n_bytes = int(told) if told.isdigit() else None
            if re.fullmatch("(?i)sha256:[0-9a-f]{64}", recorded):
                digest = recorded[7:].lower()
        return _page(name), n_bytes, digest, kind, _page(first), name, first, fields.get("warc-target-uri"), html, fits, None

    def members(file, split: dict) -> Iterator[tuple[list[tuple[dict[str, str], bytes]], str | None]]:
        start = split["start"]
        file.seek(0)
        if file.read(5) == b"WARC/":
            return plain(file, split["bytes"]) if start == 0 else iter(())
        return iter(Range(file, split["bytes"], start, start + split_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.bool_(), pa.string()]
        names = [c.split()[0] for c in READ.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

        for batch in batches:
            for split in batch.to_pylist():
                system, at = file_system(split["file"])
                rows, held = [], 0
                with system.open_input_file(at) as file:
                    for records, fault in members(file, split):
                        rows += [row(*r) for r in records if r[0].get("warc-type") in ("response", "revisit")]
                        if fault:
                            rows.append((None, None, None, "error", *[None] * 6, f"{split['file']}: {fault}"))
                        held += sum(len(r[1]) for r in records)
                        if held > 16 << 20 and rows:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return splits.mapInArrow(run, READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    manifest = write(pages, new_path(spark, "warc"))
    found = read(manifest, payloads=False)
    # all of our own records are there, whole
    wrong = F.col("error").isNotNull() | ~F.coalesce("fits", F.lit(True))
    kind = F.when(wrong, F.raise_error(F.coalesce("error", F.lit("a payload isn't what was written")))).otherwise(F.col("record_type"))
    return found.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


QUERIES = {"op9_warc": op9_warc}
ORACLES = {
    "op9_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
}
