"""WARC archives of pages: a writer with revisit records, and a reader that salvages what follows damage.

The writer puts one gzip member a record into files of about ``max_bytes`` below the shared folder; a task names its files with a fresh id and
reports them, so files of lost or repeated attempts are never listed. Among records of equal payload (``min_bytes`` long or more) the one with
the smallest id is a response and the others are revisits that name it; shorter payloads are all responses. Copies are found on digests
only: the hot side is reduced to one row per digest and task before it moves.

The reader goes through a file member by member (or, in a file without compression, record by record). A record has to pass: the member's
checksum, a version line, headers, the stated length, its closing line ends, and for responses the payload digest. When a check fails, the reader
searches for the next member start that opens with a version line (or the next version line), goes on from there, and reports the bytes
between as a gap with the reason. A file is read in pieces; one record is held at a time.

Defined results: a null page is an empty payload. A null id sorts last among equals and is written as such; if no other has the payload, all such rows are
responses. Rows equal in id and payload are all what the first of them is. Urls lose nothing but control characters, which are percent-encoded. An empty
table gives no file and no record. Other columns are ignored.
"""
import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import kept, shared_folder

PIECE = 1 << 18
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id, url: str, payload: bytes, revisits, is_revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    uri = "".join(quote(c) if ord(c) < 0x21 or ord(c) == 0x7F else c for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri}')}>",
             f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {revisits}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError names the check that failed."""
    if not VERSION.match(data, at):
        raise ValueError("version")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers")
    try:
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
    except (ValueError, KeyError) as error:
        raise ValueError("headers") from error
    block = data[end + 4:end + 4 + size]
    if size < 0 or len(block) < size:
        raise ValueError("length")
    if data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
        raise ValueError("end")
    if headers.get("WARC-Type") == "response" and "WARC-Payload-Digest" in headers:
        if headers["WARC-Payload-Digest"] != "sha1:" + digest_of(block[block.find(b"\r\n\r\n") + 4:]):
            raise ValueError("digest")
    return headers, block, end + 8 + size


class Reader:
    """Records and gaps of one archive; ``read(offset, size)`` gives bytes of it."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size

    def _member(self, at: int) -> tuple[bytes, int]:
        """Content and end of the gzip member at ``at``; zlib.error or ValueError when it is not sound."""
        tool, out, pos = zlib.decompressobj(31), [], at
        while not tool.eof:
            piece = self.read(pos, min(PIECE, self.size - pos)) if pos < self.size else b""
            if not piece:
                raise ValueError("cut off")
            out.append(tool.decompress(piece))
            pos += len(piece)
        return b"".join(out), pos - len(tool.unused_data)

    def _find(self, pattern: bytes, at: int) -> Iterator[int]:
        """Places of the pattern from ``at`` on."""
        tail = b""
        while at < self.size:
            piece = self.read(at, min(PIECE, self.size - at))
            data = tail + piece
            k = data.find(pattern)
            while k >= 0:
                yield at - len(tail) + k
                k = data.find(pattern, k + 1)
            tail = data[len(data) - len(pattern) + 1:] if len(data) >= len(pattern) else data
            at += len(piece)

    def _opens(self, at: int) -> bool:
        try:
            return VERSION.match(zlib.decompressobj(31).decompress(self.read(at, min(4096, self.size - at)), 64)) is not None
        except zlib.error:
            return False

    def _plain(self, at: int) -> tuple[dict, bytes, int]:
        """The uncompressed record at ``at``: its headers first, then as much as they state."""
        size = 4096
        while True:
            head = self.read(at, min(size, self.size - at))
            end = head.find(b"\r\n\r\n")
            if end >= 0 or size > 1 << 20 or at + size >= self.size:
                break
            size *= 4
        stated = re.search(rb"\r\nContent-Length: (\d+)\r\n", head[:end + 2] if end >= 0 else b"")
        if not VERSION.match(head) or not stated:
            raise ValueError("version" if not VERSION.match(head) else "headers")
        headers, block, used = parse(self.read(at, min(end + 8 + int(stated[1]), self.size - at)))
        return headers, block, at + used

    def __iter__(self) -> Iterator[tuple]:
        """("record", start, end, headers, block) and ("gap", start, end, reason, None)."""
        at = 0
        packed = self.read(0, 3) == MAGIC if self.size >= 3 else False
        if not packed and self.size >= 3 and not VERSION.match(self.read(0, min(16, self.size))):
            packed = any(self._opens(k) for k in self._find(MAGIC, 0))  # a damaged beginning does not tell
        while at < self.size:
            start = at
            try:
                if packed:
                    data, end = self._member(at)
                    pos, found = 0, []
                    while pos < len(data):
                        headers, block, pos = parse(data, pos)
                        found.append((headers, block))
                    for headers, block in found:
                        yield "record", start, end, headers, block
                    at = end
                else:
                    headers, block, at = self._plain(at)
                    yield "record", start, at, headers, block
            except (zlib.error, ValueError) as error:
                reason = "checksum" if isinstance(error, zlib.error) else str(error)
                at = next((k for k in self._find(MAGIC if packed else b"WARC/1.", start + 1)
                           if (self._opens(k) if packed else VERSION.match(self.read(k, min(16, self.size - k))))), self.size)
                yield "gap", start, at, reason, None


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to, is_revisit)."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    small = kept(keyed.where(F.col("size") >= min_bytes).select("page_id", "sha").distinct(), "digests")
    first = small.groupBy("sha").agg(F.min("page_id").alias("first"))
    later = kept(small.join(first, "sha").where("first IS NOT NULL AND NOT (page_id <=> first)").select(
        F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")), "revisits")
    return keyed.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select(
        "page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("is_revisit"))


def write_archives(pages: DataFrame, min_bytes: int = 0, max_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", folder: str | None = None, **columns) -> DataFrame:
    """Writes the archives and returns (path, bytes, records) of the files."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        out = path = None
        size = records = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None)
                page_id, url, page, refers, revisit = row
                tool = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = tool.compress(record_of(page_id, url, page.encode("utf-8", "surrogatepass"), refers, revisit, date)) + tool.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= max_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})
                    out, size, records = None, 0, 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})
    return kept(with_revisits(pages, min_bytes, **columns).mapInArrow(run, "path string, bytes bigint, records bigint"), "archives")


_ROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("status", pa.string()), ("reason", pa.string()), ("record_type", pa.string()),
                  ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(listing: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record (status record) and per quarantined gap (status gap) of the listed files; listing: (path)."""
    def rows(path):
        files, place = _place(path)
        with files.open_input_file(place) as f:
            for status, start, end, headers, block in Reader(lambda at, n: f.read_at(n, at), f.size()):
                row = dict.fromkeys(_ROW.names) | {"path": path, "start": start, "end": end, "status": status}
                if status == "gap":
                    yield row | {"reason": headers}
                    continue
                cut = block.find(b"\r\n\r\n") + 4
                stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)\r\n", block[:cut])
                payload = block[cut:] if headers.get("WARC-Type") == "response" else None
                number = lambda name: int(headers[name]) if re.fullmatch(r"-?\d+", headers.get(name, "")) else None
                yield row | {"record_type": headers.get("WARC-Type"), "page_id": number("X-Page-ID"), "url": headers.get("WARC-Target-URI"),
                             "refers_to": number("X-Refers-To-Page"), "payload_digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                             "payload_bytes": len(payload) if payload is not None else int(stated[1]) if stated else None,
                             "payload": payload if with_payload else None}

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_ROW)
    schema = ("path string, start bigint, end bigint, status string, reason string, record_type string, page_id bigint, url string, refers_to bigint, "
              "payload_bytes bigint, payload_digest string, payload binary")
    return listing.select("path").repartition("path").mapInArrow(run, schema)
