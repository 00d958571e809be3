"""WARC archives in Zstandard form: a dictionary in a leading skippable frame, then one frame for each record.

Spark picks the record that is written in full for each payload, tasks write and read the archives, and a manifest
table of finished files links both: a file of a task that was lost or ran twice isn't in it, so it is never read.
Writers and readers stream; a task holds a file's first records (for its dictionary) and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm.shared import folder, materialised

#: Of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Bytes of records, before compression, of one archive; of the records that its dictionary is trained on; of the dictionary.
FILE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: The target of a page without a URL.
NO_URL = "about:blank"
#: Our own header, where a URL can't stand as it is: `none` for a page without one, `percent` where characters that would
#: end or change the line, and the percent sign with them, are encoded.
ESCAPE = "X-Target-Escape"
_BREAKS = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]|^[\s<]|[\s>]$|^$")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> list[tuple[str, str]]:
    """The header fields for a URL, from which `url_of` gives exactly the same text: as it is, unless that would break the line."""
    if url is None:
        return [("WARC-Target-URI", NO_URL), (ESCAPE, "none")]
    if not _BREAKS.search(url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", urllib.parse.quote(url, safe="!#$&'()*+,/:;=?@[]~") or "%"), (ESCAPE, "percent" if url else "empty")]


def url_of(fields: dict[str, str]) -> str | None:
    """The URL of a record; that of another writer as it stands there."""
    value, escape = fields["warc-target-uri"].removeprefix("<").removesuffix(">"), fields.get(ESCAPE.lower())
    return {"none": None, "empty": "", "percent": urllib.parse.unquote(value)}.get(escape, value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that keeps only the HTTP header; both name digest and length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        *target(url),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Invalid(ValueError):
    """An archive or record that breaks the format."""


def _fields(head: bytes) -> dict[str, str]:
    """The fields of a header by lower-case names; folded lines are joined, bytes that are not UTF-8 are Latin-1."""
    out: dict[str, str] = {}
    last = None
    for line in head.split(b"\r\n") if head else []:
        try:
            text = line.decode()
        except UnicodeDecodeError:
            text = line.decode("latin-1")
        if text[:1] in (" ", "\t") and last is not None:
            out[last] = f"{out[last]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Invalid(f"no header field: {line[:80]!r}")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _joined_chunks(body: bytes) -> bytes:
    """The content of a body in chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise Invalid("bad chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise Invalid("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _page_id(name: str) -> int | None:
    """The page_id in a record's name; null for names that other writers give."""
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", name)
    return int(found[1]) if found else None


def _digest_differs(name: str, payload: bytes) -> bool:
    """Whether a digest header in base32 or hex names another payload; algorithms unknown here are not judged."""
    algorithm, _, value = name.partition(":")
    if algorithm.lower() not in ("sha1", "md5", "sha256"):
        return False
    own = hashlib.new(algorithm.lower(), payload).digest()
    return value.upper().rstrip("=") not in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


def parse(data: bytes) -> dict | None:
    """The fields of one record, with its headers, lengths and digests checked; null for a record that holds no page.

    Pages are in response, revisit and resource records; others (warcinfo, request, metadata, conversion, continuation)
    are only checked. A payload digest is computed where the record names none in base32. The payload of another writer
    is taken as it is stored, chunks joined; the length that its HTTP header states is not asked of a body that is named
    as compressed, which may be stored plain. A digest may be that of the body with its chunks.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/(0\.1[78]|1\.[01])", version):
        raise Invalid("no WARC header")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Invalid(f"no {name}")
    if not fields["content-length"].isdecimal():
        raise Invalid("content-length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Invalid(f"record of {len(rest) - 4} bytes, not {length}")
    block, kind, named = rest[:length], fields["warc-type"], fields.get("warc-payload-digest", "")
    if "warc-block-digest" in fields and _digest_differs(fields["warc-block-digest"], block):
        raise Invalid("block differs from its digest")
    if kind not in ("response", "revisit", "resource"):
        return None
    if "warc-target-uri" not in fields:
        raise Invalid("no warc-target-uri")
    http, gap, payload = block.partition(b"\r\n\r\n") if kind != "resource" and block.startswith(b"HTTP/") else (b"", b"-", block)
    if not gap or kind == "revisit" and "warc-profile" not in fields:
        raise Invalid(f"bad {kind} record")
    told = _fields(http.partition(b"\r\n")[2]) if http else {}
    size = told.get("content-length") if "content-encoding" not in told and told.get("content-length", "").isdecimal() else None
    stored = payload
    if kind == "response" and "chunked" in told.get("transfer-encoding", "").lower() and re.match(rb"[0-9A-Fa-f]+[ \t]*(;|\r\n)", payload):
        payload, size = _joined_chunks(payload), None
    if kind == "revisit":
        if payload or not named or "warc-refers-to" not in fields:
            raise Invalid("bad revisit record")
    elif size is not None and len(payload) != int(size) or named and _digest_differs(named, payload) and _digest_differs(named, stored):
        raise Invalid("payload differs from its length or digest")
    base32 = re.fullmatch("sha1:([A-Z2-7]{32})", named)
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": url_of(fields),
        "payload_bytes": int(size) if kind == "revisit" and size is not None else len(payload),
        "payload_digest": base32[1] if base32 and payload is stored else named.partition(":")[2] if kind == "revisit" else digest(payload),
        "record_type": kind,
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind != "revisit" else None,
    }


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Spark's names of object stores are those of the same stores here."""
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


class Writer:
    """One archive; its dictionary is trained on the records before SAMPLE_BYTES, a bounded sample."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.out, self.path = store.open_output_stream(path, compression=None), path
        self.sample: list[bytes] | None = []
        self.n = self.size = 0

    def add(self, data: bytes) -> None:
        self.n += 1
        self.size += len(data)
        if self.sample is None:
            self.out.write(self.compressor.compress(data))
            return
        self.sample.append(data)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        trained = None
        if len(self.sample) >= 8:
            try:
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.sample)
            except zstandard.ZstdError:  # too little in common: no dictionary
                trained = None
        if trained:
            body = trained.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        waiting, self.sample = self.sample, None
        for data in waiting:
            self.out.write(self.compressor.compress(data))

    def close(self) -> dict:
        if self.sample is not None:
            self._start()
        self.out.close()
        return {"path": self.path, "records": self.n}


def read_archive(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, a frame each; nothing but one record and one chunk is held."""
    data = stream.read(8)
    trained = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise Invalid("the dictionary is cut off")
        if struct.unpack("<I", body[:4])[0] == FRAME_MAGIC:  # it may be compressed itself
            body = zstandard.ZstdDecompressor().decompress(body)
        trained, data = zstandard.ZstdCompressionDict(body), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        frame, out = decompressor.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise Invalid("the last frame is cut off")
        data = frame.unused_data
        yield b"".join(out)


def _records(stream: pa.NativeFile, keep_broken: bool) -> Iterator[bytes | None]:
    """The records of an archive; None at the end of one that breaks off, if such are kept."""
    try:
        yield from read_archive(stream)
    except (Invalid, zstandard.ZstdError):
        if not keep_broken:
            raise
        yield None


def broken(data: bytes) -> dict:
    """The row of a record that breaks the format."""
    return dict.fromkeys(RECORD.names) | {"record_type": "broken", "payload_bytes": len(data), "payload": data}


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0) -> DataFrame:
    """(path, records): a manifest of the archives that hold a record for each page.

    Columns page_id, url, html (null: empty). Of pages with equal payloads of at least least_bytes bytes the one with
    the largest page_id is written in full; the others refer to it (pages that share that id are all in full). Pages
    without a page_id refer to the largest one, or are in full if there is none. Any URL comes back as it was, null and
    the empty one too. One record for each row, repeated rows too; an empty table gives no archive. Other columns are not
    read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary"))))
    # Only payloads that occur twice are joined back; the count is summed before it is shuffled.
    whole = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("whole"), F.count("*").alias("n")).where("n > 1").select("sha", "whole")
    rows = rows.join(whole, "sha", "left").select("page_id", "url", "html", "whole")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        writer = None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, whole = (batch.column(k)[i].as_py() for k in range(4))
                if writer is None:
                    writer = Writer(store, f"{base}/{uuid.uuid4().hex}.warc.zst")
                writer.add(record(page_id, url, html.encode(), whole, whole is not None and whole != page_id))
                if writer.size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pylist([writer.close()], schema=MANIFEST)
                    writer = None
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=MANIFEST)

    return rows.mapInArrow(write, "path string, records bigint")


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, root: str, *, with_payload: bool = True, keep_broken: bool = False) -> DataFrame:
    """The records of the archives of a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    One row for each page record of each archive, none for an empty manifest. A record or archive that breaks the format,
    or another number of records than the manifest says, fails the job; with keep_broken each is a row of its own instead,
    of record_type `broken` (its payload as it is), and of an archive the records before the break come out. root: a URI of the file system that the paths are of.
    """
    schema = RECORD if with_payload else RECORD.remove(len(RECORD) - 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in _records(stream, keep_broken):
                        try:
                            row = parse(data) if data is not None else broken(b"")
                        except Invalid:
                            if not keep_broken:
                                raise
                            row = broken(data)
                        seen += data is not None
                        if row:
                            rows.append({k: row[k] for k in schema.names})
                            size += len(data or b"")
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if seen != records and not keep_broken:
                    raise Invalid(f"{path}: {seen} records, not {records}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return manifest.mapInArrow(read, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def round_trip(pages: DataFrame, *, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """The pages, written as archives to the shared folder and read back."""
    path = folder(pages.sparkSession)
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    manifest = materialised(write_archives(pages, path, least_bytes=least_bytes))
    tasks = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return read_archives(manifest.repartition(tasks), path, with_payload=with_payload)
