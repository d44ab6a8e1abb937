"""WARC archives: one gzip member per record, written and read as streams.

Writing: pages with equal payloads share one response record, that of the smallest id; the others are revisit records,
which name it and carry the HTTP head only. Every task writes archives of about ``archive_bytes`` into a folder of the
shared storage and reports them in a manifest table; only archives of successful tasks are in the manifest.

Reading: an archive is a sequence of gzip members. It is read in blocks through an incremental zlib decompressor, never
whole; records are framed by Content-Length, and digests of blocks and payloads are verified.

Payloads of equal SHA-256 count as equal. Defined cases: a null html is the empty payload; repeated rows of the smallest
id are all responses; a null id is archived as such and is never referred to while an id is known; payloads below
``min_revisit`` bytes are always responses; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_READERS = 100_000
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
MAX_HEAD = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format or whose digests do not fit."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as one gzip member. The HTTP head states the full payload's length in either kind."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def members(read: Callable[[int], bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed blocks that must be used up before the next."""
    rest = read(READ_BYTES)
    while rest:
        unpack = zlib.decompressobj(31)

        def blocks() -> Iterator[bytes]:
            nonlocal rest
            while not unpack.eof:
                if not rest and not (rest := read(READ_BYTES)):
                    raise WarcError("the archive ends inside a gzip member")
                try:
                    data = unpack.decompress(rest, READ_BYTES)
                except zlib.error as e:
                    raise WarcError(f"broken gzip member: {e}") from e
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if data:
                    yield data

        yield blocks()
        if not unpack.eof:
            raise WarcError("a member was left unread")
        rest = rest or read(READ_BYTES)


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload_bytes(self) -> int:
        """What the HTTP head says; a response's own payload must have that length."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        names = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
        n = int(names.get(b"content-length", b"-1"))
        if not gap or n < 0:
            raise WarcError("the HTTP head has no Content-Length")
        if self.fields["warc-type"] == "response":
            if len(body) != n:
                raise WarcError(f"payload of {len(body)} bytes; the head says {n}")
            if (want := self.fields.get("warc-payload-digest")) and want != f"sha1:{digest(body)}":
                raise WarcError("payload digest does not fit")
        return n


def parse_record(blocks: Iterable[bytes]) -> Record:
    """One record from a member: head up to the empty line, block by Content-Length, closing empty lines."""
    data, blocks = bytearray(), iter(blocks)
    while (end := data.find(b"\r\n\r\n")) < 0:
        if len(data) > MAX_HEAD or not (more := next(blocks, b"")):
            raise WarcError("no end of the record's head")
        data += more
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    for more in blocks:
        data += more
    block, tail = bytes(data[end + 4 : end + 4 + size]), bytes(data[end + 4 + size :])
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
        raise WarcError("block digest does not fit")
    return Record(fields, block)


def read_records(read: Callable[[int], bytes]) -> Iterator[Record]:
    for blocks in members(read):
        yield parse_record(blocks)


def _named(text: str | None) -> int | None:
    name = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "null") else int(name)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``(page_id, url, payload, refers_to, revisit)``; a lazy manifest ``(archive, n_records)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, n, size = None, "", 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n))

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5))):
                if out is None or size >= archive_bytes:
                    close()
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                record = make_record(*(x.as_py() for x in row))
                out.write(record)
                n, size = n + 1, size + len(record)
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "n_records": [d[1] for d in done]})

    columns = ("page_id", "url", "payload", "refers_to", "revisit")
    return pages.select(*columns).mapInArrow(run, "archive string, n_records long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: ids, the payload's size and digest, type and reference, all verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=list(names))

        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, n = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream.read):
                        f = r.fields
                        digest_text = f["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_named(f["warc-record-id"]), r.payload_bytes, digest_text, f["warc-type"], _named(f.get("warc-refers-to")), f["warc-target-uri"]))
                        n += 1
                        if len(rows) >= 1000:
                            yield flush(rows)
                            rows = []
                if n != expected:
                    raise WarcError(f"{uri} holds {n} records; the manifest says {expected}")
                if rows:
                    yield flush(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return manifest.select("archive", "n_records").mapInArrow(run, schema)


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)``: which record of equal payloads is the response."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = keyed.where(F.length("payload") >= min_revisit).groupBy("key").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    # A written table: both sides of the join below are then plain scans, whose hot keys Spark can split.
    shared = scratch.save(shared.where("n > 1").select("key", "low"), "shared")
    revisit = F.coalesce(F.col("low").isNotNull() & ~F.col("low").eqNullSafe(F.col("page_id")), F.lit(False))
    joined = keyed.join(shared, "key", "left").withColumn("revisit", revisit)
    return joined.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("low")).alias("refers_to"), "revisit")


def archive_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row, then read the archives back: what they say of each row."""
    scratch = Scratch(pages.sparkSession, "warc")
    records = plan_records(pages, scratch, id_col, url_col, html_col, min_revisit)
    manifest = scratch.save(write_archives(records, f"{scratch.path}/archives", archive_bytes), "manifest")
    # a number keeps the archives from being folded into one task
    return read_archives(manifest.repartition(max(1, min(manifest.count(), MAX_READERS))))
