"""WARC archives: one gzip member per record, written and read back sequentially.

Writing: each task streams its pages into archives in the shared folder, a new one every ``ROLL`` bytes, and
returns a manifest row per finished archive. An archive of a failed task is in no manifest. Of records with
equal payloads of ``LEAST`` bytes or more the one with the largest page_id is a response and the others
revisit it; the payload of a revisit is not written.

Reading: an archive is read in pieces of ``CHUNK`` bytes; each gzip member is inflated incrementally, the
record's block is framed by its Content-Length, and payload and block digests are verified.

Defined results: a null html is an empty payload; a null url writes no target URI; control characters of a
url are percent-encoded; a row with a null page_id is always a response (the record has no page id);
repeated rows with the same page_id as the response are responses too; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from . import common

LEAST = 1000
ROLL = 64 << 20
CHUNK = 1 << 14
#: Inflated bytes that are held at once.
INFLATED = 1 << 20
#: Groups of equal payloads that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The format's version line, revisit profile and record namespace.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
EOL = b"\r\n"


def digest(data: bytes) -> str:
    """A SHA-1 in the format's own notation."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def bare(labelled: str) -> str:
    """The lower-case hex of a SHA-1 in the format's notation."""
    return base64.b32decode(labelled.partition(":")[2]).hex()


def _head(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    lines = [first] + [f"{k}: {''.join(c if c >= ' ' and c != chr(127) else f'%{ord(c):02X}' for c in v)}" for k, v in fields if v is not None]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + EOL + EOL


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response, or with ``refers_to`` a revisit of that page's response, before compression."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else _urn(refers_to)),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("X-Refers-To-Page-Id", None if refers_to is None else str(refers_to)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _head(VERSION, fields) + block + EOL + EOL


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(read) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; ``read(n)`` gives the next bytes. Each must be used up before the next."""
    rest = read(CHUNK)
    while rest:
        z = zlib.decompressobj(31)

        def pieces(z=z):
            nonlocal rest
            while not z.eof:
                if not rest and not z.unconsumed_tail:
                    rest = read(CHUNK)
                    if not rest:
                        raise ValueError("the archive ends within a gzip member")
                data = z.decompress(z.unconsumed_tail + rest, INFLATED)
                rest = b""
                if data:
                    yield data
            rest = z.unused_data

        yield pieces()
        rest = rest or read(CHUNK)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class Framed:
    """Bytes of a member by header and by length."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""

    def head(self) -> bytes:
        while (end := self.held.find(EOL + EOL)) < 0:
            piece = next(self.pieces, b"")
            if not piece:
                raise ValueError("a record's header doesn't end")
            self.held += piece
        out, self.held = self.held[:end], self.held[end + 4 :]
        return out

    def body(self, length: int) -> Iterator[bytes]:
        while length > 0:
            if not self.held:
                self.held = next(self.pieces, b"")
                if not self.held:
                    raise ValueError("a record is shorter than its Content-Length")
            piece, self.held = self.held[:length], self.held[length:]
            length -= len(piece)
            yield piece

    def ends(self) -> bool:
        return self.held + b"".join(self.pieces) == EOL + EOL


def records(read) -> Iterator[dict]:
    """The records of an archive: fields, payload_bytes and payload_digest (bare hex), both verified.

    ValueError for a record that is cut off, badly framed, or whose digests do not hold.
    """
    for pieces in members(read):
        frame = Framed(pieces)
        version, fields = _fields(frame.head())
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        length = int(fields["content-length"])
        inner = Framed(frame.body(length))
        http = inner.head()
        _, said = _fields(http)
        block, payload, n = hashlib.sha1(http + EOL + EOL), hashlib.sha1(), 0
        for piece in inner.body(length - len(http) - 4):
            block.update(piece)
            payload.update(piece)
            n += len(piece)
        if not frame.ends():
            raise ValueError("a record is longer than its Content-Length")
        if bare(fields["warc-block-digest"]) != block.hexdigest():
            raise ValueError(f"block digest of {fields.get('warc-record-id')} does not hold")
        kind = fields["warc-type"]
        if kind == "response" and (bare(fields["warc-payload-digest"]) != payload.hexdigest() or n != int(said["content-length"])):
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not hold")
        yield {
            "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
            "url": fields.get("warc-target-uri"),
            "payload_bytes": int(said["content-length"]),
            "payload_digest": bare(fields["warc-payload-digest"]),
            "record_type": kind,
            "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
        }


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to): the response that a page revisits, null for responses."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = lambda df: df.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    groups = keyed(rows).groupBy("sha", "n").agg(F.max("page_id").alias("largest"), F.min("page_id").alias("smallest"))
    groups = common.materialise(groups.where("largest > smallest").select("sha", "n", "largest"), "equal-payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    sha, n = F.when(F.octet_length("payload") >= least, F.sha1("payload")).otherwise(F.xxhash64("page_id").cast("string")), F.octet_length("payload")
    joined = rows.withColumns({"sha": sha, "n": n}).join(groups, ["sha", "n"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Archives of ``with_roles``'s rows in ``folder`` (a URI that pyarrow can open); returns their manifest (path, records, bytes), written too."""
    common.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0

        def row():
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = member(record(page_id, url, payload, refers_to))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    manifest = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return common.materialise(manifest, "archives")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives of a manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        pack = lambda rows: pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in columns.items()})
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None, buffer_size=INFLATED) as stream:
                    for r in records(stream.read):
                        rows.append(r)
                        if len(rows) == 1000:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    archives = manifest.count()
    dealt = manifest.select("path").repartition(max(1, archives))
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes an archive record per page, in a new folder of the shared one by default, and reads the archives back."""
    folder = folder or f"{common.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(with_roles(pages), folder), folder)
