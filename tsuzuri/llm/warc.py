"""WARC archives: a writer with one gzip member per record and a sequential reader.

The writer labels records first: of equal payloads (by SHA-1) of at least ``least`` bytes the one with
the smallest key is the ``response``, the others are ``revisit`` records that refer to it and hold the
HTTP header only.  Labelling shuffles digests and keys, never payloads; the repeated digests are
written first, so that both sides of the join are plain exchanges, which Spark splits when one
digest holds a large share of the rows.  Each partition then becomes
one archive in the shared folder, under a name that its content decides, by a rename: a task that
runs again, or twice at once, leaves the same file.

The reader takes one archive at a time through incremental zlib decompression, frames records by
their content length, and checks the block digest of each record and the payload digest of responses.

Defined results: a null payload is the empty payload, a null URL gives no target header.  A repeated key with an
equal payload is ``response`` in every repeat if it is the group's smallest; with another payload it is labelled
by that payload.  A row without a key is a revisit where a row with a key has its payload, else a
response; its record is named after the payload, and its key comes back as null.  URLs come back as they were.  Every row has a record, an
empty table none, and payloads of any length are written whole.  Columns other than key, URL and payload are
not read.  Broken digests or truncated records raise.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsuzuri.llm.common import map_arrow, settle, shared_dir, shuffle_width, slices

READ = 1 << 16
FIXED_DATE = "2000-01-01T00:00:00Z"
ESCAPED = "X-Target-URI-Escaped"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, payload: bytes = b"") -> str:
    """The key as a UUID; without a key a UUID of the payload, above all keys."""
    n = key & ((1 << 64) - 1) if key is not None else 1 << 127 | int.from_bytes(hashlib.sha1(payload).digest()[:15])
    return f"<{uuid.UUID(int=n).urn}>"


def key_of(rid: str) -> int | None:
    n = uuid.UUID(rid.strip("<>")).int
    if n >> 64:
        return None
    return n - (1 << 64) if n >= 1 << 63 else n


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key, payload)}", f"WARC-Date: {FIXED_DATE}"]
    if url is not None:
        odd = url != url.strip() or not url.isprintable()  # such a header would not come back as it was
        head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=') if odd else url}"] + [f"{ESCAPED}: yes"] * odd
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(read) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, each in full; ``read(n)`` gives the next bytes."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = rest or read(READ)
            if not data:
                if parts or z.unconsumed_tail:
                    raise WarcError("the archive ends inside a record")
                return
            parts.append(z.decompress(data))
            rest = z.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, framed by its content length, with its digests verified."""
    end = member.find(b"\r\n\r\n")
    lines = member[:end].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise WarcError("no record header")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = member[end + 4 : end + 4 + int(head["content-length"])]
    if len(block) != int(head["content-length"]) or member[end + 4 + len(block) :] != b"\r\n\r\n":
        raise WarcError(f"content length and record end differ in {head.get('warc-record-id')}")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise WarcError(f"block digest differs in {head['warc-record-id']}")
    if head["warc-type"] == "response" and "warc-payload-digest" in head:
        if head["warc-payload-digest"] != f"sha1:{base32_sha1(block.partition(b'\r\n\r\n')[2])}":
            raise WarcError(f"payload digest differs in {head['warc-record-id']}")
    return head, block


def fields(head: dict[str, str], block: bytes) -> dict:
    """What a record says about its page."""
    http, _, body = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    size = len(body) if head["warc-type"] == "response" else int(said["content-length"])
    to = head.get("warc-refers-to")
    return {
        "key": key_of(head["warc-record-id"]),
        "url": unquote(head["warc-target-uri"]) if ESCAPED.lower() in head else head.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": head["warc-type"],
        "refers_to": key_of(to) if to else None,
        "payload": body if head["warc-type"] == "response" else None,
    }


def label(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """``k``, ``d`` (digest) and ``refers_to`` of each key and payload that is a revisit; only digests move."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    big = pages.where(F.length(body) >= least).select(F.col(key).alias("k"), F.sha1(body).alias("d"))
    first = settle(big.groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    joined = big.join(first, "d").where("k is null or k > first")
    return joined.groupBy("k", "d").agg(F.min("first").alias("refers_to"))


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write archives to the shared folder; gives one row for each archive: path, records, bytes."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("p"))
    named = label(pages, key, payload, least).select(F.col("k").alias("lk"), "d", "refers_to")
    own = F.sha1(F.coalesce(F.col("p"), F.lit("")).cast("binary"))
    named = rows.join(named, F.col("k").eqNullSafe(F.col("lk")) & (own == F.col("d")), "left").select("k", "u", "p", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        mine = f"{base}/.{uuid.uuid4().hex}"
        n, total, name = 0, 0, hashlib.sha1()
        out = None
        try:
            for b in slices(batches):
                for k, u, p, to in zip(*(c.to_pylist() for c in b.columns)):
                    data = record(k, u, (p or "").encode(), to)
                    out = out or where.open_output_stream(mine, compression=None)
                    out.write(data)
                    name.update(data)
                    n, total = n + 1, total + len(data)
        except BaseException:  # a failed task leaves no part of an archive
            if out:
                out.close()
                where.delete_file(mine)
            raise
        if out:
            out.close()
            final = f"{base}/{name.hexdigest()}.warc.gz"
            where.move(mine, final)
            uri = folder.split(base)[0] + final
            yield pa.RecordBatch.from_pydict({"path": [uri], "records": [n], "bytes": [total]})

    return map_arrow(named, run, "path string, records bigint, bytes bigint")


def read(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives in column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as f:
                    rows = []
                    for m in members(f.read):
                        rows.append(fields(*parse(m)))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(archives.select("path"), run, "key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    archives = settle(write(pages, least=least))
    spread = archives.repartition(shuffle_width(pages.sparkSession), "path")
    return read(spread).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
