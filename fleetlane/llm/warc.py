"""Deterministic sharded WARC writer and its reader (operator 4).

Records are range-sorted by id and dealt out to shards of about equal bytes. Cuts between shards are quantiles
of a bounded sample of the rows, chosen by their hash, and not of how they happen to be partitioned, so equal
rows give equal files. A single id with more bytes than a shard has one of its own, in parts by digest. In a
shard records are sorted by id, digest, url and payload; files are rolled when the compressed size passes a
limit, every record a gzip member of its own. Headers (ids, lengths, digests) are made anew from the payload.
Dates are a parameter and record ids follow from the content.
Files are written under temporary names and committed by the manifest (files.py).

Of records whose payloads are equal and at least `revisit_from` bytes long, the one with the largest id
is a response and the others revisit it: their blocks are empty, and the reader takes length and digest
of the payload from the headers. Null html is an empty payload; null urls are written as urn:none.
Repeated rows are records of their own; of equal largest ids the first by url is the response. Records
with a null id come first and are never the target of a revisit while another id is there.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, open_fs, shared_dir, slices
from .files import committed, dealt, manifest, temporary

CRLF = b"\r\n"
#: Bytes of payload of a shard, shards at most, and rows that are sampled for each cut between them.
SHARD_BYTES, SHARDS, SAMPLE_ROWS = 64 << 20, 1 << 16, 16
#: Parts of a group of equal payloads.
COPY_PARTS = 32


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One uncompressed record. The payload's digest is a bare lower-case hex SHA-1."""
    block = b"" if is_revisit else payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in url if c > " ") if url else "urn:none"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if is_revisit:
        head.insert(4, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.insert(5, ("WARC-Refers-To", record_id(refers_to, digest)))
        head.insert(6, ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return b"WARC/1.1\r\n" + lines + CRLF + block + CRLF + CRLF


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a binary stream; checks lengths and block digests."""
    rest = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            rest = rest or source.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("a record is cut short")
                return
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data if inflate.eof else b""
        raw = b"".join(parts)
        head, _, body = raw.partition(CRLF + CRLF)
        first, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = body[: int(headers["Content-Length"])]
        if first != "WARC/1.1" or body[len(block) :] != CRLF + CRLF or headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise ValueError(f"bad record {headers.get('WARC-Record-ID')}")
        yield headers, block


def revisits(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """(page_id, digest, kept) of the pages whose payload others have too; kept: the largest page_id of them."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= revisit_from)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(COPY_PARTS)))  # a payload that very many pages share is told them in parts
    parts = rows.groupBy("digest", "part").agg(F.count("*").alias("copies"), F.max("page_id").alias("kept"))
    groups = parts.groupBy("digest").agg(F.sum("copies").alias("copies"), F.max("kept").alias("kept")).filter("copies > 1").select("digest", "kept")
    return rows.join(parts.select("digest", "part").join(groups, "digest"), ["digest", "part"]).select("page_id", "digest", "kept").distinct()


def cuts(pages: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where shards begin (the first one aside), and how many parts each shard has."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    rows, total = pages.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    shards = max(1, min(SHARDS, -(-total // shard_bytes)))
    some = pages.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, rows // max(4096, SAMPLE_ROWS * shards)))) == 0))
    some = some.groupBy("page_id").agg(F.sum(size + 1).alias("bytes")).toArrow()  # about SAMPLE_ROWS a shard, or 4096, if there are more
    ids, sizes = (some.column(c).to_numpy().astype(np.int64) for c in ("page_id", "bytes"))
    order = np.argsort(ids)
    ids, sizes = ids[order], sizes[order]
    if shards == 1 or not len(ids):
        return np.zeros(0, np.int64), np.ones(1, np.int64)
    upto, whole = np.cumsum(sizes), int(sizes.sum())
    begins = ids[np.searchsorted(upto, [whole * k // shards for k in range(1, shards)], side="right")]
    parts = -(-sizes * shards // whole)
    own = ids[parts > 1]
    begins = np.unique(np.concatenate([begins, own, own + 1]))
    each = np.ones(len(begins) + 1, np.int64)
    each[np.searchsorted(begins, own, side="right")] = parts[parts > 1]
    return begins, each


def write_warc(pages: DataFrame, out: str, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", revisit_from: int = 1000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the pages to WARC files in the folder `out`; returns the manifest: name, records, bytes and digest (SHA-1)
    of each file. Names sort as the ids do.

    What is known of copies is dealt out together with the pages, so that payloads are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        sink, done, hashed = None, [], None
        shard, part = None, 0
        at, copies, seen = object(), {}, set()

        def closed() -> None:
            sink.close()
            done[-1]["digest"] = hashed.hexdigest()

        for batch in slices(batches, "html"):
            for own, page_id, role, digest, url, kept, html in zip(*(batch.column(k).to_pylist() for k in range(6)), bytes_of(batch, "html"), strict=True):
                if own != shard:
                    if sink is not None:
                        closed()
                    shard, part, sink = own, 0, None
                    at = object()
                if page_id != at:
                    at, copies, seen = page_id, {}, set()
                if not role:
                    copies[digest] = kept
                    continue
                html = html or b""
                is_revisit = digest in copies and (copies[digest] != page_id or digest in seen)
                seen.add(digest)
                if sink is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    done.append({"file": temporary(), "name": f"pages-{shard}-{part:05d}.warc.gz", "records": 0, "bytes": 0})
                    sink, hashed, part = fs.open_output_stream(f"{root}/{done[-1]['file']}", compression=None), hashlib.sha1(), part + 1
                member = gzip.compress(record(page_id, url, html, digest, copies.get(digest), is_revisit, date), 6, mtime=0)
                sink.write(member)
                hashed.update(member)
                done[-1]["records"] += 1
                done[-1]["bytes"] += len(member)
                if done[-1]["bytes"] >= roll_bytes:
                    closed()
                    sink = None
        if sink is not None:
            closed()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())]))

    text = F.lit(None).cast("string")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    copied = revisits(pages, revisit_from).select("page_id", F.lit(0).alias("role"), "digest", text.alias("url"), "kept", text.alias("html"))
    own = pages.select(F.col("page_id").cast("long"), F.lit(1).alias("role"), F.sha1(payload).alias("digest"), F.col("url").cast("string"), F.lit(None).cast("long").alias("kept"), F.col("html").cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast(cuts(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), shard_bytes))

    @F.pandas_udf("string")
    def shard(page_id: pd.Series, prefix: pd.Series) -> pd.Series:
        begins, parts = shared.value
        at = np.searchsorted(begins, page_id.to_numpy(), side="right")
        return pd.Series([f"{a:06d}-{p:05d}" for a, p in zip(at.tolist(), (prefix.to_numpy() * parts[at] >> 16).tolist(), strict=True)])

    first = F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    rows = copied.unionByName(own).withColumn("shard", shard(F.coalesce("page_id", F.lit(-(1 << 63))), first)).select("shard", "page_id", "role", "digest", "url", "kept", "html")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "page_id", "role", "digest", "url", "html")
    return committed(rows.mapInArrow(run, "file string, name string, records long, bytes long, digest string"), out)


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each record in the folder."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]

    def parsed(name: str) -> Iterator[tuple]:
        fs, root = open_fs(out)
        with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
            for h, block in read_records(source):
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != int(h["X-Payload-Length"])):
                    raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
                number = lambda k: int(h[k]) if h.get(k) else None
                yield number("X-Page-ID"), int(h["X-Payload-Length"]), digest, kind, number("X-Refers-To-Page-ID"), h["WARC-Target-URI"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            held = []
            for row in parsed(name):
                held.append(row)
                if len(held) == 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    names = dealt(manifest(spark, out).select("name"))
    return names.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def written_and_read(pages: DataFrame) -> DataFrame:
    out = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, out)
    return read_warc(pages.sparkSession, out).drop("url")
