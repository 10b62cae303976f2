"""Token-ID binary output with byte or bit planes (operator 2).

File: magic | chunks | footer | footer length (8 bytes) | magic. Chunks have `block` ids each (the last
one may have fewer). A chunk is transposed into planes, byte planes (plane k holds byte k of every id) or
bit planes, from the lowest to the highest that is not all zero, each compressed with zstandard. The
footer (zstandard-compressed JSON and arrays) holds the chunk index (offset, ids, sizes of planes) and
the document index (doc_id, number of ids). Files follow each other in ascending doc_id.

Null text is empty: its document has the end id alone. Documents with a null doc_id come first. Rows with
equal doc_id stand in the order of their texts; each is a document of its own. No documents: no files. A file
ends after FILE_IDS ids, with its last document; its name has its range's number and its own in that range.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec_of
from .common import open_fs, shared_dir, slices, strings_of
from .files import committed, dealt, manifest, temporary

MAGIC = b"FLPLANE1"
#: Ids of a file, whose document index is held in memory.
FILE_IDS = 1 << 26


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of unsigned 32-bit ids, without the highest ones that are all zero."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    by_byte = ids.view(np.uint8).reshape(-1, 4).T
    top = int(ids.max()) if len(ids) else 0
    if not bits:
        return [by_byte[k].tobytes() for k in range((top.bit_length() + 7) // 8)]
    return [np.packbits((by_byte[k // 8] >> (k % 8)) & 1).tobytes() for k in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros(n, dtype="<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        out |= (np.unpackbits(raw, count=n) if bits else raw).astype("<u4") << (k if bits else 8 * k)
    return out


class PlaneWriter:
    """Writes one file; holds a chunk and the indexes in memory."""

    def __init__(self, sink, block: int, bits: bool, level: int):
        self.sink, self.block, self.bits = sink, block, bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.wait, self.waiting, self.at = [], 0, len(MAGIC)
        self.chunks, self.doc_ids, self.counts = [], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.wait.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.wait), dtype="<u4")
        upto = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, upto, self.block):
            part = ids[i : min(i + self.block, upto)]
            planes = [self.pack.compress(p) for p in to_planes(part, self.bits)]
            self.chunks.append([self.at, len(part), [len(p) for p in planes]])
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.wait, self.waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> dict:
        self._flush(True)
        nulls = [i for i, x in enumerate(self.doc_ids) if x is None]
        head = json.dumps({"bits": self.bits, "block": self.block, "chunks": self.chunks, "documents": len(self.counts), "nulls": nulls}).encode()
        footer = self.pack.compress(struct.pack("<Q", len(head)) + head + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return {"n_docs": len(self.counts), "n_ids": sum(self.counts)}


def read_documents(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start within the file, ids) of each document; reads the file chunk by chunk."""
    unpack = zstandard.ZstdDecompressor()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a complete token file")
    (n,) = struct.unpack("<Q", tail[:8])
    source.seek(size - 16 - n)
    raw = unpack.decompress(source.read(n))
    (n,) = struct.unpack("<Q", raw[:8])
    head = json.loads(raw[8 : 8 + n])
    rows = np.frombuffer(raw[8 + n :], "<i8")
    doc_ids, counts, nulls = rows[: head["documents"]].tolist(), rows[head["documents"] :].tolist(), set(head["nulls"])
    chunks, have, at = iter(head["chunks"]), np.zeros(0, "<u4"), 0
    for i, (doc_id, count) in enumerate(zip(doc_ids, counts, strict=True)):
        parts, got = [have], len(have)
        while got < count:
            offset, n, sizes = next(chunks)
            source.seek(offset)
            parts.append(from_planes([unpack.decompress(source.read(x)) for x in sizes], n, head["bits"]))
            got += n
        have = np.concatenate(parts) if len(parts) > 1 else have
        yield None if i in nulls else doc_id, at, have[:count]
        have, at = have[count:], at + count


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 2, block: int = 1 << 16, bits: bool = False, level: int = 3, id_col: str = "doc_id", text_col: str = "text", engine: str = "tokenizers", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes text_col (engine: as for bpe.ForcedBoundaryCodec, with equal results), appends end_id to each document and
    writes the ids in ascending id_col to files in the folder `out`. Returns the manifest: name, n_docs, n_ids and start
    (ids in the files before)."""
    names, kinds = ["file", "name", "part", "number", "n_docs", "n_ids"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = codec_of(path, engine), np.array([end_id], "<u4").tobytes()
        fs, root = open_fs(out)
        part, sink, writer, ids_in, done = TaskContext.get().partitionId(), None, None, 0, []

        def closed() -> None:
            made = writer.close()
            sink.close()
            done.append((file, f"ids-{part:06d}-{len(done):04d}.flp", part, len(done), made["n_docs"], made["n_ids"]))

        for batch in slices(batches, "t"):
            for doc_id, ids in zip(strings_of(batch, "d"), codec.encode(strings_of(batch, "t")), strict=True):
                if writer is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    file = temporary()
                    sink, ids_in = fs.open_output_stream(f"{root}/{file}"), 0
                    writer = PlaneWriter(sink, block, bits, level)
                writer.add(doc_id, ids + end)
                ids_in += len(ids) // 4 + 1
                if ids_in >= file_ids:
                    closed()
                    writer = None
        if writer is not None:
            closed()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    def started(files: DataFrame) -> DataFrame:
        """Files with start. Sums of parts come before sums in them, so that one task sees a row a part at most."""
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("upto"))
        own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("upto") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))
        return files.join(sums, "part").withColumn("start", start).select("file", "name", "n_docs", "n_ids", "start")

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange("d").sortWithinPartitions("d", "t")
    return committed(rows.mapInArrow(run, "file string, name string, part int, number int, n_docs long, n_ids long"), out, started)


def read_token_files(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (binary) of each document."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        for name, start in (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            rows, held = [], 0
            with fs.open_input_file(f"{root}/{name}") as source:
                for doc_id, at, ids in read_documents(source, source.size()):
                    raw = ids.tobytes()
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(raw), raw)[: len(fields)])
                    held += len(raw) if with_ids else 0
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    files = dealt(manifest(spark, out).select("name", "start"))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def written_and_read(docs: DataFrame, path: str) -> DataFrame:
    out = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, out)
    return read_token_files(docs.sparkSession, out)
