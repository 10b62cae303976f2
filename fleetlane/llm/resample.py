r"""Target-distribution importance resampling with a dictionary of distinct features (operator 13).

A document's features are its runs of 1 to `longest` words, joined by one space, repeats counted; words are
`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lowered. A feature's bucket is its CRC-32 modulo `buckets`. Of S features of
all documents, s are in a bucket; of T features of all target texts, t. A bucket's gain is
floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), a document's weight the sum of its features' gains.
A document's score is its weight plus Gumbel noise that follows from its doc_id; of those with at least `least` words the
`percent` per cent with the highest scores are drawn, equal scores in order of doc_id.

1. Features are counted by document. Documents that are read together (a chunk) name each feature once, with its number
   of occurrences, and refer to it by its place; so no word has more rows than there are chunks. A document is a row, and so
   are some features of a chunk; a chunk never is one.
2. The dictionary has each distinct feature once, with its occurrences in documents and target; it is hashed there and
   nowhere else, and buckets are sums over it.
3. The dictionary's gains are joined to the chunks' features, and go back to the chunks, where counts per document times
   gains give weights; documents are streamed behind their chunk's gains.
4. Scores are sorted in ranges, and a range's rank begins after those before it.

A null text has no words, so weight and features are 0, as for an empty one. Rows with equal doc_id are documents of their
own with the same noise; where they tie in score, they are ranked in any order. A row without doc_id has no score and isn't
drawn, nor counted among the documents drawn from; its features count. No target texts, no documents: defined likewise,
with T or S of 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, bytes_of, discard, slices, stored
from .words import ALNUM

LONGEST, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of text and distinct features after which a chunk is closed, features of a row, gains that a task packs at a time.
CHUNK, DISTINCT, PIECE, AT_ONCE = 16 << 20, 1 << 19, 256, 1 << 19


def features(text: bytes | None, longest: int) -> tuple[Counter, int]:
    """A text's features with their numbers, and how many words it has."""
    words = (text or b"").translate(ALNUM).split()
    out = Counter(words)
    for n in range(2, longest + 1):
        out.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return out, len(words)


class _Chunk:
    """Documents that are read together, and their features so far."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.docs, self.words, self.place, self.times, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None, longest: int) -> None:
        found, n = features(text, longest)
        index = self.index
        self.docs.append(doc_id)
        self.words.append(n)
        self.place.append(np.fromiter((index.setdefault(f, len(index)) for f in found), "<i4", len(found)))
        self.times.append(np.fromiter(found.values(), "<i4", len(found)))
        self.bytes += len(text or b"")

    def full(self) -> bool:
        return self.bytes >= CHUNK or len(self.index) >= DISTINCT

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for each PIECE features; batches of both are small."""
        for s in range(0, len(self.docs), BATCH_ROWS):
            of = slice(s, s + BATCH_ROWS)
            packed = [pa.array([x.tobytes() for x in part[of]], pa.binary()) for part in (self.place, self.times)]
            every = pa.array([int(x.sum(dtype=np.int64)) for x in self.times[of]], pa.int64())
            yield self._batch(number, doc_id=pa.array(self.docs[of], pa.int64()), words=pa.array(self.words[of], pa.int64()), features=every, place=packed[0], times=packed[1])
        total = np.zeros(len(self.index), np.int64)
        for place, times in zip(self.place, self.times, strict=True):
            total[place] += times  # a document names a place once
        names = pa.array(list(self.index), pa.binary()).cast(pa.string())
        for s in range(0, len(names), BATCH_ROWS * PIECE):
            upto = min(s + BATCH_ROWS * PIECE, len(names))
            first = np.arange(s, upto, PIECE, dtype=np.int32)
            edges = pa.array(np.append(first, upto) - s, pa.int32())
            lists = [pa.ListArray.from_arrays(edges, c) for c in (pa.array(total[s:upto]), names[s:upto])]
            yield self._batch(number, first=pa.array(first), total=lists[0], feature=lists[1])

    @staticmethod
    def _batch(number: int, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        rest = [columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _KINDS]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), *rest], names=["chunk", *(name for name, _ in _KINDS)])


_KINDS = [("doc_id", pa.int64()), ("words", pa.int64()), ("features", pa.int64()), ("place", pa.binary()), ("times", pa.binary()), ("first", pa.int32()), ("total", pa.list_(pa.int64())), ("feature", pa.list_(pa.string()))]


def _chunks(docs: DataFrame, longest: int) -> DataFrame:
    """Rows of two kinds. A document's: doc_id, words, features, and its distinct features as their places in its chunk and their
    numbers (packed as 32-bit integers). And up to PIECE features of a chunk from the place `first` on, with their numbers of
    occurrences; `first` is null in documents' rows. No row grows with a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text"), strict=True):
                chunk.add(doc_id, text, longest)
                if chunk.full():
                    yield from chunk.rows(number)
                    number, chunk = number + 1, _Chunk()
        if chunk.docs:
            yield from chunk.rows(number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "chunk long, doc_id long, words long, features long, place binary, times binary, first int, total array<long>, feature array<string>")


def _named(chunks: DataFrame) -> DataFrame:
    """chunk, place, feature and n of each feature that a chunk names."""
    each = chunks.filter("first is not null").select("chunk", "first", F.posexplode(F.arrays_zip("feature", "total")).alias("at", "x"))
    return each.select("chunk", (F.col("first") + F.col("at")).alias("place"), F.col("x.feature").alias("feature"), F.col("x.total").alias("n"))


def dictionary(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, bucket, s and t of each distinct feature of two tables (feature, n)."""
    zero = F.lit(0).cast("long")
    both = source.select("feature", F.col("n").alias("s"), zero.alias("t")).unionByName(target.select("feature", zero.alias("s"), F.col("n").alias("t")))
    sums = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return sums.select("feature", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"), "s", "t")


def gains(distinct: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of the buckets that have features: `buckets` rows at most."""
    sums = distinct.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t").cast("double") + 1.0) * F.lit(float(every["s"] + buckets)) / ((F.col("s").cast("double") + 1.0) * F.lit(float(every["t"] + buckets)))
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def _packed(gained: DataFrame) -> DataFrame:
    """chunk, place and gain, put together: chunk and gains, places in the upper and gains in the lower halves of 64-bit
    integers. A task holds AT_ONCE rows and writes a piece of each of their chunks."""

    def pieces(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        chunk, place, gain = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk, at = chunk[order], (place.astype("<i8")[order] << 32) | (gain[order] & 0xFFFFFFFF)  # a gain has 32 bits at most
        edges = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        parts = [at[s:e].tobytes() for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[edges]), pa.array(parts, pa.binary())], names=["chunk", "gains"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
                n += batch.num_rows
            if n >= AT_ONCE:
                yield pieces(held)
                held, n = [], 0
        if held:
            yield pieces(held)

    return gained.select("chunk", "place", "gain").mapInArrow(run, "chunk long, gains binary")


def _weights(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """doc_id, words, n_features and weight of all documents. A chunk's gains come before its documents, which are streamed; a
    task holds the gains of one chunk."""
    names = ["doc_id", "words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gain = None, np.zeros(0, np.int64)
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])).tolist() if len(chunks) else []
            for s, e in zip(edges, [*edges[1:], len(chunks)], strict=True) if edges else []:
                if chunks[s] != key:
                    key, gain = chunks[s], np.zeros(1 << 10, np.int64)
                of = {name: batch.column(k).slice(s, e - s) for k, name in enumerate(batch.schema.names)}
                for piece in of["gains"].drop_null().to_pylist():
                    at = np.frombuffer(piece, "<i8")
                    place = at >> 32
                    if (most := int(place.max())) >= len(gain):
                        gain = np.append(gain, np.zeros(most + 1, np.int64))
                    gain[place] = at.astype(np.int32)
                first = e - s - (of["gains"].null_count)
                of = {name: x.slice(first) for name, x in of.items()}
                if not len(of["doc_id"]):
                    continue
                place, times = (of[name].to_pylist() for name in ("place", "times"))
                upto = np.append(0, np.cumsum(gain[np.frombuffer(b"".join(place), "<i4")] * np.frombuffer(b"".join(times), "<i4")))
                weight = np.diff(upto[np.append(0, np.cumsum([len(x) // 4 for x in place]))])
                yield pa.RecordBatch.from_arrays([of["doc_id"], of["words"], of["features"], pa.array(weight)], names=names)

    docs = chunks.filter("first is null").select("chunk", F.lit(None).cast("binary").alias("gains"), "doc_id", "words", "features", "place", "times")
    rows = docs.unionByName(packed, allowMissingColumns=True)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("gains").isNull())
    return rows.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def weighted(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, words, n_features and weight of each document (doc_id, text) by the texts of a target (text)."""
    chunks = stored(_chunks(docs, longest), "chunks")
    wanted = _named(_chunks(target.select(F.lit(0).alias("doc_id"), "text"), longest))
    named = _named(chunks)
    distinct = stored(dictionary(named, wanted, buckets), "features")
    gained = distinct.filter("s > 0").join(F.broadcast(gains(distinct, buckets)), "bucket").select("feature", "gain")
    packed = _packed(named.select("chunk", "place", "feature").join(gained, "feature"))
    out = stored(_weights(chunks, packed), "weights")
    discard(chunks, distinct, shuffles=False)
    return out


def ranked(rows: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """rows (doc_id, words, score) with rank, which is null where a document isn't drawn."""
    eligible = (F.col("words") >= least) & F.col("score").isNotNull()
    n = rows.filter(eligible).count()
    drawn = percent * n // 100
    ordered = rows.filter(eligible).repartitionByRange(F.col("score").desc(), F.col("doc_id")).sortWithinPartitions(F.col("score").desc(), F.col("doc_id"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at + 1, at + batch.num_rows + 1))]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "within"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    ordered = stored(ordered.mapInArrow(numbered, f"{fields}, part int, within long"), "ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row for each range
    places = ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("within"))
    top = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rows.columns, "rank")
    return top.unionByName(rows.filter(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """doc_id, words, n_features, weight, score and rank of each document."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = weighted(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise)
    return ranked(rows, least, percent)


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that are drawn, with all their columns: those whose doc_id has a drawn row."""
    drawn = scored(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, F.col("doc_id").cast("long") == F.col("__drawn"), "left_semi")


def digests(docs: DataFrame, target: DataFrame) -> DataFrame:
    return scored(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
