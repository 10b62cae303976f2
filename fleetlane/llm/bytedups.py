"""Suffix-array dedup by run-length indexes (operator 12).

Each byte of a text covered by a string of `window` bytes that also starts anywhere else, in the same text too, is
removed; all copies go. Strings are judged on the input, and never cross texts. Text is taken as UTF-8 bytes.

1. Every window has an anchor: of its runs of `gram` bytes the one with the least hash, the leftmost of equal ones. Equal
   windows have equal anchors, so anchors that occur once in all texts are dropped with their windows. The windows
   that hold an anchor at the same place follow each other; together they are a piece of text, named by 128 bits of hash.
2. Copies of a piece are counted, not compared: where a piece occurs twice, all its windows do. One of them stands for all.
3. The different pieces of an anchor are indexed together, those of several anchors in one index of bounded size: a
   run-compressed Burrows-Wheeler transform with samples at the borders of runs (runindex.py). Matching
   statistics of the pieces are streamed from it, and tell which windows also start in another piece.
4. An anchor with over `crowd` different pieces (a common line between ever other words) isn't gathered in a task. Its
   pieces are cut in WAYS by where their windows have the anchor; the windows of a part have more bytes around
   the anchor in common than the anchor, and these are the part's key. Copies are counted and different parts indexed
   as above; where a key is crowded still, its parts are cut again, at last to single windows, which are their keys.

Keys that hold over a HEAVY_SHARE-th of all rows, of which there are fewer than that number, are broadcast.

Null and empty texts have no windows. Rows are texts of their own, whatever their doc_id: rows with equal doc_id
and text are copies of each other, a null doc_id is an id like others. No documents: no rows. Result columns
replace columns of their names; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, discard, slices, stored
from .runindex import long_matches
from .words import K1, K2

WINDOW, GRAM = 200, 16
#: Different pieces of an anchor that one index may hold; bytes of pieces after which an index is closed.
CROWD, INDEX_BYTES = 1_000, 1 << 16
#: Into how many parts a crowded anchor's windows are cut at a time.
WAYS = 4
#: Bytes of text that a task works on at a time, and so many bits tell a place in it.
AT_ONCE, PLACE_BITS = 4 << 20, 24
HEAVY_SHARE, HEAVY_ROWS = 2_000, 500


def gram_hashes(text: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes (8 to 16)."""
    n = max(0, len(text) - gram + 1)
    if not n:
        return np.zeros(0, np.uint64)
    word = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = word[:n] * K1
    h ^= h >> np.uint64(32)
    h += word[gram - 8 : gram - 8 + n]
    h *= K2
    h ^= h >> np.uint64(29)
    h *= K1
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window, windows, place of the anchor in the first one) of the pieces of texts that stand one
    after the other up to these ends."""
    none = np.zeros(0, np.int64)
    if len(text) < window:
        return none.view(np.uint64), none, none, none
    h = gram_hashes(text, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, whole = 1, window - gram + 1
    while width < whole:
        step = min(width, whole - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    edges = np.zeros(len(text) + 1, np.int32)
    begins = np.append(0, ends[:-1])
    fits = ends - begins >= window
    edges[begins[fits]] += 1
    edges[ends[fits] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(edges[: len(least)]) > 0)
    place = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at
    return h[place[first]], at[first], np.diff(np.append(first, len(at))), place[first] - at[first]


def _names(text: bytes, first: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """128 bits of hash of each piece, as two numbers."""
    digests = b"".join(xxhash.xxh3_128_digest(text[a : a + n + window - 1]) for a, n in zip(first.tolist(), windows.tolist(), strict=True))
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _found_in(text: bytes, ends: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() and names of a text that may be longer than PLACE_BITS tell, part by part."""
    most = 1 << (PLACE_BITS - 1)
    for lo in range(0, max(1, len(text) - window + 1), most):
        part = text[lo : lo + most + window - 1] if len(text) > most + window else text
        anchor, first, windows, offset = anchors(part, np.minimum(ends - lo, len(part)), window, gram)
        yield anchor.view(np.int64), _names(part, first, windows, window), first + lo, windows, offset


def _row_key() -> list[Column]:
    """What tells rows apart whose texts differ."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.col("text").cast("string"), F.col("doc_id").isNull()).alias("h")]


def _keyed(docs: DataFrame, window: int) -> DataFrame:
    return docs.filter(F.octet_length(F.col("text").cast("string")) >= window).select(*_row_key(), F.col("text").cast("string").alias("text"))


def _anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            texts = bytes_of(batch, "text")
            ends = np.cumsum([len(t) for t in texts])
            begins = np.append(0, ends[:-1])
            anchor, name, first, windows, offset = (np.concatenate(x) for x in zip(*_found_in(b"".join(texts), ends, window, gram), strict=True))
            of = np.searchsorted(ends, first, side="right")
            cuts = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
            columns = (anchor, name[:, 0], name[:, 1], (first - begins[of]).astype(np.int32), windows.astype(np.int16), offset.astype(np.int16))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(x))) for x in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["d", "h", "anchor", "k1", "k2", "start", "windows", "offset"])

    return _keyed(docs, window).mapInArrow(run, "d long, h long, anchor array<long>, k1 array<long>, k2 array<long>, start array<int>, windows array<short>, offset array<short>")


def _joined(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys, of which those that are `heavy` are few and broadcast."""
    heavy = F.broadcast(keys.filter("heavy").drop("heavy"))
    usual = rows.join(heavy.select(*on), on, "left_anti").join(keys.filter("not heavy").drop("heavy"), on)
    return usual.unionByName(rows.join(heavy, on))


def _heavy(count: str, every: int) -> Column:
    return (F.col(count) > max(HEAVY_ROWS, every // HEAVY_SHARE)).alias("heavy")


PIECE = {"key": "long", "many": "boolean", "crowded": "boolean", "d": "long", "h": "long", "start": "int", "offset": "int", "least": "int", "piece": "binary"}
KINDS = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _taken(docs: DataFrame, by_doc: DataFrame, window: int) -> DataFrame:
    """PIECE: the texts of pieces (by_doc: lists of a row's pieces). offset: where the first window has its anchor; least: the
    least offset of the key's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            out = []
            for d, h, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch, "text"), batch.column(3).to_pylist(), strict=True):
                out += [(x["anchor"], x["many"], x["crowded"], d, h, s, x["offset"], 0, text[s : s + x["windows"] + window - 1]) for x in at for s in (x["start"],)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(KINDS)], names=list(PIECE))

    return _keyed(docs, window).join(by_doc, ["d", "h"]).select("d", "h", "text", "at").mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in PIECE.items()))


def parted(piece: bytes, offset: int, least: int, width: int, ways: int, window: int) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key's text, first window, least offset, text) of the parts of a piece whose windows have offsets from least on, below
    least + width. The key's text is what all windows with the part's offsets have in common."""
    step = -(-width // ways)
    for low in range(least, least + width, step):
        first, last = max(0, offset - low - step + 1), min(len(piece) - window, offset - low)
        if first <= last:
            yield piece[offset - low : offset - low - step + 1 + window], first, low, piece[first : last + window]


def _parts(crowded: DataFrame, width: int, ways: int, window: int) -> DataFrame:
    """The parts of crowded pieces, with their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece"):
            out = []
            for many, d, h, start, offset, least, piece in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                for common, first, low, text in parted(piece, offset, least, width, ways, window):
                    name = np.frombuffer(xxhash.xxh3_128_digest(text), "<i8").tolist()
                    key = np.frombuffer(xxhash.xxh3_64_digest(common, seed=low), ">i8")[0]
                    out.append((key, many, d, h, start + first, offset - first, low, text, *name))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "many", "d", "h", "start", "offset", "least", "piece", "k1", "k2"])

    rows = crowded.select("many", "d", "h", "start", "offset", "least", "piece")
    return rows.mapInArrow(run, "key long, many boolean, d long, h long, start int, offset int, least int, piece binary, k1 long, k2 long")


def _uncrowded(crowded: DataFrame, window: int, gram: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(matches, pieces) of crowded pieces that are parted until no key is crowded: what occurs twice of pieces that occur once
    (d, h, first, bytes), and what is left to be indexed (PIECE)."""
    matches, pieces, width = [], [], window - gram + 1
    while not crowded.isEmpty():
        parts = stored(_parts(crowded, width, WAYS, window), "byte-parts")
        width = -(-width // WAYS)
        name = ["key", "k1", "k2"]
        one = F.min(F.struct("d", "h", "start", "offset", "least", "piece")).alias("one")
        kinds = stored(parts.groupBy(*name).agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), one), "byte-part-kinds")
        every = kinds.agg(F.sum("n")).first()[0] or 0
        twice = _joined(parts.filter("not many"), kinds.filter("n > 1").select(*name, _heavy("n", every)), name)
        matches.append(stored(twice.select("d", "h", F.col("start").cast("long").alias("first"), F.octet_length("piece").cast("long").alias("bytes")), "byte-part-copies"))
        discard(parts, shuffles=False)
        sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key", ((F.col("kinds") > crowd) & (F.lit(width) > 1)).alias("crowded"), _heavy("kinds", every))
        mixed = _joined(kinds, sizes, ["key"]).select("key", (F.col("n") > 1).alias("many"), "crowded", "one.*")
        pieces.append(stored(mixed.select(*PIECE), "byte-pieces"))
        discard(kinds, shuffles=False)
        crowded = pieces[-1].filter("crowded")
    return matches, pieces


def _indexed(pieces: DataFrame, window: int, index_bytes: int) -> DataFrame:
    """(d, h, first, bytes) of what other pieces of the same key also hold, of pieces that occur once."""

    def matched(held: list[tuple]) -> pa.RecordBatch:
        out = [(*held[k][1:3], held[k][3] + first, n + window - 1) for k, first, n in long_matches([x[4] for x in held], window) if not held[k][0]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["d", "h", "first", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at and size >= index_bytes:
                    yield matched(held)
                    held, size = [], 0
                at = key
                held.append(row)
                size += len(row[4])
        yield matched(held)

    rows = pieces.filter("not crowded").select("key", "many", "d", "h", "start", "piece")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "d long, h long, first long, bytes long")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """d, h (the key of rows with equal doc_id and text) and found: an array of (first, bytes) whose windows start elsewhere too."""
    anchored = stored(_anchored(docs, window, gram), "byte-anchors")
    every = anchored.agg(F.sum(F.size("anchor"))).first()[0] or 0
    counts = anchored.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    counts = stored(counts.select("anchor", _heavy("n", every)), "byte-counts")
    flat = anchored.select("d", "h", F.explode(F.arrays_zip("anchor", "k1", "k2", "start", "windows", "offset")).alias("at")).select("d", "h", "at.*")
    places = stored(_joined(flat, counts, ["anchor"]), "byte-places")
    discard(anchored, counts, shuffles=False)

    name = ["anchor", "k1", "k2"]
    kinds = stored(places.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "start", "windows", "offset")).alias("one")), "byte-kinds")
    copies = kinds.filter("n > 1").select(*name, _heavy("n", every))
    whole = _joined(places, copies, name).select("d", "h", F.col("start").cast("long").alias("first"), (F.col("windows") + F.lit(window - 1)).cast("long").alias("bytes"))
    whole = stored(whole, "byte-copies")
    discard(places, shuffles=False)
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor", (F.col("kinds") > crowd).alias("crowded"), _heavy("kinds", every))
    mixed = _joined(kinds, sizes, ["anchor"]).select("one.d", "one.h", F.struct("anchor", (F.col("n") > 1).alias("many"), "crowded", "one.start", "one.windows", "one.offset").alias("x"))
    by_doc = stored(mixed.groupBy("d", "h").agg(F.collect_list("x").alias("at")), "byte-kept")
    discard(kinds, shuffles=False)
    pieces = stored(_taken(docs, by_doc, window), "byte-pieces")
    discard(by_doc, shuffles=False)
    matches, more = _uncrowded(pieces.filter("crowded"), window, gram, crowd)
    every_piece = pieces
    for part in more:
        every_piece = every_piece.unionByName(part)
    found = whole.unionByName(stored(_indexed(every_piece, window, index_bytes), "byte-matches"))
    discard(pieces, *more, shuffles=False)
    for part in matches:
        found = found.unionByName(part)
    return found.groupBy("d", "h").agg(F.collect_set(F.struct("first", "bytes")).alias("found"))


RESULTS = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "spans": T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("bytes", T.LongType())]))}


def _cut(text: bytes, found: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay, and (first, bytes) of each maximal run that goes."""
    edges = np.zeros(len(text) + 1, np.int64)
    first = np.array([x["first"] for x in found], np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + np.array([x["bytes"] for x in found], np.int64), -1)
    gone = np.cumsum(edges) > 0
    change = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    change = np.append(0, change) if gone[0] else change
    spans = [(int(a), int(b - a)) for a, b in change.reshape(-1, 2)]
    return np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes(), spans


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with kept (the bytes that stay), n_bytes, n_removed, n_spans and spans (maximal runs that go)."""
    rest = [f for f in docs.schema.fields if f.name not in RESULTS and f.name != "text"]
    rows = docs.select(F.struct(*[f.name for f in rest]).alias("row"), F.col("text").cast("string").alias("text"), *_row_key())
    found = repeats(docs, window, gram, crowd, index_bytes)
    rows = rows.join(found, ["d", "h"], "left").select("row", "text", "found")
    schema = T.StructType([rows.schema["row"], rows.schema["text"], *[T.StructField(n, k) for n, k in RESULTS.items()]])
    span = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in bytes_of(batch, "text")]
            cut = [_cut(t, at) if at else (t, []) for t, at in zip(texts, batch.column(2).to_pylist(), strict=True)]
            numbers = [[len(t) for t in texts], [sum(n for _, n in spans) for _, spans in cut], [len(spans) for _, spans in cut]]
            gone = pa.array([[{"first": a, "bytes": n} for a, n in spans] for _, spans in cut], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in cut], pa.binary()), *[pa.array(x, pa.int64()) for x in numbers], gone], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    out = removed(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
