r"""Substring dedup with prefix-partitioned suffix trees (operator 9).

A window has `window` consecutive words of a document, words being `[^\x20\x09-\x0D]+`. Each word covered
by a window whose word sequence also starts earlier (smaller doc_id, or same document and earlier start)
is removed; windows are judged on the input.

1. Of all suffixes, those can share `window` words with another one that share their anchor: the run of
   `prefix` words with the least hash inside the suffix's first `window` words. A document names each of
   its anchors with the suffixes that hold it; anchors that occur once in all documents are dropped.
2. The remaining suffixes, cut off where a node of `window` words can't reach, are dealt out by prefix, of
   variable length: up to the anchor, if the anchor's group fits in memory, and else all `window` words.
   Suffixes that hold the anchor at the same place follow each other and travel as one piece of text.
3. A group with the short prefix is a subtree that fits in memory: its suffixes are sorted word by word
   (their hashes only brought them together), and leaves next to each other that have `window` words in
   common hang under an inner node of that depth. All of its leaves but the first repeat; those that follow
   one another make maximal repeats. A group with the long prefix is a single such node, whose first leaf
   is a grouped minimum, taken in parts: no task gets all leaves of a node that very many documents share.

Hashes decide where suffixes go, never which are equal. Anchors with over a HEAVY_SHARE-th of all places
are so few that they are broadcast, and their places aren't joined by anchor.

Null or empty text has no words. Rows with equal doc_id are versions of one document: a window is no repeat
of itself at the same place, and a word removed from one version is removed from all. Rows with a null
doc_id stay whole and are not looked at. No documents: no rows. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, discard, slices, stored
from .words import Words

PREFIX_WORDS = 5
#: Places of an anchor up to which its group is kept in memory; bytes of text that a task works on at a time.
GROUP_PLACES, AT_ONCE = 20_000, 1 << 20
#: Anchors with more than this part of all places (and some places at least) are heavy: there are fewer of them than this number.
HEAVY_SHARE, HEAVY_PLACES = 2_000, 500
#: Parts of a node's leaves.
SALTS = 64


def anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first suffix, suffixes) of each run of suffixes that hold the anchor at the same place; suffixes are
    numbered by their first words."""
    value = words.hashes(prefix)
    place = np.arange(len(value), dtype=np.int32)
    width, whole = 1, window - prefix + 1
    while width < whole:  # the least value of twice as many places, the leftmost of equal ones
        step = min(width, whole - width)
        n = max(0, len(value) - step)
        later = value[step:] < value[:n]
        value, place = np.where(later, value[step:], value[:n]), np.where(later, place[step:], place[:n])
        width += step
    suffix = np.flatnonzero(words.left()[: len(value)] >= window)
    value, place = value[suffix], place[suffix]
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (suffix[1:] != suffix[:-1] + 1))) if len(suffix) else suffix
    return value[first], suffix[first], np.diff(np.append(first, len(suffix)))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")


def _anchored(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            words = Words(bytes_of(batch, "text"))
            keys, at, sizes = anchors(words, window, prefix)
            of = np.searchsorted(words.first + words.counts, at, side="right")
            begin = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(begin, pa.array(x)) for x in (keys.view(np.int64), (at - words.first[of]).astype(np.int32), sizes.astype(np.int16))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "anchor", "start", "suffixes"])

    return _identified(docs).mapInArrow(run, "doc_id long, anchor array<long>, start array<int>, suffixes array<short>")


def _pieces(docs: DataFrame, by_doc: DataFrame, window: int) -> DataFrame:
    """(anchor, large, doc_id, start, suffixes, piece) of each place of a repeated anchor (by_doc: lists of a document's
    places): the words of its suffixes."""
    names = ["anchor", "large", "doc_id", "start", "suffixes", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            words, at = Words(bytes_of(batch, "text")), batch.column(2).flatten()
            doc = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            anchor, large, start, suffixes = (at.field(k) for k in range(4))
            s, n = start.to_numpy().astype(np.int64), suffixes.to_numpy().astype(np.int64) + window - 1
            there = np.flatnonzero(s + n <= words.counts[doc])  # another version of the document may be shorter
            data, begin = words.cut((s + words.first[doc])[there], n[there])
            piece = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(there), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            at = [x.take(pa.array(there)) for x in (anchor, large, batch.column(0).take(pa.array(doc)), start, suffixes)]
            yield pa.RecordBatch.from_arrays([*at, piece], names=names)

    rows = _identified(docs).join(by_doc, "doc_id").select("doc_id", "text", "at")
    return rows.mapInArrow(run, "anchor long, large boolean, doc_id long, start int, suffixes short, piece binary")


def suffixes_of(piece: bytes, n: int, window: int) -> list[bytes]:
    """The first `window` words of each of a piece's n suffixes."""
    at = list(accumulate((len(w) + 1 for w in piece.split(b" ")), initial=0))
    return [piece[at[i] : at[i + window]] for i in range(n)]


def later_leaves(leaves: list[tuple[bytes, int, int]]) -> list[tuple[int, int]]:
    """(doc_id, start) of the leaves (suffix, doc_id, start) under inner nodes that have an earlier leaf."""
    leaves.sort()
    out, node, first = [], None, None
    for suffix, *place in leaves:
        if suffix != node:
            node, first = suffix, place
        elif place != first:
            out.append(tuple(place))
    return out


def _maximal(found: list[tuple[int, int]]) -> pa.RecordBatch:
    """(doc_id, first, suffixes) of runs of suffixes that follow each other."""
    doc, start = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))) if len(doc) else doc
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(np.diff(np.append(first, len(doc))))], names=["doc_id", "first", "suffixes"])


def _subtrees(pieces: DataFrame, window: int) -> DataFrame:
    """(doc_id, first, suffixes) of the repeats in groups with a short prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, leaves, found = None, [], []
        for batch in slices(batches, "piece"):
            for key, doc, start, n, piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != anchor:
                    found += later_leaves(leaves)
                    anchor, leaves = key, []
                leaves += [(suffix, doc, start + i) for i, suffix in enumerate(suffixes_of(piece, n, window))]
            if len(found) > 100_000:
                yield _maximal(found)
                found = []
        yield _maximal(found + later_leaves(leaves))

    rows = pieces.filter("not large").select("anchor", "doc_id", "start", "suffixes", "piece")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, first long, suffixes long")


def _single_nodes(pieces: DataFrame, window: int) -> DataFrame:
    """(doc_id, first, suffixes) of the repeats in groups with a long prefix: each group is a node of `window` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", AT_ONCE):
            rows = [(suffix, doc, start + i) for doc, start, n, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) for i, suffix in enumerate(suffixes_of(piece, n, window))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["node", "doc_id", "start"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            out = []
            for node, part, role, *place in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not role:
                    at, first = (node, part), place
                elif at == (node, part) and place != first:
                    out.append(tuple(place))
            yield _maximal(out)

    leaves = pieces.filter("large").select("doc_id", "start", "suffixes", "piece").mapInArrow(run, "node binary, doc_id long, start long")
    leaves = leaves.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    parts = leaves.groupBy("node", "part").agg(F.min(F.struct("doc_id", "start")).alias("leaf"), F.count("*").alias("leaves"))
    first = parts.groupBy("node").agg(F.min("leaf").alias("leaf"), F.sum("leaves").alias("leaves")).filter("leaves > 1").select("node", "leaf")
    told = parts.select("node", "part").join(first, "node").select("node", "part", F.lit(0).alias("role"), "leaf.*")
    rows = told.unionByName(leaves.withColumn("role", F.lit(1)))
    return rows.repartition("node", "part").sortWithinPartitions("node", "part", "role").mapInArrow(later, "doc_id long, first long, suffixes long")


def repeats(docs: DataFrame, window: int = 20, prefix: int = PREFIX_WORDS, group: int = GROUP_PLACES) -> DataFrame:
    """doc_id and repeats (array of first, suffixes): runs of windows that also start earlier."""
    anchored = stored(_anchored(docs, window, prefix), "anchors")
    every = anchored.agg(F.sum(F.size("anchor"))).first()[0] or 0
    counts = anchored.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("places")).filter("places > 1")
    counts = stored(counts.withColumn("heavy", F.col("places") > max(HEAVY_PLACES, every // HEAVY_SHARE)), "counts")
    large = (F.col("places") > group).alias("large")
    heavy = F.broadcast(counts.filter("heavy").select("anchor", large))  # HEAVY_SHARE rows at most
    flat = anchored.select("doc_id", F.explode(F.arrays_zip("anchor", "start", "suffixes")).alias("at")).select("doc_id", "at.*")
    usual = flat.join(heavy.select("anchor"), "anchor", "left_anti").join(counts.filter("not heavy").select("anchor", large), "anchor")
    places = usual.unionByName(flat.join(heavy, "anchor"))
    by_doc = stored(places.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "large", "start", "suffixes")).alias("at")), "places")
    discard(anchored, counts)
    pieces = stored(_pieces(docs, by_doc, window), "pieces")
    discard(by_doc)
    found = stored(_subtrees(pieces, window).unionByName(_single_nodes(pieces, window)), "repeats")
    discard(pieces)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "suffixes")).alias("repeats"))


def _without(words: list[bytes], found: list[dict], window: int) -> tuple[list[bytes], int]:
    cover = np.zeros(len(words) + 1, np.int64)
    for x in found:
        if x["first"] < len(words):
            cover[x["first"]] += 1
            cover[min(len(words), x["first"] + x["suffixes"] + window - 1)] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~gone)], int(gone.sum())


def removed(docs: DataFrame, window: int = 20, prefix: int = PREFIX_WORDS, group: int = GROUP_PLACES) -> DataFrame:
    """docs with kept_text (the words that stay, joined by one space), n_words and n_removed, which replace
    columns of these names."""
    kept = [f for f in docs.schema.fields if f.name not in ("kept_text", "n_words", "n_removed")]
    rest = [f.name for f in kept if f.name != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeats(docs, window, prefix, group)
    rows = packed.join(found, "doc_id", "left").select("row", "text", "repeats")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, counts, gone = [], [], []
            for text, at in zip(bytes_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                left, n = _without(words, at, window) if at else (words, 0)
                texts.append(b" ".join(left).decode())
                counts.append(len(words))
                gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    own = [F.col("text").cast(docs.schema["text"].dataType).alias("text") if f.name == "text" else F.col("row")[f.name].alias(f.name) for f in kept]
    return rows.mapInArrow(run, schema).select(*own, "kept_text", "n_words", "n_removed")


def deduplicated(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs whose text, where it had repeats, is the words that stay; n_chars follows it."""
    out = removed(docs, window)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(docs: DataFrame, window: int = 20) -> DataFrame:
    out = removed(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
