r"""Benchmark decontamination with suffix arrays over the training texts (operator 6).

A task turns its documents into shards of word ids and sorts, in each shard, the suffixes that can match: those
whose first words (up to SEED, as many as the shortest windows have) some test window begins with, too. Every
test window, being the head of a test suffix, is searched in the array by bisection; equal ranges give all its
verbatim occurrences, and runs of them along one diagonal the longest matches with their places. Nothing is
shuffled: the test items are made into blocks of bounded size once, however many there are; these lie in the
shared folder, workers load them one after the other, and keep the usual single one.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lowering A-Z. A window has `window` consecutive words of
an item; an item with fewer words, but not none, is one window. Null or empty text has no words: such
documents are clean, such items match nothing. Each row is a document of its own, also with equal ids.
Items with equal item_id count as one, and so do those with a null item_id (named by an empty text).
Without items, no document is hit. Other columns are kept as they are, except those named like results.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, open_fs, per_worker, shared_dir, slices
from .words import ALNUM, gram_hashes

#: Words of a shard, and of a block of test items (an item that is longer is a block of its own); words by which
#: suffixes are chosen.
SHARD_WORDS, BLOCK_WORDS, SEED = 1 << 20, 1 << 20, 3
MATCHES = "array<struct<item_id:string,doc_start:int,item_start:int,length:int>>"
RESULTS = {"n_words", "n_hit", "items", "matches"}


class TestBlock:
    """Test items as word ids, their windows sorted and made distinct."""

    def __init__(self, names: list[str], texts: list[bytes], window: int):
        self.names, self.window, self.vocabulary = names, window, {}
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.translate(ALNUM).split()], dtype=np.uint32) for text in texts]
        rows, sizes, items, starts = [], [], [], []
        seeds: dict[int, list[np.ndarray]] = {}
        for k, x in enumerate(ids):
            n = min(window, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                rows.append(np.pad(x[s : s + n], (0, window - n)))
                sizes.append(n)
                items.append(k)
                starts.append(s)
            if n:
                seeds.setdefault(min(SEED, n), []).append(gram_hashes(x.astype(np.uint64), min(SEED, n))[: len(x) - n + 1])
        self.heads = np.array(rows, dtype=np.uint32).reshape(-1, window)
        self.sizes, self.items, self.starts = np.array(sizes, np.int64), np.array(items, np.int64), np.array(starts, np.int64)
        self.seeds = {n: np.unique(np.concatenate(x)) for n, x in seeds.items()}
        self.bits = {n: np.zeros(1 << 22, dtype=bool) for n in seeds}
        for n, x in self.seeds.items():
            self.bits[n][(x & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        last = self.heads.copy()
        last[np.arange(window) >= self.sizes[:, None]] = 0xFFFFFFFF
        self.low, self.high = keyed(self.heads), keyed(last)

    def chosen(self, shard: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that can match."""
        found = [np.zeros(0, np.int64)]
        for n, seeds in self.seeds.items():
            grams = gram_hashes(shard.astype(np.uint64), n)
            at = np.flatnonzero(self.bits[n][(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
            found.append(at[np.isin(grams[at], seeds)])
        return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]

    def found(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the shard) of every occurrence. Places between documents hold 0, as unknown words do."""
        at = self.chosen(shard)
        if not len(at) or not len(self.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([shard, np.zeros(self.window, np.uint32)])
        keys = keyed(padded[at[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]  # the shard's suffix array
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        return which, at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def keyed(heads: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort as the rows do."""
    return np.ascontiguousarray(heads.astype(">u4")).view(f"S{4 * heads.shape[1]}").ravel() if len(heads) else np.zeros(0, f"S{4 * heads.shape[1]}")


def test_blocks(benchmark: DataFrame, window: int) -> list[str]:
    """Makes the test items into blocks in the shared folder; returns their addresses, one for some million words each."""
    folder = shared_dir(benchmark.sparkSession, "test-items")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    most = 6 * BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        names, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            file = uuid.uuid4().hex
            with fs.open_output_stream(f"{root}/{file}") as f:
                f.write(pickle.dumps(vars(TestBlock(names, texts, window))))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{file}"])], names=["file"])

        for batch in slices(batches, "text"):
            for name, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text"), strict=True):
                if names and size + len(text) > most:
                    yield block()
                    names, texts, size = [], [], 0
                names.append(name)
                texts.append(text)
                size += len(text)
        if names:
            yield block()

    parts = -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most)
    return sorted(r["file"] for r in tests.repartition(max(1, parts)).mapInArrow(run, "file string").collect())


def loaded(address: str) -> TestBlock:
    """A block, of which a worker keeps the last ones."""

    def load() -> TestBlock:
        fs, path = open_fs(address)
        block = object.__new__(TestBlock)
        with fs.open_input_stream(path) as f:
            vars(block).update(pickle.loads(f.read()))
        return block

    return per_worker(("test-block", address), load)


def runs(which: np.ndarray, at: np.ndarray, docs: np.ndarray, block: TestBlock) -> tuple[np.ndarray, ...]:
    """Longest matches: (document, item, place in the shard, start in the item, words)."""
    item, start, size = block.items[which], block.starts[which], block.sizes[which]
    order = np.lexsort((at, at - start, item, docs))
    item, start, size, at, docs = item[order], start[order], size[order], at[order], docs[order]
    new = np.ones(len(at), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return docs[first], item[first], at[first], start[first], at[last] - at[first] + size[last]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside occurrences of windows), items (sorted item ids, as strings) and matches
    (the longest verbatim matches and their places, in words)."""
    blocks = test_blocks(benchmark, window)
    kept = [f for f in docs.schema.fields if f.name not in RESULTS]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T._parse_datatype_string(MATCHES))]
    schema = T.StructType([*kept, *added])
    place = pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())])

    def searched(shard_texts: list[bytes]) -> tuple[list, list, list, list]:
        words = [t.translate(ALNUM).split() for t in shard_texts]
        counts = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(counts + 1) - counts - 1
        doc_of = np.repeat(np.arange(len(words)), counts + 1)
        hit = np.zeros(len(doc_of) + 1, np.int64)
        items: list[set] = [set() for _ in words]
        places: list[list] = [[] for _ in words]
        for block in map(loaded, blocks):
            shard, get = np.zeros(len(doc_of), np.uint32), block.vocabulary.get
            for b, w in zip(begin.tolist(), words, strict=True):
                shard[b : b + len(w)] = np.fromiter((get(x, 0) for x in w), np.uint32, len(w))
            which, at = block.found(shard)
            if not len(which):
                continue
            np.add.at(hit, at, 1)
            np.add.at(hit, at + block.sizes[which], -1)
            for d, k, a, s, n in zip(*(x.tolist() for x in runs(which, at, doc_of[at], block)), strict=True):
                places[d].append({"item_id": block.names[k], "doc_start": a - int(begin[d]), "item_start": s, "length": n})
            pairs = np.unique(doc_of[at] * len(block.names) + block.items[which])
            for p in pairs.tolist():
                items[p // len(block.names)].add(block.names[p % len(block.names)])
        covered = np.cumsum(hit[:-1]) > 0
        n_hit = np.bincount(doc_of[covered], minlength=len(words)) if len(doc_of) else np.zeros(0, np.int64)
        return counts.tolist(), n_hit.tolist(), [sorted(x) for x in items], places

    def answered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searched([t or b"" for batch in held for t in bytes_of(batch, text_col)])
        at = 0
        for batch in held:
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            part = [x[at : at + batch.num_rows] for x in found]
            at += batch.num_rows
            new = [pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.list_(pa.string())), pa.array(part[3], pa.list_(place))]
            yield pa.RecordBatch.from_arrays(cols + new, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, text_col):
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text_col)).nbytes
            if size >= 6 * SHARD_WORDS:
                yield from answered(held)
                held, size = [], 0
        if held:
            yield from answered(held)

    return docs.mapInArrow(run, schema)


def contaminated(per_mille: int = 50):
    """Whether at least per_mille thousandths of a document's words, and not none, are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 1000 >= F.col("n_words") * per_mille)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_mille: int = 50) -> DataFrame:
    """docs without those that are contaminated; their columns as they were."""
    marked = docs.withColumn("__text", F.col("text"))
    keyed_docs = marked.select(F.struct(*docs.columns).alias("__row"), "__text")
    found = matches(keyed_docs, benchmark, window, "__text")
    return found.filter(~contaminated(per_mille)).select("__row.*")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, with how many longest matches a document has and how many words the longest has."""
    found = matches(docs.select("doc_id", "text"), benchmark)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"), F.size("matches").cast("long").alias("n_matches"), longest)
