"""Embedding near-dedup by a subspace pigeonhole join (operator 10).

Vectors are brought to length one and rotated by a fixed orthogonal matrix. Cosine `least` or more means a
squared distance of at most 2 - 2 * least, so in one of `blocks` blocks of coordinates at least the squared
distance is within that block's proportional budget. Each block is range-joined exactly: vectors lie in the cells of
their nearest centers, which are a bounded sample, one for each CELL of all vectors and CENTERS at most; chunks are
runs of cells, written to the shared folder once, and a task compares two chunks, piece by piece of AT_ONCE vectors in
the order of cells. A block of two pieces is left out where the balls around their coordinates are farther apart than
`reach` times the budget's radius; with reach 1, the default, nothing within the budget is missed. The union of the
blocks' candidates is verified by cosine in double precision (of the vectors as they came, where rotation might
round it over the threshold).

Vectors without structure aren't told apart by balls, so all pieces are compared and seconds grow with the square of
the number of distinct vectors. Memory, disk and tasks don't: a chunk has CHUNK vectors, or one in CHUNKS of all as
far as CHUNK_BYTES allow; a task holds two; shuffles carry each vector a fixed number of times.

Equal vectors become one class first, so copies aren't compared; a task hands on the number of links of
each class, and links that join what it hasn't joined yet, but never all pairs.

Null and zero vectors and those with null or non-finite components link with nothing; nor do vectors of
different lengths. Rows with equal vec_id are each a row of the result; their vectors are vectors of their
own, of which n_links counts every row. A null vec_id keeps its row (component null, kept true). No rows:
no rows. Columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, discard, open_fs, per_worker, shared_dir, stored
from .graph import components

#: Blocks of coordinates, vectors a center stands for, centers at most, vectors of a piece.
BLOCKS, CELL, CENTERS, AT_ONCE = 4, 1024, 16_384, 512
#: Vectors of a chunk, and into how many chunks more of them are divided, as far as these don't exceed so many bytes.
CHUNK, CHUNKS, CHUNK_BYTES = 4096, 32, 32 << 20
#: Spark's tasks for pairs of chunks, at most.
TASKS = 1000
#: How far apart pieces are compared, as a part of the budget's radius; 1 misses nothing.
REACH = 1.0
#: Added to budgets for rounding, in double and in single precision; whatever it lets through is verified.
SLACK, LOOSE = 1e-9, 1e-5


def rotation(dim: int) -> np.ndarray:
    return per_worker(("rotation", dim), lambda: np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0])


def units(payloads: list[bytes], rotated: bool) -> np.ndarray:
    """Vectors (float64 bytes, all of one length) at length one, turned if asked for."""
    x = np.frombuffer(b"".join(payloads), "<f8").reshape(len(payloads), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ rotation(x.shape[1]) if rotated else x


def parts_of(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id and payload (float64 bytes; null for vectors that link with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = np.array([], float) if not v.is_valid else np.array(v.values.to_numpy(zero_copy_only=False), dtype="<f8")
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() and not v.values.null_count else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "payload"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, payload binary")


def budget(least: float, lo: int, hi: int, dim: int) -> float:
    """The squared distance that a block may have of what vectors with cosine `least` have."""
    return (2 - 2 * least) * (hi - lo) / dim + SLACK


def _centers(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centers for each length of vectors: a sample of one in CELL, CENTERS at most."""
    every = classes.count()
    some = classes.orderBy(F.xxhash64("node", F.lit("center")), "node").limit(min(CENTERS, -(-every // CELL))).select("payload").collect()  # CENTERS vectors at most
    by: dict[int, list[bytes]] = {}
    for (payload,) in some:
        by.setdefault(len(payload) // 8, []).append(bytes(payload))
    return {dim: units(payloads, True) for dim, payloads in by.items()}


def _cells(classes: DataFrame, centers) -> DataFrame:
    """(node, copies, payload, dim, cell) of each class. Vectors of a length that has no centers all lie in cell 0."""
    names = ["node", "copies", "payload", "dim", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, AT_ONCE) for b in batches for s in range(0, b.num_rows, AT_ONCE)):
            payloads = batch.column(2).to_pylist()
            sizes = np.array([len(p) // 8 for p in payloads])
            cells = np.zeros(len(payloads), np.int32)
            for dim in np.unique(sizes).tolist():
                if dim in centers.value:
                    at = np.flatnonzero(sizes == dim)
                    cells[at] = (units([payloads[i] for i in at], True) @ centers.value[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cells)], names=names)

    return classes.select("node", "copies", "payload").mapInArrow(run, "node long, copies long, payload binary, dim int, cell int")


def _chunked(cells: DataFrame) -> DataFrame:
    """Classes with their chunk: a length's cells follow each other, and are cut every so many vectors."""
    of = Window.partitionBy("dim").orderBy("cell")  # a row for each center at most
    sizes = cells.groupBy("dim", "cell").agg(F.count("*").alias("size"))
    every = F.sum("size").over(Window.partitionBy("dim"))
    most = F.greatest(F.lit(1), F.floor(F.lit(CHUNK_BYTES) / (8 * F.col("dim"))))
    bounds = sizes.select("dim", "cell", "size", (F.sum("size").over(of) - F.col("size")).alias("begin"), F.least(most, F.greatest(F.lit(CHUNK), F.ceil(every / CHUNKS))).alias("each"))
    place = F.col("begin") + F.pmod(F.xxhash64("node"), F.col("size"))
    return cells.join(F.broadcast(bounds), ["dim", "cell"]).select("node", "copies", "payload", "cell", "dim", F.floor(place / F.col("each")).cast("int").alias("chunk"))


class Part:
    """A chunk's vectors in the order of cells: rotated and as they came, their blocks as single-precision factors of squared
    distances, and the balls around each piece's blocks."""

    def __init__(self, rows: pa.Table, blocks: int):
        rows = rows.take(np.argsort(rows["cell"].to_numpy(), kind="stable"))
        payloads = rows["payload"].to_pylist()
        self.nodes, self.copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        self.at, self.raw = units(payloads, True), np.frombuffer(b"".join(payloads), "<f8").reshape(len(payloads), -1)
        self.n, self.pieces, self.left, self.right, self.balls = np.zeros(len(payloads), np.int64), [slice(s, min(s + AT_ONCE, len(payloads))) for s in range(0, len(payloads), AT_ONCE)], [], [], []
        for lo, hi in parts_of(self.at.shape[1], blocks):
            x = self.at[:, lo:hi]
            square, one = (x**2).sum(1)[:, None], np.ones((len(x), 1))
            self.left.append(np.hstack([-2 * x, square, one]).astype("<f4"))
            self.right.append(np.hstack([x, one, square]).astype("<f4"))
            middle = np.array([x[p].mean(0) for p in self.pieces])
            self.balls.append((middle, np.array([np.sqrt(((x[p] - m) ** 2).sum(1).max()) for p, m in zip(self.pieces, middle, strict=True)])))


class Joined:
    """Which of two chunks' classes are joined so far; places of the second one follow the first one's."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.up = nodes, np.arange(len(nodes))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
        """The links among these that join something: first each row's first one, then each column's, then the others."""
        for turn in ("rows", "columns", "rest"):
            while not np.array_equal(self.up[self.up], self.up):
                self.up = self.up[self.up]
            new = self.up[i] != self.up[j]
            i, j = i[new], j[new]
            some = np.arange(len(i)) if turn == "rest" else np.unique(i if turn == "rows" else j, return_index=True)[1]
            for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
                if (x := self.root(a)) != (y := self.root(b)):
                    self.up[x] = y
                    yield int(self.nodes[a]), int(self.nodes[b]), None


def _similar(a: Part, b: Part, p: slice, q: slice, close: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of those candidates in two pieces that have cosine `least`."""
    i, j = np.nonzero(close)
    if len(i) * 32 > close.size:
        cosine = (a.at[p] @ b.at[q].T)[i, j]
        i, j = i + p.start, j + q.start
    else:
        i, j = i + p.start, j + q.start
        cosine = np.einsum("ij,ij->i", a.at[i], b.at[j])
    for k in np.flatnonzero(np.abs(cosine - least) < 1e-9):
        x, y = a.raw[i[k]], b.raw[j[k]]
        cosine[k] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))
    good = cosine >= least
    return i[good], j[good]


def _compared(a: Part, b: Part, least: float, blocks: int, reach: float) -> Iterator[tuple]:
    """Links (as of _joined) between the classes of two chunks, or within one if they are the same."""
    dim = a.at.shape[1]
    budgets = [budget(least, lo, hi, dim) for lo, hi in parts_of(dim, blocks)]
    meet = []
    for most, (ca, ra), (cb, rb) in zip(budgets, a.balls, b.balls, strict=True):
        apart = np.sqrt(((ca[:, None] - cb) ** 2).sum(2)) - ra[:, None] - rb
        meet.append(apart <= reach * np.sqrt(most) + 1e-7)
    joined = Joined(a.nodes if a is b else np.append(a.nodes, b.nodes))
    behind = 0 if a is b else len(a.nodes)
    for x, y in np.argwhere(np.any(meet, axis=0)).tolist():
        if a is b and x > y:
            continue
        p, q = a.pieces[x], b.pieces[y]
        close = np.zeros((p.stop - p.start, q.stop - q.start), bool)
        for k, most in enumerate(budgets):
            if meet[k][x, y]:
                close |= a.left[k][p] @ b.right[k][q].T <= most + LOOSE
        if a is b and x == y:
            close = np.triu(close, 1)
        if not close.any():
            continue
        i, j = _similar(a, b, p, q, close, least)
        np.add.at(a.n, i, b.copies[j])
        np.add.at(b.n, j, a.copies[i])
        yield from joined.add(i, j + behind)
    for part in (a,) if a is b else (a, b):
        for k in np.flatnonzero(part.n).tolist():
            yield int(part.nodes[k]), None, int(part.n[k])
        part.n[:] = 0


def _joined(cells: DataFrame, least: float, blocks: int, reach: float) -> DataFrame:
    """Links of classes: (a, b, n): n links of class a to others, or, where n is null, a link between a and b."""
    names, kinds = ["a", "b", "n"], (pa.int64(), pa.int64(), pa.int64())
    spark, folder = cells.sparkSession, shared_dir(cells.sparkSession, "chunks")
    _chunked(cells).repartition("dim", "chunk").write.partitionBy("dim", "chunk").option("compression", "zstd").parquet(folder)
    chunks = spark.read.schema("node long, copies long, payload binary, cell int, dim int, chunk int").parquet(folder).select("dim", "chunk").distinct()
    pairs = chunks.join(chunks.withColumnRenamed("chunk", "to"), "dim").filter("chunk <= to")

    def part(dim: int, chunk: int) -> Part:
        fs, root = open_fs(folder)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/dim={dim}/chunk={chunk}")) if f.base_name.endswith(".parquet"))
        tables = []
        for path in files:
            with fs.open_input_file(path) as source:
                tables.append(pq.ParquetFile(source).read())
        return Part(pa.concat_tables(tables), blocks)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, home = None, None
        for dim, chunk, to in (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if key != (dim, chunk):
                key, home = (dim, chunk), part(dim, chunk)
            yield from _compared(home, home if to == chunk else part(dim, to), least, blocks, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in results(batches):
            held.append(row)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    pairs = pairs.repartition(max(1, min(TASKS, pairs.count()))).sortWithinPartitions("dim", "chunk", "to")
    links = stored(pairs.select("dim", "chunk", "to").mapInArrow(run, "a long, b long, n long"), "links")
    fs, root = open_fs(folder)
    fs.delete_dir(root)
    return links


def near_duplicates(rows: DataFrame, least: float = 0.9, blocks: int = BLOCKS, reach: float = REACH) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    vectors = stored(_vectors(rows).withColumn("key", F.sha2("payload", 256)), "vectors")
    classes = vectors.filter("payload is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("payload").alias("payload"))
    classes = stored(classes.withColumn("node", F.xxhash64("key")), "classes")
    cells = stored(_cells(classes, Shared(rows.sparkSession, _centers(classes))), "cells")
    links = _joined(cells, least, blocks, reach)
    discard(cells)
    counts = links.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    found = components(links.filter("n is null").select("a", "b"))
    parts = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = parts.groupBy("component").agg(F.min("first").alias("component_id"))
    named = parts.join(least_id, "component").join(counts, "node", "left").select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = vectors.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
