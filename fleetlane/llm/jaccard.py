r"""N-gram Jaccard join, size-aware with light and heavy sets (operator 8).

A document's set holds its distinct shingles of `size` words; with fewer words, the whole sequence is its
only shingle. Two documents link when their sets' Jaccard similarity is at least `percent` hundredths.

1. Equal sets become one class each, with its smallest doc_id for a name; only classes are joined.
2. Shingles are put in one order for all sets, those seen often last. Sets that link share `o` shingles or
   more, so their first n - o + c shingles have c in common.
3. Light sets (at most `boundary` shingles) enumerate all c-subsets (c = 2) of these as keys. Heavy sets,
   and the light sets that can link with a heavy one, stand in the inverted lists of each of their first
   n - o + 1 shingles. The boundary is where enumerating costs more than scanning, by the counted lists.
4. Lists are scanned in two rounds, so that copies aren't expanded into all pairs. In the first, every set
   in a list is compared with the most central one, which stands in the longest lists. In the second, sets
   of a list that aren't connected yet are compared with each other. Two sets are compared at a key only if
   what both have from there on is enough, as it must be at the first key that they share.
5. A sketch per set (how many of its shingles fall into each of CELLS cells) bounds from below how many
   shingles two sets don't share; candidates beyond what the similarity allows go. The others are verified
   on the whole texts, around the set of each pair that has more candidates; its candidates are dealt out in
   chunks of bounded size.

The order of shingles only decides how long lists get, never what is found. It begins with counts inside
tasks, summed up, of which the most frequent KEPT_SHINGLES are used; a shingle that is common but thinly spread
isn't among them. Lists in which more than CROWD sets aren't connected after the first round show such
shingles: they are counted over all sets in crowded lists, go last as well, and the sets get new keys, until no
list is crowded by shingles that aren't last already. So the second round compares sets of short lists.

Null or empty text: no shingles, links with nothing. A null doc_id keeps its row, with null component_id.
Rows with equal doc_id are each a row of the result; sets named by equal ids are taken as connected.
No documents: no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, bytes_of, discard, slices, stored
from .graph import components
from .words import LOWER, Words, gram_hashes, mixed

#: The most frequent shingles that are put last (and as many found in crowded lists each time, MOST_LAST in all), and
#: how many shingles a task counts at a time.
KEPT_SHINGLES, MOST_LAST, COUNTED = 1 << 17, 1 << 20, 1 << 20
#: Sets of a list that aren't connected, from which on it is crowded.
CROWD = 200
#: A candidate's verification costs as much as so many keys; light sets differ in at most so many shingles.
VERIFY_COST, MOST_SPARE = 4, 8
#: Candidates of a chunk that is verified around one set; bytes of text that a task cuts into words at a time.
CHUNK_SETS, AT_ONCE = 256, 1 << 20
#: Cells of a set's sketch.
CELLS = 128
PAIR = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    words = Words(texts, LOWER)
    value = words.values()
    every, out = gram_hashes(value, size), []
    short = {n: gram_hashes(value, n) for n in set(words.counts[words.counts < size].tolist()) - {0}}
    for s, n in zip(words.first.tolist(), words.counts.tolist(), strict=True):
        out.append(np.unique(every[s : s + n - size + 1]) if n >= size else short[n][s : s + 1] if n else every[:0])
    return out


def spare(n: int, percent: int) -> int:
    """How many of n shingles a set may lack in another one it links with."""
    return n - -(-n * percent // 100)


def _mark() -> Column:
    """Tells the texts of rows with equal doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (doc_id, mark, n, digest), and rows of shingles (token, times) that recur in a task."""
    import xxhash

    names = ["doc_id", "mark", "n", "digest", "token", "times"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= 3
        k = int(often.sum()) + 1  # the last row counts all shingles, under no token
        token = pa.array(values[often].view(np.int64).tolist() + [None], pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), token, pa.array(times[often].tolist() + [int(times.sum())], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in slices(batches, "text", AT_ONCE):
            ns, digests = [], []
            for s in shingle_sets(bytes_of(batch, "text"), size):
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                held.append(s)
                waiting += len(s)
                if waiting >= COUNTED:
                    yield counted(held)
                    held, waiting = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(digests, pa.binary()), pa.nulls(len(ns), pa.int64()), pa.nulls(len(ns), pa.int64())], names=names)
        if held:
            yield counted(held)

    rows = docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, n int, digest binary, token long, times long")


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both * 100 >= percent * (len(p) + len(q) - both)


def boundary_of(recurring: float, total: float, percent: int) -> int:
    """The largest size at which enumerating 2-subsets costs no more than scanning the lists of single shingles."""
    others = recurring / max(total, 1)  # sets that a shingle's list holds besides, on average
    n = 9
    while spare(n + 1, percent) <= MOST_SPARE and (spare(n + 1, percent) + 2) / 2 <= 1 + VERIFY_COST * others:
        n += 1
    return n


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each cell, at most 65,535."""
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=CELLS), 0xFFFF).astype("<u2").tobytes()


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches (sets: doc_id, n, sketch) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int32) for k in (4, 5))
            unlike = np.abs(x - y).sum(1)
            yield batch.select([0, 1]).filter(pa.array(unlike * (100 + percent) <= n * (100 - percent)))

    a, b = (sets.select(F.col("doc_id").alias(x), F.col("n").cast("long").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


class Order:
    """The common order of shingles: those seen often last, the most frequent at the end, the others by their hashes."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray):
        """tokens: shingles' hashes, each once."""
        by_hash = np.argsort(mixed(tokens))
        self.tokens, self.times = tokens[by_hash], times[by_hash]
        self.often = mixed(self.tokens)
        rank = np.empty(len(tokens), np.int32)
        rank[np.lexsort((self.often, self.times))] = np.arange(1, len(tokens) + 1)
        self.rank = rank

    def with_more(self, tokens: np.ndarray, times: np.ndarray) -> Order:
        new = ~np.isin(tokens, self.tokens)
        return Order(np.concatenate([self.tokens, tokens[new]]), np.concatenate([self.times, times[new]]))

    def sorted(self, s: np.ndarray) -> np.ndarray:
        s = np.sort(mixed(s))
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, s), len(self.often) - 1)
            s = s[np.argsort(np.where(self.often[at] == s, self.rank[at], 0), kind="stable")]
        return s


def _keys(docs: DataFrame, size: int, percent: int, boundary: int, order: Shared) -> DataFrame:
    """(doc_id, n, keys, at, sketch) of each document whose set can link with a different one. at: how many of the
    set's first shingles a key leaves out."""
    single_from = -(-(boundary + 1) * percent // 100)

    def keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(s)
        d = spare(n, percent)
        s = order.value.sorted(s)
        out, at = [], []
        if n <= boundary:
            pairs = np.array(list(combinations(range(d + 2), 2)))
            first = np.minimum(s[pairs[:, 0]], s[pairs[:, 1]])
            second = np.maximum(s[pairs[:, 0]], s[pairs[:, 1]])
            out.append(mixed(first * PAIR + second))
            at.append(pairs[:, 1] - 1)
        if n > boundary or n >= single_from:
            out.append(s[: d + 1])
            at.append(np.arange(d + 1))
        return np.concatenate(out).view(np.int64), np.concatenate(at).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            rows = []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(bytes_of(batch, "text"), size), strict=True):
                if doc_id is not None and (spare(len(s), percent) or spare(len(s) + 1, percent)):
                    rows.append((doc_id, len(s), *keys(s), sketch(s)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n", "keys", "at", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n int, keys array<long>, at array<int>, sketch binary")


def _first_shingles(docs: DataFrame, size: int, percent: int, order: Shared) -> DataFrame:
    """(token, times): how many sets have a shingle among those that their keys are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            first = [np.zeros(0, np.uint64)]
            for s in shingle_sets(bytes_of(batch, "text"), size):
                of = dict(zip(mixed(s).tolist(), s.tolist(), strict=True))
                first.append(np.array([of[x] for x in order.value.sorted(s)[: spare(len(s), percent) + 2].tolist()], np.uint64))
            tokens, times = np.unique(np.concatenate(first), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int64))], names=["token", "times"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, times long")
    return counted.groupBy("token").agg(F.sum("times").alias("times"))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets are similar enough.

    A pair goes to the one of its sets that has more pairs. That set's text goes once to each chunk of its pairs, the
    other's once for each of its pairs.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs"))
    x, y = (degree.select(F.col("node").alias(k), F.struct("pairs", "node").alias(f"__{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").select(F.greatest("__a", "__b").alias("hub"), F.least("__a", "__b")["node"].alias("other"))
    chunk = F.pmod(F.xxhash64("other"), F.ceil(F.col("hub.pairs") / CHUNK_SETS))
    placed = stored(both.select(F.col("hub.node").alias("hub"), "other", chunk.alias("chunk")), "placed")
    wanted = placed.select(F.col("hub").alias("node"), "hub", "chunk", F.lit(0).alias("role")).distinct()
    wanted = wanted.unionByName(placed.select(F.col("other").alias("node"), "hub", "chunk", F.lit(1).alias("role")))
    sets = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []  # rows with equal doc_id: each of their sets
        for batch in slices(batches, "text", AT_ONCE):
            keep = []
            for hub, chunk, role, node, s in zip(*(batch.column(k).to_pylist() for k in range(4)), shingle_sets(bytes_of(batch, "text"), size), strict=True):
                if (hub, chunk) != task:
                    task, held = (hub, chunk), []
                if not role:
                    held.append(s)
                elif any(similar(s, h, percent) for h in held):
                    keep.append((min(hub, node), max(hub, node)))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], names=["a", "b"])

    rows = sets.select("hub", "chunk", "role", "node", "text").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role")
    return rows.mapInArrow(run, "a long, b long")


def classes_and_links(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, mark, n, digest), (classes: digest, rep, copies) and verified links (a, b) between the
    classes' representatives: enough of them to connect all that is connected."""
    sets = stored(_sets(docs, size), "sets")
    documents = sets.filter("digest is not null").select("doc_id", "mark", "n", "digest")
    classes = documents.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    tokens = sets.filter("digest is null").groupBy("token").agg(F.sum("times").alias("times"))
    total, recurring = (x or 0 for x in tokens.agg(F.sum(F.when(F.col("token").isNull(), F.col("times"))), F.sum(F.when(F.col("token").isNotNull(), F.col("times")))).first())
    top = tokens.filter("token is not null").orderBy(F.desc("times"), "token").limit(KEPT_SHINGLES).toArrow()
    order = Order(top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("times").to_numpy().astype(np.int64))
    boundary = boundary_of(recurring, total, percent)
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    links = None

    def fits(x: str, y: str) -> Column:
        """Whether two sets that share a key, and none before it, can be similar enough."""
        need = (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent  # over 100 + percent: the shingles they must share
        return F.least(*[(F.col(f"{s}.n") - F.col(f"{s}.at")) * (100 + percent) for s in (x, y)]) >= need

    while True:
        shared_order = Shared(docs.sparkSession, order)
        keys = stored(_keys(docs, size, percent, boundary, shared_order).join(reps, "doc_id", "left_semi"), "keys")
        lists = keys.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("sets"))
        lists = lists.filter("low < high").select("key", "sets")
        places = keys.select("doc_id", "n", F.explode(F.arrays_zip("keys", "at")).alias("k")).select("doc_id", "n", F.col("k.keys").alias("key"), "k.at")
        shared = stored(places.join(lists, "key"), "lists")
        # of a group of copies, the one with the fewest changes stands in the longest lists
        central = shared.groupBy("doc_id").agg(F.sum("sets").alias("central"))
        heads = shared.join(central, "doc_id").groupBy("key").agg(F.max_by(F.struct("doc_id", "n", "at"), F.struct("central", F.negative("doc_id"))).alias("head"))

        x, y = shared.alias("x"), heads.select("key", "head.*").alias("y")
        star = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") != F.col("y.doc_id")) & fits("x", "y"))
        star = stored(star.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "star")
        all_star, star = star, stored(_possible(star, keys, percent), "star")
        found = _verified(star, docs, size, percent)
        links = stored(found if links is None else links.unionByName(found), "links")

        near = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
        parts = stored(shared.select("key", "doc_id", "n", "at").join(near, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")), "parts")
        apart = parts.groupBy("key", "part").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("parts"))
        split = stored(apart.filter("parts > 1"), "split")
        crowded = split.filter(F.col("parts") > CROWD).select("key")
        crowd = parts.join(crowded, "key", "left_semi").select("doc_id").distinct()
        room = min(KEPT_SHINGLES, MOST_LAST - len(order.tokens))
        if room <= 0 or crowded.isEmpty():
            break
        some = docs.withColumn("__id", F.col("doc_id").cast("long")).join(crowd.select(F.col("doc_id").alias("__id")), "__id", "left_semi")
        more = _first_shingles(some, size, percent, shared_order).filter(F.col("times") > CROWD).orderBy(F.desc("times"), "token").limit(room + len(order.tokens)).toArrow()
        tokens = more.column("token").to_numpy().astype(np.int64).view(np.uint64)
        new = ~np.isin(tokens, order.tokens)
        if not new.any():
            break
        order = order.with_more(tokens[new][:room], more.column("times").to_numpy().astype(np.int64)[new][:room])
        discard(keys, shared, star, all_star, parts, split)

    parts_stored, parts = parts, parts.join(split.select("key"), "key", "left_semi")
    x, y = parts.alias("x"), parts.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part")) & fits("x", "y"))
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(all_star, ["a", "b"], "left_anti")
    rest = stored(_possible(rest, keys, percent), "rest")
    discard(keys, shared, star, all_star, parts_stored, split)
    more = stored(_verified(rest, docs, size, percent), "links")
    discard(rest, shuffles=False)
    return documents, classes, links.unionByName(more)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document."""
    return _components(docs, size, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    documents, classes, links = classes_and_links(docs, size, percent)
    found = components(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(found, "rep", "left").filter("copies > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return documents.join(named, "digest", "left").select("doc_id", "mark", "n", component.alias("component_id"))


def deduplicated(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs of which the smallest doc_id of each component stays; of rows with equal doc_id and text one stays.
    Rows with a null doc_id stay."""
    gone = _components(docs, size, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("__id"), _mark().alias("__mark"))
    left = packed.join(gone, ["__id", "__mark"], "left_anti")
    first = F.row_number().over(Window.partitionBy("__id", "__mark").orderBy("__id"))
    return left.withColumn("__n", first).filter("__n = 1 or __id is null").select("row.*")
