"""Language ID with interpolated Kneser-Ney character models (operator 3).

A text becomes lower-case letters with one blank for whatever is between words. Each language's model has
the `order`-grams of all its training texts, counted by Spark; lower orders count distinct left neighbours.
Grams and contexts lie, with their discounted probabilities and back-off weights, in sorted arrays, cut
between contexts into pieces that Spark's tasks write to the shared folder and workers map into memory.
Neither grams nor languages are dropped.
A text goes to the language with the lowest length-normalised cross-entropy. Rejection is calibrated on
texts that the models haven't seen: a bounded sample of the labelled rows (CALIBRATION_ROWS, a tenth at most,
of languages with LEAST_TEXTS or more) is left out of the counts, and a text is rejected if its cross-entropy
is above what all but `reject` of its language's texts in that sample reach. Languages without such texts
reject nothing.

Null text or text without a letter: `und`, score 0, rejected. Without training texts every text is `und`.
Of equal cross-entropies the first language by name wins. Repeated rows get equal results. Columns besides
doc_id, text and lang are neither read nor kept; rows without lang are never learnt from.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, discard, open_fs, per_worker, shared_dir, slices, stored, strings_of
from .folds import held_out

ORDER = 4
#: Rows that calibrate rejection, and texts that a language must have for that; grams from which a piece of a model ends with the context.
CALIBRATION_ROWS, LEAST_TEXTS, PIECE_GRAMS = 10_000, 50, 1 << 20
#: Characters worked on at a time; letters after which the score no longer gains from more of them.
AT_ONCE, FULL_LENGTH = 1 << 20, 100


def letters() -> np.ndarray:
    """For each code point the lower-case letter it stands for, as 16 bits, or 0."""

    def made() -> np.ndarray:
        out = np.zeros(0x110000, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[i] = low if low < 0x10000 else 1 + low % 0xFFFE
        return out

    return per_worker("letters", made)


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a blank and then the packed grams that end in each of its characters; where each text
    begins; and each text's number of letters."""
    points = np.frombuffer("".join(f"\0{t or ''}" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    text_of = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
    x, new = letters()[points], np.append(True, text_of[1:] != text_of[:-1])
    keep = new | (x != 0)
    keep[1:] |= x[:-1] != 0
    x, text_of = x[keep].astype(np.uint64), text_of[keep]
    start = np.flatnonzero(np.append(True, text_of[1:] != text_of[:-1]))
    place = np.arange(len(x)) - start[text_of]
    out = x.copy()
    for k in range(1, order):  # what lies before a text is blank
        out[k:] |= np.where(place[k:] >= k, x[:-k] << np.uint64(16 * k), np.uint64(0))
    return out, start, np.bincount(text_of[x != 0], minlength=len(texts))


def _pieces(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches whose texts have about AT_ONCE characters together, or a single one."""
    for batch in slices(batches, name):
        texts, s, total = strings_of(batch, name), 0, 0
        for i, t in enumerate(texts):
            total += len(t or "")
            if total >= AT_ONCE or i + 1 == len(texts):
                yield batch.slice(s, i + 1 - s), texts[s : i + 1]
                s, total = i + 1, 0


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, times) over all texts with a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pieces(batches):
            langs = np.array(strings_of(batch, "lang"), object)
            for lang in sorted(set(langs)):
                g, start, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                values, times = np.unique(np.delete(g, start), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "times"])

    rows = docs.filter("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(run, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def _piece(g: np.ndarray, c: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted grams with discounted probabilities, sorted contexts with back-off weights. All grams of its contexts are in g."""
    context, of, followers = np.unique(g >> np.uint64(16), return_inverse=True, return_counts=True)  # the last character is the lowest
    total = np.bincount(of, weights=c)
    return g, (np.maximum(c - discount, 0) / total[of]).astype(np.float32), context, (discount * followers / total).astype(np.float32)


class KneserNey:
    """One language's model: for each order, from the highest, the pieces in the order of their contexts."""

    def __init__(self, grams: np.ndarray, times: np.ndarray, order: int = ORDER):
        self.levels = []
        at = np.argsort(grams)
        g, c = grams[at], times[at].astype(float)
        for k in range(order, 0, -1):
            self.levels.append([_piece(g, c, _discount((c == 1).sum(), (c == 2).sum()))])
            if k > 1:  # lower orders count distinct left neighbours
                g, c = np.unique(g & np.uint64((1 << (16 * (k - 1))) - 1), return_counts=True)
                c = c.astype(float)

    def entropies(self, g: np.ndarray, letters: int) -> np.ndarray:
        """-log2 of the last character's probability, for each packed gram."""
        p = np.full(len(g), 1 / letters)
        for k, pieces in enumerate(reversed(self.levels), 1):
            own = g & np.uint64((1 << (16 * k)) - 1) if k < 4 else g
            before = own >> np.uint64(16)
            in_piece = np.searchsorted(np.array([x[2][0] for x in pieces[1:]], np.uint64), before, side="right")
            order = np.argsort(in_piece, kind="stable") if len(pieces) > 1 else np.arange(len(g))
            ends = np.searchsorted(in_piece, np.arange(len(pieces)), side="right", sorter=order)
            seen, back = np.zeros(len(g)), np.ones(len(g))
            for here, (keys, values, contexts, weights) in zip(np.split(order, ends[:-1]), pieces, strict=True):
                if len(here):
                    at = np.minimum(np.searchsorted(keys, own[here]), len(keys) - 1)
                    there = np.minimum(np.searchsorted(contexts, before[here]), len(contexts) - 1)
                    seen[here] = np.where(keys[at] == own[here], values[at], 0)
                    back[here] = np.where(contexts[there] == before[here], weights[there], 1)
            p = seen + back * p
        return -np.log2(p).astype(np.float32)


def _mapped(address: str) -> np.ndarray:
    """A file's bytes, mapped into memory; from a remote store by way of an unnamed temporary file."""
    fs, path = open_fs(address)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as there:
        shutil.copyfileobj(there, f)
        f.flush()
        return np.memmap(f, np.uint8, "r")


class StoredKneserNey(KneserNey):
    """A model whose pieces are in files: for each order (file, offset, grams, contexts) of each piece. Opened when first used."""

    def __init__(self, places: list[list[tuple[str, int, int, int]]]):
        self.places, self.opened = places, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": None}

    @property
    def levels(self) -> list:
        if self.opened is None:
            files = {f: per_worker_file(f) for pieces in self.places for f, *_ in pieces}
            self.opened = [sorted((self._read(files[f], *at) for f, *at in pieces), key=lambda x: int(x[2][0])) for pieces in self.places]
        return self.opened

    @staticmethod
    def _read(data: np.ndarray, at: int, n: int, m: int) -> tuple[np.ndarray, ...]:
        cut = lambda s, k, kind: data[s : s + k * np.dtype(kind).itemsize].view(kind)
        return cut(at, n, np.uint64), cut(at + 8 * (n + m), n, np.float32), cut(at + 8 * n, m, np.uint64), cut(at + 12 * n + 8 * m, m, np.float32)


#: Files that this process has mapped; models of several languages share them.
_FILES: dict[str, np.ndarray] = {}


def per_worker_file(address: str) -> np.ndarray:
    if address not in _FILES:
        root = address.rsplit("/", 1)[0]
        for other in [f for f in _FILES if f.rsplit("/", 1)[0] != root]:
            del _FILES[other]
        _FILES[address] = _mapped(address)
    return _FILES[address]


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, k, grams, times) of sorted rows of these; from `most` grams on, a run is cut between contexts."""
    key, size = None, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        code, k = lang.indices.to_numpy(), batch.column(1).to_numpy()
        grams, times = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy().astype(float)
        new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (k[1:] != k[:-1]))) if len(k) else []
        for s, e in zip(new, [*new[1:], len(k)], strict=True):
            own = lang.dictionary[int(code[s])].as_py(), int(k[s])
            if held and own != key:
                yield *key, *map(np.concatenate, zip(*held, strict=True))
                held, size = [], 0
            key = own
            held.append((grams[s:e], times[s:e]))
            size += e - s
            if size >= most:
                g, c = map(np.concatenate, zip(*held, strict=True))
                cut = int(np.searchsorted(g >> np.uint64(16), g[-1] >> np.uint64(16)))
                if cut:
                    yield *key, g[:cut], c[:cut]
                held, size = [(g[cut:], c[cut:])], len(g) - cut
    if held:
        yield *key, *map(np.concatenate, zip(*held, strict=True))


def built(found: DataFrame, piece_grams: int | None = None) -> tuple[dict[str, StoredKneserNey], int]:
    """The model of each lang of a stored table (lang, gram, times), which goes, and the number of letters."""
    levels = [found]
    for k in range(ORDER - 1, 0, -1):  # lower orders count distinct left neighbours
        low = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")
        levels.append(stored(levels[-1].groupBy("lang", low).agg(F.count("*").alias("times")), "grams"))
    every = levels[0].withColumn("k", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):
        every = every.unionByName(levels[ORDER - k].withColumn("k", F.lit(k)))
    sums = every.groupBy("lang", "k").agg(F.count_if(F.col("times") == 1).alias("once"), F.count_if(F.col("times") == 2).alias("twice"), F.count("*").alias("n")).collect()  # ORDER rows a language
    discounts = {(r["lang"], r["k"]): _discount(r["once"], r["twice"]) for r in sums}
    letters = levels[-1].select("gram").distinct().count() + 1
    most = piece_grams or PIECE_GRAMS
    folder = shared_dir(found.sparkSession, "models")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        file, at, f, places = uuid.uuid4().hex, 0, None, []
        for lang, k, g, c in _runs(batches, most):
            f = f or fs.open_output_stream(f"{root}/{file}")
            g, p, contexts, weights = _piece(g, c, discounts[lang, k])
            data = b"".join(x.tobytes() for x in (g, contexts, p, weights))
            f.write(data + bytes(-len(data) % 8))
            places.append((lang, k, file, at, len(g), len(contexts)))
            at += len(data) + -len(data) % 8
        if f:
            f.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*places, strict=True)], names=["lang", "k", "file", "at", "grams", "contexts"])

    context = F.shiftrightunsigned("gram", 16)
    parts = 8 + sum(r["n"] for r in sums) // most
    dealt = every.select("lang", "k", "gram", "times").repartitionByRange(parts, "k", "lang", context).sortWithinPartitions("k", "lang", context, "gram")
    places: dict[str, list] = defaultdict(lambda: [[] for _ in range(ORDER)])
    for r in dealt.mapInArrow(run, "lang string, k long, file string, at long, grams long, contexts long").collect():  # a row a piece
        places[r["lang"]][ORDER - r["k"]].append((f"{folder}/{r['file']}", r["at"], r["grams"], r["contexts"]))
    discard(*levels)
    return {lang: StoredKneserNey(x) for lang, x in places.items()}, letters


class Models:
    """All languages' models. limits: the cross-entropy above which a language's texts are rejected."""

    def __init__(self, names: list[str], models: list[KneserNey], letters: int, limits: dict[str, float]):
        self.names, self.models, self.letters, self.limits = names, models, letters, limits

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and cross-entropy (bits a character) of each text."""
        g, start, has = grams(texts)
        of, distinct = pd.factorize(g)
        sizes = np.diff(np.append(start, len(g))) - 1
        bits = np.zeros((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            each = model.entropies(distinct, self.letters)[of]
            each[start] = 0
            bits[:, k] = np.add.reduceat(each, start, dtype=np.float64) / np.maximum(sizes, 1)
        if not self.models:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        odds = np.exp2(np.maximum(-1000, (low[:, None] - bits) * np.minimum(sizes, FULL_LENGTH)[:, None])).sum(1)
        known = has > 0
        return np.where(known, np.array(self.names, object)[best], "und").tolist(), np.where(known, 1 / odds, 0.0).tolist(), np.where(known, low, 0.0).tolist()


def fit(docs: DataFrame, learn: Column, reject: float = 0.001) -> Models:
    """Models of the languages of those docs for which `learn` holds."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(learn).filter("lang is not null and text is not null")
    known = rows.groupBy("lang").agg(F.count("*").alias("texts"))
    every = known.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    ids = rows.filter("doc_id is not null").select("doc_id", "lang").join(known.filter(F.col("texts") >= LEAST_TEXTS).select("lang"), "lang")
    ids = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("calibration")), "doc_id").limit(min(CALIBRATION_ROWS, every // 10))
    ids = stored(ids, "calibration")
    models, letters = built(stored(counts(rows.join(F.broadcast(ids), "doc_id", "left_anti")), "grams"))  # CALIBRATION_ROWS ids at most
    names = sorted(models)
    made = Models(names, [models[x] for x in names], letters, {})
    limits = judged(rows.join(F.broadcast(ids), "doc_id"), made, ["lang"]).filter("lang = lang_pred").groupBy("lang").agg(F.percentile("bits", F.lit(1 - reject)).alias("most")).collect()
    discard(ids)
    return Models(names, made.models, letters, {r["lang"]: r["most"] for r in limits})


def judged(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred, score, bits and rejected."""
    shared = Shared(docs.sparkSession, models)
    names = [*keep, "lang_pred", "score", "bits", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch, texts in _pieces(batches, "__text"):
            lang, score, bits = models.judged(texts)
            out = [x == "und" or b > models.limits.get(x, np.inf) for x, b in zip(lang, bits, strict=True)]
            kept = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(out, pa.bool_())], names=names)

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits double, rejected boolean")


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and more, by models of the documents that aren't held out."""
    models = fit(docs, ~held_out(F.col("doc_id")))
    out = judged(docs.select("doc_id", "text"), models, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "rejected")
