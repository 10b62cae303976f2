"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 1).

Texts are folded first: lower case, look-alike letters of other scripts, full-width, styled and accented ones
become Latin ones, digits and signs that stand for letters become those (1 stands for i and l, so l becomes i
too, in lexicon and text alike; ! and | do so inside words), other signs become blanks. The lexicon has word
beginnings and whole words with weights, learnt as log-ratios of their rates in toxic and other texts.
Exceptions are longer words with a low ratio, and phrases of two or three words around a word of the lexicon,
learnt likewise or given by the caller; a hit inside an exception doesn't count, and of hits that begin
together the longest counts. A text's density is the sum of its hits' weights over its number of words; a
logistic curve turns it into a score from 0 to 1.

Learning takes a bounded sample of labelled rows, FIT_ROWS: those with the lowest hashed ids. Half of
them give the lexicon, the others the curve; each half learns once from a whole text and its label, however
often it is repeated. Texts that only begin alike are all learnt from. Of what the sample has, nothing else is
cut. Without labels of both kinds the lexicon is empty.

Null or empty text has no hits and the lowest score. Repeated rows get equal scores; a doc_id labelled
more than once counts as toxic if any label says so. Rows with a null doc_id are scored, not learnt from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, per_worker, slices, stored, strings_of
from .folds import held_out

#: Labelled rows that are learnt from at most.
FIT_ROWS = 20_000
SHORTEST, LONGEST = 4, 14
#: Words added to a text's length, so that a single hit in a short text isn't everything.
EXTRA_WORDS = 20
#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһкмтвнԛԝӏαορτυνικεηχ", "aeopcyxijsdhkmtbhqwlaoptuvikenx", strict=True))
STANDS_FOR = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}
#: Signs that stand for i between letters or digits alone.
INSIDE = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")
#: Code points of letters and digits that decompose to ASCII ones: accented, circled, full-width, styled.
DECOMPOSED = [(0xA0, 0x250), (0x1E00, 0x1F00), (0x2460, 0x24F0), (0xFF10, 0xFF5B), (0x1D400, 0x1D800)]


def fold_table() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    for low, high in DECOMPOSED:
        for i in range(low, high):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)).lower() if not unicodedata.combining(c))
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                table[i] = STANDS_FOR.get(plain, plain)
    table |= {ord(k): STANDS_FOR.get(v, v) for k, v in (LOOK_ALIKE | STANDS_FOR).items()}
    return table | {i: "" for i in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF)}


def fold(text: str | None) -> str:
    low = (text or "").lower()
    if "!" in low or "|" in low:
        low = INSIDE.sub("i", low)
    return f" {low.translate(per_worker('fold-table', fold_table))} "


def patterns(word: str) -> list[str]:
    """A word's beginnings, and all of it, with the blanks around."""
    return [f" {word[:n]}" for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "]


class Lexicon:
    """weights of patterns; exceptions with weight 0; the curve's parameters."""

    def __init__(self, weights: dict[str, float], phrases: tuple[str, ...] = (), curve: tuple[float, ...] = (-4.0, 4.0, 0.0)):
        self.weights, self.phrases, self.curve, self.automaton = weights, phrases, curve, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def hits(self, folded: str) -> list[float]:
        """The weights of a folded text's hits."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self.automaton.add_word(p, (len(p), w, False))
            for p in self.phrases:  # folding what is folded changes nothing
                folded_phrase = " ".join(fold(p).split())
                self.automaton.add_word(f" {folded_phrase} ", (len(folded_phrase) + 2, 0.0, True))
            self.automaton.add_word("\n", (1, 0.0, False))
            self.automaton.make_automaton()
        found: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, weight, phrase) in self.automaton.iter(folded):
            if phrase:
                covered.append((end - size + 1, end))
            elif size > found.get(end - size, (0, 0.0))[0]:
                found[end - size] = (size, weight)
        return [w for s, (n, w) in found.items() if w and not any(a <= s + 1 and s + n - 1 <= b for a, b in covered)]

    def features(self, text: str | None) -> tuple[int, float, int]:
        """(hits, density, words) of a text."""
        folded = " ".join(fold(text).split())
        found = self.hits(f" {folded} ")
        words = folded.count(" ") + 1 if folded else 0
        return len(found), max(0.0, sum(found)) / (words + EXTRA_WORDS), words

    def score(self, density: float, words: int) -> float:
        a, b, c = self.curve
        x = a + (b + c * math.log1p(words)) * math.log1p(100 * density)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.01 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(pattern, toxic, times, texts): how often patterns occur, and in how many texts. wanted: these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter = Counter()
        texts: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(times)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([times[k] for k in keys], pa.int64()), pa.array([texts[k] for k in keys], pa.int64())], names=["pattern", "toxic", "times", "texts"])

        for batch in slices(batches, "text"):
            for text, toxic in zip(strings_of(batch, "text"), strings_of(batch, "toxic"), strict=True):
                own: Counter = Counter()
                for word, n in Counter(fold(text).split()).items():
                    times[("", toxic)] += n
                    for p in patterns(word):
                        if wanted is None or p in wanted:
                            own[p] += n
                for p, n in own.items():
                    times[(p, toxic)] += n
                    texts[(p, toxic)] += 1
            if len(times) > 500_000:
                yield out()
                times, texts = Counter(), Counter()
        yield out()

    counted = rows.select("text", "toxic").mapInArrow(run, "pattern string, toxic int, times long, texts long")
    return counted.groupBy("pattern", "toxic").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts"))


def _ratio(toxic: int, clean: int, totals: dict[int, int]) -> float:
    return math.log((toxic + 0.5) / (totals.get(1, 0) + 1)) - math.log((clean + 0.5) / (totals.get(0, 0) + 1))


def weigh(counts: dict[str, dict[int, tuple[int, int]]], totals: dict[int, int]) -> dict[str, float]:
    """The lexicon from each pattern's (times, texts) by label: patterns far likelier in toxic texts, and, with
    weight 0, longer patterns that begin like these but aren't."""
    ratio, good = {}, {}
    share = totals.get(1, 0) / max(1, totals.get(0, 0) + totals.get(1, 0))
    for p, by in counts.items():
        (t, texts), (c, _) = by.get(1, (0, 0)), by.get(0, (0, 0))
        ratio[p] = _ratio(t, c, totals)
        spread = math.sqrt((t + c) * share * (1 - share)) or 1.0
        good[p] = texts >= 4 and ratio[p] >= 1.5 and (t - (t + c) * share) / spread >= 6
    chosen: dict[str, float] = {}
    for p in sorted(counts, key=lambda p: (len(p), p)):
        above = next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in chosen), None)
        if good[p] and (above is None or ratio[p] > chosen[above] + 0.7):
            chosen[p] = ratio[p]
        elif above is not None and chosen[above] and sum(x[0] for x in counts[p].values()) >= 8 and ratio[p] < 0.7:
            chosen[p] = 0.0
    return chosen


def around(words: list[str], weights: dict[str, float], known: dict[str, bool]) -> Iterator[str]:
    """The phrases of two and three folded words around those that the lexicon hits; known remembers which these are."""
    for i, w in enumerate(words):
        hit = known.get(w)
        if hit is None:
            longest = next((p for p in sorted(patterns(w), key=len, reverse=True) if p in weights), None)
            hit = known[w] = bool(longest and weights[longest])
        if hit:
            for s, e in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2)):
                if s >= 0 and e <= len(words):
                    yield " ".join(words[s:e])


def harmless(rows: DataFrame, weights: dict[str, float], totals: dict[int, int]) -> tuple[str, ...]:
    """Phrases around words of the lexicon that aren't much likelier in toxic texts than in others."""
    if not weights:
        return ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in slices(batches, "text"):
            times: Counter = Counter()
            for text, toxic in zip(strings_of(batch, "text"), strings_of(batch, "toxic"), strict=True):
                times.update((p, toxic) for p in around(fold(text).split(), weights, known))
            keys = list(times)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([times[k] for k in keys], pa.int64())], names=["phrase", "toxic", "times"])

    said = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("times"))), F.lit(0))
    found = rows.select("text", "toxic").mapInArrow(run, "phrase string, toxic int, times long").groupBy("phrase").agg(said(1).alias("bad"), said(0).alias("fine"))
    return tuple(sorted(r["phrase"] for r in found.filter("bad + fine >= 8").collect() if _ratio(r["bad"], r["fine"], totals) < 0.7))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS, phrases: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon learnt from the labels for whose doc_id `learn` holds. What comes to the driver are patterns and phrases
    of the bounded sample that it has several times."""
    named = labels.filter("doc_id is not null and toxic is not null").filter(learn).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(some), "doc_id")  # fit_rows small rows at most
    rows = stored(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))).withColumn("copy", F.sha2("text", 256)), "labelled")
    first = rows.filter("half = 0").dropDuplicates(["copy", "toxic"])
    wanted = frozenset(r["pattern"] for r in _counted(first.filter("toxic = 1"), None).filter("texts >= 4").select("pattern").collect())
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in _counted(first, wanted).collect():
        counts.setdefault(r["pattern"], {})[r["toxic"]] = (r["times"], r["texts"])
    totals = {k: v[0] for k, v in counts.pop("", {}).items()}
    weights = weigh(counts, totals)
    lexicon = Lexicon(weights, (*phrases, *harmless(first, weights, totals)))
    found = sorted(features(rows.filter("half = 1").dropDuplicates(["copy", "toxic"]), lexicon, ["toxic"]).select("toxic", "density", "words").collect())  # fit_rows rows at most
    if found and len({r["toxic"] for r in found}) == 2:
        d = np.log1p(100 * np.array([r["density"] for r in found]))
        n = np.log1p(np.array([r["words"] for r in found], float))
        lexicon.curve = tuple(_logistic(np.stack([np.ones(len(d)), d, d * n], 1), np.array([r["toxic"] for r in found], float)).tolist())
    return lexicon


def features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns `keep` with hits, density, words and score."""
    shared = Shared(docs.sparkSession, lexicon)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    fields = [T.StructField("hits", T.LongType()), T.StructField("density", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields[: len(keep)], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in slices(batches, "__text"):
            found = [lexicon.features(t) for t in strings_of(batch, "__text")]
            cols = [batch.column(k) for k in range(len(keep))]
            new = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), pa.array([lexicon.score(f[1], f[2]) for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + new, names=schema.names)

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and more of each document."""
    lexicon = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = features(docs, lexicon, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "hits", "density")


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without those whose score is `least` or more; their columns as they were."""
    lexicon = fit(docs, labels, ~held_out(F.col("doc_id")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return features(packed, lexicon, ["row"]).filter(F.col("score") < least).select("row.*")
