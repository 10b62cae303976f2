"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlane.llm import bytedups, centroids, resample, runindex
from fleetlane.llm.words import ALNUM

from . import odd

# --- runs and matching statistics


def plain_statistics(texts):
    suffixes = [t[i:] for t in texts for i in range(len(t) + 1)]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    return [max([common(a, b) for k, b in enumerate(suffixes) if k != i], default=0) for i, a in enumerate(suffixes)]


def some_texts(rng):
    letters = rng.choice([b"a", b"ab", b"abc\x00", bytes(range(250))])
    made = lambda n: bytes(rng.choice(letters) for _ in range(n))
    base = made(40)
    return [base[(i := rng.randint(0, 20)) : i + rng.randint(0, 30)] + made(rng.randint(0, 9)) if rng.random() < 0.6 else made(rng.randint(0, 25)) for _ in range(rng.randint(1, 6))]


def test_statistics_are_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        texts = some_texts(rng)
        assert runindex.RunIndex.of(texts).statistics().tolist() == plain_statistics(texts)


def test_a_repetitive_collection_has_few_runs():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    copies = [base[:k] + b"X" + base[k:] for k in range(0, 3000, 100)]
    index = runindex.RunIndex.of(copies)
    assert index.n > 90_000 and len(index.first) < index.n // 15


def plain_bytes(rows, window):
    """(bytes, removed, spans, kept) of each (doc_id, text)."""
    blobs = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + window] for b in blobs for i in range(len(b) - window + 1))
    out = []
    for (d, _), b in zip(rows, blobs, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def odd_bytes(seed):
    """Rows with copies, equal rows, equal and null doc_ids, characters of several bytes, repeats inside a text."""
    rows = list(odd.documents(seed).items())
    rng = random.Random(seed)
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, None), (rows[9][0], "é" * 90), (900, "é" * 31 + "x"), (901, "x" + "é" * 31), (902, "aé" * 10)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, window, gram, crowd, index_bytes, heavy", [(0, 40, 8, 1000, 1 << 16, 500), (1, 24, 16, 3, 100, 2), (2, 200, 16, 0, 1, 1)])
def test_bytes_are_brute_force(spark, monkeypatch, seed, window, gram, crowd, index_bytes, heavy):
    """Also where all anchors are crowded, indexes hold one anchor each, and nearly all keys are heavy."""
    monkeypatch.setattr(bytedups, "HEAVY_ROWS", heavy)
    rows = odd_bytes(seed)
    df = odd.clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumns({c: F.lit(0) for c in ("d", "h", "found", "n_bytes", "kept", "spans")})
    out = bytedups.removed(df, window, gram, crowd, index_bytes)
    assert out.columns == [c for c in df.columns if c not in bytedups.RESULTS] + list(bytedups.RESULTS)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()]
    assert sorted(got, key=key) == sorted(plain_bytes(rows, window), key=key)
    assert [r["row"] for r in out.select("row").collect()] == ["x"] * len(rows)


def test_spans_are_what_goes(spark):
    text = "0123456789" * 3
    (r,) = bytedups.removed(spark.createDataFrame([(1, "abc" + text + "!"), ], "doc_id long, text string"), 20, 8).collect()
    assert [tuple(s) for s in r["spans"]] == [(3, 30)] and bytes(r["kept"]) == b"abc!" and r["text"] == "abc" + text + "!"


def test_texts_longer_than_places_are_told(monkeypatch):
    monkeypatch.setattr(bytedups, "PLACE_BITS", 9)
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    found = list(bytedups._found_in(text, np.array([len(text)]), 40, 8))
    windows = [i for _, _, first, n, _ in found for a, m in zip(first.tolist(), n.tolist(), strict=True) for i in range(a, a + m)]
    assert len(found) > 5 and windows == list(range(3000 - 39))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    shared = bytes(rng.choice(b"ab") for _ in range(60))
    at = {}
    for _ in range(20):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 50))) + shared + bytes(rng.choice(b"ab") for _ in range(30))
        anchor, first, n, offset = bytedups.anchors(text, np.array([len(text)]), 24, 12)
        assert (bytedups.gram_hashes(text, 12)[first + offset] == anchor).all() and (offset - n + 1 >= 0).all() and (offset <= 12).all()
        for a, s, m in zip(anchor.tolist(), first.tolist(), n.tolist(), strict=True):
            for i in range(s, s + m):
                assert at.setdefault(text[i : i + 24], a) == a


def test_parts_hold_all_windows_once_and_equal_windows_have_equal_keys():
    rng = random.Random(5)
    window, width, keys = 24, 13, {}
    shared = bytes(rng.choice(b"abc") for _ in range(40))
    for _ in range(40):
        k = rng.randint(0, 8)
        text = bytes(rng.choice(b"abc") for _ in range(k)) + shared[rng.randint(0, 3) : rng.randint(30, 40)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6)))
        windows = len(text) - window + 1
        offset = rng.randint(windows - 1, width - 1) if windows <= width else None
        if offset is None:
            continue
        got = [(first + i, offset - first - i) for _, first, _, part in bytedups.parted(text, offset, 0, width, 4, window) for i in range(len(part) - window + 1)]
        assert sorted(got) == [(i, offset - i) for i in range(windows)]
        for common, first, low, part in bytedups.parted(text, offset, 0, width, 4, window):
            assert low <= offset - first < low + 4 and len(common) == window - 3 and common in part
            for i in range(len(part) - window + 1):
                assert keys.setdefault((part[i : i + window], offset - first - i), (common, low)) == (common, low)


# --- centroids


def plain_clusters(rows, k, rounds, size, scale=1024, seed=3):
    kept = [(d, [math.floor(scale * x) for x in v]) for d, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{d}".encode()).hexdigest(), v) for d, v in kept if d is not None)
    cs = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, of, strict=True) if a == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(d, near(v)[1], near(v)[0]) for d, v in kept], cs


def vectors(seed, n, size):
    """Clusters, copies, ties on a coarse grid, and rows that don't count."""
    rng = random.Random(seed)
    middle = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(size)] for _ in range(6)]
    rows = [(i, [x + rng.choice([0, 0, 0.0009765625, -0.25]) for x in rng.choice(middle)]) for i in range(n)]
    rows += [(i, list(rows[0][1])) for i in range(n, n + 40)] + [(3, rows[-1][1]), (3, rows[-1][1]), (None, rows[n // 2][1])]
    bad = [None, [], [0.0] * (size - 1), [0.0] * (size + 1), [None, *[0.0] * (size - 1)], [float("nan")] * size, [float("inf"), *[0.0] * (size - 1)], [1e300] * size]
    rng.shuffle(rows)
    return rows, [(10_000 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize("seed, k, rounds, n", [(0, 8, 10, 400), (1, 3, 0, 60), (2, 1, 4, 50), (3, 8, 5, 2)])
def test_clusters_are_brute_force(spark, monkeypatch, seed, k, rounds, n):
    monkeypatch.setattr(centroids, "BLOCK", 64)
    rows, bad = vectors(seed, n, 6)
    rows = rows[: n if n < 5 else None]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit("x") for c in ("cluster", "v", "label", "distance")})
    out = centroids.clustered(df, k, rounds, 6).collect()
    want, cs = plain_clusters(rows, k, rounds, 6)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in out], key=key) == sorted(want, key=key)
    assert all(r["centroid"] == cs[r["cluster"]] and r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in out)


def test_bounds_skip_calculations_and_keep_ties():
    rng = np.random.default_rng(5)
    middle = rng.integers(-2000, 2000, (8, 16))
    x = (middle[rng.integers(0, 8, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int64)
    at = x[:8].copy()
    b, made = centroids.Bounds(x, 8), 0
    for _ in range(8):
        b.assign(at)
        d = np.stack([centroids.squared(x, c) for c in at], axis=1)
        assert (b.cluster == d.argmin(axis=1)).all()
        assert (b.upper.astype(float) ** 2 >= d[np.arange(len(x)), b.cluster]).all() and (b.lower.astype(float) ** 2 <= d).all()
        new = np.array([x[b.cluster == j].sum(axis=0) // max(1, (b.cluster == j).sum()) for j in range(8)])
        by = centroids._up(np.sqrt(((new - at) ** 2).sum(axis=1).astype(float))).astype(float)
        made, at = made + b.calculated, new
        b = centroids.Bounds(x, 8, b.cluster, b.upper, b.lower)
        b.moved(by)
    assert made < 3000 * 8 * 8 // 3
    equal = np.array([[0, 0], [2, 0], [0, 0]])
    b = centroids.Bounds(np.array([[1, 0], [2, 0], [0, 0]]), 3)
    b.assign(equal)
    assert b.cluster.tolist() == [0, 1, 0]


# --- resampling


def plain_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())
    grams = lambda w: [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f) % buckets
    s = Counter(bucket(f) for _, t in docs for f in grams(words(t)))
    t = Counter(bucket(f) for x in target for f in grams(words(x)))
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets))))
    rows = []
    for d, x in docs:
        f = grams(words(x))
        weight = sum(gain(bucket(g)) for g in f)
        h = None if d is None else int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)), None])
    pool = sorted((r for r in rows if r[4] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(pool[: percent * len(pool) // 100], 1):
        r[5] = rank
    return sorted(((*r[:4], r[5]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4] is None, r[4] or 0))


@pytest.mark.parametrize("seed, longest, percent", [(0, 1, 10), (1, 2, 35), (2, 3, 100)])
def test_resampling_is_brute_force(spark, monkeypatch, seed, longest, percent):
    monkeypatch.setattr(resample, "CHUNK", 3000)
    docs = [*odd.documents(seed).items(), (None, "no id " * 30), (None, None), (4, "again " * 25)]
    target = ["al be ra si tu von", "one two THREE", None, "", "alra béx"]
    df = odd.clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).withColumns({c: F.lit("y") for c in ("rank", "weight", "chunk", "feature", "bucket")})
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample.scored(df, wanted, longest=longest, percent=percent).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4] is None, r[4] or 0)) == plain_resample(docs, target, longest, percent=percent)
    drawn = resample.resampled(df, wanted, longest=longest, percent=percent)
    assert drawn.columns == df.columns and {r["doc_id"] for r in drawn.collect()} == {g[0] for g in got if g[4] is not None}


def test_equal_rows_have_equal_scores(spark):
    df = spark.createDataFrame([(7, "same text " * 15)] * 5, "doc_id long, text string")
    out = resample.scored(df, spark.createDataFrame([("same",)], "text string"), percent=60).collect()
    assert len({(r["weight"], r["score"]) for r in out}) == 1 and sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]


def test_a_feature_is_hashed_once(spark):
    docs = spark.createDataFrame([(i, "the the cat") for i in range(50)], "doc_id long, text string").repartition(4)
    named = resample._named(resample._chunks(docs, 1))
    distinct = resample.dictionary(named, named.limit(0), 100)
    assert sorted((r["feature"], r["s"]) for r in distinct.collect()) == [("cat", 50), ("the", 100)]


def test_words_of_features():
    assert ALNUM.translate(ALNUM) == ALNUM and resample.features("A-b Éx1".encode(), 2)[0] == Counter({b"a": 1, b"b": 1, "Éx1".encode(): 1, b"a b": 1, "b Éx1".encode(): 1})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bytedups.digests(docs).count() == 0 and resample.digests(docs, docs).count() == 0
    assert centroids.digests(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], docs.schema)
    assert [(r["n_bytes"], r["n_spans"]) for r in bytedups.digests(one).collect()] == [(0, 0)] * 2
    assert [(r["n_features"], r["weight"], r["rank"]) for r in resample.digests(one, docs).collect()] == [(0, 0, None)] * 2


def test_no_row_grows_with_a_chunk(spark):
    """Chunks' rows once held all their documents, and readers, joins and batches many chunks at a time."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(2000)], "doc_id long, text string").coalesce(1)
    chunks = resample._chunks(docs, 1)
    assert chunks.agg(F.max(F.length(F.to_json(F.struct(*chunks.columns))))).first()[0] < 20_000
    assert resample._named(chunks).count() == 40_000 and resample._named(chunks).select("chunk", "place").distinct().count() == 40_000
    packed = resample._packed(resample._named(chunks).withColumn("gain", F.lit(-3).cast("long")))
    assert {tuple(r) for r in resample._weights(chunks, packed).select("n_features", "weight").collect()} == {(20, -60)}
