import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlane.llm import embeddings, language, toxicity

from . import brute, odd


def held(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


@pytest.mark.parametrize("chunk, cell", [(4096, 1024), (7, 1024), (7, 9)])
def test_embeddings_are_brute_force(spark, monkeypatch, chunk, cell):
    """With reach 1, or all vectors in one cell, nothing is missed."""
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "AT_ONCE", 5)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(16)
        rows += [(base + rng.standard_normal(16) * s).astype(np.float32).tolist() for s in (0, 0, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4)]
    rows += [(np.array(rows[3]) * 7).tolist(), (np.array(rows[3]) * -1).tolist(), [0.0] * 16, None, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [], [1.0, 2.0], [2.0, 4.0], [1e300, 1e300], [1e-300, 1e-300]]
    ids = list(range(100, 100 + len(rows)))
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("node", "key", "first", "cells", "component")}).repartition(3)
    good = {i: np.array(v) / np.abs(v).max() for i, v in zip(ids, rows, strict=True) if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    edges = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    parts = brute.union(ids, edges)
    links = {i: sum(i in e for e in edges) for i in ids}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, reach=embeddings.REACH if cell > len(ids) else 1.0).collect()}
    assert got == {i: (links[i], parts[i], parts[i] == i) for i in ids}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_and_odd_ids(spark, monkeypatch):
    """Pairs right at the threshold, many cells: at least 0.9 of the links, and none that isn't one."""
    monkeypatch.setattr(embeddings, "CELL", 60)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 64))
    y = rng.standard_normal((1500, 64))
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y - (x * y).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    cosine = np.where(np.arange(1500) % 3 == 0, 0.89, 0.901)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]))]
    rows += [(None, rows[1][1]), (7000, rows[4][1]), (7000, rows[4][1]), (7001, (np.array(rows[7][1]) * 3).tolist())]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {r["vec_id"]: r for r in out if r["vec_id"] is not None and r["vec_id"] < 1500}
    assert all(by[i]["n_links"] == 0 for i in range(0, 1500, 3))
    assert np.mean([by[i]["n_links"] > 0 for i in range(1500) if i % 3]) >= 0.9
    assert sorted(r["n_links"] for r in out if r["vec_id"] == 7000) == [by[4]["n_links"]] * 2 and by[4]["n_links"] >= 2
    assert [(r["component_id"], r["kept"]) for r in out if r["vec_id"] is None] == [(None, True)]


def test_embeddings_miss_no_link(spark, monkeypatch):
    """Isotropic pairs right above the threshold, in many cells: every one is found, by the defaults."""
    monkeypatch.setattr(embeddings, "CELL", 30)
    monkeypatch.setattr(embeddings, "CHUNK", 500)
    rng = np.random.default_rng(16)
    x, y = rng.standard_normal((1000, 64)), rng.standard_normal((1000, 64))
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y - (x * y).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    z = 0.9001 * x + np.sqrt(1 - 0.9001**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, z]))]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {i: (1, i % 1000) for i in range(2000)}


def test_cosine_on_the_threshold_is_taken_from_the_vectors_themselves(spark):
    """Vectors of ten ones of which nine are shared have cosine 0.9 on the dot."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        on = rng.permutation(64)[:11]
        rows += [(2 * k + j, np.isin(np.arange(64), np.delete(on, j)).astype(float).tolist()) for j in range(2)]
    want = {i: sum(np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w))) >= 0.9 for j, w in rows if j != i) for i, v in rows}
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == want


def sentences(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


LANGS = {"xa": ["the", "ing", "and", "th", "er"], "xb": ["der", "ung", "sch", "ein", "ich"], "xc": ["ción", "las", "el", "ñar", "os"]}


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, LANGS[lang], rng.randrange(3, 60)), lang) for i in range(600) for lang in [rng.choice(list(LANGS))]]
    rows += [(1001, None, "xa"), (1002, "12 .. 3", "xb"), (1003, "the and", None), (None, "ing and the", "xa"), (1004, "THE AND ING", None), (1005, "", None), (1006, "the " * 30_000, None), (1006, "the " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.predicted(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    tested = [(by[i]["lang_pred"], lang) for i, _, lang in rows[:600] if held(i)]
    assert np.mean([a == b for a, b in tested]) > 0.98 and all(by[i]["held_out"] == held(i) for i, *_ in rows[:600])
    assert [by[i]["lang_pred"] for i in (1001, 1002, 1005, 1003, 1004, 1006)] == ["und"] * 3 + ["xa"] * 3
    assert all(0 <= r["score"] <= 1 for r in got) and by[1001]["rejected"]
    assert {r["lang_pred"] for r in language.predicted(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predicted(df.limit(0)).count() == 0


def plain_letters(text):
    """A blank, then lower-case letters with one blank for whatever is between words."""
    out = [" "]
    for c in text or "":
        if c.isalpha():
            out.append(c.lower()[0])
        elif out[-1] != " ":
            out.append(" ")
    return out


class PlainKneserNey:
    """Interpolated Kneser-Ney in dictionaries, straight from its definition."""

    def __init__(self, texts, order=4):
        grams = {}
        for t in texts:
            x = [" "] * (order - 1) + plain_letters(t)
            for i in range(order, len(x)):  # the blank in front isn't predicted
                g = tuple(x[i - order + 1 : i + 1])
                grams[g] = grams.get(g, 0) + 1
        self.levels = {order: grams}
        for k in range(order - 1, 0, -1):
            low = {}
            for g in self.levels[k + 1]:
                low[g[1:]] = low.get(g[1:], 0) + 1
            self.levels[k] = low
        self.discount, self.context = {}, {}
        for k, level in self.levels.items():
            once, twice = (sum(n == m for n in level.values()) for m in (1, 2))
            self.discount[k] = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
            for g, n in level.items():
                total, kinds = self.context.get(g[:-1], (0, 0)) if len(g) == k else (0, 0)
                self.context[g[:-1]] = (total + n, kinds + 1)

    def bits(self, text, letters, order=4):
        x = [" "] * (order - 1) + plain_letters(text)
        total = 0.0
        for i in range(order, len(x)):
            p = 1 / letters
            for k in range(1, order + 1):
                g = tuple(x[i - k + 1 : i + 1])
                times, kinds = self.context.get(g[:-1], (0, 0))
                if times:
                    p = max(self.levels[k].get(g, 0) - self.discount[k], 0) / times + self.discount[k] * kinds / times * p
            total -= np.log2(p)
        return total / max(1, len(x) - order)


def test_language_is_a_plain_kneser_ney(spark):
    rng = random.Random(9)
    rows = [(i, sentences(rng, LANGS[lang], rng.randrange(1, 30)) + rng.choice(["", ".", " 12", " Éa"]), lang) for i in range(90) for lang in [rng.choice(list(LANGS))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.fit(df, F.lit(True))  # 9 of the rows calibrate, where a language has 50
    left_out = {r["doc_id"] for r in df.select("doc_id", "lang").join(df.groupBy("lang").count().filter("count >= 50"), "lang").orderBy(F.xxhash64("doc_id", F.lit("calibration"))).limit(9).collect()}
    learnt = [r for r in rows if r[0] not in left_out]
    plain = {lang: PlainKneserNey([t for _, t, x in learnt if x == lang]) for lang in LANGS}
    letters = len({g for p in plain.values() for g in p.levels[1]}) + 1
    assert models.names == sorted(LANGS) and models.letters == letters
    for r in language.judged(df, models, ["doc_id", "text"]).collect():
        bits = {lang: p.bits(r["text"], letters) for lang, p in plain.items()}
        best = min(bits, key=bits.get)
        assert r["lang_pred"] == best and abs(r["bits"] - bits[best]) < 1e-4
        n = min(100, len(plain_letters(r["text"])) - 1)
        assert abs(r["score"] - 1 / sum(2 ** (n * (bits[best] - b)) for b in bits.values())) < 1e-2


def test_rejection_is_calibrated_on_unseen_texts(spark):
    """About `reject` of new texts of the same kind are rejected, not the many that a limit from seen texts would."""
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(i, "".join(rng.choices(letters[1000 * k : 1000 * k + 1000], k=60)), lang) for i in range(3000) for k, lang in [rng.choice(list(enumerate(LANGS)))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.fit(df.filter("doc_id < 2000"), F.lit(True), reject=0.05)
    new = language.judged(df.filter("doc_id >= 2000"), models, ["doc_id"])
    seen = language.judged(df.filter("doc_id < 2000"), models, ["doc_id"])
    assert set(models.limits) == set(LANGS) and 0.01 < new.filter("rejected").count() / 1000 < 0.12
    assert seen.filter("rejected").count() / 2000 < 0.02
    other = spark.createDataFrame([(1, "qqq zzz xxx www vvv kkk jjj")], "doc_id long, text string")
    assert language.judged(other, models, ["doc_id"]).first()["rejected"]


def test_kneser_ney_sums_to_one():
    texts = ["abab abcab", "bca b ac", "abcabc"]
    g, start, _ = language.grams(texts)
    values, times = np.unique(np.delete(g, start), return_counts=True)
    model = language.KneserNey(values, times)
    letters = [0, *map(ord, "abc")]
    for context in [(0, 0, 0), (97, 98, 97), (98, 98, 98), (122, 97, 98)]:
        packed = np.array([context[0] << 48 | context[1] << 32 | context[2] << 16 | c for c in letters], np.uint64)
        assert 0.99 < np.exp2(-model.entropies(packed, len(letters)).astype(float)).sum() < 1.01


def test_models_keep_all_grams(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(map(chr, rng.integers(0x4E00, 0x9000, 1000))), "zh") for i in range(450)]
    models, letters = language.built(language.stored(language.counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "grams"))
    g, start, _ = language.grams([t for _, t, _ in rows])
    values, times = np.unique(np.delete(g, start), return_counts=True)
    wanted = language.KneserNey(values, times)
    assert len(values) > 400_000 and list(models) == ["zh"]
    for some in (values, values + np.uint64(1)):
        assert (models["zh"].entropies(some, letters) == wanted.entropies(some, letters)).all()


def test_models_keep_all_languages(spark):
    rows = [(i, "the and" + " ing" * (i % 3), f"l{i}") for i in range(300)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).names == sorted(r[2] for r in rows)


def test_models_in_pieces_are_whole_models(spark):
    rng = random.Random(5)
    texts = [sentences(rng, LANGS["xa"] + LANGS["xc"] + ["\u65e5\u672c", "\uff21\uffdc\u8a9e"], 40) for _ in range(60)]
    g, start, _ = language.grams(texts)
    values, times = np.unique(np.delete(g, start), return_counts=True)
    rows = list(zip(["x"] * len(values), values.view(np.int64).tolist(), times.tolist(), strict=True))
    found = language.stored(spark.createDataFrame(rows, "lang string, gram long, times long").repartition(3), "grams")
    models, letters = language.built(found, 50)
    assert letters == len(np.unique(values & np.uint64(0xFFFF))) + 1 and len(models["x"].levels[0]) > 8
    assert sum(len(p[0]) for p in models["x"].levels[0]) == len(values)
    some = np.concatenate([values, values + np.uint64(1), values << np.uint64(16)])
    assert (models["x"].entropies(some, letters) == language.KneserNey(values, times).entropies(some, letters)).all()


def test_grams_do_not_see_their_neighbours():
    alone = [language.grams([t])[0].tolist() for t in ("Ab, c", "", "x", None)]
    joint, start, has = language.grams(["Ab, c", "", "x", None])
    assert [x.tolist() for x in np.split(joint, start[1:])] == alone and has.tolist() == [3, 0, 1, 0]


def toxic_rows():
    rng = random.Random(3)
    rows, labels = [], []
    bad = ["idiot", "moron", "scumbag"]
    for i in range(1200):
        words = [rng.choice(["the", "lot", "of", "green", "paper", "1999", "island"]) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join([f"d{i}", *words])))
        if i % 3 != 1:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    plain = "the lot of green paper " * 6
    odd_rows = [(5000, plain + "what an 1d10t he is"), (5001, plain + "you Mоrоn"), (5002, plain + "a ｉｄｉｏｔ !"), (5003, plain), (5004, None), (5005, ""), (None, "idiot"), (5006, plain * 2000), (5007, "green idiotic-free"), (5003, plain)]
    docs = spark.createDataFrame(rows + odd_rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "toxic": F.lit(1)})
    table = spark.createDataFrame([*labels, (5004, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int").withColumn("quality", F.lit(None).cast("int"))
    got = toxicity.scored(docs.drop("toxic"), table).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert np.mean([by[i] == (i % 6 == 0) for i in range(1200) if held(i)]) > 0.97
    assert [by[i] for i in (5000, 5001, 5002, 5003, 5004, 5005, 5006)] == [1, 1, 1, 0, 0, 0, 0]
    wrong = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.drop("toxic"), wrong).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}  # labels of held-out rows are never looked at
    left = toxicity.kept(odd.clashing(docs), table)
    assert left.columns == odd.clashing(docs).columns and left.filter("doc_id in (5000, 5001, 5002)").count() == 0 and left.filter("doc_id >= 5003").count() >= 5
    assert toxicity.scored(docs.limit(0), table).count() == 0
    assert {r["predicted"] for r in toxicity.scored(docs, table.limit(0)).collect()} == {0}


def test_texts_that_begin_alike_are_learnt_from(spark):
    rows, labels = toxic_rows()
    header = "this text is licensed to everyone under the terms that its source gives on the first page of the text "
    docs = spark.createDataFrame([(i, header + t) for i, t in rows], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert len(header) >= 100 and toxicity.fit(docs, table, F.lit(True)).weights
    by = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, table).collect()}
    assert np.mean([by[i] == (i % 6 == 0) for i in range(1200) if held(i)]) > 0.97


def test_equal_texts_are_learnt_from_once(spark):
    rows, labels = toxic_rows()
    more = [(10_000 + k, rows[0][1]) for k in range(500)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    once, often = (toxicity.fit(spark.createDataFrame(d, "doc_id long, text string").repartition(n), table(x), F.lit(True)) for d, x, n in ((rows + more[:40], labels + [(i, 1) for i, _ in more[:40]], 2), (rows + more, labels + [(i, 1) for i, _ in more], 7)))
    assert once.weights == often.weights and once.curve == often.curve


def test_scores_are_those_of_a_plain_scorer(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), phrases=("green moron",))
    assert lexicon.weights
    lexicon.weights |= {" moronic ": 0.0, " green ": 0.5}
    some = [t for _, t in rows[:150]] + [None, "", "moron", "m0r0n moronic MORONS", "a green moron is green", "green moron moron", "ＭＯＲＯＮ!"]
    out = toxicity.features(spark.createDataFrame(list(enumerate(some)), "k long, text string"), lexicon, ["k"]).collect()
    for r in out:
        hits, density, words = brute.toxicity_features(lexicon, some[r["k"]])
        assert (r["hits"], r["words"]) == (hits, words) and abs(r["density"] - density) < 1e-12
        assert r["score"] == lexicon.score(r["density"], r["words"])


def test_folding():
    fold = lambda t: " ".join(toxicity.fold(t).split())
    assert fold("ｌｏｌ") == fold("lol") == fold("LÖL") == fold("l0l") == fold("ӏol") == fold("𝐥𝐨𝐥") == fold("ⓛⓞⓛ") == "ioi"
    assert fold("idi!ot id|ot idiot! |a|") == "idiiot idiot idiot a" and fold("lo\u0301l lo\u200bl") == "ioi ioi"
    assert fold(fold("Lóꝉ x1")) == fold("Lóꝉ x1") and fold(None) == ""


def test_harmless_phrases_are_learnt(spark):
    """A word of toxic texts that clean texts have in one phrase alone."""
    rng = random.Random(6)
    filler = ["the", "lot", "of", "paper", "island", "stone"]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(filler) for _ in range(rng.randrange(30, 60))]
        if i % 4 == 0:
            words[10:10] = ["you", "trash"] if i % 8 else ["trash", "all"]
        elif i % 40 == 1:
            words[10:10] = ["trash", "can"]
        rows.append((i, " ".join([f"d{i}", *words])))
        labels.append((i, int(i % 4 == 0)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, table, F.lit(True))
    assert any("can" in p.split() for p in lexicon.phrases) and not any(p in ("you trash", "trash aii") for p in lexicon.phrases)
    assert lexicon.features("the trash can is there")[0] == 0 and lexicon.features("that trash")[0] == 1


def test_exceptions():
    lexicon = toxicity.Lexicon({" idiot": 3.0, " idiotes ": 0.0, " trash ": 2.0}, phrases=("Trash can",))
    hits = lambda text: lexicon.hits(" " + " ".join(toxicity.fold(text).split()) + " ")
    lexicon.weights = {toxicity.fold(k.strip())[:-1] + (" " if k.endswith(" ") else ""): w for k, w in lexicon.weights.items()}
    assert hits("an Idiot, idiots") == [3.0, 3.0] and hits("idiotes") == [] and hits("videoidiot") == []
    assert hits("the trash") == [2.0] and hits("the TRA5H can") == [] and hits("trash cans") == [2.0]
