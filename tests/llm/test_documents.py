import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlane.llm import decontaminate, graph, jaccard, substrings, words
from fleetlane.llm import queries as Q

from . import brute, odd


@pytest.mark.parametrize("seed, size, percent", [(0, 3, 90), (1, 3, 90), (2, 5, 80), (3, 1, 70)])
def test_jaccard_is_brute_force(spark, seed, size, percent):
    docs = odd.documents(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd.frame(spark, docs), size, percent).collect()}
    assert got == brute.near_duplicates(docs, size, percent)


@pytest.mark.parametrize("boundary", [0, 9, 30, 99])
def test_any_boundary_gives_the_same(spark, monkeypatch, boundary):
    docs = odd.documents(4)
    monkeypatch.setattr(jaccard, "boundary_of", lambda *_: boundary)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(odd.frame(spark, docs)).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(docs).items()}


def test_a_shingle_that_all_texts_share_is_found_and_put_last(spark, monkeypatch):
    """No task counts it twice at first; nevertheless the second round doesn't pair all texts with each other."""
    monkeypatch.setattr(jaccard, "COUNTED", 1)
    monkeypatch.setattr(jaccard, "CROWD", 20)
    made = []
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *rest, f=jaccard._possible: made.append(pairs.count()) or f(pairs, *rest))
    rng = np.random.default_rng(3)
    docs = {i: " ".join(["we all share", *(f"w{k}" for k in rng.integers(0, 10**6, 30))]) for i in range(400)}
    docs |= {1000 + i: docs[i] + " end" for i in range(0, 100, 10)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd.frame(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)
    assert sum(made) < 3 * len(docs)


def test_the_order_of_shingles():
    order = jaccard.Order(np.array([5, 6, 7], np.uint64), np.array([10, 30, 20]))
    tokens = np.array([1, 5, 6, 7, 9], np.uint64)
    back = dict(zip(words.mixed(tokens).tolist(), tokens.tolist(), strict=True))
    assert [back[x] for x in order.sorted(tokens).tolist()][2:] == [5, 7, 6]
    more = order.with_more(np.array([6, 9], np.uint64), np.array([99, 15]))
    assert [back[x] for x in more.sorted(tokens).tolist()][1:] == [5, 9, 7, 6]


def test_jaccard_keeps_one_of_each_group(spark):
    docs = odd.documents(5)
    df = odd.clashing(odd.frame(spark, docs))
    extra = df.filter("text is not null").limit(3)
    null = df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    out = jaccard.deduplicated(df.unionByName(extra).unionByName(null).unionByName(null))
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(d for d, (_, c) in brute.near_duplicates(docs).items() if c == d) and ids.count(None) == 2


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1050)] + [(5000, i) for i in range(4000, 4100)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute.union({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed, window, group, heavy", [(0, 20, 20_000, 500), (1, 20, 3, 500), (2, 6, 5, 500), (3, 20, 20_000, 4)])
def test_substrings_are_brute_force(spark, monkeypatch, seed, window, group, heavy):
    docs = odd.documents(seed)
    monkeypatch.setattr(substrings, "HEAVY_PLACES", heavy)
    out = substrings.removed(odd.frame(spark, docs), window, group=group)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()} == brute.cut_repeats(docs, window)


def test_equal_hashes_of_different_words_remove_nothing(spark):
    """All pieces are said to have one anchor; words alone decide."""
    piece = lambda t: " ".join([*t.split(), ""]).encode()
    rows = [(7, False, 5, 3, 2, piece("a b c d e")), (7, False, 4, 0, 2, piece("x b c d e")), (7, False, 9, 8, 1, piece("a b c dd")), (7, False, 1, 1, 1, piece("ab c d e"))]
    pieces = spark.createDataFrame(rows, "anchor long, large boolean, doc_id long, start int, suffixes short, piece binary")
    assert [tuple(r) for r in substrings._subtrees(pieces, 4).collect()] == [(5, 4, 1)]
    assert [tuple(r) for r in substrings._single_nodes(pieces.withColumn("large", F.lit(True)), 4).collect()] == [(5, 4, 1)]


def test_hashes_of_word_runs():
    texts = ["a b", None, "", "b a b a b", "ab a"]
    w = words.Words([t and t.encode() for t in texts])
    assert w.counts.tolist() == [2, 0, 0, 5, 2] and w.left().tolist() == [2, 1, 5, 4, 3, 2, 1, 2, 1]
    runs = [tuple(" ".join(t for t in texts if t).split()[i : i + 2]) for i in range(8)]
    assert len(set(w.hashes(2).tolist())) == len(set(runs)) == len(set(zip(w.hashes(2).tolist(), runs, strict=True)))
    data, begin = w.cut(np.array([3, 7]), np.array([3, 1]))
    assert [data[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [b"a b a ", b"ab "]


def test_substring_stage_keeps_other_columns_and_odd_rows(spark):
    docs = {1: "  ".join(map(str, range(30))), 2: "x " + " ".join(map(str, range(25))), 3: None}
    df = odd.clashing(odd.frame(spark, docs))
    twice = df.filter("doc_id = 1")
    null = twice.withColumn("doc_id", F.lit(None).cast("long"))
    out = substrings.deduplicated(df.unionByName(twice).unionByName(null))
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str) == sorted([(1, docs[1], len(docs[1]))] * 2 + [(2, "x", 1), (3, None, None), (None, docs[1], len(docs[1]))], key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_contamination_is_brute_force(spark, monkeypatch, seed):
    docs = odd.documents(seed)
    long = [t for t in docs.values() if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[5 + k : 25 + k])) for k, t in enumerate(long[:12])] + [(90, "one two"), (91, ""), (92, None), (93, long[3]), (94, "ALRA! alra"), (93, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    for words_of_block in (1 << 20, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words_of_block)
        assert len(decontaminate.test_blocks(bench, 13)) == 1 or words_of_block == 20
        out = decontaminate.matches(odd.clashing(odd.frame(spark, docs)), bench).collect()
        for r in out:
            assert (r["n_words"], r["n_hit"], r["items"]) == brute.contamination(docs[r["doc_id"]], items), r["doc_id"]
            text = brute.ALNUM.findall((docs[r["doc_id"]] or "").translate(brute.LOWER))
            for m in r["matches"]:
                item = [brute.ALNUM.findall((t or "").translate(brute.LOWER)) for k, t in items if str(k) == m["item_id"]]
                assert text[m["doc_start"] : m["doc_start"] + m["length"]] in [i[m["item_start"] : m["item_start"] + m["length"]] for i in item]


def test_short_items_do_not_widen_the_choice_of_suffixes():
    block = decontaminate.TestBlock(["a", "b"], [b"rare", " ".join(f"w{i}" for i in range(30)).encode()], 13)
    get = block.vocabulary.get
    shard = np.array([get(w.encode(), 0) for w in ["w1", "w2", "w3", "w9", "rare", "w5", "x", "w6", "w7"]], np.uint32)
    assert block.chosen(shard).tolist() == [0, 4]


def test_longest_match_and_threshold(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = {1: f"a b {' '.join(f'w{i}' for i in range(3, 30))} c", 2: " ".join(["z"] * 247) + " " + " ".join(f"w{i}" for i in range(13)), 3: " ".join(["z"] * 248) + " " + " ".join(f"w{i}" for i in range(13))}
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    out = {r["doc_id"]: r for r in decontaminate.matches(odd.frame(spark, docs), bench).collect()}
    assert [m.asDict() for m in out[1]["matches"]] == [{"item_id": "q", "doc_start": 2, "item_start": 3, "length": 27}]
    df = odd.clashing(odd.frame(spark, docs))
    left = decontaminate.decontaminated(df, bench)
    assert [r["doc_id"] for r in left.collect()] == [3] and left.columns == df.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], odd.SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.near_duplicates(none).count() == jaccard.deduplicated(none).count() == substrings.removed(none).count() == decontaminate.matches(none, bench).count() == 0
    some = odd.frame(spark, {1: "a b", 2: None})
    assert {r["n_hit"] for r in decontaminate.matches(some, bench).collect()} == {0}
    assert jaccard.near_duplicates(odd.frame(spark, {1: None, 2: ""})).count() == 2


def test_word_rules():
    text = "Ab c\td\x0be f 9x-y\x7fz_"
    assert [w.decode() for w in text.encode().translate(words.LOWER).split()] == brute.BLANK.findall(text.translate(brute.LOWER))
    assert [w.decode() for w in text.encode().translate(words.ALNUM).split()] == brute.ALNUM.findall(text.translate(brute.LOWER))


def test_queries_have_names_of_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_long_words_of_two_letters_are_told_apart(spark):
    """Words in the Thue-Morse order and their complements, which sums of powers can't tell apart."""
    def word(n, flip):
        return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))

    for n in (64, 256, 1024, 4096):
        texts = [word(n, flip).encode() for flip in (0, 1)]
        values = words.Words(texts).values()
        assert len(set(values.tolist())) == 2
        assert words.Words([b" ".join([t] * 3) for t in texts]).hashes(3)[0] != words.Words([b" ".join([texts[1]] * 3)]).hashes(3)[0]
    docs = {1: word(1024, 0), 2: word(1024, 1), 3: word(1024, 0)}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(odd.frame(spark, docs)).collect()} == {1: 1, 2: 2, 3: 1}
