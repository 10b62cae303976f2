import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlane.llm import bpe, chat, common, files, tokens, warc
from fleetlane.llm.queries import vocabulary

from . import odd


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


CODECS = {e: bpe.ForcedBoundaryCodec(vocabulary(), e) for e in ("tokenizers", "tiktoken")}
PARTS = st.sampled_from([" ", "  ", "\n", "\t", " ", "　", "'s", "'ll ", "<|endoftext|>", "é", "é", "漢字", "🙂", "Ünï", "x1y2", "...", "3.14", "\x85", "​", "The", " the"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=6)), max_size=12))
def test_ids_are_those_of_the_library(library, parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    want = library.encode(text, add_special_tokens=False).ids
    for codec in CODECS.values():
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == want
        assert codec.decode(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


def test_odd_documents_round_trip(spark, library):
    docs = odd.documents(1)
    df = odd.clashing(odd.frame(spark, docs))
    out = bpe.transcode(df, vocabulary())
    for r in out.select("doc_id", "text", "ids", "n_tokens", "decoded").collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == (r["text"] or "")
    apart = bpe.decode(bpe.encode(df, vocabulary()), vocabulary())
    assert apart.select("doc_id", "ids", "decoded").exceptAll(out.select("doc_id", "ids", "decoded")).isEmpty()
    assert bpe.transcode(df.limit(0), vocabulary()).count() == 0


def test_a_small_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    codec = bpe.ForcedBoundaryCodec(vocabulary(), "tiktoken")
    for text in [t or "" for t in odd.texts(2)]:
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


SOLID = st.sampled_from(["漢", "字", "の", "ー", "ラ", "я", "ж", "é", "x", "Q", "7", "½", "'", "'s", "'re", "!", "¡", "\u0301", "\u2009", "\u3000", "\n", "\r\n", " ", "🙂", "\x1c", "\x85", "<|endoftext|>", "ש", "ا", "क", "ि"])


@settings(max_examples=300, deadline=None)
@given(st.lists(SOLID, min_size=30, max_size=200))
def test_long_fragments_are_cut_and_equal(library, parts):
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    for codec in CODECS.values():
        for some in (text, "a " + text, text + " " + text):
            assert np.frombuffer(codec.encode([some])[0], "<u4").tolist() == library.encode(some, add_special_tokens=False).ids
        assert codec.decode(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


def test_a_text_without_spaces_is_cut(library):
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9000, 20_000)))
    codec = bpe.ForcedBoundaryCodec(vocabulary())
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    sizes = np.diff(codec.ends[: codec.n_kept + 1])
    assert codec.n_kept > 1000 and sizes.max() < 400 and codec.encode([""]) == [b""] and codec.encode([]) == []


def test_other_pre_tokenizers_get_whole_texts(tmp_path):
    import json

    with open(vocabulary(), encoding="utf-8") as f:
        model = json.load(f)
    model["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    (tmp_path / "t.json").write_text(json.dumps(model), encoding="utf-8")
    plain = Tokenizer.from_file(str(tmp_path / "t.json"))
    codec = bpe.ForcedBoundaryCodec(str(tmp_path / "t.json"))
    for text in ("some words here", "", "xyz " * 40):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.booleans())
def test_planes_round_trip(ids, bits):
    x = np.array(ids, "<u4")
    assert tokens.from_planes(tokens.to_planes(x, bits), len(x), bits).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_files_round_trip(bits, block):
    rng = np.random.default_rng(3)
    docs = [(None, b""), (None, b"\1\0\0\0"), *((int(i), rng.integers(0, 60_000, rng.integers(0, 40)).astype("<u4").tobytes()) for i in range(-3, 30))]
    sink = io.BytesIO()
    writer = tokens.PlaneWriter(sink, block, bits, 3)
    for d in docs:
        writer.add(*d)
    assert writer.close() == {"n_docs": len(docs), "n_ids": sum(len(x) for _, x in docs) // 4}
    assert [(d, x.tobytes()) for d, _, x in tokens.read_documents(sink, len(sink.getvalue()))] == docs


def test_token_files(spark, library):
    docs = odd.documents(3)
    df = odd.frame(spark, docs)
    df = df.unionByName(df.limit(2)).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((r.asDict() for r in tokens.written_and_read(df, vocabulary()).collect()), key=lambda r: r["start"])
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert g == {"doc_id": r["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)
    assert tokens.written_and_read(df.limit(0), vocabulary()).count() == 0


def test_warc(spark):
    long = "<p>ä" + "x" * 1200
    rows = [(1, "http://a", long), (2, "http://b b", long), (9, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long + "y"), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (None, "u", long), (None, "u", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in warc.written_and_read(df).collect()), key=str)
    def row(i, html, kind, to=None):
        raw = (html or "").encode()
        return (i, len(raw), hashlib.sha1(raw).hexdigest(), kind, to)
    want = [row(1, long, "revisit", 9), row(2, long, "revisit", 9), row(9, long, "response"), row(None, long, "revisit", 9), row(3, "short", "response"), row(4, "short", "response"), row(5, "", "response"), row(6, "", "response"), row(7, long + "y", "response"), row(8, "x" * 1000, "response"), row(8, "x" * 1000, "revisit", 8), row(None, "z" * 2000, "response")]
    assert got == sorted(want, key=str)
    assert warc.written_and_read(df.limit(0)).count() == 0


def files_in(out):
    fs, root = common.open_fs(out)
    found = fs.get_file_info(common.pafs.FileSelector(root))
    return {i.base_name: fs.open_input_file(i.path).read() for i in found if i.type == common.pafs.FileType.File}


def test_warc_files_are_deterministic_and_roll(spark):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))

    def made(n):
        out = common.shared_dir(spark, "warc-test")
        listed = warc.write_warc(df.repartition(n), out, roll_bytes=2000, shard_bytes=1000).collect()
        files = files_in(out)
        assert {f["name"]: (f["bytes"], f["digest"]) for f in listed} == {n: (len(x), hashlib.sha1(x).hexdigest()) for n, x in files.items()}
        assert all(f["bytes"] < 3000 for f in listed) and sum(f["records"] for f in listed) == 40 and len(files) > 3
        return files

    assert made(1) == made(5)


def test_warc_shards_of_many_rows_follow_from_the_rows(spark):
    """60,000 rows, a third with one id, the others bunched; twice, in other partitions and orders."""
    n = F.col("id")
    page_id = F.when(n % 3 == 0, 7).when(n % 3 == 1, n).otherwise(10**12 + n * n)
    df = spark.range(60_000).select(page_id.alias("page_id"), F.concat(F.lit("u"), n % 5).alias("url"), F.when(n % 100 == 0, F.repeat(F.lit("copy "), 300)).otherwise(F.sha2(n.cast("string"), 256)).alias("html"))

    def made(rows):
        out = common.shared_dir(spark, "warc-test")
        sizes = [r["bytes"] for r in warc.write_warc(rows, out, shard_bytes=100_000).collect()]
        return files_in(out), sizes, warc.read_warc(spark, out)

    (one, sizes, rows), (two, _, _) = made(df), made(df.repartition(11).orderBy(F.desc("url"), F.rand(3)))
    assert one == two and len(one) > 20 and max(sizes) < 0.2 * sum(sizes)
    ids = [h["X-Page-ID"] for _, x in sorted(one.items()) for h, _ in warc.read_records(io.BytesIO(x))]
    assert list(map(int, ids)) == sorted(map(int, ids)) and rows.count() == 60_000
    assert rows.filter("record_type = 'revisit'").count() == 600 - 1


def test_files_that_were_renamed_before_are_committed(spark):
    """As after the loss of an executor that had renamed some files."""
    out = common.shared_dir(spark, "files-test")
    fs, root = common.open_fs(out)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    for name in ("_temporary/x", "b"):
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(b"1")
    written = spark.createDataFrame([("_temporary/x", "a"), ("_temporary/y", "b")], "file string, name string")
    assert sorted(r["name"] for r in files.committed(written, out).collect()) == ["a", "b"] and set(files_in(out)) == {"a", "b"}


def test_token_files_roll(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id"))).alias("text")).withColumns({c: F.lit("clash") for c in ("d", "t", "file", "name", "start", "part")})
    out = common.shared_dir(spark, "token-test")
    made = tokens.write_token_files(df.repartition(5), vocabulary(), out, file_ids=500, block=64).collect()
    assert len(made) > 20 and sum(r["n_docs"] for r in made) == 200
    got = sorted(tokens.read_token_files(spark, out, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == list(range(200))
    assert [r["start"] for r in got] == [0, *np.cumsum([len(r["ids"]) // 4 for r in got])[:-1]]


def test_chat(spark):
    rows = [(1, 0, "system", "s\n<|end|>"), (1, 1, "user", None), (1, 2, "assistant", "a\\b</s>"), (1, 3, "assistant", ""), (1, 4, "user", "tail"), (2, 0, "user", "only"), (3, 0, None, "<|turn|>x"), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (None, 0, "user", "n"), (None, None, "assistant", "<|text|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    examples = chat.expand(df)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for e in examples.collect():
        assert e["trainable"] == (e["loss_end"] >= e["loss_start"] and e["text"].endswith("<|end|>") and chat.parse(e["text"])[-1][0] == "assistant") or not e["trainable"]
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "turn", "end", "/s>"]), st.text(max_size=3)), max_size=8).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def test_usual_words_are_cut_inside_and_encoded_one_by_one(monkeypatch, library):
    """Every certain pair cuts, in short words too; no fragment that is encoded holds one."""
    import public_tokenizers

    codec = bpe.ForcedBoundaryCodec(public_tokenizers.path("byte_bpe_50k.json"), "tiktoken")
    words = ["qzéж", "abÿc", "naïveжx", "don'tж", "x ж", "plain", "ж'rž", "日本語テキスト", "ab😀cd", "<|endoftext|>ж"]
    seen = []
    real = codec.ranked.encode_ordinary

    class Spy:
        def encode_ordinary(self, text):
            seen.append(text)
            return real(text)

    codec.ranked = Spy()
    texts = [" ".join(words), " ".join(reversed(words)), "жq " * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    inside = codec._cut_inside(words)
    assert len(inside) > 4 and all("".join(parts) == w and len(parts) > 1 for w, parts in inside.items()) and "plain" not in inside
    for fragment in seen:
        b = fragment.encode()
        for i in range(2, len(b)):
            if b[i] & 0xC0 != 0x80 and not codec.joined[b[i - 1], b[i]]:
                left, right = b[:i].decode()[-1], b[i:].decode()[0]
                assert any(c.isspace() or c == "'" for c in (left, right)), fragment


def test_a_word_is_looked_up_once_a_batch():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    codec = bpe.ForcedBoundaryCodec(vocabulary())
    codec.after_space = Counted()
    texts = ["one two one two", "two  one", None, "", " one"] * 50
    assert codec.encode(texts) == bpe.ForcedBoundaryCodec(vocabulary()).encode(texts) and 0 < Counted.asked < 10
