"""BPE encoding and decoding by forced-boundary splitting (operator 5).

A byte pair that occurs inside no vocabulary token can never be merged over. Where the pre-tokenizer, too,
makes no difference between a text and its parts, such a pair is a certain cut: in front of a space that
follows no white space, and between two characters of which neither is white space or an apostrophe (the
pre-tokenizer looks ahead in white space, and an apostrophe may begin a contraction). The text is cut in front
of spaces first, and what is between them at all other certain cuts; each distinct fragment is encoded once, by
itself, and the ids are concatenated. (The slower tokenizers engine cuts words of over LONG characters alone, and
encodes new fragments that end solidly side by side.)
What a worker keeps of them is bounded in bytes. Texts with the vocabulary's special tokens are cut outside of these.
Other pre-tokenizers than the byte-level one, and normalizers, get whole texts as fragments.

Null text is empty: no ids. Null ids decode to an empty text. Repeated rows and ids give equal results.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_worker, slices, strings_of

#: Bytes of encoded fragments that a Python worker keeps, what one takes besides its characters and ids, and from how many
#: characters on a word is put together anew each time, and cut by the tokenizers engine.
CACHE_BYTES, FRAGMENT_BYTES, LONG = 160 << 20, 200, 64
#: Bytes beside which there is never a certain cut: ASCII white space and the apostrophe.
SOFT = np.isin(np.arange(256), [*b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", ord("'")])
#: A word's last character, or nothing.
LAST = itemgetter(slice(-1, None))
#: The contractions that the pre-tokenizer knows.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: The byte-level pre-tokenizer as tokenizer files state it, and the pieces it finds.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """Each id's bytes, special tokens included."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    alphabet = byte_alphabet()
    found = {i: bytes(alphabet[c] for c in token) for token, i in model["model"]["vocab"].items()}
    found |= {x["id"]: x["content"].encode() for x in model.get("added_tokens", [])}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def inner_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 booleans: the byte pairs that occur inside some token."""
    seen = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8)
            seen[b[:-1], b[1:]] = True
    return seen


def ranked(model: dict):
    """A tiktoken encoding of the file's vocabulary, or None if ids do not rise with the merges."""
    import tiktoken

    alphabet, vocab = byte_alphabet(), model["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if made != sorted(made) or len(vocab) != len(merges) + 256 or model["pre_tokenizer"] != BYTE_LEVEL or model.get("normalizer"):
        return None
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _coded(split: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The parts of all texts as places among the distinct ones, these, and how many parts each text has."""
    coded = split.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), pc.list_value_length(split).to_numpy().astype(np.int64)


class ForcedBoundaryCodec:
    """Encodes texts to little-endian unsigned 32-bit ids and back.

    engine "tokenizers" has that library encode every fragment. "tiktoken" has fragments without special
    tokens encoded by tiktoken from the same file's vocabulary, some five times faster; it is taken only
    where ids rise in the order of the merges, so that both libraries merge alike.
    """

    def __init__(self, path: str, engine: str = "tokenizers"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = token_bytes(path)
        self.lengths = np.array([len(x) for x in self.tokens], dtype=np.int64)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        self.ranked = ranked(model) if engine == "tiktoken" else None
        self.joined = inner_pairs(self.tokens)
        self.joined[[ord(x[1]) for x in CONTRACTIONS if x[2:]], [ord(x[2]) for x in CONTRACTIONS if x[2:]]] = True
        self.cuts = model.get("pre_tokenizer") == BYTE_LEVEL and not model.get("normalizer")
        self.blocked_bytes = frozenset(b for b in range(256) if self.joined[b, 0x20] and not bytes([b]).isspace())
        self.blocked: dict[str, bool] = {"": True}
        self._forget()

    def _blocks(self, left: str) -> bool:
        """Whether a space after this text's last character is no certain cut."""
        c = left[-1:]
        if c not in self.blocked:
            self.blocked[c] = c.isspace() or c.encode()[-1] in self.blocked_bytes
        return self.blocked[c]

    def _note_uneven(self, words: set[str]) -> None:
        """Remembers the words after which a space is no certain cut."""
        last = {c for c in set(map(LAST, words)) if self._blocks(c)}
        if last:
            self.uneven.update(w for w in words if w[-1:] in last)

    def _merged(self, parts: list[str]) -> list[str]:
        """parts without the cuts that are not certain."""
        merged, left = [], parts[0]
        for part in parts[1:]:
            if self._blocks(left):
                left = f"{left} {part}"
            else:
                merged.append(left)
                left = part
        return [*merged, left]

    def _each(self, fragments: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(fragments, add_special_tokens=False)]

    def _inner(self, text: str) -> list[str]:
        """A text's parts between its certain cuts, other than those in front of spaces."""
        if any(x in text for x in self.special):
            return [text]
        b = np.frombuffer(text.encode(), np.uint8)
        at = np.flatnonzero((b & 0xC0) != 0x80)  # where characters begin
        solid = np.fromiter((not (c.isspace() or c == "'") for c in text), bool, len(text))
        cut = np.flatnonzero(solid[:-1] & solid[1:] & ~self.joined[b[at[1:] - 1], b[at[1:]]]) + 1
        return [text[s:e] for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(text)).tolist(), strict=True)]

    def _cut_inside(self, words: list[str]) -> dict[str, list[str]]:
        """The fragments of each word that has a certain cut inside; all words are looked at together."""
        text = " ".join(words)
        b = np.frombuffer(text.encode(), np.uint8)
        begins = (b & 0xC0) != 0x80
        at = np.flatnonzero(begins[1:] & ~self.joined[b[:-1], b[1:]] & ~SOFT[b[:-1]] & ~SOFT[b[1:]]) + 1
        if not len(at):
            return {}
        place = np.cumsum(begins)[at] - 1  # of the character behind the cut
        wide = np.flatnonzero((b[at] >= 128) | (b[at - 1] >= 128))  # white space of other kinds
        keep = np.ones(len(at), bool)
        keep[wide] = [not (text[i].isspace() or text[i - 1].isspace()) for i in place[wide].tolist()]
        place = place[keep]
        if not len(place):
            return {}
        first = np.append(0, np.cumsum([len(w) + 1 for w in words]))
        of = np.searchsorted(first, place, side="right") - 1
        cuts = (place - first[of]).tolist()
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out = {}
        for k, lo, hi in zip(of[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(cuts)], strict=True):
            w, own = words[k], cuts[lo:hi]
            out[w] = [w[i:j] for i, j in zip([0, *own], [*own, len(w)], strict=True)]
        special = [x for x in self.special if x in text]
        return {w: parts for w, parts in out.items() if not any(x in w for x in special)} if special else out

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments, one after the other, and how many each has."""
        begin, size = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        to = np.cumsum(size)
        return self.kept[np.repeat(begin - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)], size

    def _put_together(self, cut: dict[str, list[str]]) -> None:
        """Keeps the ids of words whose fragments are known."""
        if not cut:
            return
        numbers: list[int] = []
        for x in cut.values():
            numbers.append(self.after_space[x[0]])
            numbers += map(self.alone.__getitem__, x[1:])
        ids, size = self._gathered(np.array(numbers, np.int64))
        parts = np.fromiter(map(len, cut.values()), np.int64, len(cut))
        self.after_space.update(zip(cut, self._store([ids], np.add.reduceat(size, np.cumsum(parts) - parts), list(cut)), strict=True))

    def _store(self, ids: list[np.ndarray], sizes: np.ndarray, texts: list[str]) -> range:
        """Appends fragments' ids (sizes: how many each has) to the kept ones; returns the fragments' numbers."""
        n, at, more = self.n_kept, int(self.ends[self.n_kept]), int(sizes.sum())
        while len(self.kept) < at + more:
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        while len(self.ends) <= n + len(sizes):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.kept[at : at + more] = np.concatenate(ids) if ids else 0
        self.ends[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.n_kept += len(sizes)
        self.bytes += 4 * more + FRAGMENT_BYTES * len(sizes) + sum(map(len, texts))
        return range(n, self.n_kept)

    def _learn(self, words: set[str], uneven: set[str]) -> None:
        """Encodes the fragments ' ' + word, one by one, or, with the tokenizers engine, those that end solidly as one text that
        is cut at the certain places."""
        odd = words & uneven
        text = " ".join(words)
        for special in self.special:
            if special in text:
                odd |= {w for w in words if special in w}
        joint = list(words - odd)
        if odd:
            each = self._each([" " + w for w in odd])
            self.after_space.update(zip(odd, self._store(each, np.array([len(x) for x in each]), list(odd)), strict=True))
        if joint and self.ranked:
            each = [self.ranked.encode_ordinary(" " + w) for w in joint]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            ids = np.fromiter(chain.from_iterable(each), "<u4", int(sizes.sum()))
            self.after_space.update(zip(joint, self._store([ids], sizes, joint), strict=True))
        elif joint:
            text = " " + " ".join(joint)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(self.lengths[ids])
            spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8)[1:] == 0x20) + 1
            if len(spaces) + 1 == len(joint):  # else some words have spaces of their own
                begins = np.append(spaces, ends[-1])
            else:
                begins = np.cumsum([len(w.encode()) + 1 for w in joint])
            upto = np.searchsorted(ends, begins, side="left") + 1
            self.after_space.update(zip(joint, self._store([ids], np.diff(np.append(0, upto)), joint), strict=True))

    def _learn_alone(self, texts: set[str]) -> None:
        """Encodes fragments that follow no space."""
        todo = list(texts.difference(self.alone))
        plain = self.ranked and not any(x in w for w in todo for x in self.special)
        each = [np.array(self.ranked.encode_ordinary(w), "<u4") for w in todo] if plain else self._each(todo)
        self.alone.update(zip(todo, self._store(each, np.array([len(x) for x in each], np.int64), todo), strict=True))

    def _forget(self) -> None:
        self.after_space: dict[str, int] = {}
        self.alone: dict[str, int] = {}
        self.uneven: set[str] = set()
        self.kept, self.ends, self.n_kept, self.bytes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), 0, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as the tokenizers library gives them without added special tokens."""
        if self.bytes > CACHE_BYTES:
            self._forget()
        if not self.cuts:
            return [x.tobytes() for x in self._each([t or "" for t in texts])]
        split = pc.split_pattern(pa.array([t or "" for t in texts], pa.string()), " ")
        codes, names, words = _coded(split)
        new = set(names).difference(self.after_space)
        self._note_uneven(new)
        if not self.uneven.isdisjoint(names):
            parts = split.to_pylist()
            merged = [x if self.uneven.isdisjoint(x[:-1]) else self._merged(x) for x in parts]
            if any(x is not y for x, y in zip(merged, parts, strict=True)):
                codes, names, words = _coded(pa.array(merged, pa.list_(pa.string())))
                new = set(names).difference(self.after_space)
                self._note_uneven(new)
        begins = np.cumsum(words) - words
        heads = [names[i] for i in codes[begins].tolist()]  # these follow no space
        cut = self._cut_inside([w for w in new if self.ranked or len(w) > LONG])
        after = {x[0] for x in cut.values()}.difference(self.after_space)
        self._note_uneven(after)
        self._learn((new - cut.keys()) | after, self.uneven)
        first = {w: self._inner(w) for w in set(heads)}
        inside = chain.from_iterable(x[1:] for x in cut.values())
        self._learn_alone(set(chain(chain.from_iterable(first.values()), inside)))
        self._put_together({w: x for w, x in cut.items() if len(w) <= LONG})
        numbers = np.fromiter(map(self.after_space.get, names, repeat(-1)), np.int64, len(names))[codes]
        whole = {w: self.alone[x[0]] for w, x in first.items() if len(x) == 1}
        numbers[begins] = [whole.get(w, -1) for w in heads]
        todo = np.flatnonzero(numbers < 0)  # heads and long words of several fragments
        if len(todo):
            at_head = set(begins.tolist())
            of = [names[k] for k in codes[todo].tolist()]
            several = [[self.alone[x] for x in first[w]] if i in at_head else [self.after_space[cut[w][0]], *(self.alone[x] for x in cut[w][1:])] for i, w in zip(todo.tolist(), of, strict=True)]
            times = np.ones(len(codes), np.int64)
            times[todo] = [len(x) for x in several]
            numbers = np.repeat(numbers, times)
            numbers[numbers < 0] = list(chain.from_iterable(several))
            words = np.add.reduceat(times, begins)
        ids, size = self._gathered(numbers)
        edges = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(words))].tolist()
        return [ids[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: bytes | None) -> str:
        """The text of ids, special tokens kept; broken UTF-8 becomes U+FFFD, unknown ids nothing."""
        top, table = len(self.tokens), self.tokens
        x = np.frombuffer(ids or b"", dtype="<u4")
        if len(x) and x.max() >= top:
            x = x[x < top]
        return b"".join(map(table.__getitem__, x.tolist())).decode("utf-8", "replace")


def codec_of(path: str, engine: str = "tokenizers") -> ForcedBoundaryCodec:
    """The Python worker's codec; its tasks share what it has encoded."""
    return per_worker(("codec", path, engine), lambda: ForcedBoundaryCodec(path, engine))


def _mapped(df: DataFrame, sized_by: str, added: list[tuple[str, T.DataType]], make, names: set[str]) -> DataFrame:
    """df without the columns `names` and with the columns that make() returns for a batch."""
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, sized_by):
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(cols + work(batch), names=[f.name for f in kept] + [n for n, _ in added])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", engine: str = "tiktoken") -> DataFrame:
    """df with ids (binary, little-endian unsigned 32-bit) and n_tokens (long). Columns of these names are replaced."""

    def make():
        codec = codec_of(path, engine)

        def work(batch):
            ids = codec.encode(strings_of(batch, text_col))
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

        return work

    return _mapped(df, text_col, [("ids", T.BinaryType()), ("n_tokens", T.LongType())], make, {"ids", "n_tokens"})


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded (string), the text of its ids. A column of that name is replaced."""

    def make():
        codec = codec_of(path)
        return lambda batch: [pa.array([codec.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()], pa.string())]

    return _mapped(df, ids_col, [("decoded", T.StringType())], make, {"decoded"})


def transcode(df: DataFrame, path: str, text_col: str = "text", engine: str = "tiktoken") -> DataFrame:
    """encode() and decode() in one pass: df with ids, n_tokens and decoded, which replace columns of these names."""

    def make():
        codec = codec_of(path, engine)

        def work(batch):
            ids = codec.encode(strings_of(batch, text_col))
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([codec.decode(x) for x in ids], pa.string())]

        return work

    added = [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.StringType())]
    return _mapped(df, text_col, added, make, {n for n, _ in added})


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document's ids and of the text decoded from them."""
    out = transcode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
