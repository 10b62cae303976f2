r"""Chat formatting by prefix-target expansion (operator 7).

Every assistant turn becomes an example of its own: all turns before it as context, then that reply,
and only the reply's text is trainable. Turns after the last reply (or a conversation without a reply)
make one more example without a trainable part, so that the output holds every turn.

A turn is written <|turn|>role<|text|>text<|end|>. Inside roles and texts a backslash is doubled, and one
is put behind the first character of every control string, this template's and those of other common
templates, so that no control string survives in a text; unescape() takes them out again.

Null role and text are empty. Turns of a conversation stand in the order of (turn, role, text), nulls
first; repeated rows are turns of their own. Rows with a null conv_id are one conversation. Columns
besides conv_id, turn, role and text are not read. No rows give no examples. A conversation's rows are
streamed in order; a task holds one conversation's formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, slices, stored, strings_of, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates ("<|" begins all of one family).
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
#: A backslash, or the first character of a control string (also of one that overlaps the one before).
_FIND = re.compile(rf"\\|(?=(?:{'|'.join(map(re.escape, CONTROL))})).", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)
EXAMPLE = "conv_id long, example int, n_turns int, trainable boolean, text string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    turns = []
    for block in text.split(END)[:-1]:
        role, _, body = block.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(body)))
    return turns


def _batched(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], sized) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += sized(row)
        if len(held) >= BATCH_ROWS or total > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (0, 1, ...), n_turns (in this example), trainable, text, loss_start and
    loss_end (code points of text; equal where nothing is trainable)."""
    fields = [("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("trainable", pa.bool_()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())]

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, prefix, n, k, open_turns = object(), "", 0, 0, False
        for batch in slices(batches, "text"):
            for c, role, text in zip(*(strings_of(batch, x) for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    if open_turns:
                        yield conv, k, n, False, prefix, len(prefix), len(prefix)
                    conv, prefix, n, k, open_turns = c, "", 0, 0, False
                head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
                start = len(prefix) + len(head)
                prefix, n = f"{prefix}{head}{body}{END}", n + 1
                open_turns = role != "assistant"
                if not open_turns:
                    yield conv, k, n, True, prefix, start, start + len(body)
                    k += 1
        if open_turns:
            yield conv, k, n, False, prefix, len(prefix), len(prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(examples(batches), fields, lambda row: len(row[4]))

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLE)


def read_back(examples: DataFrame) -> DataFrame:
    """Each conversation's digests, from the examples alone."""
    fields = [("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches, "text"):
                for conv, k, text, start, end in zip(*(strings_of(batch, x) for x in ("conv_id", "example", "text", "loss_start", "loss_end")), strict=True):
                    turns = parse(text)
                    whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                    yield conv, k, len(turns), hashlib.sha256(whole.encode()).hexdigest(), unescape(text[start:end]), len(text)

        return _batched(rows(), fields, lambda row: len(row[4]))

    read = examples.mapInArrow(run, "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long")
    last = F.max(F.struct("example", "n_turns", "turns_sha256")).alias("last")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    out = read.groupBy("conv_id").agg(last, loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", F.col("last.n_turns").alias("n_turns"), F.col("last.turns_sha256").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def formatted_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(stored(expand(rows), "chat-examples"))
