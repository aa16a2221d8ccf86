"""Chat formatting by columnar byte assembly, and reading the format back.

A turn becomes  <|im_start|>ROLE \\n TEXT <|im_end|> \\n  (without the spaces). Inside roles and texts a backslash is put
into every "<", backslashes, "|" sequence, so no control string is left in them and one backslash less gives the
text back; a line break in a role becomes <|nl|>. Of a batch of turns, segment lengths are summed to offsets and
headers, roles, texts and ends are copied by computed indices into one preallocated buffer, which becomes the Arrow
column as it is.

Turns of a conversation are ordered by turn, then role, then text; rows are streamed in that order, never gathered,
so a conversation of any length needs the memory of one slice of some 512 KB, or of its longest text.

Defined cases: null texts and roles are empty; null turns come first; rows whose conversation id is null are one
conversation; repeated rows are turns of their own; roles other than assistant carry no loss; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm import grams
from quire.llm.common import small_batches

BEGIN, END, BREAK = b"<|im_start|>", b"<|im_end|>\n", "<|nl|>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\1\\|")


def unescape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\\\|", r"<\1|")


def assemble(parts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the parts of each row one after another, and its rows + 1 offsets. A part: bytes and rows + 1 offsets."""
    sizes = np.stack([np.diff(o) for _, o in parts])
    ends = np.cumsum(sizes.T.ravel())
    begins = (ends - sizes.T.ravel()).reshape(rows, len(parts)).T
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for (data, offsets), begin, size in zip(parts, begins, sizes, strict=True):
        shift = np.repeat(begin - offsets[:-1], size)
        out[np.arange(offsets[0], offsets[-1]) + shift] = data[offsets[0] : offsets[-1]]
    return out, np.concatenate([[0], ends[len(parts) - 1 :: len(parts)]])


def _constant(value: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(value, np.uint8), rows), np.arange(rows + 1) * len(value)


def _large(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts are some 512 KB, or one text."""
    for b in batches:
        for row, _, offsets in grams.chunks(b.column(column)):
            yield b.slice(row, len(offsets) - 1)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end), in order within a conversation's partition.

    The loss mask is a half-open byte run of formatted's UTF-8, empty for turns without loss.
    """
    small_batches(conversations.sparkSession)
    ordered = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 3):
            n, role, text = b.num_rows, _large(b.column(2)), escape(_large(b.column(3)))
            loss = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
            role = pc.replace_substring(escape(role), "\n", BREAK)
            roles, texts = grams.texts(role), grams.texts(text)
            out, offsets = assemble([_constant(BEGIN, n), roles, _constant(b"\n", n), texts, _constant(END, n)], n)
            column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
            start = len(BEGIN) + np.diff(roles[1]) + 1
            end = np.where(loss, start + np.diff(texts[1]), start)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column.cast(pa.string()), pa.array(start), pa.array(end)], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, loss_start long, loss_end long")


def parse(formatted: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Roles and texts of formatted turns."""
    found = pc.extract_regex(formatted, r"(?s)\A<\|im_start\|>(?P<role>[^\n]*)\n(?P<text>.*)<\|im_end\|>\n\z")
    if found.null_count:
        raise ValueError("not a formatted turn")
    role, text = found.flatten()
    return unescape(pc.replace_substring(role, BREAK, "\n")), unescape(text)


class _Sums:
    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_turns(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, from what format_turns gives, read back: counts and digests of turns and of the text under the loss mask."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, out = None, None, []
        for b in _pieces(batches, 2):
            role, text = parse(_large(b.column(2)))
            chars = pc.utf8_length(b.column(2)).to_pylist()
            raw, offsets = grams.texts(b.column(2))
            masked = [raw[offsets[k] + x : offsets[k] + y].tobytes().decode() for k, (x, y) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))]
            masked = unescape(pa.array(masked, pa.large_string())).to_pylist()
            for conv, r, t, c, m in zip(b.column(0).to_pylist(), role.to_pylist(), text.to_pylist(), chars, masked, strict=True):
                if sums is None or conv != now:
                    if sums is not None:
                        out.append((now, *sums.row()))
                    now, sums = conv, _Sums()
                sums.turns += 1
                sums.chars += c
                sums.loss_chars += len(m)
                sums.all.update(f"{r}\n{t}\n".encode())
                sums.loss.update(m.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(["conv_id", *names], r, strict=True)) for r in out], schema)
                out = []
        if sums is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(["conv_id", *names], (now, *sums.row()), strict=True))], schema)

    result = T._parse_datatype_string(f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    schema = to_arrow_schema(result)
    return formatted.mapInArrow(run, result)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return digest_turns(format_turns(table.unionByName(probe)))
