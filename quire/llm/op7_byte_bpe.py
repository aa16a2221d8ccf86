"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from the vocabulary.

Nothing is trained. Each token of the rank file becomes a piece: its bytes mapped to printable characters, its
score the negated rank; the model's normalisation is identity, without dummy prefix, white-space removal or
escaping. sentencepiece then merges the best-scored adjacent pair first, which is the rank order. The splitting
pattern is applied first and each pre-token encoded alone; a pre-token that is itself in the vocabulary is that
token. Decoding maps ids to pieces and the pieces' characters back to bytes.

Defined cases: a null text is encoded as the empty text (no tokens); texts of any length are encoded whole;
strings that look like special tokens are ordinary text; repeated rows are encoded one by one; an empty table
gives an empty result; other columns pass through unless a result column takes the name.

Memory of a task: the batch, and a table of at most `cache` pre-tokens that is emptied when full.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.llm.common import map_batches, text_only

CACHE = 300_000

#: White space as Unicode defines it; the regex module's own class also holds U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: A pattern and another that makes the same matches, with the frequent alternatives first: no two of the moved ones
#: can begin at the same character.
_FASTER = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def byte_characters() -> str:
    """A printable, non-space character for each byte: Latin-1 where it has one, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, an unsigned integer or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece k is the token of rank k, then the unknown piece."""
    chars = byte_characters()
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [b"".join((_field(1, "".join(chars[b] for b in token).encode()), _field(2, -float(rank)))) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        chars = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        pattern = _FASTER.get(pattern, pattern)
        spaced = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.split = regex.compile(spaced, regex.V0).findall
        self.to_chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.known = {token.decode(): np.uint32(rank).tobytes() for token, rank in ranks.items() if _is_text(token)}
        self.cache, self.limit = dict(self.known), cache + len(self.known)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts, cache = self.split(text), self.cache
        new = [p for p in {*parts} if p not in cache]
        if new:
            if len(cache) + len(new) > self.limit:
                cache = self.cache = dict(self.known)
                new = [p for p in {*parts} if p not in cache]
            mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in new]
            cache.update(zip(new, [array.array("I", x).tobytes() for x in self.model.encode(mapped, num_threads=1)], strict=True))
        return b"".join([cache[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_MADE: dict[tuple, ByteBpe] = {}


def codec(ranks: dict[bytes, int], pattern: str, key: object) -> ByteBpe:
    """One codec for each Python worker and vocabulary."""
    if (key, pattern) not in _MADE:
        _MADE[key, pattern] = ByteBpe(ranks, pattern)
    return _MADE[key, pattern]


def _shared_ranks(spark: SparkSession, path: str):
    """The vocabulary file (bounded: a tokenizer's) travels as a broadcast; executors needn't have it."""
    return spark.sparkContext.broadcast(read_ranks(path)), hashlib.sha256(path.encode()).hexdigest()


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """docs with token_ids, an array of ints, and n_tokens."""
    ranks, key = _shared_ranks(docs.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(ranks.value, pattern, key)
        ids = [own.encode(t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
        return {"n_tokens": sizes.tolist(), "token_ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)}

    return map_batches(docs, run, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, vocabulary: str, pattern: str, *, ids_col: str = "token_ids") -> DataFrame:
    """tokens with decoded, the bytes that the ids stand for. Null ids give null."""
    ranks, key = _shared_ranks(tokens.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(ranks.value, pattern, key)
        column = batch.column(batch.schema.get_field_index(ids_col))
        flat, offsets = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
        return {"decoded": [own.decode(flat[a:b].tobytes()) if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_valid().to_pylist(), strict=True)]}

    return map_batches(tokens, run, T.StructType([T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and the digests of their ids and of the bytes that these decode to, in one pass."""
    ranks, key = _shared_ranks(docs.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(ranks.value, pattern, key)
        ids = [own.encode(t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]}

    return map_batches(docs, run, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = text_only(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


__all__ = ["ByteBpe", "codec", "decode", "encode", "op7_byte_bpe", "read_ranks", "round_trip", "serialise_model"]
