"""Byte-level BPE encoding and decoding through sentencepiece.

The ranks of a byte-level vocabulary are written as a sentencepiece model: every token is a piece whose characters stand
for its bytes, its score is the negative rank, and the normaliser is the identity. sentencepiece then merges the pair
with the best score first, which is the order of the ranks. Texts are cut by the pattern first and each part is encoded
separately; decoding maps the characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from peakloom.llm.common import whole_text

#: Characters that stand for bytes: one block of letters that no step of sentencepiece treats specially.
FIRST_CHARACTER = 0x100
#: Parts whose ids are kept per task; the store is emptied when full, so memory stays bounded.
KEPT_PARTS = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 token and rank per line."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [token for _, token in tokens]


def _number(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """One field of a protocol buffer message: bytes, or a whole number."""
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def as_characters(data: bytes) -> str:
    return "".join(chr(FIRST_CHARACTER + b) for b in data)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; the unknown piece it must have comes last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(
        _field(1, _field(1, as_characters(t).encode()) + _number(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, normal))
        for rank, t in enumerate(tokens)
    )
    last = _field(1, _field(1, b"<unk>") + _number(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, unknown))
    trainer = _field(2, _field(3, bpe) + _field(4, len(tokens) + 1))
    identity = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return pieces + last + trainer + identity


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: rank for rank, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(sentencepiece_model(tokens))
        self.letters = {b: FIRST_CHARACTER + b for b in range(256)}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def parts(self, text: str) -> list[str]:
        return self.split(text)

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not kept yet: their ids, and the same as decimal numbers."""
        if len(self.known) + len(parts) > KEPT_PARTS:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        long = []
        for p in new:
            rank = self.whole.get(p.encode())
            if rank is None:
                long.append(p)
            else:
                self.known[p] = (rank,), str(rank)
        if long:
            mapped = [p.encode().decode("latin-1").translate(self.letters) for p in long]
            for p, ids in zip(long, self.model.encode(mapped, out_type=int, num_threads=1)):
                self.known[p] = tuple(ids), ",".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        parts = self.split(text)
        self.learn(set(parts))
        return [i for p in parts for i in self.known[p][0]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(df: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    The ids are those of the ranks applied to each match of the pattern; a part that is a token as a whole is that token.
    No special tokens. Null text counts as empty and has no ids. Any text is encoded whole, and decoding the ids gives its
    bytes back. Equal texts get equal results; an empty table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            counts, encoded, decoded, lists = [], [], [], []
            for text in batch.column("text"):
                parts = codec.parts(text.as_py() or "")
                codec.learn(set(parts))
                entries = [codec.known[p] for p in parts]
                ids = [i for part, _ in entries for i in part]
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join([x for _, x in entries]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [df.schema["doc_id"]] + [T.StructField(n, t) for n, t in zip(names[1:], [
        T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())
    ])]
    return df.select("doc_id", whole_text().alias("text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the column ``ids``; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(T.BinaryType())
    def of(ids):  # noqa: ANN001, ANN202
        tokens = shared.value
        return ids.map(lambda x: None if x is None else b"".join(tokens[i] for i in x))

    return df.withColumn("decoded", of("ids"))
