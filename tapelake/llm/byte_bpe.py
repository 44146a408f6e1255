"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte is one character of the model (U+0100 plus the byte), a piece's score is its negative rank and the
normaliser is the identity, so that the model merges exactly the pair of lowest rank. Texts are cut into pre-tokens
by a pattern, each is encoded on its own, and decoding maps ids back to the bytes of their pieces.

A column that has the name of a new one is replaced. A pre-token that is itself a piece is that piece, as in the public rank-file tokenizers. NULL counts as the empty
text; the empty text has no ids. Rows are independent: repeated rows give repeated results, extra columns pass through.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.llm.common import bound_batches, fresh, giving_back, numbered

SHIFT = {b: 0x100 + b for b in range(256)}
KEEP = 150_000  # pre-tokens that a worker remembers
CHUNK = 16 << 20  # bytes of results in one Arrow batch, a single longer text aside


def read_ranks(path: str) -> list[bytes]:
    """Pieces in order of rank from a rank file (base64 piece, blank, rank)."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, filter(bytes.strip, lines)))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [piece for _, piece in ranked]


def _field(number: int, value: int | bytes) -> bytes:
    """One field of a protocol buffer: a varint or a length-delimited value."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def mapped(piece: bytes) -> str:
    return piece.decode("latin-1").translate(SHIFT)


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose ids are the ranks; one id more stands for the unknown."""
    out = []
    for rank, piece in enumerate(pieces):
        score = _varint_free_float(2, -float(rank))
        out.append(_field(1, _field(1, mapped(piece).encode()) + score + _field(3, 1)))
    unknown = len(pieces)
    out.append(_field(1, _field(1, b"<unk>") + _varint_free_float(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown)  # model type BPE, size, id of the unknown
    # no bos, eos or pad: an id of -1 is a varint of 64 bits
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, plain)


def _varint_free_float(number: int, value: float) -> bytes:
    return bytes([number << 3 | 5]) + struct.pack("<f", value)


class Encoder(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit integers, remembered up to a bound."""

    def __init__(self, model: bytes, pattern: str):
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern)
        self.whole = {self.model.id_to_piece(i): i for i in range(self.model.get_piece_size() - 1)}

    def __missing__(self, token: str) -> bytes:
        if len(self) >= KEEP:
            self.clear()
        text = mapped(token.encode())
        one = self.whole.get(text)
        ids = self.model.encode(text, out_type=int) if one is None else [one]
        value = np.array(ids, "<u4").tobytes()
        if len(token) <= 64:  # long ones seldom come again
            self[token] = value
        return value

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut.findall(text)))


@functools.lru_cache(maxsize=2)
def _encoder(model: bytes, pattern: str) -> Encoder:
    return Encoder(model, pattern)


def _chunks(batch: pa.RecordBatch, column: int, make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batch with the binary columns more that `make` gives a tuple of, cut where the new values pass CHUNK bytes."""
    values, start, size = [], 0, 0
    source = batch.column(column)

    def cut(end: int) -> pa.RecordBatch:
        part = batch.slice(start, end - start)
        return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(column, pa.binary()) for column in zip(*values))], schema=schema)

    for at, value in enumerate(source):
        values.append(make(value.as_py()))
        size += sum(map(len, values[-1]))
        if size >= CHUNK:
            yield cut(at + 1)
            values, start, size = [], at + 1, 0
    if values:
        yield cut(len(source))


def _mapped(df: DataFrame, column: str, names: list[str], factory, done=lambda: None) -> DataFrame:
    bound_batches(df.sparkSession)
    df = df.drop(*names)
    at = df.columns.index(column)
    out = T.StructType([*df.schema.fields, *(T.StructField(name, T.BinaryType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = factory()
        try:
            for batch in batches:
                schema = pa.schema([*(pa.field(n, f.type) for n, f in zip(out.names, batch.schema)), *(pa.field(name, pa.binary()) for name in names)])
                yield from _chunks(batch, at, make, schema)
        finally:
            done()

    return numbered(df).mapInArrow(giving_back(run), out)


def encode(df: DataFrame, pieces: list[bytes], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`: the text's token ids as little-endian unsigned 32-bit integers."""
    model = model_bytes(pieces)

    def factory():
        encoder = _encoder(model, pattern)
        return lambda value: (encoder.encode(value) if value else b"",)
    return _mapped(df, text, [ids], factory, lambda: _encoder(model, pattern).clear())


def _bytes_of(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(df: DataFrame, pieces: list[bytes], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded`: the bytes of the pieces that `ids` names, in order."""
    return _mapped(df, ids, [decoded], lambda: lambda value: (_bytes_of(value or b"", pieces),))


def round_trip(df: DataFrame, pieces: list[bytes], pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `ids` and what they decode to, in one Python worker a task (`decode` after `encode` takes two)."""
    model = model_bytes(pieces)

    def factory():
        encoder = _encoder(model, pattern)

        def both(value: str | None) -> tuple[bytes, bytes]:
            found = encoder.encode(value) if value else b""
            return found, _bytes_of(found, pieces)
        return both
    return _mapped(df, text, [ids, decoded], factory, lambda: _encoder(model, pattern).clear())


def digests(docs: DataFrame, pieces: list[bytes], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, ids_sha256 and decoded_sha256 after a full round trip."""
    docs = docs.select(key, text)
    ids, decoded = fresh(docs, "ids"), fresh(docs, "decoded")
    return round_trip(docs, pieces, pattern, text, ids, decoded).select(
        key, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
