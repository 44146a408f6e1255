"""What the corpus operators share: word splitting, hashed words, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII letters lower-cased, digits and every byte of a non-ASCII character kept, all else a gap.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
# The same gaps for Java's regular expressions, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_column(text: Column) -> Column:
    """Words as an array column; NULL has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAPS), "")


def words_of(text: bytes) -> list[bytes]:
    """The words of `words_column`, inside a task."""
    return text.translate(WORD_BYTES).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    KEEP = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEEP:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()  # one per worker process


PIECE = 1 << 18  # bytes of text hashed at once
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """HASHES.of(words_of(text)) for each of `texts(column)`, many texts at once and without an object for each word."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body, first = memoryview(column.buffers()[2] or b""), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        cuts = ends[first:last + 1]
        hashes, starts = _hashed(bytes(body[cuts[0]:cuts[-1]]).translate(WORD_BYTES), cuts - cuts[0])
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield hashes[start:end]
        first = last


def _hashed(data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the words of texts that lie one behind the other, gaps as blanks, and each text's first place there."""
    inside = np.frombuffer(data, np.uint8) != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inner], ends[inner - 1] = inside[inner], inside[inner - 1]
    at, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    starts = np.searchsorted(at, cuts)
    padded = data + bytes(8)
    eight, four = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    out = (end - at).astype(np.uint64) + P5
    long = np.flatnonzero(end - at >= 32)
    whole = [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(at[long].tolist(), end[long].tolist())]
    at[long] = end[long]
    some = np.flatnonzero(end - at >= 8)
    while len(some):
        out[some] = _turned(out[some] ^ _turned(eight[at[some]] * P2, 31) * P1, 27) * P1 + P4
        at[some] += 8
        some = some[end[some] - at[some] >= 8]
    some = np.flatnonzero(end - at >= 4)
    out[some] = _turned(out[some] ^ four[at[some]].astype(np.uint64) * P1, 23) * P2 + P3
    at[some] += 4
    some = np.flatnonzero(end > at)
    while len(some):
        out[some] = _turned(out[some] ^ eight[at[some]].astype(np.uint8) * P5, 11) * P1
        at[some] += 1
        some = some[end[some] > at[some]]
    out = (out ^ out >> np.uint64(33)) * P2
    out = (out ^ out >> np.uint64(29)) * P3
    out ^= out >> np.uint64(32)
    out[long] = whole
    return out, starts


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; when a task ends, its worker, which Spark keeps for later ones, remembers no words and holds no unused Arrow memory."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()
    return task


def _give_back() -> None:  # of its own: a nested function reaches the tasks with a copy of HASHES
    HASHES.clear()
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k consecutive words; fewer words make one shingle, none make none."""
    n = len(hashes)
    k = min(k, n)
    if not k:
        return hashes
    out, factor = np.full(n - k + 1, k, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out *= factor
        out += hashes[i:n - k + 1 + i]
        out = mixed(out)
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 of each value, NULL as nothing, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) \
        else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def packed(values: np.ndarray) -> pa.BinaryArray:
    """Numbers from 0 on as one binary value: the bytes of each, as few as the largest needs, and their number. Spark handles it as one
    piece, an array number by number."""
    top = int(values.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    return pa.array([values.astype(f"<u{size}").tobytes() + bytes([size])], pa.binary())


def unpacked(value: pa.BinaryScalar, kind) -> np.ndarray:
    body = value.as_buffer()
    size = memoryview(body)[-1]
    return np.frombuffer(body, f"<u{size}", (body.size - 1) // size).astype(kind)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The table's columns by their exact names, dots included."""
    return [F.col(quoted(c)) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """The table under the names c0, c1, ...: PySpark's Arrow functions look names up, and a dot in one would mislead them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A written table, broadcast in the next join if it has at most `rows` rows; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most `size` (a longer row aside) in the tables written here: memory stays bounded by bytes, not
    by rows, where rows carry whole texts."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """The same for tables that the caller writes later: the session's bound is lowered to `size` and stays so, as a plan reads it
    when it runs."""
    text = (spark.conf.get(BATCH_BYTES, None) or "").lower().removesuffix("b")
    if text:
        now = int(text[:-1]) << {"k": 10, "m": 20, "g": 30}[text[-1]] if text[-1].isalpha() else int(text)
        if now <= 0 or now > size:
            spark.conf.set(BATCH_BYTES, str(size))
