"""Which texts contain which phrases, without comparing every text with every phrase."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.functions.text import has_word
from tapelake.session import written


# A phrase side of up to so many bytes is shipped to every task; a larger one is shuffled, with the same result.
SHIPPED_BYTES = 32 << 20
WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
WORD_ENDS = frozenset(bytes([b]) for b in WORD_BYTES)
IN_WORD = np.isin(np.arange(256), list(WORD_BYTES))
GRAM = 8  # bytes of a phrase that it is looked up by


def bytes_of(*columns: str) -> Column:
    """About the bytes that a row's columns take, nested ones as JSON."""
    return F.octet_length(F.to_json(F.struct(*columns))) + 64


def shipped(df: DataFrame) -> DataFrame:
    """Broadcast a side that is measured to be small, else leave the join to Spark. The side is written first, so measuring
    it does not compute it twice."""
    df = written(df, "phrases")
    total = df.agg(F.sum(bytes_of(*df.columns).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= SHIPPED_BYTES else df


def phrase_hits(
    phrases: DataFrame, texts: DataFrame, phrase_ids: Sequence[str], text_ids: Sequence[str],
    phrase: str, text: str, q: int = 1, on: Sequence[str] = (), edges: bool = False,
) -> DataFrame:
    """(on, phrase_ids, text_ids) for every phrase that is a substring of a text; NULL ``on`` values are equal to none.

    Phrases have ``q`` characters or more. Each is known by one gram of its bytes (GRAM of them, or the whole of a shorter phrase), the one
    fewest phrases share. A task runs over the bytes of a batch of texts at once and asks a bit table whether a place can be such a gram; what
    passes is checked exactly. A phrase set of checked size goes to the tasks whole and hits come out at once; of a larger one only the bit table
    does, and the grams found meet the phrases in a join on their hashes. No row is made for a place that the table rules out. With ``edges``
    only occurrences count that no letter or digit (a-z, 0-9) touches.
    """
    spark = texts.sparkSession
    on, phrase_ids, text_ids = list(on), list(phrase_ids), list(text_ids)
    group = F.xxhash64(*on) if on else F.lit(0).cast("long")
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    own = phrases.where(known & (F.octet_length(phrase) > 0)).select(*on, *phrase_ids, group.alias("__on"), F.col(phrase).alias("__phrase"))
    own = written(own, "phrases")
    size = own.agg(F.sum(bytes_of(*own.columns).cast("long"))).first()[0] or 0
    body = texts.where(known & F.col(text).isNotNull()).select(*on, *text_ids, group.alias("__on"), F.col(text).alias("__text"))
    names = [*on, *phrase_ids]
    if size <= SHIPPED_BYTES:
        out = T.StructType([*[f for f in texts.select(*on).schema], T.StructField("__no", T.LongType()), *texts.select(*text_ids).schema])
        table = own.toArrow()
        index = spark.sparkContext.broadcast(Anchors(table.column("__phrase").to_pylist(), table.column("__on").to_numpy(),
                                                     list(zip(*[table.column(c).to_pylist() for c in on])) if on else None, edges))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, numbers = index.value.hits(batch.column("__text"), batch.column("__on"), [batch.column(c) for c in on])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in on], numbers, *[batch.column(c).take(rows) for c in text_ids]],
                                                 schema=pa.schema([*[batch.schema.field(c) for c in on], pa.field("__no", pa.int64()),
                                                                   *[batch.schema.field(c) for c in text_ids]]))

        found = body.mapInArrow(run, out)
        numbered = spark.createDataFrame(table.select(phrase_ids).append_column("__no", pa.array(range(table.num_rows), pa.int64())),
                                         T.StructType([*own.select(*phrase_ids).schema, T.StructField("__no", T.LongType())]))
        return found.join(F.broadcast(numbered), "__no").select(*names, *text_ids)

    grams = own.withColumn("__id", F.monotonically_increasing_id())
    grams = written(grams, "phrases")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = own_grams(batch.column("__phrase"), batch.column("__on").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(rows), pa.array(hashes.view(np.int64))], ["__id", "__gram"])

    each = grams.select("__id", "__on", "__phrase").mapInArrow(anchors, "__id long, __gram long").distinct()
    shared = each.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    chosen = each.join(shared, "__gram").groupBy("__id").agg(F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"))
    chosen = written(grams.join(chosen, "__id"), "anchors")
    width = min(27, max(16, (16 * chosen.count()).bit_length()))
    word = F.shiftrightunsigned("__gram", 64 - width + 6)
    words = chosen.select(word.alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__gram, {64 - width}) & 63 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (width - 6), np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    lengths = [r[0] for r in chosen.select(F.least(F.octet_length("__phrase"), F.lit(GRAM))).distinct().collect()]
    shipped_bits = spark.sparkContext.broadcast((bits.view(np.uint8), sorted(lengths)))
    out = T.StructType([*texts.select(*on, *text_ids).schema, T.StructField("__gram", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = shipped_bits.value
        for batch in batches:
            parts = [places(batch.column("__text"), batch.column("__on").to_numpy(), n, table) for n in sizes]
            row, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            first = np.append(True, (np.diff(row) > 0) | (found[1:] != found[:-1]))[:len(row)]
            rows = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in [*on, *text_ids]], pa.array(found[first].view(np.int64))],
                                             schema=pa.schema([*[batch.schema.field(c) for c in [*on, *text_ids]], pa.field("__gram", pa.int64())]))

    candidates = body.mapInArrow(scan, out).join(chosen.drop("__on", "__id"), [*on, "__gram"])
    whole = candidates.join(body.drop("__on"), [*on, *text_ids])
    held = has_word(F.col("__text"), F.col("__phrase")) if edges else F.contains("__text", "__phrase")
    return whole.where(held).select(*names, *text_ids)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _hashes(data: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every n neighbouring bytes, or of those that begin at the given places."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(data) - n + 1 if at is None else len(at), n, np.uint64)
    for i in range(n):
        own = data[i:len(data) - n + 1 + i] if at is None else data[at + i]
        out = (out << np.uint64(8)) + own if n <= 7 else out * np.uint64(257) + own
    return out


def _mixed(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    x = (hashes ^ (group * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def places(column: pa.Array, groups: np.ndarray, n: int, table: np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first byte) of every place of n bytes inside one text of the batch that the table of bits (8 a byte, lowest first) lets through; with ``edges``
    only of places that no letter or digit touches, which are found before anything is hashed."""
    data, offsets = _buffer(column)
    groups = groups.view(np.uint64)
    start, rows, found, firsts, shift = 0, [], [], [], np.uint64(64 - (8 * len(table) - 1).bit_length())
    while start < len(offsets) - 1:  # stretches of about 128 KB keep the arrays in the cache
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 17), "right")) - 1)
        part, bounds = data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        if edges:
            free = ~IN_WORD[part]
            begins, ends = np.append(True, free), np.append(free, True)
            begins[bounds], ends[bounds] = True, True
            at = np.flatnonzero(begins[:max(0, len(part) - n + 1)] & ends[n:])
            own = _hashes(part, n, at)
            row = np.searchsorted(bounds, at, "right") - 1 + start
        else:
            own = _hashes(part, n)
            at = np.arange(len(own))
            row = np.repeat(np.arange(start, end), np.diff(bounds))[:len(own)]
        own = _mixed(own, groups[row])
        bit = own >> shift
        seen = np.flatnonzero(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        seen = seen[at[seen] + n <= bounds[row[seen] + 1 - start]]
        rows.append(row[seen])
        found.append(own[seen])
        firsts.append(at[seen] + offsets[start])
        start = end
    none = np.zeros(0, np.int64)
    return np.concatenate([*rows, none]), np.concatenate([*found, none.astype(np.uint64)]), np.concatenate([*firsts, none])


def own_grams(column: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the grams of each phrase: GRAM bytes each, or the whole of a shorter phrase."""
    sizes = np.minimum(np.diff(_buffer(column)[1]), GRAM)
    everything = np.full(1 << 13, 255, np.uint8)
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == n)
        row, found, _ = places(column.take(pa.array(own)), groups[own], n, everything)
        rows.append(own[row])
        hashes.append(found)
    return np.concatenate(rows), np.concatenate(hashes)


class Anchors:
    """A phrase set inside the tasks: for each gram length the anchors' hashes, and the phrases behind each.

    A phrase of GRAM bytes or fewer is its own gram: whether it lies at a place, and between which bytes, is seen for all places at once. A longer
    one is looked for in its text, which is taken out of the batch once for all its candidates. Equal phrases of a group are looked for once.
    """

    def __init__(self, phrases: list[str], groups: np.ndarray, keys: list[tuple] | None, edges: bool):
        known = {}
        label = np.array([known.setdefault(k, len(known)) for k in zip((p.encode() for p in phrases), groups.tolist())], np.int64)
        self.phrases, self.keys, self.edges = [p for p, _ in known], keys, edges
        self.members, self.ends = np.argsort(label, kind="stable"), np.cumsum(np.bincount(label, minlength=len(known)))
        column = pa.array(self.phrases, pa.binary())
        rows, hashes = own_grams(column, np.array([g for _, g in known], np.int64))
        _, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((hashes, counts[where], rows))
        first = np.append(True, np.diff(rows[order]) > 0) if len(order) else np.zeros(0, bool)
        chosen = order[first]
        lengths = np.array([len(p) for p in self.phrases], np.int64)
        sizes = np.minimum(lengths, GRAM)
        self.tables = []
        for n, whole in sorted(set(zip(sizes.tolist(), (lengths <= GRAM).tolist()))):
            own = chosen[(sizes[rows[chosen]] == n) & ((lengths[rows[chosen]] <= GRAM) == whole)]
            own = own[np.argsort(hashes[own], kind="stable")]
            unique, starts = np.unique(hashes[own], return_index=True)
            width = min(27, max(16, (16 * len(unique)).bit_length()))
            table = np.zeros(1 << width, bool)
            table[unique >> np.uint64(64 - width)] = True
            table = np.packbits(table, bitorder="little")
            behind = rows[own]
            letters = np.frombuffer(b"".join(self.phrases[b] for b in behind), np.uint8).reshape(-1, n) if whole else None
            self.tables.append((n, table, unique, np.append(starts, len(own)), behind, letters))

    def held(self, phrase: bytes, text: bytes) -> bool:
        at = text.find(phrase)
        while self.edges and at >= 0 and (at and text[at - 1] in WORD_BYTES or text[at + len(phrase):at + len(phrase) + 1] in WORD_ENDS):
            at = text.find(phrase, at + 1)
        return at >= 0

    def hits(self, column: pa.Array, groups: pa.Array, keys: list[pa.Array]) -> tuple[pa.Array, pa.Array]:
        """(row, phrase number) of every phrase inside a text of its own group."""
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        groups = groups.to_numpy()
        data, offsets = _buffer(column)
        for n, table, unique, starts, behind, letters in self.tables:
            row, found, first = places(column, groups, n, table, self.edges and letters is not None)
            at = np.minimum(np.searchsorted(unique, found), len(unique) - 1)
            exact = unique[at] == found
            row, at, first = row[exact], at[exact], first[exact]
            if letters is None:
                _, kept = np.unique(row * len(unique) + at, return_index=True)
                row, at, first = row[kept], at[kept], first[kept]
            many = starts[at + 1] - starts[at]
            place = np.repeat(starts[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, first, number = np.repeat(row, many), np.repeat(first, many), behind[place]
            if letters is not None:
                same = np.ones(len(row), bool)
                for i in range(n):
                    same &= data[first + i] == letters[place, i]
                pairs = np.unique(row[same] * len(self.phrases) + number[same])
                row, number = pairs // len(self.phrases), pairs % len(self.phrases)
            else:
                own, text, same = -1, b"", np.zeros(len(row), bool)
                for i, (r, p) in enumerate(zip(row.tolist(), number.tolist())):
                    if r != own:
                        own, text = r, data[offsets[r]:offsets[r + 1]].tobytes()
                    same[i] = self.held(self.phrases[p], text)
                row, number = row[same], number[same]
            rows.append(row)
            numbers.append(number)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        many = np.diff(self.ends, prepend=0)[number]
        place = np.repeat(self.ends[number] - many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, number = np.repeat(row, many), self.members[place]
        if self.keys is not None:
            own = [tuple(k[r].as_py() for k in keys) for r in np.unique(row).tolist()]
            where = np.searchsorted(np.unique(row), row)
            same = np.fromiter((self.keys[p] == own[w] for w, p in zip(where.tolist(), number.tolist())), bool, len(row))
            row, number = row[same], number[same]
        return pa.array(row, pa.int64()), pa.array(number, pa.int64())


def word_hits(
    phrases: DataFrame, texts: DataFrame, phrase_ids: Sequence[str], text_ids: Sequence[str],
    phrase: str, text: str, on: Sequence[str] = (),
) -> DataFrame:
    """(on, phrase_ids, text_ids) for every phrase found between word edges in a collapsed text; phrases without letter or digit are in none."""
    return phrase_hits(phrases.where(F.regexp_like(phrase, F.lit("[a-z0-9]"))), texts, phrase_ids, text_ids, phrase, text, 1, on, edges=True)
