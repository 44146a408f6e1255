"""SentencePiece BPE encoding by a table over prefixes, and decoding.

In a merge-type (BPE) model the best-scored neighbouring pieces merge first, the leftmost of equals. Two facts follow: the encoding
of a text is the one sequence of pieces in which every neighbouring pair, merged on its own, gives that same pair; and the encoding of
a prefix is the encoding of a shorter prefix and one piece more. So one piece a prefix is enough: an automaton over the vocabulary
names the pieces that end at a place, the only one compatible with the last piece of the prefix before it is stored, and the
pieces are recovered from the end backwards. The work grows with the text's length, whatever its words are.

Pieces never reach over a character the model doesn't know (it becomes its UTF-8 bytes as byte pieces, or the unknown id). In most models they
never reach either from another character to a blank sign, or from a letter to another sign; the vocabulary tells. Texts are cut there and the
parts' ids remembered up to a bound. Normalisation and decoding are the model's own.

A column that has the name of a new one is replaced. NULL counts as the empty text; the empty text has only its begin and end ids, as far as
they are asked for. Rows are independent: repeated rows give repeated results, extra columns pass through. Models that are no BPE models or
have pieces defined by users, and pieces listed as unused, are refused.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.llm.common import bound_batches, numbered

BLANK = "▁"
KEEP = 200_000  # parts of texts that a worker remembers (and as many old ones), and answers about pairs
NEVER = float("-inf")
CHUNK = 16 << 20  # bytes of results in one Arrow batch, a single longer text aside


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Encoder(dict):
    """Ids of parts of normalised texts as little-endian unsigned 32-bit integers, remembered up to a bound: a full memory becomes
    the old one, from which parts that come again are taken over."""

    def __init__(self, model: bytes):
        super().__init__()
        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if any(map(m.is_unused, plain)):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            parts, steps = self.merges(piece)
            if len(parts) == 1:  # others never come out of merging
                self.automaton.add_word(piece, (i, len(piece)))
                self.steps[i] = steps
        self.automaton.make_automaton()
        known = {p for p in self.ids if len(p) == 1}
        if not set("".join(self.ids)) <= known:
            raise ValueError("pieces must be made of characters that are pieces")
        self.cut = re.compile(self.parts(known), re.DOTALL)
        self.bytes = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.check()

    def parts(self, known: set[str]) -> str:
        """A pattern for the longest parts that pieces can reach over, as the vocabulary shows, and for single unknown characters."""
        def kind(c: str) -> str:
            return "blank" if c == BLANK else "letter" if c.isalpha() else "other"

        seen = {(kind(a), kind(b)) for p in self.ids for a, b in zip(p, p[1:])}
        chars = {k: "".join(map(re.escape, sorted(c for c in known if kind(c) == k))) or "^\\s\\S" for k in ("letter", "other")}
        letters, others = f"[{chars['letter']}]", f"[{chars['other']}]"
        blank, word = f"{BLANK}+", f"(?:{letters}|{others})"
        if seen & {("letter", "blank"), ("other", "blank")}:
            return f"(?:{BLANK}|{word})+|."
        if ("letter", "other") in seen:
            return f"{blank}{word}*|{word}+|."
        return f"{blank}{others}*{letters}*|{others}+{letters}*|{letters}+|."

    def check(self) -> None:
        """Refuses models of another kind: a unigram model cuts some piece in another way than merging does."""
        sample = "".join(p for p in list(self.ids)[:: max(1, len(self.ids) // 500)])
        if self.encode(sample) != np.array(self.model.encode(sample), "<u4").tobytes():
            raise ValueError("not a model of plain BPE merges")

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The pieces that merging makes of a short text, and each step's score with the first and the last part before it."""
        parts, steps = list(text), []
        while len(parts) > 1:
            score, at = max((self.scores.get(parts[i] + parts[i + 1], NEVER), -i) for i in range(len(parts) - 1))
            if score == NEVER:
                break
            steps.append((score, parts[0], parts[-1]))
            parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
        return parts, [*steps, (NEVER, parts[0], parts[-1])]

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging the two pieces' text gives the two pieces.

        Both pieces' own steps are played in the order of their scores (the left piece's first of equals); a merge of the parts beside the
        border must never come before the next of them.
        """
        if len(self.pairs) >= KEEP:
            self.pairs.clear()
        left, right, scores = self.steps[first], self.steps[second], self.scores
        i = j = 0
        while True:
            one, _, last = left[i]
            two, start, _ = right[j]
            over = scores.get(last + start, NEVER)
            if over > one and over >= two and over > NEVER:
                known = False
                break
            if one >= two:
                i += 1
            else:
                j += 1
            if one == two == NEVER:
                known = True
                break
        self.pairs[first << 32 | second] = known
        return known

    def __missing__(self, part: str) -> bytes:
        value = self.old.get(part)
        if value is None:
            if part[0] not in self.ids:
                ids = [self.bytes[f"<0x{b:02X}>"] for b in part.encode()] if self.bytes else [self.model.unk_id()]
                value = np.array(ids, "<u4").tobytes()
            else:
                value = np.array(self.along(part), "<u4").tobytes()
        if len(part) <= 64:  # long ones seldom come again
            if len(self) >= KEEP:
                self.old = dict(self)
                self.clear()
            self[part] = value
        return value

    def along(self, part: str) -> list[int]:
        """Ids by the table of each prefix's last piece."""
        last, sizes, pairs = [0] * (len(part) + 1), [0] * (len(part) + 1), self.pairs
        for at, (piece, size) in self.automaton.iter(part):
            end, start = at + 1, at + 1 - size
            if sizes[end]:
                continue
            if start:
                if not sizes[start]:
                    continue
                known = pairs.get(last[start] << 32 | piece)
                if not (self.compatible(last[start], piece) if known is None else known):
                    continue
            last[end], sizes[end] = piece, size
        out, end = [], len(part)
        while end:
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        parts = self.cut.findall(self.model.normalize(text)) if text else ()
        if self.bytes:
            return b"".join(map(self.__getitem__, parts))
        out, before = [], False  # without byte pieces a run of unknown characters is one unknown id
        for part in parts:
            unknown = part[0] not in self.ids
            if not (unknown and before):
                out.append(self[part])
            before = unknown
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


@functools.lru_cache(maxsize=2)
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _added(df: DataFrame, column: str, name: str, kind: T.DataType, factory: Callable) -> DataFrame:
    """The table with one column more, which `factory()` computes from a value of `column` inside the tasks."""
    bound_batches(df.sparkSession)
    df = df.drop(name)
    at = df.columns.index(column)
    out = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = factory()
        for batch in batches:
            schema = pa.schema([*(pa.field(n, f.type) for n, f in zip(out.names, batch.schema)), pa.field(name, arrow)])
            values, start, size = [], 0, 0
            for end, value in enumerate(batch.column(at), 1):
                values.append(make(value.as_py()))
                size += len(values[-1])
                if size >= CHUNK or end == len(batch):
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow)], schema=schema)
                    values, start, size = [], end, 0

    return numbered(df).mapInArrow(run, out)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", begin: bool = False, end: bool = False) -> DataFrame:
    """Adds `ids`: the text's ids as little-endian unsigned 32-bit integers, on request with the begin and the end id."""
    def factory():
        encoder = _encoder(model)
        before = np.array([encoder.model.bos_id()] * begin, "<u4").tobytes()
        after = np.array([encoder.model.eos_id()] * end, "<u4").tobytes()
        return lambda value: before + encoder.encode(value or "") + after
    return _added(df, text, ids, T.BinaryType(), factory)


def decode(df: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded`: the model's text of `ids`; NULL counts as no ids."""
    def factory():
        processor = _processor(model)
        return lambda value: processor.decode(np.frombuffer(value or b"", "<u4").tolist())
    return _added(df, ids, decoded, T.StringType(), factory)


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, ids_sha256 and decoded_sha256 after a full round trip, with begin and end ids."""
    done = decode(encode(docs.select(key, text), model, text, begin=True, end=True).select(key, "ids"), model)
    return done.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
