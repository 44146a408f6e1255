"""Toxicity scores from a bag of subword vectors and a linear softmax, trained jointly in numpy.

A word's features are itself and its character n-grams, hashed into buckets of one embedding table, so that an unseen
misspelling or inflection shares vectors with known words. Words longer than PIECE characters (clauses of scripts without
blanks among them) count as overlapping pieces, each a word of the passage. The features of a passage of WINDOW words are averaged and
a linear softmax over two classes follows; a document's evidence is that of its strongest passage, turned into a
probability by a logistic curve fitted on labelled rows that the embeddings have not seen.

The embeddings learn from a bounded sample, `max_toxic` and `max_clean` labelled rows (those of smallest hash), on the
driver. Scoring covers every word of every text inside tasks: after training the table and the softmax collapse to one
number per bucket.

NULL and empty texts have no passage; they get the curve's value at the model's bias. NULL labels are no labels.
Repeated rows get equal scores. Without rows of both classes the score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.llm.common import bound_batches, numbered, texts, words_of

BUCKETS, DIM, WINDOW = 1 << 17, 8, 16
SIZES = (3, 4, 5)  # of the character n-grams
WIDTH = 48  # features of a word at most, enough for all n-grams of PIECE characters
PIECE, OVERLAP = 16, 4  # longer words count as pieces of so many characters; an n-gram of the word lies in a piece
MAX_TOXIC, MAX_CLEAN = 2048, 4096  # rows of the training sample
KEEP = 120_000  # words that a worker remembers


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, those of more than PIECE characters cut into overlapping pieces."""
    out = []
    for word in words_of(text):
        if len(word) <= PIECE or len(chars := word.decode("utf-8", "replace")) <= PIECE:
            out.append(word)
        else:
            out += [chars[i:i + PIECE].encode() for i in range(0, len(chars) - OVERLAP, PIECE - OVERLAP)]
    return out


def features(word: bytes) -> list[int]:
    """Buckets of a word (bytes of lower case, PIECE characters at most) and of its character n-grams."""
    text = f"<{word.decode('utf-8', 'replace')}>"
    out = [zlib.crc32(word) % BUCKETS]
    out += [zlib.crc32(text[i:i + n].encode()) % BUCKETS for i in range(len(text)) for n in SIZES if i + n <= len(text)]
    return out


def passages(values: np.ndarray) -> np.ndarray:
    """Means over each WINDOW consecutive words (all if fewer); a word's value is sum + count * i."""
    sums = np.cumsum(values)
    sums = np.concatenate([sums[WINDOW - 1:WINDOW], sums[WINDOW:] - sums[:-WINDOW]]) if len(values) > WINDOW else sums[-1:]
    return sums.real / sums.imag


@dataclass
class Model:
    weights: np.ndarray  # per bucket, the difference of the two classes' logits
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def word(self, word: bytes) -> complex:
        found = features(word)
        return complex(self.weights[found].sum(), len(found))

    def evidence(self, values: np.ndarray) -> float:
        """Of words' values: the largest mean over WINDOW consecutive words, or over all if there are fewer."""
        return float(passages(values).max()) + self.bias if len(values) else self.bias

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40))))


class WordValues(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= KEEP:
            self.clear()
        value = self[word] = self.model.word(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.complex128, len(words))


class Vocabulary:
    """The sample's words as numbers, and the buckets of each, padded with BUCKETS; the last row is padding."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        return np.array([self.numbers.setdefault(w, len(self.numbers)) for w in tokens(text)], np.int32)

    def table(self) -> np.ndarray:
        out = np.full((len(self.numbers) + 1, WIDTH), BUCKETS, np.int32)
        for row, word in zip(out, self.numbers):
            own = features(word)
            row[:len(own)] = own
        return out


def train(ids: list[np.ndarray], labels: np.ndarray, table: np.ndarray, seed: int = 7, rounds: int = 4, steps: int = 220,
          batch: int = 192, rate: float = 2.0) -> Model:
    """Embeddings and softmax over passages of the documents in `ids` (word numbers, none empty). The first round takes
    passages at random; later rounds take the strongest passage of each document as well, since only some passages of a
    toxic document are toxic."""
    rng = np.random.default_rng(seed)
    counts = (table < BUCKETS).sum(1).astype(np.float64)
    vectors = np.vstack([rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM, np.zeros((1, DIM))])
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    squares, squares_out = np.full(BUCKETS + 1, 1e-4), np.full((DIM, 2), 1e-4)
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    starts = np.array([0] * len(ids))
    for turn in range(rounds):
        for _ in range(steps):
            picked = np.concatenate([rng.choice(side, batch // 2) for side in sides])
            at = rng.random(batch)
            words = np.full((batch, WINDOW), len(table) - 1, np.int64)
            for row, (doc, x) in enumerate(zip(picked, at)):
                n = len(ids[doc])
                strongest = turn and (labels[doc] or x < 0.5)
                start = starts[doc] if strongest else int(x * max(1, n - WINDOW + 1))
                part = ids[doc][start:start + WINDOW]
                words[row, :len(part)] = part
            buckets = table[words].reshape(batch, -1)
            sizes = counts[words].sum(1, keepdims=True)
            means = vectors[buckets].sum(1) / sizes
            logits = means @ softmax + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            wrong = odds / odds.sum(1, keepdims=True)
            wrong[np.arange(batch), labels[picked]] -= 1
            wrong /= batch
            into = means.T @ wrong
            back = (wrong @ softmax.T) / sizes
            squares_out += into ** 2
            softmax -= rate * 0.1 * into / np.sqrt(squares_out)
            bias -= 0.2 * wrong.sum(0)
            used, place = np.unique(buckets, return_inverse=True)
            grads = np.zeros((len(used), DIM))
            flat = place.reshape(batch, -1)
            for d in range(DIM):
                grads[:, d] = np.bincount(flat.ravel(), np.repeat(back[:, d], flat.shape[1]), len(used))
            squares[used] += (grads ** 2).mean(1)
            vectors[used] -= rate * 0.1 * grads / np.sqrt(squares[used])[:, None]
            vectors[BUCKETS] = 0
        model = Model(vectors[:BUCKETS] @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))
        sums = word_sums(model, table)
        for doc, own in enumerate(ids):  # the strongest passage of each document
            starts[doc] = int(passages(sums[own] + 1j * counts[own]).argmax())
    return model


def word_sums(model: Model, table: np.ndarray) -> np.ndarray:
    weights = np.append(model.weights, 0.0)
    return np.concatenate([weights[table[i:i + 50_000]].sum(1) for i in range(0, len(table), 50_000)])


def calibrate(model: Model, evidence: np.ndarray, labels: np.ndarray) -> Model:
    """Slope and shift of the logistic curve, by Newton's method on the standardised evidence."""
    mean, spread = evidence.mean(), evidence.std() or 1.0
    x = np.stack([(evidence - mean) / spread, np.ones(len(evidence))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - labels) + 0.02 * theta
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2), slope)
    model.slope, model.shift = float(theta[0] / spread), float(theta[1] - theta[0] * mean / spread)
    return model


def fit_rows(rows: list[tuple[bytes, int, bool]]) -> Model:
    """A model from (text, label, kept for the curve) rows."""
    words = Vocabulary()
    ids = [words.of(text) for text, _, _ in rows]
    labels = np.array([int(y) for _, y, _ in rows], np.int64)
    curve = np.array([bool(c) for _, _, c in rows], bool)
    learn = ~curve & np.array([len(i) > 0 for i in ids], bool)
    if min((labels[learn] == y).sum() for y in (0, 1)) == 0:
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    table = words.table()
    model = train([i for i, keep in zip(ids, learn) if keep], labels[learn], table)
    rest = curve if len(set(labels[curve])) == 2 else np.ones(len(labels), bool)
    values = word_sums(model, table) + 1j * (table < BUCKETS).sum(1)
    evidence = np.array([model.evidence(values[i]) for i, keep in zip(ids, rest) if keep])
    return calibrate(model, evidence, labels[rest])


def remainder(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learn from labelled rows outside the held-out fifth; of these, a fifth only fits the curve."""
    marked = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
              .groupBy(key).agg(F.max(label).cast("int").alias("_label"))
              .withColumn("_rest", remainder(key)).where("_rest <> 0").withColumn("_order", F.xxhash64(key)))
    sample = (marked.where("_label = 1").orderBy("_order").limit(max_toxic)
              .unionByName(marked.where("_label = 0").orderBy("_order").limit(max_clean)))
    rows = (docs.select(key, F.col(text).cast("binary").alias("_text"))
            .join(F.broadcast(sample), key).groupBy(key).agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"),
                                                F.first("_rest").alias("_rest"))
            .select("_text", "_label", F.expr("_rest = 1").alias("_curve"), F.xxhash64(key).alias("_order")).collect())
    rows.sort(key=lambda r: (r["_order"], bytes(r["_text"] or b"")))
    return fit_rows([(r["_text"] or b"", r["_label"], r["_curve"]) for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The rows with `score` (0 to 1) and `predicted` (score >= 0.5); columns of these names are replaced."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(score, predicted)
    at = docs.columns.index(text)
    out = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = WordValues(model)
        for batch in batches:
            found = [model.probability(model.evidence(values.of(tokens(t))))
                     for t in texts(batch.column(at))]
            new = [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], out.names)

    return numbered(docs).mapInArrow(run, out)
