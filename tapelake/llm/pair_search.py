"""Ranked lexical search with pair-bound MaxScore: integer BM25, exact.

The index is built where the rows are read: a task packs SHARD_DOCS rows (or SHARD_WORDS words) at a time into a shard, one row of a written
table, with postings sorted by term (64-bit word hashes) and rows in order of their key, each column one binary value. Document counts, lengths and document frequencies are
global, so shards merge exactly.

Before a block of queries is asked, each shard gets the impacts of the block's terms and the pair lists: a query's terms that more than one in
FREQUENT of the documents hold are coupled by falling weight, and for every couple the shard stores the rows that hold both and the largest sum of
their two impacts. A couple then adds no more than the largest of that sum and its two single maxima, which is less than the sum of the maxima
that plain MaxScore must assume.

In a shard a query's couples and single terms are taken by falling bound. Rows are collected from postings only while what is left can lift an
unseen row to the score to reach: the k-th best so far, of this shard and, carried along, of the task's earlier ones. From there on only
the collected rows are looked up, those outside a couple's intersection with the smaller bound, and rows that can no longer get there leave. Rows
that are skipped cannot be among the k best.

Scores are integers: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); with m = 10 + 90nN div L a row of tf occurrences adds weight * (10^9 tf
div (1000 tf + 8m)). Rows are ranked by score, then by key (NULL last). A query's term counts once. Queries go in blocks of about BLOCK_TERMS terms,
each broadcast to one pass. Equal texts under one key are one query; several texts under one key are ranked each, told apart by `text_sha256`. NULL
and empty texts match nothing. Rows of NULL keys can be found and can ask. Repeated rows are rows of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.common import giving_back, hashed_texts, packed, quoted, small_batches, unpacked
from tapelake.session import LARGE_ROWS, written

SHARD_DOCS, SHARD_WORDS = 4096, 2_000_000
FREQUENT = 16
BLOCK_TERMS = 200_000
POSTINGS = "terms binary, sizes binary, rows binary, counts binary"
LISTS = "terms array<long>, starts array<int>, rows array<int>"
TERMS_AT_ONCE = 1 << 16  # of a shard, in an Arrow batch


def _lists(column: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, column)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*column, np.zeros(0, kind)]).astype(kind)))


def _bag(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    terms, counts = np.unique(found, return_counts=True)
    return terms, counts, len(found)


def _shard(ids: list, bags: list, kind: pa.DataType) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    bags = [bags[i] for i in order]
    terms = np.concatenate([b[0] for b in bags])
    rows = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    counts = np.concatenate([b[1] for b in bags])
    order_of_terms = np.argsort(terms, kind="stable")
    own, starts = np.unique(terms[order_of_terms], return_index=True)
    keys = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array([ids[i] for i in order], kind))
    lengths = _lists([np.array([b[2] for b in bags])], np.int64)
    columns = own, np.diff(starts, append=len(terms)), rows[order_of_terms], counts[order_of_terms]
    return pa.RecordBatch.from_arrays([keys, lengths, *map(packed, columns)], ["keys", "lengths", "terms", "sizes", "rows", "counts"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index as a written table, one row per shard."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bags, words, name = [], [], 0, None
        for batch in batches:
            name = batch.schema.field(0).type
            for one, found in zip(batch.column(0).to_pylist(), hashed_texts(batch.column(1))):
                ids.append(one)
                bags.append(_bag(found))
                words += bags[-1][2]
                if len(ids) >= shard_docs or words >= SHARD_WORDS:
                    yield _shard(ids, bags, name)
                    ids, bags, words = [], [], 0
        if ids:
            yield _shard(ids, bags, name)

    with small_batches(docs.sparkSession):
        rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
        return written(rows.mapInArrow(giving_back(run), f"keys array<{kind}>, lengths array<long>, {POSTINGS}"), "postings", **LARGE_ROWS)


def totals(index: DataFrame) -> tuple[int, int]:
    """(N, L): documents with a term, and all terms."""
    def add(test):
        return F.sum(F.aggregate("lengths", F.lit(0).cast("long"), test))
    row = index.agg(add(lambda a, n: a + F.when(n > 0, 1).otherwise(0)).alias("n"), add(lambda a, n: a + n).alias("words")).first()
    return row["n"] or 0, row["words"] or 0


def query_terms(queries: DataFrame, index: DataFrame, documents: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(number, key, text_sha256) of each query, and (number, terms, weights, frequent) of those with terms in the index; both written."""
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            found = [_bag(words)[0].view(np.int64) for words in hashed_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, np.int64)], ["number", "terms"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, sizes in zip(batch.column(0), batch.column(1)):
                each = pa.RecordBatch.from_arrays([pa.array(unpacked(c, np.int64)) for c in (terms, sizes)], ["term", "n"])
                yield from (each.slice(i, TERMS_AT_ONCE) for i in range(0, len(each), TERMS_AT_ONCE))

    named = queries.select(F.col(quoted(key)).alias("key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    named = named.withColumn("text_sha256", F.sha2("text", 256)).dropDuplicates(["key", "text_sha256"])
    named = written(named.withColumn("number", F.monotonically_increasing_id()), "asked")
    with small_batches(queries.sparkSession):
        terms = written(named.select("number", "text").mapInArrow(giving_back(bags), "number long, terms array<long>"), "asked")
        terms = terms.select("number", F.explode("terms").alias("term"))
        found = index.select("terms", "sizes").mapInArrow(giving_back(frequencies), "term long, n long")
        df = found.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1))).cast("long")
        one = F.struct("term", weight.alias("weight"), (F.col("df") * FREQUENT > documents).alias("frequent"))
        each = terms.join(df, "term").groupBy("number").agg(F.array_sort(F.collect_list(one)).alias("t"))
        each = written(each.select("number", *[F.col(f"t.{a}").alias(b) for a, b in (("term", "terms"), ("weight", "weights"),
                                                                                      ("frequent", "frequent"))]), "asked")
    return named.select("number", "key", "text_sha256"), each


class Block:
    """A block of queries: their terms and weights, and the couples that get pair lists."""

    def __init__(self, rows: list):
        self.queries = []
        for row in rows:
            terms, weights = np.array(row["terms"], np.int64).view(np.uint64), np.array(row["weights"], np.int64)
            frequent = [int(i) for i in np.lexsort((terms, -weights)) if row["frequent"][i]]
            couples = list(zip(frequent[::2], frequent[1::2]))
            paired = {i for c in couples for i in c}
            self.queries.append((row["number"], terms, weights, couples, [i for i in range(len(terms)) if i not in paired]))
        weights = {int(t): int(w) for _, terms, ws, _, _ in self.queries for t, w in zip(terms, ws)}
        self.terms = np.array(sorted(weights), np.uint64)
        self.weights = np.array([weights[int(t)] for t in self.terms], np.int64)
        self.couples = sorted({tuple(sorted((int(terms[a]), int(terms[b])))) for _, terms, _, couples, _ in self.queries for a, b in couples})


def paired(index: DataFrame, block, documents: int, words: int) -> DataFrame:
    """The index narrowed to a block's terms, with impacts instead of counts and with the couples' pair lists; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        for batch in batches:
            for r in range(len(batch)):
                lengths = batch.column(1)[r].values.to_numpy(zero_copy_only=False)
                terms, sizes, rows, counts = (unpacked(batch.column(c)[r], t) for c, t in ((2, np.uint64), (3, np.int64), (4, np.int32), (5, np.int32)))
                starts = np.append(0, np.cumsum(sizes))
                at = np.searchsorted(terms, asked.terms)
                inside = np.flatnonzero(at < len(terms))
                here = inside[terms[at[inside]] == asked.terms[inside]]
                at = at[here]
                m = 10 + 90 * lengths * documents // max(words, 1)
                lists, parts = [], []
                for i in at:
                    own = rows[starts[i]:starts[i + 1]]
                    tf = counts[starts[i]:starts[i + 1]].astype(np.int64)
                    lists.append(own)
                    parts.append(1_000_000_000 * tf // (1000 * tf + 8 * m[own]))
                place = {int(asked.terms[i]): k for k, i in enumerate(here)}
                pairs, joint, both = [], [], []
                for a, b in asked.couples:
                    i, j = place.get(a), place.get(b)
                    if i is None or j is None:
                        continue
                    common, x, y = np.intersect1d(lists[i], lists[j], assume_unique=True, return_indices=True)
                    pairs += [a, b]
                    both.append(common)
                    sums = parts[i][x] * asked.weights[here[i]] + parts[j][y] * asked.weights[here[j]]
                    joint.append(int(sums.max(initial=0)))
                ends = np.cumsum([0, *map(len, lists)])
                pair_ends = np.cumsum([0, *map(len, both)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[r:r + 1], *[_lists([np.asarray(c)], t) for c, t in (
                    (asked.terms[here].view(np.int64), np.int64), (ends, np.int32), (np.concatenate([*lists, np.zeros(0)]), np.int32),
                    (np.concatenate([*parts, np.zeros(0)]), np.int32), (np.array(pairs, np.uint64).view(np.int64), np.int64),
                    (joint, np.int64), (pair_ends, np.int32), (np.concatenate([*both, np.zeros(0)]), np.int32))]],
                    ["keys", "terms", "starts", "rows", "parts", "pairs", "joint", "pair_starts", "pair_rows"])

    kind = index.schema["keys"].dataType.simpleString()
    schema = f"keys {kind}, {LISTS}, parts array<int>, pairs array<long>, joint array<long>, pair_starts array<int>, pair_rows array<int>"
    with small_batches(index.sparkSession):
        return written(index.mapInArrow(giving_back(run), schema), "pairs", **LARGE_ROWS)


def _hit(rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of `asked` are in the sorted `rows`, their places there)."""
    at = np.searchsorted(rows, asked)
    inside = at < len(rows)
    inside[inside] = rows[at[inside]] == asked[inside]
    return inside, at[inside]


class Shard:
    """A shard of the narrowed index in a task."""

    def __init__(self, size: int, terms, starts, rows, parts, pairs, joint, pair_starts, pair_rows):
        self.size = size
        self.place = {int(t): (rows[starts[i]:starts[i + 1]], parts[starts[i]:starts[i + 1]].astype(np.int64))
                      for i, t in enumerate(terms.view(np.uint64))}
        ends = pairs.view(np.uint64).reshape(-1, 2)
        self.pairs = {(int(a), int(b)): (int(joint[i]), pair_rows[pair_starts[i]:pair_starts[i + 1]]) for i, (a, b) in enumerate(ends)}
        self.read = 0  # postings taken or looked up

    def units(self, terms: np.ndarray, weights: np.ndarray, couples: list, single: list) -> list[tuple]:
        """(bound, bound outside the intersection, rows of the intersection, [(rows, impacts)]) by falling bound."""
        out = []

        def one(i: int):
            found = self.place.get(int(terms[i]))
            return None if found is None else (found[0], found[1] * weights[i])

        for i in single:
            if (own := one(i)) is not None:
                top = int(own[1].max())
                out.append((top, top, None, [own]))
        for i, j in couples:
            own = [x for x in (one(i), one(j)) if x is not None]
            if own:
                top = max(int(x[1].max()) for x in own)
                joint, both = self.pairs.get(tuple(sorted((int(terms[i]), int(terms[j])))), (0, None)) if len(own) == 2 else (0, None)
                out.append((max(top, joint), top, both, own))
        return sorted(out, key=lambda u: -u[0])

    def best(self, query: tuple, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of at most k rows that reach `least`, best first, rows of smaller keys first among equals."""
        _, terms, weights, couples, single = query
        units = self.units(terms, weights, couples, single)
        left = [0]
        for u in reversed(units):
            left.append(left[-1] + u[0])
        left.reverse()  # what the units from here on can add
        least = max(least, 1)
        score, at = np.zeros(self.size, np.int64), 0
        while at < len(units) and left[at] >= least:
            for rows, impacts in units[at][3]:
                score[rows] += impacts
                self.read += len(rows)
            at += 1
            if self.size > k:
                least = max(least, int(np.partition(score, self.size - k)[self.size - k]))
        rows = np.flatnonzero((score > 0) & (score + left[at] >= least))
        for place in range(at, len(units)):
            bound, outside, both, parts = units[place]
            if both is not None and outside < bound:
                most = np.where(_hit(both, rows)[0], bound, outside)
                rows = rows[score[rows] + most + left[place + 1] >= least]
            for own, impacts in parts:
                inside, found = _hit(own, rows)
                score[rows[inside]] += impacts[found]
                self.read += len(rows)
            rows = rows[score[rows] + left[place + 1] >= least]
        rows = rows[score[rows] >= least]
        rows = rows[np.lexsort((rows, -score[rows]))[:k]]
        return rows, score[rows]


def search(narrowed: DataFrame, block, k: int, kind: str) -> DataFrame:
    """(number, key, score): each task's k best rows for each query of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, name = block.value.queries, None
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            name = batch.schema.field(0).type.value_type
            for r in range(len(batch)):
                keys = batch.column(0)[r].values
                shard = Shard(len(keys), *(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(1, 9)))
                for q, query in enumerate(queries):
                    rows, scores = shard.best(query, k, -best[q][-1][0] if len(best[q]) == k else 1)
                    if len(rows):
                        more = [(-s, key is None, key) for s, key in zip(scores.tolist(), keys.take(pa.array(rows)).to_pylist())]
                        best[q] = sorted(best[q] + more)[:k]
        if name is not None:
            found = [(query[0], key, -s) for query, own in zip(queries, best) for s, _, key in own]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], name),
                                              pa.array([f[2] for f in found], pa.int64())], ["number", "key", "score"])

    with small_batches(narrowed.sparkSession):
        return written(narrowed.mapInArrow(giving_back(run), f"number long, key {kind}, score long"), "found")


def top_k(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "item_id", text: str = "text", k: int = 10,
          shard_docs: int = SHARD_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query, text_sha256, rank, doc, score): the k best rows of `docs` for each query with a score above 0."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    index = build_index(docs, key, text, shard_docs)
    documents, words = totals(index)
    names, terms = query_terms(queries, index, documents, query_key, text)
    blocks = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    found = None
    for number in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == number).collect()
        if rows or found is None and number == blocks - 1:
            block = spark.sparkContext.broadcast(Block(rows))
            part = search(paired(index, block, documents, words), block, k, kind)
            block.destroy()
            found = part if found is None else found.unionByName(part)
    first = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).withColumnRenamed("key", "doc")
    return names.join(ranked, "number").select(F.col("key").alias("query"), "text_sha256", "rank", "doc", "score")
