import math
import random
from collections import Counter

import numpy as np
import pytest

from tapelake.llm import common, pair_search
from tapelake.llm.common import words_of
import cases


def expected(rows, queries, k):
    bags = [Counter(words_of((t or "").encode())) for _, t, *_ in rows]
    N, L, df = sum(map(bool, bags)), sum(sum(b.values()) for b in bags), Counter(w for b in bags for w in b)
    out = []
    for q, text in queries:
        scores = []
        for (doc, *_), b in zip(rows, bags):
            n = sum(b.values())
            m = 100 - 90 + 90 * n * N // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10 ** 9 * b[w] // (1000 * b[w] + 8 * m))
                    for w in set(words_of((text or "").encode())) if w in b)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(q, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scores)[:k])]
    return out


def tables(spark):
    rng = random.Random(8)
    rows = cases.odd_rows() + [(100 + i, " ".join(cases.words(rng, rng.randrange(40), 60)), "en", "s", 0) for i in range(150)]
    rows += [(400 + i, rows[30][1], "en", "s", 0) for i in range(15)]  # more ties than k
    queries = [(i, " ".join(cases.words(rng, rng.randrange(1, 30), 60))) for i in range(40)]
    queries += [(90, rows[30][1]), (91, None), (92, ""), (93, "unheard of"), (7, "w1 w2"), (7, "w1 w2"), (94, "W3 w3, w3")]
    return rows, queries


@pytest.mark.parametrize("shard,block", [(7, 60), (4096, 200_000)])
def test_same_rows_as_scoring_everything(spark, shard, block):
    rows, queries = tables(spark)
    docs = cases.clashing(cases.frame(spark, rows)).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 AS number", "2 AS terms", "3 AS key")
    got = pair_search.top_k(docs, asked, k=4, shard_docs=shard, block_terms=block).collect()
    want = expected(rows, dict.fromkeys(queries), 4)
    assert sorted((r["query"], r["rank"], r["doc"] or -1, r["score"]) for r in got) == sorted((q, n, d or -1, s) for q, n, d, s in want)


def test_text_keys_and_two_texts_under_one_key(spark):
    docs = spark.createDataFrame([("b", "red apple"), ("a", "red apple"), (None, "blue plum red")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "apple"), ("q", "plum")], "item_id string, text string")
    got = pair_search.top_k(docs, asked).collect()
    assert len({r["text_sha256"] for r in got}) == 2
    assert sorted((r["rank"], r["doc"] or "") for r in got) == [(1, ""), (1, "a"), (2, "b")]


def test_empty_tables(spark):
    none, some = cases.frame(spark, []), cases.frame(spark, cases.odd_rows())
    for docs, asked in ((none, none), (none, some), (some, none)):
        assert pair_search.top_k(docs, asked, query_key="doc_id").collect() == []


def test_pair_bounds_read_fewer_postings_for_the_same_rows():
    """Frequent terms that seldom meet: the couple's bound rules rows out that single maxima let in."""
    rng = np.random.default_rng(2)
    size, weights = 2000, np.array([250, 90, 88, 86, 84])
    lists = [np.sort(rng.choice(size, n, replace=False)).astype(np.int32) for n in (60, 700, 0, 700, 0)]
    lists[2] = np.setdiff1d(np.arange(size, dtype=np.int32), lists[1])[::2]  # never beside term 1
    lists[4] = np.setdiff1d(np.arange(size, dtype=np.int32), lists[3])[::2]
    parts = [rng.integers(1, 900, len(x)) for x in lists]
    starts = np.cumsum([0, *map(len, lists)])
    terms = np.arange(5, dtype=np.int64)

    def shard(pairs, joint, both):
        ends = np.cumsum([0, *map(len, both)])
        return pair_search.Shard(size, terms, starts, np.concatenate(lists), np.concatenate(parts), np.array(pairs, np.int64),
                                 np.array(joint, np.int64), ends, np.concatenate([*both, np.zeros(0, np.int32)]).astype(np.int32))

    none = np.zeros(0, np.int32)
    with_pairs, without = shard([1, 2, 3, 4], [0, 0], [none, none]), shard([], [], [])
    score = np.zeros(size, np.int64)
    for w, x, p in zip(weights, lists, parts):
        score[x] += w * p
    want = np.lexsort((np.arange(size), -score))[:10]
    one = with_pairs.best((0, terms.view(np.uint64), weights, [(1, 2), (3, 4)], [0]), 10, 1)
    two = without.best((0, terms.view(np.uint64), weights, [], [0, 1, 2, 3, 4]), 10, 1)
    assert one[0].tolist() == two[0].tolist() == want.tolist() and one[1].tolist() == score[want].tolist()
    assert with_pairs.read < 0.7 * without.read


def test_large_shards_are_written_and_read_one_by_one(spark):
    """A writer that kept all rows of a task, and a reader that took them as one batch, would need memory by the size of a partition."""
    docs = spark.range(300, numPartitions=1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 4000), i -> hex(xxhash64(id, i))), ' ') AS text")
    index = pair_search.build_index(docs, shard_docs=30)
    assert index.count() == 10 and cases.most_rows_read_at_once(index) < 10


def test_numbers_as_one_binary_value():
    for top, size in ((0, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4), (2**32, 8), (2**64 - 1, 8)):
        values = np.array([0, top, 7 if top > 7 else 0], np.uint64)
        one = common.packed(values)
        assert len(one[0].as_py()) == 3 * size + 1 and common.unpacked(one[0], np.uint64).tolist() == values.tolist()
    assert common.unpacked(common.packed(np.zeros(0, np.int64))[0], np.int64).tolist() == []
