import random

import numpy as np
import pytest

from tapelake.llm import set_join
from tapelake.llm.components import components
import cases


def expected(rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return sets, list(groups.values())


def families(seed, percent, k):
    """Families whose members differ by about the allowed distance, in chains and stars, of many sizes."""
    rng = random.Random(seed)
    rows = cases.odd_rows()
    for family in range(25):
        base = cases.words(rng, rng.choice([1, 2, 3, 8, 9, 11, 14, 25, 60, 150]), 50)
        for _ in range(rng.randrange(1, 8)):
            rows.append((len(rows) + 1000, rng.choice([" ", "\n", "\t "]).join(base), "en", "s", 0))
            if rng.random() < 0.6:  # go on from the last one: a chain
                for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) * (100 - percent) // (200 * k))])):
                    base = base[:]
                    at = rng.randrange(len(base))
                    base[at:at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 70)])
def test_components_are_those_of_all_pairs(spark, seed, k, percent):
    rows = families(seed, percent, k)
    df = cases.clashing(cases.frame(spark, rows))
    sets, groups = expected(rows, k, percent)
    want = []
    for group in groups:
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            empty = not sets[i]
            want.append((rows[i][0], len(sets[i]), rows[i][0] if empty or not ids else min(ids)))
    got = [tuple(r) for r in set_join.clusters(df, k=k, percent=percent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = set_join.keep_one(df, k=k, percent=percent)
    assert kept.columns == df.columns
    left = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    firsts = []
    for group in groups:
        if not sets[group[0]]:
            firsts += [rows[i][0] for i in group]
        else:
            firsts.append(min((rows[i][0] for i in group if rows[i][0] is not None), default=None))
    assert left == sorted(firsts, key=repr)


@pytest.mark.parametrize("percent", [90, 80, 70])
def test_keys_meet_for_every_pair_that_links(percent):
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(9, 400))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        other = base.copy()
        while True:
            at = rng.integers(0, len(other))
            change = np.unique(np.append(np.delete(other, at), rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64)))
            both = len(np.intersect1d(base, change))
            if 100 * both < percent * (len(base) + len(change) - both):
                break
            other = change
        if len(other) != len(base) or (other != base).any():
            assert np.intersect1d(set_join.keys(base, percent), set_join.keys(other, percent)).size


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_sets_that_link_share_several_lists_of_a_class(percent):
    rng = np.random.default_rng(percent)
    for n in (40, 150, 600, 1500):
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2))
            out = rng.integers(0, n * (100 - percent) // (100 + percent) + 1)
            more = rng.integers(0, 1 << 63, out, np.int64).astype(np.uint64) * np.uint64(2)
            other = np.union1d(np.delete(base, rng.choice(len(base), out, replace=False)), more)
            assert 100 * np.intersect1d(base, other).size >= percent * np.union1d(base, other).size
            both = np.intersect1d(set_join.keys(base, percent), set_join.keys(other, percent))
            classes, times = np.unique(both & np.uint64(set_join.CLASSES - 1), return_counts=True)
            assert any(t >= set_join.least_shared(int(c), percent) for c, t in zip(classes, times))


def test_sets_with_one_line_in_common_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    line = cases.words(rng, 60, 10**6)
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(240)] + line), "en", "s", 0) for i in range(150)]
    near = rows[7][1].split()
    near[20] = "other"
    rows.append((150, " ".join(near), "en", "s", 0))
    compared, real = [], set_join._verified

    def counted(pairs, *more, **named):
        compared.append(pairs.count())
        return real(pairs, *more, **named)
    monkeypatch.setattr(set_join, "_verified", counted)
    got = set_join.clusters(cases.frame(spark, rows), k=5, percent=80).where("doc_id <> component_id").collect()
    assert [tuple(r) for r in got] == [(150, 296, 7)]
    assert compared[0] <= 5


def test_shared_entries_lose_none(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(1)
        rows = [(rng.randrange(3000) if rng.random() < .7 else 77, rng.randrange(500)) for _ in range(3000)]
        got = {tuple(r) for r in set_join.shared_entries(spark.createDataFrame(rows, "key long, v long")).collect()}
        counts = {}
        for key, _ in rows:
            counts[key] = counts.get(key, 0) + 1
        assert {r for r in rows if counts[r[0]] > 1} <= got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_component_rounds(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 300), (None, 4)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 300: 0, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_empty_table(spark):
    assert set_join.clusters(cases.frame(spark, [])).count() == 0
    assert set_join.keep_one(cases.frame(spark, [])).count() == 0
