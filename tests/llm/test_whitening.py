import random

import numpy as np
import pytest

from tapelake.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed=3, d=6, n=120):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1 + j) / 4 for j in range(d)], 1) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(70)]  # a vector with a third of all rows
    return rows + [(5, rows[7][1], 1), (None, rows[8][1], 0)]


def bad(d=6):
    return [(900, None, 0), (901, [0.0] * (d - 1) + [None], 0), (902, [float("nan")] * d, 0), (903, [float("inf")] * d, 0), (904, [], 0),
            (905, [1.0], 0)]


def expected(rows, k):
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v, _ in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = ((n * x - s) / n).astype(float)
    cov = z.T @ z / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    w = z @ axes[:, order] / np.sqrt(values[order])
    return n, [int(v) for v in ((n * x - s) ** 2).sum(axis=1)], w, values[order] / np.trace(cov)


@pytest.mark.parametrize("hot", [200, 2])
def test_same_as_a_dense_computation(spark, monkeypatch, hot):
    monkeypatch.setattr(whitening, "HOT", hot)
    rows = vectors()
    df = spark.createDataFrame(rows + bad(), SCHEMA).repartition(5)
    df = df.withColumns({c: df.label for c in ("x", "w", "key", "copies", "component", "n", "a.b")})
    got = whitening.whiten(df, components=4).collect()
    n, deviation, w, explained = expected(rows, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    assert 0 <= got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1
    want = sorted(((i if i is not None else -1), c + 1, d, round(abs(w[r, c]), 6), round(explained[c], 9)) for r, ((i, *_), d) in
                  enumerate(zip(rows, deviation)) for c in range(4))
    assert want == sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.deviation, round(abs(r.whitened), 6), round(r.explained, 9))
                          for r in got)
    for c in range(1, 5):  # one sign for all rows
        own = {r.vec_id: r.whitened for r in got if r.component == c}
        assert len({np.sign(own[i]) * np.sign(w[i, c - 1]) for i in range(100) if i != 5 and abs(w[i, c - 1]) > 1e-6}) == 1


def test_weights_of_one_ignore_copies(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    once = {tuple(v): (i, v, 0) for i, v, _ in rows}
    n, _, w, explained = expected(list(once.values()), 2)
    got = whitening.whiten(df, components=2, weigh=False).collect()
    assert len(got) == 2 * len(rows) and {r.n for r in got} == {n}
    assert sorted({round(r.explained, 9) for r in got}) == sorted({round(v, 9) for v in explained})


def test_no_variance_and_huge_entries(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    got = whitening.whiten(same).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(9)], SCHEMA)).collect()
    assert len(flat) == 18 and all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    huge = spark.createDataFrame([(1, [1e300, 0.0], 0), (2, [-1e300, 0.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    assert [r.deviation for r in whitening.whiten(huge).where("component = 1").orderBy("vec_id").collect()][:2] == [None, None]


@pytest.mark.parametrize("rows", [[], bad()[:4], [(1, [], 0)]])
def test_nothing_left(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []
