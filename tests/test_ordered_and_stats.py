import datetime
import decimal
import math
import random
import re
import struct
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tapelake.functions import stats
from tapelake.operators import containment, ordered
from tapelake.operators.containment import Anchors, phrase_hits, word_hits


def sample(spark, n=60, seed=3):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), i, rng.choice([None, 1.0, 2.0, 5.5])) for i in range(n)]
    return data, spark.createDataFrame(data, "g string, i int, x double")


def groups(data):
    out = {}
    for g, i, x in sorted(data, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, x))
    return out


def test_running_sum_and_row_number(spark, group_limit):
    data, df = sample(spark)
    want_sum, want_no = [], []
    for g, items in groups(data).items():
        total = None
        for no, (i, x) in enumerate(items, 1):
            if x is not None:
                total = (total or 0) + x
            want_sum.append((g, i, total))
            want_no.append((g, i, no))
    assert rows(ordered.running_sum(df, ["g"], ["i"], {"s": "x"}), "g", "i", "s") == sorted(want_sum, key=repr)
    assert rows(ordered.row_number(df, ["g"], ["i"], "no"), "g", "i", "no") == sorted(want_no, key=repr)


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbours(spark, group_limit, step):
    data, df = sample(spark, 40)
    want = []
    for g, items in groups(data).items():
        for no, (i, _) in enumerate(items):
            other = no + step
            want.append((g, i, *(items[other] if 0 <= other < len(items) else (None, None))))
    got = ordered.neighbour(df, ["g"], ["i"], {"oi": "i", "ox": "x"}, step)
    assert rows(got, "g", "i", "oi", "ox") == sorted(want, key=repr)


def test_nearest_rank(spark, group_limit):
    data, df = sample(spark, 80)
    empty = spark.createDataFrame([("none", 1, None), ("none", 2, float("nan"))], "g string, i int, x double")
    got = ordered.nearest_rank(df.unionByName(empty), ["g"], {"p50": ("x", 0.5), "p95": ("x", 0.95)}, [F.count("*").alias("n")])
    want = []
    for g, items in {**groups(data), "none": [(1, None), (2, None)]}.items():
        xs = sorted(x for _, x in items if x is not None)
        pick = lambda p: xs[max(1, math.ceil(p * len(xs))) - 1] if xs else None
        want.append((g, len(items), pick(0.5), pick(0.95)))
    assert rows(got, "g", "n", "p50", "p95") == sorted(want, key=repr)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_wilson_and_quantiles(spark):
    w = one(spark, a=stats.wilson(F.lit(32), F.lit(36)), b=stats.wilson(F.lit(0), F.lit(0)))
    assert w.a.low == pytest.approx(0.74685, abs=1e-5)
    assert tuple(w.b) == (0, 0, 1)
    r = one(spark, z=stats.normal_quantile(F.lit(0.975)), low=stats.normal_quantile(F.lit(0.01)), n=stats.separate(F.lit(0.42), F.lit(0.58)),
            same=stats.separate(F.lit(0.5), F.lit(0.5)), c=stats.comb(F.lit(5), F.lit(2)), t=stats.tie_rate(F.lit(0.5), F.lit(4)))
    assert r.z == pytest.approx(1.959964, abs=1e-6) and r.low == pytest.approx(-2.326348, abs=1e-6)
    assert (r.n, r.same, r.c, r.t) == (153, None, 10, pytest.approx(0.2734375))


def exact_cdf(k, n, p):
    return math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_distribution(spark):
    cases = [(4, 10, 0.5), (32, 36, 0.9), (25, 36, 0.9), (60, 72, 0.9), (56, 72, 0.9), (0, 5, 0.3), (5, 5, 0.3), (-1, 5, 0.3),
             (380, 1000, 0.4), (420, 1000, 0.4), (695, 700, 0.99), (2, 700, 0.01)]
    df = spark.createDataFrame(cases, "k int, n int, p double").withColumn("c", stats.binom_cdf("k", "n", "p"))
    got = {(r.k, r.n, r.p): r.c for r in df.collect()}
    assert got[4, 10, 0.5] == 0.376953125
    for (k, n, p), c in got.items():
        assert c == pytest.approx(exact_cdf(k, n, p), rel=1e-9, abs=1e-15)


def test_large_samples_agree_with_the_series(spark):
    big = spark.createDataFrame([(399_000, 1_000_000), (400_000, 1_000_000), (401_000, 1_000_000)], "k long, n long")
    got = [r.c for r in big.select(stats.binom_cdf("k", "n", 0.4).alias("c")).collect()]
    log_term = lambda n, p, i: (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                                + i * math.log(p) + (n - i) * math.log1p(-p))
    want = [math.fsum(math.exp(log_term(10 ** 6, 0.4, i)) for i in range(394_000, k + 1)) for k in (399_000, 400_000, 401_000)]
    assert got == pytest.approx(want, rel=1e-7)
    # the window route and the long series meet at the switch
    near = spark.createDataFrame([(k, 1370) for k in (500, 530, 548, 560, 600)], "k long, n long")
    for r in near.withColumn("c", stats.binom_cdf("k", "n", 0.4)).collect():
        ways = sum(math.comb(r.n, i) * 2 ** i * 3 ** (r.n - i) for i in range(r.k + 1))
        assert r.c == pytest.approx(float(Fraction(ways, 5 ** r.n)), rel=1e-9)


def test_plan_and_power(spark):
    d = stats.plan(spark, 0.9, 0.8, max_n=120).first()
    assert (d.n, d.fail_at_or_below, round(d.power, 5)) == (78, 65, 0.80818)
    sizes = spark.createDataFrame([(5,), (80,), (3000,)], "n int")
    got = {r.n: r.p for r in sizes.withColumn("p", stats.achieved_power("n", 0.9, 0.8)).collect()}
    assert got[80] == pytest.approx(0.753, abs=1e-3) and got[3000] == pytest.approx(1)
    with pytest.raises(ValueError):
        stats.plan(spark, 0.8, 0.9)


def test_published_verdicts(spark):
    df = spark.createDataFrame([(33, 36), (68, 72), (72, 78), (40, 40), (25, 36), (0, 0)], "k int, n int")
    got = {(r.k, r.n): (r.outcome, r.published_reason) for r in stats.published(df, "k", "n", 0.9).collect()}
    assert got == {(33, 36): ("EXTEND", "downgraded_underpowered"), (68, 72): ("EXTEND", "downgraded_underpowered"),
                   (72, 78): ("PASS", "ok"), (40, 40): ("PASS", "ok"), (25, 36): ("FAIL", "failed"), (0, 0): (None, None)}


def test_phrase_hits_equal_a_full_comparison(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    phrases = [(i, word(rng.randint(3, 6))) for i in range(12)]
    texts = [(i, word(rng.choice([0, 2, 5, 40, 900]))) for i in range(12)] + [(99, "ba" * 5000)]
    p = spark.createDataFrame(phrases, "pid int, phrase string")
    t = spark.createDataFrame(texts, "tid int, body string")
    got = phrase_hits(p, t, ["pid"], ["tid"], "phrase", "body", 3)
    assert rows(got, "pid", "tid") == sorted([(i, j) for i, a in phrases for j, b in texts if a in b], key=repr)


def test_short_phrases_are_found_for_all_places_at_once(monkeypatch):
    """No phrase of a gram or less is looked for in a text by itself, and equal phrases are looked for once."""
    def alone(*_):
        raise AssertionError("a short phrase was searched for in a whole text")

    monkeypatch.setattr(Anchors, "held", alone)
    phrases, texts = ["it's", "été", "a1", "a1", "eightabc", "xyz"], ["it's a1-a1 été", "ba1 a1", "", "a1b", "eightabc", "zeightabc été"]
    groups = np.array([0, 0, 0, 7, 0, 0], np.int64)
    for edges in (False, True):
        found = Anchors(phrases, groups, None, edges).hits(pa.array(texts), pa.array([0, 0, 0, 0, 7, 0], pa.int64()), [])
        want = {(r, p) for r, t in enumerate(texts) for p, x in enumerate(phrases) if groups[p] == (7 if r == 4 else 0)
                and (re.search(rf"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", t) if edges else x in t)}
        assert sorted(zip(*[c.to_pylist() for c in found])) == sorted(want) and want


def test_places_ask_a_table_of_eight_bits_a_byte():
    column, one = pa.array(["abcab", "", "xabc"]), np.zeros(3, np.int64)
    row, found, first = containment.places(column, one, 2, np.full(1 << 13, 255, np.uint8))
    assert list(zip(row.tolist(), first.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 5), (2, 6), (2, 7)]
    bit = int(found[0]) >> 48
    table = np.zeros(1 << 13, np.uint8)
    table[bit >> 3] = 1 << (bit & 7)
    row, _, first = containment.places(column, one, 2, table)
    assert list(zip(row.tolist(), first.tolist())) == [(0, 0), (0, 3), (2, 6)]


def test_word_hits_need_edges(spark):
    p = spark.createDataFrame([(1, "307"), (2, "a-b c"), (3, "x.y")], "pid int, phrase string")
    t = spark.createDataFrame([(1, "code 307."), (2, "13075"), (3, "see a-b c"), (4, "a-b cd"), (5, "xzy x.y")], "tid int, body string")
    assert rows(word_hits(p, t, ["pid"], ["tid"], "phrase", "body"), "pid", "tid") == [(1, 1), (2, 3), (3, 5)]


def test_reading_orders_and_an_unreached_plan(spark):
    from tapelake.operators import admission, calls
    errors = spark.createDataFrame([("2027-01-02", 1), (None, 2), ("2027-01-01", 3)], "t string, i int")
    assert [r.i for r in calls.by_time(errors).collect()] == [2, 3, 1]
    ledger = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "rule string, dropped int")
    assert [r.rule for r in admission.by_dropped(ledger).collect()] == ["c", "a", "b"]
    none = stats.plan(spark, 0.9, 0.8, max_n=20).first()
    assert (none.n, none.searched_to) == (None, 20)


def test_bits_order_as_the_values(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 2.0, 4.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1e22, 2.0 ** 52 + 1]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [2.0 ** k * f for k in range(-1070, 1020, 7) for f in (1, 1.0000000000000002, 1.9999999999999998)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", ordered.ordered_bits(F.col("v"), T.DoubleType()))
    for r in df.collect():
        raw = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b ^ (-1 << 63) == (-raw if r.v < 0 else raw), r.v
    more = spark.createDataFrame([(5, datetime.date(2020, 1, 1), decimal.Decimal("-1.25"))], "i int, d date, m decimal(10,2)")
    kinds = {f.name: f.dataType for f in more.schema}
    got = more.select(*[ordered.ordered_bits(F.col(c), k).bitwiseXOR(F.lit(-1 << 63)).alias(c) for c, k in kinds.items()]).first()
    assert tuple(got) == (5, 18262, -125)


def test_percentiles_of_wide_values_take_several_passes(spark):
    rng = random.Random(11)
    data = [(rng.choice(["a", "a", "a", None]), rng.choice([rng.uniform(-1e9, 1e9), rng.gauss(0, 1e-9), float(rng.randrange(5))]), rng.randrange(1 << 40))
            for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, x double, n long")
    got = {r.g: r for r in ordered.nearest_rank(df, ["g"], {"a": ("x", 0.5), "b": ("x", 0.99), "c": ("n", 0.0), "d": ("n", 1.0), "e": ("n", 0.37)}).collect()}
    for g in ("a", None):
        xs, ns = sorted(x for k, x, _ in data if k == g), sorted(n for k, _, n in data if k == g)
        pick = lambda v, p: v[max(1, math.ceil(p * len(v))) - 1]
        assert tuple(got[g])[1:] == (pick(xs, .5), pick(xs, .99), pick(ns, 0), pick(ns, 1), pick(ns, .37))


@pytest.mark.parametrize("shipped", [containment.SHIPPED_BYTES, 0])
def test_phrases_inside_their_own_group(spark, monkeypatch, shipped):
    monkeypatch.setattr(containment, "SHIPPED_BYTES", shipped)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé漢 ") for _ in range(n))
    phrases = [(rng.choice(["r", "s", None]), i, word(rng.randrange(0, 14))) for i in range(60)] + [("r", 60, None)]
    texts = [(rng.choice(["r", "s", None]), i, word(rng.choice([0, 3, 30, 400]))) for i in range(40)] + [("r", 40, None), ("s", 41, "ab" * 40_000)]
    texts += [("r", 42, phrases[3][2] + "|" + phrases[4][2]), ("r", 43, phrases[5][2][:2])]
    p = spark.createDataFrame(phrases, "run string, pid int, phrase string")
    t = spark.createDataFrame(texts, "run string, tid int, body string").repartition(3)
    got = rows(phrase_hits(p, t, ["pid"], ["tid"], "phrase", "body", 1, ["run"]), "run", "pid", "tid")
    assert got == sorted([(r, i, j) for r, i, a in phrases for s, j, b in texts if r and r == s and a and b and a in b], key=repr)
    everywhere = rows(phrase_hits(p.drop("run"), t.drop("run"), ["pid"], ["tid"], "phrase", "body"), "pid", "tid")
    assert everywhere == sorted([(i, j) for _, i, a in phrases for _, j, b in texts if a and b and a in b], key=repr)
    assert phrase_hits(p.limit(0), t, ["pid"], ["tid"], "phrase", "body").count() == 0


@pytest.mark.parametrize("shipped", [containment.SHIPPED_BYTES, 0])
def test_words_between_edges(spark, monkeypatch, shipped):
    monkeypatch.setattr(containment, "SHIPPED_BYTES", shipped)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab1é -") for _ in range(n))
    phrases = [(i, word(rng.randrange(0, 5))) for i in range(60)]
    texts = [(i, word(rng.choice([0, 3, 12, 60]))) for i in range(60)]
    got = rows(word_hits(spark.createDataFrame(phrases, "pid int, phrase string"), spark.createDataFrame(texts, "tid int, body string"),
                         ["pid"], ["tid"], "phrase", "body"), "pid", "tid")
    found = lambda a, b: re.search("(^|[^a-z0-9])" + re.escape(a) + "($|[^a-z0-9])", b)
    assert got == sorted([(i, j) for i, a in phrases for j, b in texts if re.search("[a-z0-9]", a) and found(a, b)], key=repr)
