import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapelake.operators import gates


def test_construct_reasons(spark):
    counts = [("pass", 40, 40, 0), ("extend", 32, 36, 0), ("fail", 25, 36, 0), ("broken", 40, 40, 3), ("none", 0, 0, 0), ("alldead", 0, 0, 2)]
    df = spark.createDataFrame(counts, "g string, k int, n int, errors int")
    got = dict(rows(gates.with_construct_reason(df), "g", "reason"))
    assert got == {"pass": "ok", "extend": "under_resolved", "fail": "below_min_rate", "broken": "compromised",
                   "none": "no_cases", "alldead": "compromised"}


def test_pooled_steps(spark, group_limit):
    parts = [("r", i, k, n, 0) for i, (k, n) in enumerate([(32, 36), (6, 6), (6, 6), (2, 12), (5, 6)])]
    df = spark.createDataFrame(parts, "run_id string, i int, k long, n long, errors long")
    got = {r.i: r for r in gates.pooled_steps(df, ["run_id"], ["i"]).collect()}
    assert [(got[i].k_after, got[i].n_after) for i in range(5)] == [(32, 36), (38, 42), (44, 48), (46, 60), (51, 66)]
    assert [got[i].reason_after for i in range(5)] == ["under_resolved", "ok", "ok", "below_min_rate", "below_min_rate"]
    assert (got[0].reason_before, got[1].reason_before) == ("no_cases", "under_resolved")


def test_extension_decisions(spark):
    cases = [("under_resolved", 0, 6, 2, False, True, "under_resolved", None),
             ("under_resolved", 2, 6, 2, False, False, "unresolved_after_max_extensions", "GATE_FAILED"),
             ("under_resolved", 1, 6, 2, True, False, "under_resolved_not_extended", None),
             ("under_resolved", 0, 0, 2, False, False, "under_resolved", "EXTEND_EXHAUSTED"),
             ("compromised", 0, 6, 2, False, False, "compromised", "COMPROMISED"),
             ("ok", 0, 6, 2, False, False, "ok", None),
             ("below_min_rate", 0, 6, 2, False, False, "below_min_rate", "GATE_FAILED")]
    df = spark.createDataFrame(cases, "reason string, used int, size int, most int, blocked boolean, extend boolean, label string, outcome string")
    got = df.withColumn("g", gates.resolve_extension(*[F.col(c) for c in ("reason", "used", "size", "most", "blocked")]))
    for r in got.collect():
        assert (r.g.extend, r.g.reason, r.g.outcome) == (r.extend, r.label, r.outcome), r


def test_null_baseline(spark, group_limit):
    nulls = [("kill", "a", 5, 10), ("kill", "b", 1, 10), ("go", "a", 1, 10), ("flat", "a", 0, 10), ("unmeasured", "a", 0, 0)]
    signals = [("kill", 8, 10), ("go", 8, 10), ("flat", 0, 10), ("unmeasured", 5, 10), ("noagent", 0, 0)]
    n = spark.createDataFrame(nulls, "run_id string, label string, k int, n int")
    s = spark.createDataFrame(signals, "run_id string, k int, n int")
    got = {r.run_id: (r.outcome, r.reason) for r in gates.null_baseline(n, s).collect()}
    assert got == {"kill": ("KILL", "noise_exceeds_signal"), "go": ("PROCEED", "ok"),
                   "flat": ("INDETERMINATE", "degenerate_no_signal"), "unmeasured": ("INDETERMINATE", "no_measurements"),
                   "noagent": ("INDETERMINATE", "no_measurements")}
    worst = gates.worst_null(n.withColumn("seq", F.monotonically_increasing_id()), ["run_id"], "seq")
    assert {r.run_id: r.worst.label for r in worst.collect()}["kill"] == "a"


def test_variance_reasons(spark):
    data = ([("floor", True, None, None)] * 3 + [("ceiling", False, None, None)] * 3 + [("low", False, None, None)] * 40
            + [("low", True, None, None)] + [("fine", True, None, None), ("fine", False, None, None), ("fine", False, "x", None),
                                            ("fine", False, None, "y")] + [("dead", False, "x", "y")])
    df = spark.createDataFrame(data, "g string, wrong boolean, oe string, te string")
    got = {r.g: r for r in gates.variance(df, ["g"], F.col("wrong"), F.col("oe"), F.col("te")).collect()}
    assert {g: r.reason for g, r in got.items()} == {
        "floor": "at_floor", "ceiling": "at_ceiling", "low": "below_min_error_rate", "fine": "ok", "dead": "no_cases"}
    assert (got["fine"].oracle_errors, got["fine"].truth_errors, got["dead"].truth_errors) == (1, 1, 0)


def test_structural_reasons(spark):
    make = lambda g, made, holds, rest: [(g, True, True)] * holds + [(g, True, False)] * (made - holds) + [(g, False, None)] * rest
    data = make("none", 0, 0, 5) + make("bad", 9, 8, 0) + make("few", 7, 7, 0) + make("thin", 9, 9, 40) + make("ok", 9, 9, 3)
    df = spark.createDataFrame(data, "g string, made boolean, holds boolean")
    got = dict(rows(gates.structural(df, ["g"], F.col("made"), F.col("holds")), "g", "reason"))
    assert got == {"none": "no_cases_generated", "bad": "property_violated", "few": "too_few_generated",
                   "thin": "admission_rate_below_minimum", "ok": "ok"}


def variation(counts):
    worst = 0.0
    for a, b in itertools.combinations(counts.values(), 2):
        na, nb = sum(a.values()), sum(b.values())
        worst = max(worst, 0.5 * sum(abs(a.get(k, 0) / na - b.get(k, 0) / nb) for k in {*a, *b}))
    return worst


@pytest.mark.parametrize("alphabet", ["abc", "abcdefghijklmnopqrstu"])
def test_order_invariance(spark, alphabet):
    rng = random.Random(8)
    data, counts, modal = [], {}, {}
    for item in range(6):
        for o in range(rng.randint(1, 4)):
            for s in range(6):
                key = None if rng.random() < 0.2 else rng.choice(alphabet)
                data.append((item, o, o * 100 + s, key))
                if key:
                    c = counts.setdefault(item, {}).setdefault(o, {})
                    c[key] = c.get(key, 0) + 1
    for item, by_order in counts.items():
        modal[item] = {o: max(c, key=lambda k: c[k]) for o, c in by_order.items()}
    df = spark.createDataFrame(data, "item int, o int, seq int, key string")
    got = {r.item: r for r in gates.order_invariance(df, ["item"], "o", "key", "seq").collect()}
    for item, by_order in counts.items():
        r = got[item]
        assert r.orderings == len(by_order) and r.value == modal[item][min(by_order)]
        if len(by_order) < 2:
            assert r.verdict == "not_applicable" and r.dispersion == 0
        else:
            assert r.dispersion == pytest.approx(variation(by_order))
            assert r.verdict == ("unstable" if len(set(modal[item].values())) > 1 else "stable")


def test_run_outcomes(spark):
    ledger = [
        ("ok", 0, "structural", True, "ok"), ("ok", 1, "protocol_hygiene", False, "x"),
        ("thin", 0, "structural", False, "too_few_generated"), ("thin", 1, "suite_size", False, "below_minimum_suite_size"),
        ("emptied", 0, "structural", False, "too_few_generated"), ("emptied", 1, "suite_size", False, "all_candidates_null_answerable"),
        ("broken", 0, "structural", False, "property_violated"),
        ("leaky", 0, "structural", False, "too_few_generated"), ("leaky", 1, "answer_leak", False, "answer_in_prompt"),
        ("dead", 0, "suite_size", False, "below_minimum_suite_size"), ("dead", 1, "construct", False, "compromised"),
        ("noise", 0, "null_baseline", False, "noise_exceeds_signal"), ("quiet", 0, "null_baseline", False, "no_measurements"),
        ("spent", 0, "construct", False, "under_resolved"), ("undriven", 0, "structural", True, "ok")]
    df = spark.createDataFrame(ledger, "run_id string, seq int, gate string, ok boolean, reason string")
    driven = df.select("run_id").distinct().withColumn("tasks_driven", F.when(F.col("run_id") == "undriven", 0).otherwise(5))
    got = {r.run_id: (r.refused_at, r.outcome) for r in gates.run_outcomes(df, driven).collect()}
    assert got == {
        "ok": (None, "SCORED"), "thin": ("structural", "INSUFFICIENT_SURFACE"), "emptied": ("suite_size", "DEGENERATE"),
        "broken": ("structural", "GATE_FAILED"), "leaky": ("structural", "GATE_FAILED"), "dead": ("suite_size", "COMPROMISED"),
        "noise": ("null_baseline", "DEGENERATE"), "quiet": ("null_baseline", "INDETERMINATE"),
        "spent": ("construct", "EXTEND_EXHAUSTED"), "undriven": (None, "INDETERMINATE")}


def test_free_gates_and_audit(spark):
    suites = spark.createDataFrame([("a", 9, 0, 0), ("b", 3, 1, 6), ("c", 3, 0, 1)], "run_id string, tasks int, leaks int, screened_out int")
    got = {(r.run_id, r.gate): (r.ok, r.reason) for r in gates.free_gates(suites, 78).collect()}
    assert got["a", "suite_size"] == (True, "ok") and got["a", "plan_power"] == (True, "underpowered_recorded")
    assert got["b", "answer_leak"] == (False, "answer_in_prompt")
    assert got["b", "suite_size"] == (False, "all_candidates_null_answerable")
    assert got["c", "suite_size"] == (False, "below_minimum_suite_size")
    labelled = [("unsolvable", False, "structural", False), ("disagrees", False, None, True), ("chain", True, None, True), ("odd", True, None, None)]
    df = spark.createDataFrame(labelled, "name string, valid boolean, catchable_by string, said_valid boolean")
    s = gates.audit_summary(gates.audit_rows(df)).first()
    assert (s.caught, s.missed, s.passed_valid, s.errors, s.unreachable, s.reachable_missed, s.ok) == (1, 1, 1, 1, 1, 0, False)


def test_first_rows_are_bounded(spark, group_limit):
    df = spark.createDataFrame([("g", i, f"d{i}") for i in range(20)] + [("h", 1, "x")], "g string, i int, d string")
    got = {r.g: [(e.i, e.d) for e in r.few] for r in gates.first_rows(df, ["g"], ["i"], 3, ["d"], "few").collect()}
    assert got == {"g": [(0, "d0"), (1, "d1"), (2, "d2")], "h": [(1, "x")]}


def test_many_answers_and_orderings(spark):
    rng = random.Random(21)
    data, counts = [], {}
    for item, (answers, orderings) in enumerate([(40, 200), (12, 60), (13, 1), (2, 90)]):
        for o in range(orderings):
            for s in range(rng.randrange(1, 30)):
                key = f"k{rng.choice([rng.randrange(answers), o % answers])}"
                data.append((item, o, s, key))
                c = counts.setdefault(item, {}).setdefault(o, {})
                c[key] = c.get(key, 0) + 1
    df = spark.createDataFrame(data, "item int, o int, seq int, key string")
    got = {r.item: r.dispersion for r in gates.order_invariance(df, ["item"], "o", "key", "seq").collect()}
    assert got == {item: pytest.approx(variation(by_order)) for item, by_order in counts.items()}


def test_farthest_distributions_equal_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(60):
        p = rng.dirichlet(np.full(rng.integers(2, 30), rng.choice([0.05, 0.5, 5])), rng.integers(1, 40))
        want = max([np.abs(a - b).sum() / 2 for a in p for b in p])
        assert gates.farthest.func(pd.Series([[list(x) for x in p], None])).tolist()[0] == pytest.approx(want)
