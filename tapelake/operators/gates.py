"""Validity gates over recorded measurements."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.functions import stats, typed
from tapelake.operators.ordered import equi_join, nearest_rank, row_number, running_sum
from tapelake.session import written

MIN_SUITE = 8  # fixed value: fewest tasks a suite may hold
MAX_ERROR_RATE = 0.05  # fixed value: share of failed calls beyond which a gate measured nothing


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int,
               columns: Sequence[str], name: str) -> DataFrame:
    """The first ``keep`` rows per group as an ordered array.

    The row limit per group is found by its place in the group's order, so only
    ``keep`` rows per group are ever put together.
    """
    entry = F.struct(*order, *[c for c in columns if c not in order])
    placed = row_number(df, keys, order, "__rn").where(F.col("__rn") <= keep)
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))


def equals(answer: Column, want: Column) -> Column:
    """Default comparison of recorded answers (both already text)."""
    return answer.eqNullSafe(want)


def null_counts(rows: DataFrame, keys: Sequence[str], label: str, passed: Column) -> DataFrame:
    """Pooled k of n per null model."""
    return rows.groupBy(*keys, label).agg(
        F.count_if(passed).alias("k"), F.count(F.lit(1)).alias("n"))


def null_verdict(noise: Column, signal: Column, ratio: float = 0.5) -> Column:
    return (F.when(noise.isNull() | signal.isNull() | (signal == 0), "INDETERMINATE")
            .when(noise >= ratio * signal, "KILL").otherwise("PROCEED"))


def null_baseline(nulls: DataFrame, signals: DataFrame, keys: Sequence[str] = ("run_id",),
                  fraction: float = 0.95, ratio: float = 0.5) -> DataFrame:
    """Noise floor of the null models against the agent's own rate.

    nulls: keys, label, k, n. signals: keys, k, n.
    """
    rated = nulls.withColumn("rate", F.when(F.col("n") > 0, F.col("k") / F.col("n")))
    floor = nearest_rank(rated, keys, {"noise": ("rate", fraction)}, [
        F.max_by(F.when(F.col("n") > 0, F.struct("label", "rate")), F.struct("rate", "label")).alias("worst")])
    joined = equi_join(
        signals.select(*keys, F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("signal")), floor, keys, "left")
    verdict = null_verdict(F.col("noise"), F.col("signal"), ratio)
    return joined.select(
        *keys, "noise", "signal", (ratio * F.col("signal")).alias("kill_at"), verdict.alias("outcome"),
        (verdict == "PROCEED").alias("ok"),
        F.when(verdict == "PROCEED", "ok").when(verdict == "KILL", "noise_exceeds_signal")
        .when(F.col("noise").isNull() | F.col("signal").isNull(), "no_measurements")
        .otherwise("degenerate_no_signal").alias("reason"), F.col("worst.label").alias("worst_label"))


def worst_null(nulls: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The null model with the highest rate, the earliest one on a tie."""
    rated = nulls.where("n > 0").withColumn("rate", F.col("k") / F.col("n"))
    return rated.groupBy(*keys).agg(
        F.max_by(F.struct("label", "k", "n", "rate"), F.struct("rate", -F.col(order))).alias("worst"))


def construct_reason(k: str, n: str, errors: str, p_value: str, min_rate: float = 0.9, alpha: float = 0.05,
                     max_error_rate: float = MAX_ERROR_RATE) -> Column:
    """Typed reason from counts and p-value columns."""
    kc, nc, ec = F.col(k), F.col(n), F.col(errors)
    outcome = stats.outcome_of(kc, nc, F.col(p_value), min_rate, alpha)
    return (F.when(stats.rate(ec, nc + ec) > max_error_rate, "compromised")
            .when(nc == 0, "no_cases")
            .when(outcome == "PASS", "ok")
            .when(outcome == "EXTEND", "under_resolved")
            .otherwise("below_min_rate"))


def construct(trials: DataFrame, keys: Sequence[str], intended: Column, error: Column,
              min_rate: float = 0.9, alpha: float = 0.05) -> DataFrame:
    """Does the reference reach the answer key? One row per key with the typed reason."""
    ran = error.isNull()
    counted = trials.groupBy(*keys).agg(
        F.count_if(ran).alias("n"), F.count_if(ran & intended).alias("k"), F.count_if(~ran).alias("errors"))
    return with_construct_reason(counted, min_rate, alpha)


def with_construct_reason(counted: DataFrame, min_rate: float = 0.9, alpha: float = 0.05) -> DataFrame:
    n, k, e = F.col("n"), F.col("k"), F.col("errors")
    return (counted
            .withColumn("rate", stats.rate(k, n)).withColumn("error_rate", stats.rate(e, n + e))
            .withColumn("p_value", F.when(n > 0, stats.binom_cdf("k", "n", min_rate)))
            .withColumn("reason", construct_reason("k", "n", "errors", "p_value", min_rate, alpha))
            .withColumn("ok", F.col("reason") == "ok"))


def pool(parts: DataFrame, keys: Sequence[str], min_rate: float = 0.9, alpha: float = 0.05) -> DataFrame:
    """Sum the counts of a suite and its extensions, then decide once. parts: keys, n, k, errors."""
    summed = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("errors").alias("errors"))
    return with_construct_reason(summed, min_rate, alpha)


def pooled_steps(parts: DataFrame, keys: Sequence[str], order: Sequence[str], min_rate: float = 0.9,
                 alpha: float = 0.05) -> DataFrame:
    """Per part: the pooled counts before and after it, each with its verdict."""
    parts = written(parts, "parts")
    sums = running_sum(parts, keys, order, {"k_after": "k", "n_after": "n", "errors_after": "errors"})
    out = sums
    for c in ("k", "n", "errors"):
        out = out.withColumn(f"{c}_before", F.col(f"{c}_after") - F.col(c))
    for side in ("before", "after"):
        names = [f"{c}_{side}" for c in ("k", "n", "errors", "p_value")]
        out = out.withColumn(names[3], F.when(F.col(names[1]) > 0, stats.binom_cdf(names[0], names[1], min_rate)))
        out = out.withColumn(f"reason_{side}", construct_reason(*names, min_rate, alpha))
    return out


def resolve_extension(reason: Column, consumed: Column, size: Column, most: Column, blocked: Column) -> Column:
    """What an unresolved gate does next: struct(extend, reason, resolved_to_fail, outcome)."""
    open_ = (reason == "under_resolved") & (size > 0) & (most - consumed > 0)
    none = F.lit(None).cast("string")
    never = (most == 0) | (size == 0)
    label = (F.when(reason != "under_resolved", reason)
             .when(open_ & blocked, "under_resolved_not_extended")
             .when(open_ | never, "under_resolved")
             .otherwise("unresolved_after_max_extensions"))
    outcome = (F.when(reason == "compromised", "COMPROMISED").when(reason == "ok", none)
               .when(reason != "under_resolved", "GATE_FAILED").when(open_, none)
               .when(never, "EXTEND_EXHAUSTED").otherwise("GATE_FAILED"))
    return F.struct(
        (open_ & ~blocked).alias("extend"), label.alias("reason"),
        (label == "unresolved_after_max_extensions").alias("resolved_to_fail"), outcome.alias("outcome"))


def variance(trials: DataFrame, keys: Sequence[str], wrong: Column, oracle_error: Column, truth_error: Column,
             min_error_rate: float = 0.05) -> DataFrame:
    """Is there anything to attribute? Ceiling and floor suites carry no information."""
    bad_oracle = oracle_error.isNotNull()
    bad_truth = ~bad_oracle & truth_error.isNotNull()
    ran = ~bad_oracle & ~bad_truth
    out = trials.groupBy(*keys).agg(
        F.count_if(ran).alias("n"), F.count_if(ran & wrong).alias("n_wrong"),
        F.count_if(bad_oracle).alias("oracle_errors"), F.count_if(bad_truth).alias("truth_errors"))
    n, w = F.col("n"), F.col("n_wrong")
    return (out.withColumn("error_rate", stats.rate(w, n)).withColumn("interval", stats.wilson(w, n))
            .withColumn("reason", F.when(n == 0, "no_cases").when(w == n, "at_floor").when(w == 0, "at_ceiling")
                        .when(stats.rate(w, n) < min_error_rate, "below_min_error_rate").otherwise("ok"))
            .withColumn("ok", F.col("reason") == "ok"))


def structural(candidates: DataFrame, keys: Sequence[str], generated: Column, holds: Column,
               min_generated: int = MIN_SUITE, min_admission: float = 0.25) -> DataFrame:
    """Enough candidates, all of which hold; a predicate that failed to run is NULL and does not hold."""
    out = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(generated).alias("generated"),
        F.count_if(generated & F.coalesce(holds, F.lit(False))).alias("holding"))
    r, g, h = F.col("requested"), F.col("generated"), F.col("holding")
    return (out.withColumn("admission_rate", stats.rate(g, r)).withColumn("hold_rate", stats.rate(h, g))
            .withColumn("reason", F.when(g == 0, "no_cases_generated").when(h != g, "property_violated")
                        .when(g < min_generated, "too_few_generated")
                        .when(stats.rate(g, r) < min_admission, "admission_rate_below_minimum").otherwise("ok"))
            .withColumn("ok", F.col("reason") == "ok"))


# --- order invariance -----------------------------------------------------------

# Up to this many answers per item the maximum is taken over answer subsets; a bound on the arrays inside a row, not on the result.
SUBSET_ANSWERS = 12


def order_invariance(answers: DataFrame, item: Sequence[str], ordering: str, key: str, seq: str,
                     threshold: float | None = None) -> DataFrame:
    """Does the answer depend on the order of the input?

    answers: item, ordering (0 is the order as given), seq, key (NULL: the call
    failed). Per item: modal answer of the first answered ordering, the largest
    pairwise total variation, and a verdict.
    """
    calls = answers.groupBy(*item).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col(key).isNull()).alias("errors"))
    counts = written(answers.where(F.col(key).isNotNull()).groupBy(*item, ordering, key).agg(
        F.count(F.lit(1)).alias("c"), F.min(seq).alias("first_seq")), "answers")
    modal = counts.groupBy(*item, ordering).agg(
        F.max_by(key, F.struct("c", -F.col("first_seq"))).alias("modal"))
    shape = modal.groupBy(*item).agg(
        F.count(F.lit(1)).alias("orderings"), F.min_by("modal", ordering).alias("value"),
        (F.min("modal") != F.max("modal")).alias("modal_differs"))
    spread = max_variation(counts.select(*item, ordering, key, "c"), item, ordering, key)
    out = equi_join(equi_join(calls, shape, item, "left", nulls=False), spread, item, "left", nulls=False)
    ran = F.coalesce("orderings", F.lit(0)) >= 2
    dispersion = F.when(ran, F.coalesce("dispersion", F.lit(0.0))).otherwise(0.0)
    moved = F.col("modal_differs") if threshold is None else dispersion > threshold
    unstable = F.when(ran, moved).otherwise(F.lit(False))
    return out.select(
        *item, "calls", "errors", F.coalesce("orderings", F.lit(0)).alias("orderings"), "value",
        dispersion.alias("dispersion"), unstable.alias("unstable"),
        F.when(~ran, "not_applicable").when(unstable, "unstable").otherwise("stable").alias("verdict"))


def max_variation(counts: DataFrame, item: Sequence[str], ordering: str, key: str) -> DataFrame:
    """Largest total variation between any two orderings of an item, whose distinct distributions (orderings times answers) one row holds.

    Total variation is the largest difference two distributions can have on a subset of answers, so the maximum over all pairs is, per subset,
    the highest minus the lowest probability any ordering gives it. The sums over all subsets are built inside the row, answer by answer, and
    highest and lowest are kept element by element, so no pair of orderings is formed. A subset and its complement differ alike, which leaves one
    answer out. Items of more than SUBSET_ANSWERS answers would need too many subsets; see ``farthest``.
    """
    shares = counts.groupBy(*item, ordering).agg(F.sum("c").alias("__n"), F.array_sort(F.collect_list(F.struct(key, "c"))).alias("__c"))
    shares = shares.select(*item, F.transform("__c", lambda e: F.struct(e[key].alias("k"), (e["c"] / F.col("__n")).alias("p"))).alias("__d"))
    rows = shares.groupBy(*item).agg(F.collect_set("__d").alias("__ds"))  # equal distributions count once
    rows = rows.withColumn("__keys", F.array_sort(F.array_distinct(F.flatten(F.transform("__ds", lambda d: F.transform(d, lambda e: e["k"]))))))

    def aligned(keys: Column) -> Column:
        return F.transform("__ds", lambda d: typed.let(F.map_from_entries(d), lambda m: F.transform(
            keys, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))))

    def sums(vector: Column) -> Column:
        return F.aggregate(vector, F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.transform(acc, lambda x: x + p)))

    def widest(vectors: Column) -> Column:
        first = sums(F.get(vectors, F.lit(0)))
        ends = F.aggregate(vectors, F.struct(first.alias("low"), first.alias("high")), lambda acc, v: typed.let(sums(v), lambda s: F.struct(
            F.zip_with(acc["low"], s, lambda a, b: F.least(a, b)).alias("low"), F.zip_with(acc["high"], s, lambda a, b: F.greatest(a, b)).alias("high"))))
        return typed.let(ends, lambda e: F.array_max(F.zip_with(e["high"], e["low"], lambda h, n: h - n)))

    few = F.size("__keys") <= SUBSET_ANSWERS
    rows = rows.withColumn("__v", aligned(F.when(few, F.slice("__keys", F.lit(1), F.greatest(F.size("__keys") - 1, F.lit(0)))).otherwise(F.col("__keys"))))
    wide = farthest(F.when(~few, F.col("__v")))
    return rows.select(*item, F.when(few, widest(F.col("__v"))).otherwise(wide).alias("dispersion"))


@F.pandas_udf(T.DoubleType())
def farthest(distributions: pd.Series) -> pd.Series:
    """Largest total variation within each list of distributions, by branch and bound.

    Two distributions are no farther apart than their distances from the mean together. Taken by falling distance, a distribution is compared with
    those before it whose distances can still beat the best pair, and the rest is left out once no pair of it can.
    """
    def one(rows) -> float | None:
        if rows is None:
            return None
        p = np.stack([np.asarray(r, float) for r in rows])
        radius = np.abs(p - p.mean(axis=0)).sum(axis=1) / 2
        order = np.argsort(-radius, kind="stable")
        p, radius = p[order], radius[order]
        best = 0.0
        for i in range(1, len(p)):
            if radius[i] + radius[0] <= best:
                break
            near = int(np.searchsorted(-radius[:i], radius[i] - best, side="left"))  # those with radius + radius[i] > best
            if near:
                best = max(best, float(np.abs(p[:near] - p[i]).sum(axis=1).max() / 2))
        return best
    return distributions.map(one)


# --- ledger -----------------------------------------------------------------------

SURFACE_GATES = ("structural", "suite_size")


def suite_size_reason(tasks: Column, screened_out: Column, minimum: int = MIN_SUITE) -> Column:
    """A short suite the null screen explains is a different finding from a thin one."""
    return (F.when(tasks >= minimum, "ok")
            .when((screened_out > 0) & (tasks + screened_out >= minimum), "all_candidates_null_answerable")
            .otherwise("below_minimum_suite_size"))


def gate_outcome_code(gate: Column, reason: Column) -> Column:
    """The run outcome a refusing gate stands for."""
    return (F.when(reason == "compromised", "COMPROMISED")
            .when((gate == "structural") & (reason == "too_few_generated"), "INSUFFICIENT_SURFACE")
            .when((gate == "suite_size") & (reason == "all_candidates_null_answerable"), "DEGENERATE")
            .when(gate == "suite_size", "INSUFFICIENT_SURFACE")
            .when((gate == "null_baseline") & (reason == "noise_exceeds_signal"), "DEGENERATE")
            .when(gate == "null_baseline", "INDETERMINATE")
            .when((gate == "construct") & (reason == "under_resolved"), "EXTEND_EXHAUSTED")
            .otherwise("GATE_FAILED"))


def run_outcomes(ledger: DataFrame, driven: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """First refusing gate and outcome of each run.

    ledger: keys, seq, gate, ok, reason. driven: keys, tasks_driven. Hygiene and
    the power row never refuse. A structural count the null screen explains is
    left to suite_size. A compromised construct gate renames any outcome, and a
    leaked answer key any but that one.
    """
    silent = F.col("gate").isin("protocol_hygiene", "plan_power") | (F.col("reason") == "under_resolved_not_extended")
    refusing = ~F.col("ok") & ~silent
    counted = (F.col("gate") == "structural") & (F.col("reason") != "property_violated")
    row = F.struct("gate", "reason")
    first_of = lambda c: F.min_by(F.when(c, row), F.when(c, F.col("seq")))
    first = ledger.groupBy(*keys).agg(
        first_of(refusing).alias("__any"), first_of(refusing & ~counted).alias("__later"),
        F.bool_or(F.col("reason") == "all_candidates_null_answerable").alias("__explained"),
        F.bool_or((F.col("gate") == "construct") & (F.col("reason") == "compromised")).alias("compromised"),
        F.bool_or((F.col("gate") == "answer_leak") & ~F.col("ok")).alias("leaked"))
    first = first.withColumn("r", F.when(F.col("__explained"), F.col("__later")).otherwise(F.col("__any")))
    out = equi_join(first, driven, keys, "left")
    outcome = (F.when(F.col("compromised"), "COMPROMISED").when(F.col("leaked"), "GATE_FAILED")
               .when(F.col("r").isNotNull(), gate_outcome_code(F.col("r.gate"), F.col("r.reason")))
               .when(F.coalesce("tasks_driven", F.lit(0)) == 0, "INDETERMINATE").otherwise("SCORED"))
    return out.select(*keys, F.col("r.gate").alias("refused_at"), F.col("r.reason").alias("reason"),
                      outcome.alias("outcome"))


def free_gates(suites: DataFrame, required_n: int) -> DataFrame:
    """Answer-leak, suite-size and power rows of the ledger.

    suites: run_id, tasks, leaks, screened_out.
    """
    size = suite_size_reason(F.col("tasks"), F.col("screened_out"))
    rows = F.array(
        F.struct(F.lit("answer_leak").alias("gate"), (F.col("leaks") == 0).alias("ok"),
                 F.when(F.col("leaks") == 0, "ok").otherwise("answer_in_prompt").alias("reason")),
        F.struct(F.lit("suite_size").alias("gate"), (size == "ok").alias("ok"), size.alias("reason")),
        F.struct(F.lit("plan_power").alias("gate"), F.lit(True).alias("ok"),
                 F.when(F.col("tasks") >= required_n, "ok").otherwise("underpowered_recorded").alias("reason")))
    return suites.select("run_id", F.posexplode(rows).alias("seq", "g")).select("run_id", "seq", "g.*")


def audit_rows(verdicts: DataFrame, reachable: Sequence[str] = ("structural",)) -> DataFrame:
    """How a check did on each labelled suite.

    verdicts: name, valid, catchable_by, said_valid (NULL: the check failed to run).
    """
    v, s = F.col("valid"), F.col("said_valid")
    finding = (F.when(s.isNull(), "error").when(v & s, "passed_valid").when(v, "false_alarm")
               .when(s, "missed").otherwise("caught"))
    reach = v | F.coalesce(F.col("catchable_by").isin(*reachable), F.lit(False))
    return verdicts.withColumn("finding", finding).withColumn("reachable", reach)


def audit_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of each finding; ok when nothing reachable was missed, flagged wrongly or failed to run."""
    is_ = lambda f: F.col("finding") == f
    out = rows.groupBy(*keys).agg(
        *[F.count_if(is_(f)).alias(n) for f, n in (
            ("caught", "caught"), ("missed", "missed"), ("false_alarm", "false_alarms"),
            ("passed_valid", "passed_valid"), ("error", "errors"))],
        F.count_if(~F.col("reachable")).alias("unreachable"),
        F.count_if(is_("missed") & F.col("reachable")).alias("reachable_missed"))
    return out.withColumn("ok", F.col("reachable_missed") + F.col("false_alarms") + F.col("errors") == 0)
