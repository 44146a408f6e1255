"""Exact small-sample statistics as column expressions.

``binom_cdf`` has two exact routes. Small counts follow the term-by-term series
from zero, which reproduces dyadic golden values to the last bit. Counts that
would underflow or need a long series start from the closed-form probability at
``k`` (saddle-point form of the binomial density) and add the terms below it
until they no longer count, which is a window of a few standard deviations, so
a group of billions of rows costs no more than its square root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96
SERIES_MAX = 4096


def rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))


def mean(c: Column) -> Column:
    """Mean of the finite values; NULL when there are none."""
    x = c.cast("double")
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def default_detectable(threshold: float) -> float:
    return threshold - 0.1 if threshold - 0.1 > 0 else threshold / 2


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(rate, low, high); an empty sample gives (0, 0, 1)."""
    p = k / n
    zz = z * z
    d = 1 + zz / n
    centre = (p + zz / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    full = n > 0
    return F.struct(
        F.when(full, p).otherwise(F.lit(0.0)).alias("rate"),
        F.when(full, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0)).alias("low"),
        F.when(full, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0)).alias("high"))


# --- binomial -------------------------------------------------------------
#
# These are written as SQL text: k and n are column names or SQL expressions.
# ``transform(array(x), a -> ...)[0]`` works x out once and names it.


def _d(x: float) -> str:
    return f"{float(x)!r}D"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


_STIRLING = "array(" + ", ".join(_d(x) for x in [0.0] + [
    math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]) + ")"


def _stirling_error(n: str) -> str:
    nn = f"({n} * {n})"
    series = (f"({_d(1 / 12)} - ({_d(1 / 360)} - ({_d(1 / 1260)} - ({_d(1 / 1680)} - {_d(1 / 1188)}"
              f" / {nn}) / {nn}) / {nn}) / {nn}) / {n}")
    return f"CASE WHEN {n} <= 15 THEN element_at({_STIRLING}, int(least({n}, 15)) + 1) ELSE {series} END"


def _deviance(x: str, m: str) -> str:
    """x*ln(x/m) + m - x without cancellation near x = m."""
    odd = _d(1 / 19)
    for j in range(8, 0, -1):
        odd = f"({odd} * v * v + {_d(1 / (2 * j + 1))})"
    near = _let("v", f"({x} - {m}) / ({x} + {m})", f"({x} - {m}) * v + 2 * {x} * v * ({odd} * v * v)")
    return f"CASE WHEN abs({x} - {m}) < 0.1D * ({x} + {m}) THEN {near} ELSE {x} * ln({x} / {m}) + {m} - {x} END"


def _pmf(k: str, n: str, p: str) -> str:
    args = (f"named_struct('x', double({k}), 'm', double({n}), 'y', double({n}) - {k}, 'p', {p},"
            f" 'mp', {n} * {p}, 'mq', {n} * (1 - {p}))")
    inner = (f"exp(({_stirling_error('b.m')}) - ({_stirling_error('b.x')}) - ({_stirling_error('b.y')})"
             f" - ({_deviance('b.x', 'b.mp')}) - ({_deviance('b.y', 'b.mq')}))"
             f" * sqrt(b.m / ({_d(2 * math.pi)} * b.x * b.y))")
    return _let("b", args, f"""CASE WHEN b.x < 0 OR b.y < 0 THEN 0D
        WHEN b.p <= 0 THEN double(b.x = 0) WHEN b.p >= 1 THEN double(b.y = 0)
        WHEN b.x = 0 THEN exp(b.m * log1p(-b.p)) WHEN b.y = 0 THEN power(b.p, b.m) ELSE {inner} END""")


def binom_pmf(k: str, n: str, p) -> Column:
    """P(X = k) for any n, without factorials."""
    return F.expr(_pmf(k, n, _p(p)))


def _p(p) -> str:
    return p if isinstance(p, str) else _d(p)


def _sum_terms(first: str, steps: str, factor: str) -> str:
    """first + first*factor(1) + first*factor(1)*factor(2) + ..., at most 1."""
    term = f"CASE WHEN i > 0 THEN s.term * {factor} ELSE s.term END"
    return (f"aggregate(sequence(0L, {steps}), named_struct('term', {first}, 'acc', 0D), "
            f"(s, i) -> {_let('t', term, "named_struct('term', t, 'acc', s.acc + t)")}, s -> least(s.acc, 1D))")


def _series(k: str, n: str, p: str) -> str:
    return _sum_terms(f"power(1 - {p}, double({n}))", k, f"(({n} - i + 1) / i) * ({p} / (1 - {p}))")


def _tail_below(k: str, n: str, p: str) -> str:
    """Sum of terms from k downwards; enough of them to exhaust a double."""
    steps = f"least({k}, bigint(12 * sqrt({n} * {p} * (1 - {p}))) + 60)"
    return _sum_terms(_pmf(k, n, p), steps, f"(({k} - i + 1) * (1 - {p})) / (({n} - {k} + i) * {p})")


def _cdf(k: str, n: str, p: str) -> str:
    # On the far side of the mean the complement is the short tail:
    # P(X <= k) = 1 - P(Y <= n - k - 1) with Y ~ Binomial(n, 1 - p).
    return _let("a", f"named_struct('k', bigint({k}), 'n', bigint({n}), 'p', {p}, 'j', bigint({n} - {k} - 1), 'q', 1 - {p})",
                f"""CASE WHEN a.k < 0 THEN 0D WHEN a.k >= a.n THEN 1D WHEN a.p <= 0 THEN 1D WHEN a.p >= 1 THEN 0D
        WHEN a.n * log1p(-a.p) > -700 AND a.k <= {SERIES_MAX} THEN {_series('a.k', 'a.n', 'a.p')}
        WHEN a.k <= a.n * a.p THEN {_tail_below('a.k', 'a.n', 'a.p')}
        ELSE 1 - {_tail_below('a.j', 'a.n', 'a.q')} END""")


def binom_cdf(k: str, n: str, p) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact for every n."""
    return F.expr(_cdf(k, n, _p(p)))


def outcome_of(k: Column, n: Column, p_value: Column, threshold: float, alpha: float = 0.05) -> Column:
    """PASS / FAIL / EXTEND from counts whose p-value is known; NULL for an empty sample."""
    return (F.when(n <= 0, F.lit(None).cast("string"))
            .when(k / n >= threshold, F.lit("PASS"))
            .when(p_value < alpha, F.lit("FAIL"))
            .otherwise(F.lit("EXTEND")))


def gate_outcome(k: str, n: str, threshold: float, alpha: float = 0.05) -> Column:
    return outcome_of(F.expr(k), F.expr(n), binom_cdf(k, n, threshold), threshold, alpha)


def _critical(n: str, threshold: float, alpha: float) -> str:
    if threshold >= 1:
        return f"({n}) - 1"
    p, q = threshold, 1 - threshold
    odds = _d(p / q)

    def walk(first: str, acc: str, low: str, steps: str) -> str:
        """Add terms upwards from ``low`` and keep the last count still below alpha."""
        term = f"CASE WHEN i > 0 THEN s.term * ((c.n - ({low} + i) + 1) / ({low} + i)) * {odds} ELSE s.term END"
        grown = "CASE WHEN i > 0 THEN s.acc + t ELSE s.acc END"
        step = _let("t", term, _let("g", grown, (
            f"named_struct('term', t, 'acc', g, 'crit', CASE WHEN g < {_d(alpha)} THEN {low} + i ELSE s.crit END)")))
        return (f"aggregate(sequence(0L, {steps}), named_struct('term', {first}, 'acc', {acc}, 'crit', -1L), "
                f"(s, i) -> {step}, s -> s.crit)")

    start = f"power({_d(q)}, double(c.n))"
    exact = walk(start, start, "0L", "c.n - 1")
    # For a larger n the normal quantile is off by a few counts at most, so the
    # walk starts well below it.
    wide = walk(_pmf("c.low", "c.n", _d(p)), _cdf("c.low", "c.n", _d(p)), "c.low", "64L")
    guess = f"bigint({n} * {_d(p)} + {_d(_quantile(alpha))} * sqrt({n} * {_d(p * q)})) - 24"
    return _let("c", f"named_struct('n', bigint({n}), 'low', greatest(0L, {guess}))",
                f"""CASE WHEN c.n <= 0 THEN -1L
        WHEN c.n * {_d(math.log1p(-p))} > -700 AND c.n <= {SERIES_MAX} THEN {exact} ELSE {wide} END""")


def critical_k(n: str, threshold: float, alpha: float = 0.05) -> Column:
    """Largest k that still fails the gate at size n, -1 if none does."""
    return F.expr(_critical(n, threshold, alpha))


def achieved_power(n: str, threshold: float, detectable: float, alpha: float = 0.05) -> Column:
    """P(FAIL) at size n when the true rate is ``detectable``."""
    crit = f"named_struct('k', {_critical(n, threshold, alpha)}, 'n', bigint({n}))"
    return F.expr(_let("e", crit, f"CASE WHEN e.k < 0 THEN 0D ELSE {_cdf('e.k', 'e.n', _d(detectable))} END"))


def plan(spark, threshold: float, detectable: float, alpha: float = 0.05, power: float = 0.8,
         max_n: int = 2000) -> DataFrame:
    """One row: the smallest n from 5 to ``max_n`` whose achieved power is enough; n is NULL if there is none up to ``searched_to``."""
    if not 0 < detectable < threshold <= 1:
        raise ValueError("need 0 < detectable < threshold <= 1")
    sizes = spark.range(5, max_n + 1).select(F.col("id").alias("n"))
    graded = sizes.select(
        "n", critical_k("n", threshold, alpha).alias("fail_at_or_below"),
        achieved_power("n", threshold, detectable, alpha).alias("power"))
    best = graded.agg(F.min_by(F.struct(*graded.columns), F.when(F.col("power") >= power, F.col("n"))).alias("d"))
    return best.select("d.*", F.lit(max_n).alias("searched_to"))


def published(df: DataFrame, k: str, n: str, threshold: float, alpha: float = 0.05,
              power: float = 0.8, detectable: float | None = None) -> DataFrame:
    """Add the verdict and its publication rule.

    A raw PASS stays one only if its interval clears the threshold or the size
    has enough power. Power depends on n alone, so it is worked out once per
    distinct n and joined back.
    """
    if detectable is None:
        detectable = default_detectable(threshold)
    kc, nc = F.col(k), F.col(n)
    powers = df.select(nc.cast("long").alias("__n")).where("__n > 0").distinct().withColumn(
        "achieved_power", achieved_power("__n", threshold, detectable, alpha))
    w = wilson(kc, nc)
    out = df.join(powers, nc.cast("long") == F.col("__n"), "left").drop("__n")
    out = out.withColumn("raw_outcome", gate_outcome(k, n, threshold, alpha))
    weak = (F.col("raw_outcome") == "PASS") & (w["low"] < threshold) & (F.col("achieved_power") < power)
    return (out
            .withColumn("wilson_low", w["low"]).withColumn("wilson_high", w["high"])
            .withColumn("downgraded", F.coalesce(weak, F.lit(False)))
            .withColumn("outcome", F.when(F.col("downgraded"), F.lit("EXTEND")).otherwise(F.col("raw_outcome")))
            .withColumn("published_reason",
                        F.when(F.col("raw_outcome").isNull(), F.lit(None).cast("string"))
                        .when(F.col("downgraded"), "downgraded_underpowered")
                        .when(F.col("raw_outcome") == "PASS", "ok")
                        .when(F.col("raw_outcome") == "FAIL", "failed")
                        .otherwise("under_resolved")))


# --- normal quantile and sample sizes -------------------------------------

# Coefficients of the rational approximation of the normal quantile.
CENTRE_NUM = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
              1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
CENTRE_DEN = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
              6.680131188771972e1, -1.328068155288572e1)
TAIL_NUM = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_DEN = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)
TAIL_CUT = 0.02425


def _poly(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _quantile(q: float) -> float:
    """The same approximation for one parameter."""
    if q < TAIL_CUT or q > 1 - TAIL_CUT:
        u = math.sqrt(-2 * math.log(min(q, 1 - q)))
        tail = _poly(TAIL_NUM, u) / _poly((*TAIL_DEN, 1.0), u)
        return tail if q < TAIL_CUT else -tail
    u = q - 0.5
    return _poly(CENTRE_NUM, u * u) * u / _poly((*CENTRE_DEN, 1.0), u * u)


def normal_quantile(q: Column) -> Column:
    u = F.sqrt(-2 * F.ln(F.least(q, 1 - q)))
    tail = _poly([F.lit(c) for c in TAIL_NUM], u) / _poly([F.lit(c) for c in (*TAIL_DEN, 1.0)], u)
    v = q - 0.5
    centre = _poly([F.lit(c) for c in CENTRE_NUM], v * v) * v / _poly([F.lit(c) for c in (*CENTRE_DEN, 1.0)], v * v)
    return (F.when((q <= 0) | (q >= 1), F.lit(None).cast("double"))
            .when(q < TAIL_CUT, tail).when(q > 1 - TAIL_CUT, -tail).otherwise(centre))


def separate(p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Sample size per group that tells two rates apart; NULL for equal or degenerate rates."""
    za, zb = _quantile(1 - alpha / 2), _quantile(power)
    mid = (p1 + p2) / 2
    need = za * F.sqrt(2 * mid * (1 - mid)) + zb * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    usable = (p1 > 0) & (p1 < 1) & (p2 > 0) & (p2 < 1) & (p1 != p2)
    return F.when(usable, F.ceil(need * need / ((p1 - p2) * (p1 - p2))))


def comb(n: Column, k: Column) -> Column:
    short = F.least(k, n - k).cast("long")
    grown = F.aggregate(
        F.sequence(F.lit(0).cast("long"), short), F.lit(1.0),
        lambda r, i: F.when(i > 0, r * (n - short + i) / i).otherwise(r))
    return F.when((k < 0) | (k > n), F.lit(0.0)).otherwise(grown)


def tie_rate(base: Column, reps: Column) -> Column:
    """Chance that two suites of ``reps`` tasks at one base rate score the same."""
    def add(total, k):
        p = comb(reps, k) * F.pow(base, k.cast("double")) * F.pow(1 - base, (reps - k).cast("double"))
        return total + p * p
    return F.aggregate(F.sequence(F.lit(0).cast("long"), reps.cast("long")), F.lit(0.0), add)
