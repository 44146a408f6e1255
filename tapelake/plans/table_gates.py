"""Statistics, gates and scores over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import stats
from tapelake.operators import admission, audit, board, gates, score
from tapelake.plans.registry import day, query, table

Z = "1.96"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """SQL text of the two ends of the interval (n > 0)."""
    p, d = f"(CAST({k} AS DOUBLE) / {n})", f"(1 + {Z} * {Z} / {n})"
    centre = f"(({p} + {Z} * {Z} / (2.0 * {n})) / {d})"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})) / {d})"
    return f"greatest(0.0, {centre} - {half})", f"least(1.0, {centre} + {half})"


def cdf_sql(k: str, n: str, p: float) -> str:
    """SQL text of the binomial distribution function, term by term."""
    term = (f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) "
            f"+ i * ln({p}) + ({n} - i) * ln(1 - {p}))")
    return f"least(1.0, list_sum(list_transform(range(0, {k} + 1), lambda i: {term})))"


LOW, HIGH = wilson_sql("k", "n")


@query(f"""
WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, k, n, round(CAST(k AS DOUBLE) / n, 9) AS rate, round({LOW}, 9) AS low, round({HIGH}, 9) AS high FROM s""")
def wilson_by_supplier(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    return s.select("l_suppkey", "k", "n", *[F.round(f"w.{c}", 9).alias(c) for c in ("rate", "low", "high")])


def _supplier_counts(spark, sf_dir, keys):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_linestatus")
    line = line.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return line.groupBy(*keys).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH c AS (SELECT s_nationkey, l_linestatus, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
     v AS (SELECT *, {cdf_sql('k', 'n', 0.35)} AS p FROM c)
SELECT s_nationkey, l_linestatus, k, n, round(p, 7) AS p_value,
       CASE WHEN CAST(k AS DOUBLE) / n >= 0.35 THEN 'PASS' WHEN p < 0.05 THEN 'FAIL' ELSE 'EXTEND' END AS outcome
FROM v""")
def binomial_verdict(spark, sf_dir):
    counts = _supplier_counts(spark, sf_dir, ["l_suppkey", "l_linestatus"])
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = counts.join(supplier, counts["l_suppkey"] == supplier["s_suppkey"]).groupBy("s_nationkey", "l_linestatus").agg(
        F.sum("k").alias("k"), F.sum("n").alias("n"))
    return c.select("s_nationkey", "l_linestatus", "k", "n",
                    F.round(stats.binom_cdf("k", "n", 0.35), 7).alias("p_value"),
                    stats.gate_outcome("k", "n", 0.35).alias("outcome"))


@query(f"""
WITH c AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month,
                  count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY ALL),
     sizes AS (SELECT DISTINCT n FROM c),
     steps AS (SELECT n, unnest(range(0, n)) AS j FROM sizes),
     crit AS (SELECT n, coalesce(max(j) FILTER ({cdf_sql('j', 'n', 0.35)} < 0.05), -1) AS crit FROM steps GROUP BY n),
     power AS (SELECT n, CASE WHEN crit < 0 THEN 0.0 ELSE {cdf_sql('crit', 'n', 0.25)} END AS power FROM crit),
     v AS (SELECT c.*, power, {LOW} AS low, {cdf_sql('k', 'c.n', 0.35)} AS p FROM c JOIN power ON c.n = power.n),
     r AS (SELECT *, CASE WHEN CAST(k AS DOUBLE) / n >= 0.35 THEN 'PASS' WHEN p < 0.05 THEN 'FAIL'
                          ELSE 'EXTEND' END AS raw_outcome FROM v)
SELECT l_suppkey, month, k, n, raw_outcome, round(power, 8) AS achieved_power,
       CASE WHEN raw_outcome = 'PASS' AND low < 0.35 AND power < 0.8 THEN 'EXTEND' ELSE raw_outcome END AS outcome,
       CASE WHEN raw_outcome = 'PASS' AND low < 0.35 AND power < 0.8 THEN 'downgraded_underpowered'
            WHEN raw_outcome = 'PASS' THEN 'ok' WHEN raw_outcome = 'FAIL' THEN 'failed'
            ELSE 'under_resolved' END AS published_reason
FROM r""".replace(LOW, LOW.replace("/ n", "/ c.n").replace("* n", "* c.n")))
def published_verdict(spark, sf_dir):
    c = _supplier_counts(spark, sf_dir, ["l_suppkey", "month"])
    out = stats.published(c, "k", "n", 0.35, detectable=0.25)
    return out.select("l_suppkey", "month", "k", "n", "raw_outcome",
                      F.round("achieved_power", 8).alias("achieved_power"), "outcome", "published_reason")


@query(f"""
WITH s AS (SELECT s_suppkey, n_regionkey, count(*) FILTER ((l_partkey + l_orderkey) % 10 < l_suppkey % 10) AS k, count(*) AS n
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
     w AS (SELECT s_suppkey, n_regionkey, CAST(k AS DOUBLE) / n AS rate, {LOW} AS low, {HIGH} AS high FROM s),
     r AS (SELECT a.*, 1 + (SELECT count(*) FROM w b WHERE b.n_regionkey = a.n_regionkey AND b.low > a.high) AS rank FROM w a),
     t AS (SELECT a.*, 1 + (SELECT count(*) FROM r b WHERE b.n_regionkey = a.n_regionkey AND b.rank = a.rank
              AND b.s_suppkey <> a.s_suppkey AND b.low <= a.high AND a.low <= b.high) AS group_size FROM r a)
SELECT s_suppkey, n_regionkey, round(rate, 9) AS rate, rank, group_size, group_size > 1 AS tied,
       coalesce(lag(low) OVER o <= high AND low <= lag(high) OVER o, false) AS overlaps_above
FROM t WINDOW o AS (PARTITION BY n_regionkey ORDER BY rate DESC, s_suppkey)""")
def dominance_rank(spark, sf_dir):
    ranked = board.dominance_rank(_intervals(spark, sf_dir), ["n_regionkey"], "low", "high")
    out = board.display_order(ranked, ["n_regionkey"], "rate", "s_suppkey", "low", "high")
    return out.select("s_suppkey", "n_regionkey", F.round("rate", 9).alias("rate"), "rank", "group_size", "tied",
                      "overlaps_above")


def _intervals(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if((F.col("l_partkey") + F.col("l_orderkey")) % 10 < F.col("l_suppkey") % 10).alias("k"),
        F.count(F.lit(1)).alias("n"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", "n_regionkey", stats.wilson(F.col("k"), F.col("n")).alias("w")).select(
        "s_suppkey", "n_regionkey", "w.*")


@query(f"""
WITH s AS (SELECT s_suppkey, n_regionkey, count(*) FILTER ((l_partkey + l_orderkey) % 10 < l_suppkey % 10) AS k, count(*) AS n
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
     w AS (SELECT s_suppkey, n_regionkey, {LOW} AS low, {HIGH} AS high FROM s),
     p AS (SELECT a.n_regionkey, count(*) FILTER (a.low > b.high) AS separated FROM w a JOIN w b
           ON a.n_regionkey = b.n_regionkey GROUP BY 1)
SELECT n_regionkey, count(*) AS rows, any_value(separated) AS separated, count(*) * (count(*) - 1) // 2 AS pairs,
       count(*) > 1 AND any_value(separated) = 0 AS all_overlap
FROM w JOIN p USING (n_regionkey) GROUP BY n_regionkey""")
def separated_pairs(spark, sf_dir):
    ranked = board.dominance_rank(_intervals(spark, sf_dir), ["n_regionkey"], "low", "high")
    return board.separation(ranked, ["n_regionkey"])


@query("""
SELECT lang, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed,
       count(*) FILTER (quality IS NULL) AS unknown, count(quality) AS checked
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def hygiene_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("pass"))
    return audit.hygiene(docs.join(labels, "doc_id", "left"), ["lang"])


@query("""
WITH d AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
     n AS (SELECT lang, source, CAST(count(*) FILTER (toxic = 1) AS DOUBLE) / count(*) AS rate FROM d GROUP BY ALL),
     f AS (SELECT lang, quantile_disc(rate, 0.95) AS noise, max(rate) AS top FROM n GROUP BY lang),
     w AS (SELECT n.lang, max(source) AS worst FROM n JOIN f ON n.lang = f.lang AND n.rate = f.top GROUP BY n.lang),
     s AS (SELECT lang, CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*) AS signal FROM d GROUP BY lang),
     j AS (SELECT s.lang, noise, signal, worst FROM s JOIN f USING (lang) JOIN w USING (lang))
SELECT lang, round(noise, 9) AS noise, round(signal, 9) AS signal, round(0.5 * signal, 9) AS kill_at, worst AS worst_label,
       CASE WHEN signal = 0 THEN 'INDETERMINATE' WHEN noise >= 0.5 * signal THEN 'KILL' ELSE 'PROCEED' END AS outcome,
       CASE WHEN signal = 0 THEN 'degenerate_no_signal' WHEN noise >= 0.5 * signal THEN 'noise_exceeds_signal'
            ELSE 'ok' END AS reason
FROM j""")
def null_baseline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    d = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    nulls = gates.null_counts(d, ["lang"], "source", F.col("toxic") == 1).withColumnRenamed("source", "label")
    signals = d.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    out = gates.null_baseline(nulls, signals, ["lang"])
    return out.select("lang", *[F.round(c, 9).alias(c) for c in ("noise", "signal", "kill_at")], "worst_label",
                      "outcome", "reason")


def construct_reason_sql(k: str, n: str, e: str) -> str:
    return f"""CASE WHEN {n} + {e} > 0 AND CAST({e} AS DOUBLE) / ({n} + {e}) > 0.05 THEN 'compromised'
        WHEN {n} = 0 THEN 'no_cases' WHEN CAST({k} AS DOUBLE) / {n} >= 0.9 THEN 'ok'
        WHEN {cdf_sql(k, n, 0.9)} < 0.05 THEN 'below_min_rate' ELSE 'under_resolved' END"""


@query(f"""
WITH t AS (SELECT lang, source, quality = 1 - toxic AS hit, n_chars > 4000 AS err FROM documents JOIN labels USING (doc_id)),
     p AS (SELECT lang, source, count(*) FILTER (NOT err) AS n, count(*) FILTER (NOT err AND hit) AS k,
                  count(*) FILTER (err) AS errors FROM t GROUP BY ALL),
     s AS (SELECT *, CAST(sum(k) OVER w AS BIGINT) AS k_after, CAST(sum(n) OVER w AS BIGINT) AS n_after,
                  CAST(sum(errors) OVER w AS BIGINT) AS e_after FROM p WINDOW w AS (PARTITION BY lang ORDER BY source))
SELECT lang, source, n, k, errors, {construct_reason_sql('k', 'n', 'errors')} AS reason, k_after, n_after,
       {construct_reason_sql('k_after', 'n_after', 'e_after')} AS reason_after,
       {construct_reason_sql('(k_after - k)', '(n_after - n)', '(e_after - errors)')} AS reason_before
FROM s""")
def construct_variance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    t = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    error = F.when(F.col("n_chars") > 4000, "answer too long")
    parts = gates.construct(t, ["lang", "source"], gates.equals(F.col("quality"), 1 - F.col("toxic")), error)
    out = gates.pooled_steps(parts, ["lang"], ["source"])
    return out.select("lang", "source", "n", "k", "errors", "reason", "k_after", "n_after", "reason_after", "reason_before")


@query(f"""
WITH t AS (SELECT source, quality = 1 - toxic AS hit, n_chars > 4000 AS err FROM documents JOIN labels USING (doc_id)),
     p AS (SELECT source, count(*) FILTER (NOT err) AS n, count(*) FILTER (NOT err AND hit) AS k,
                  count(*) FILTER (err) AS errors FROM t GROUP BY source),
     q AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, CAST(sum(errors) AS BIGINT) AS errors FROM p),
     d AS (SELECT *, {construct_reason_sql('k', 'n', 'errors')} AS reason FROM q)
SELECT n, k, errors, reason, round(CAST(k AS DOUBLE) / n, 9) AS rate,
       reason = 'under_resolved' AS extend,
       CASE reason WHEN 'compromised' THEN 'COMPROMISED' WHEN 'ok' THEN NULL WHEN 'under_resolved' THEN NULL
            ELSE 'GATE_FAILED' END AS outcome
FROM d""")
def extension_decision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    t = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    error = F.when(F.col("n_chars") > 4000, "answer too long")
    parts = gates.construct(t, ["source"], F.col("quality") == 1 - F.col("toxic"), error)
    pooled = gates.pool(parts.withColumn("suite", F.lit("all")), ["suite"])
    next_ = gates.resolve_extension(F.col("reason"), F.lit(0), F.lit(6), F.lit(2), F.lit(False))
    return pooled.withColumn("next", next_).select(
        "n", "k", "errors", "reason", F.round("rate", 9).alias("rate"), "next.extend", "next.outcome")


@query("""
WITH t AS (SELECT source, quality IS NOT NULL AS answered, toxic = quality AS wrong, n_chars > 20000 AS oracle_error
           FROM documents LEFT JOIN labels USING (doc_id)),
     c AS (SELECT source, count(*) FILTER (NOT oracle_error AND answered) AS n,
                  count(*) FILTER (NOT oracle_error AND answered AND wrong) AS w,
                  count(*) FILTER (oracle_error) AS oe, count(*) FILTER (NOT oracle_error AND NOT answered) AS te
           FROM t GROUP BY source)
SELECT source, n, w AS n_wrong, oe AS oracle_errors, te AS truth_errors,
       round(CASE WHEN n > 0 THEN CAST(w AS DOUBLE) / n ELSE 0 END, 9) AS error_rate,
       CASE WHEN n = 0 THEN 'no_cases' WHEN w = n THEN 'at_floor' WHEN w = 0 THEN 'at_ceiling'
            WHEN CAST(w AS DOUBLE) / n < 0.05 THEN 'below_min_error_rate' ELSE 'ok' END AS reason
FROM c""")
def variance_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    t = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = gates.variance(
        t, ["source"], F.col("toxic") == F.col("quality"), F.when(F.col("n_chars") > 20000, "too long"),
        F.when(F.col("quality").isNull(), "no label"))
    return out.select("source", "n", "n_wrong", "oracle_errors", "truth_errors",
                      F.round("error_rate", 9).alias("error_rate"), "reason")


@query("""
WITH c AS (SELECT lang, count(*) AS r, count(*) FILTER (n_chars >= 200) AS g,
                  count(*) FILTER (n_chars >= 200 AND NOT contains(text, 'token = "')) AS h FROM documents GROUP BY lang)
SELECT lang, r AS requested, g AS generated, h AS holding, round(CAST(g AS DOUBLE) / r, 9) AS admission_rate,
       CASE WHEN g = 0 THEN 'no_cases_generated' WHEN h <> g THEN 'property_violated' WHEN g < 8 THEN 'too_few_generated'
            WHEN CAST(g AS DOUBLE) / r < 0.25 THEN 'admission_rate_below_minimum' ELSE 'ok' END AS reason
FROM c""")
def structural_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars", "text")
    out = gates.structural(docs, ["lang"], F.col("n_chars") >= 200, ~F.contains("text", F.lit('token = "')))
    return out.select("lang", "requested", "generated", "holding", F.round("admission_rate", 9).alias("admission_rate"),
                      "reason")


@query("""
WITH c AS (SELECT user_id, weekofyear(ts) AS o, event_type AS key, count(*) AS c, min(event_id) AS first
           FROM events GROUP BY ALL),
     m AS (SELECT user_id, o, key AS modal FROM c QUALIFY row_number() OVER (PARTITION BY user_id, o ORDER BY c DESC, first) = 1),
     p AS (SELECT user_id, o, key, c / sum(c) OVER (PARTITION BY user_id, o) AS p FROM c),
     w AS (SELECT DISTINCT user_id, o FROM c),
     pairs AS (SELECT a.user_id, a.o AS a, b.o AS b FROM w a JOIN w b ON a.user_id = b.user_id AND a.o < b.o),
     keys AS (SELECT DISTINCT key FROM c),
     tv AS (SELECT pairs.user_id, a, b, 0.5 * sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) AS tv
            FROM pairs CROSS JOIN keys LEFT JOIN p x ON x.user_id = pairs.user_id AND x.o = a AND x.key = keys.key
                 LEFT JOIN p y ON y.user_id = pairs.user_id AND y.o = b AND y.key = keys.key GROUP BY ALL),
     d AS (SELECT user_id, max(tv) AS d FROM tv GROUP BY 1),
     s AS (SELECT user_id, count(*) AS orderings, arg_min(modal, o) AS value, count(DISTINCT modal) > 1 AS moved FROM m GROUP BY 1)
SELECT s.user_id, orderings, value, round(coalesce(d, 0), 9) AS dispersion,
       CASE WHEN orderings < 2 THEN 'not_applicable' WHEN moved THEN 'unstable' ELSE 'stable' END AS verdict
FROM s LEFT JOIN d USING (user_id)""")
def order_tv(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.weekofyear("ts").alias("week"), "event_type", "event_id")
    out = gates.order_invariance(e, ["user_id"], "week", "event_type", "event_id")
    return out.select("user_id", "orderings", "value", F.round("dispersion", 9).alias("dispersion"), "verdict")


# --- scores ----------------------------------------------------------------------


@query(f"""
WITH o AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS ok, bool_and(l_returnflag <> 'R') AS clean, count(*) AS calls,
                  sum(l_quantity) AS tokens FROM lineitem GROUP BY 1),
     t AS (SELECT o_custkey, coalesce(ok, false) AS success, coalesce(clean, false) AND coalesce(ok, false) AS first_try,
                  coalesce(calls, 0) AS calls, tokens,
                  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.1234567 END AS cost
           FROM orders LEFT JOIN o ON o_orderkey = l_orderkey),
     a AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (first_try) AS k, count(*) FILTER (success) AS e,
                  avg(calls) FILTER (success) AS mc, avg(tokens) FILTER (success) AS mt, avg(cost) FILTER (success) AS mu
           FROM t GROUP BY 1)
SELECT o_custkey, n, k AS first_try_k, e AS eventual_k, round(mc, 6) AS mean_calls, round(mt, 6) AS mean_tokens,
       round(mu, 2) AS mean_cost_usd, round({LOW}, 9) AS low, round({HIGH}, 9) AS high
FROM a""")
def score_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tasks = o.select("o_custkey", F.col("o_orderkey").alias("task_id"),
                     F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 0.1234567).alias("cost_usd"))
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.bool_or(F.col("l_linestatus") == "F").alias("success"),
        F.bool_and(F.col("l_returnflag") != "R").alias("first_try"),
        F.count(F.lit(1)).alias("tool_calls"), F.sum("l_quantity").alias("net_tokens"))
    results = score.task_outcomes(tasks, line, keys=[]).withColumn(
        "tool_calls", F.coalesce("tool_calls", F.lit(0))).withColumn("unconfirmed_calls", F.lit(0))
    out = score.score_block(results, ["o_custkey"])
    return out.select("o_custkey", "n", "first_try_k", "eventual_k", F.round("mean_calls", 6).alias("mean_calls"),
                      F.round("mean_tokens", 6).alias("mean_tokens"), F.round("mean_cost_usd", 2).alias("mean_cost_usd"),
                      F.round("first_try.low", 9).alias("low"), F.round("first_try.high", 9).alias("high"))


@query("""
WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type,
                  CASE event_type WHEN 'error' THEN 'tool-error' WHEN 'signup' THEN 'protocol-error' ELSE 'ok' END AS status
           FROM events),
     t AS (SELECT user_id, day, count(*) AS calls, bool_or(event_type = 'purchase') AS success,
                  bool_or(status <> 'ok') AS bad, bool_or(status = 'protocol-error') AS proto,
                  bool_or(status = 'tool-error') AS tool, count(*) > 8 AS budget,
                  arg_max(event_type, event_id) FILTER (status <> 'ok') AS last_bad, arg_max(event_type, event_id) AS last_any
           FROM s GROUP BY ALL),
     f AS (SELECT *, CASE WHEN budget THEN 'budget-exhausted' WHEN proto THEN 'protocol-error'
                          WHEN tool AND success THEN 'execution-error-recovered'
                          WHEN tool THEN 'execution-error-fatal' END AS failure FROM t)
SELECT user_id, day, calls AS tool_calls, success, success AND NOT bad AND NOT budget AS first_try, failure,
       CASE WHEN failure IS NOT NULL THEN coalesce(last_bad, last_any) END AS failure_tool
FROM f""")
def failure_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", day("ts"))
    status = F.when(F.col("event_type") == "error", "tool-error").when(
        F.col("event_type") == "signup", "protocol-error").otherwise("ok")
    steps = e.select("user_id", "day", F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), status.alias("status"))
    verdicts = e.groupBy("user_id", "day").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("check_passed"),
        (F.count(F.lit(1)) > 8).alias("budget_exhausted")).withColumn("loop_error", F.lit(None).cast("string"))
    out = score.task_rollup(steps, verdicts, ["user_id", "day"])
    return out.select("user_id", "day", "tool_calls", "success", "first_try", "failure", "failure_tool")


@query("""
WITH d AS (SELECT d.doc_id, lang, text, quality, toxic, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat
           FROM documents d LEFT JOIN labels USING (doc_id)),
     v AS (SELECT doc_id, CASE lang WHEN 'en' THEN contains(flat, 'and the')
                 WHEN 'fr' THEN regexp_matches(text, '(?i)tion[, ]+l[ea]')
                 WHEN 'de' THEN coalesce(quality = 1, false)
                 ELSE toxic = 1 END AS passed FROM d)
SELECT passed, count(*) AS tasks, CAST(sum(doc_id) AS BIGINT) AS ids FROM v GROUP BY passed""")
def success_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    lang = F.col("lang")
    kind = F.when(lang == "en", "substring").when(lang == "fr", "regex").when(lang == "de", "tool_called").otherwise("judge")
    made = F.when(F.col("quality").isNotNull(), F.array(F.struct(
        F.lit("label").alias("tool"), (F.col("quality") == 1).alias("ok"), F.lit("").alias("text"))))
    calls = F.coalesce(made, F.array().cast("array<struct<tool:string,ok:boolean,text:string>>"))
    passed = score.check_passed(kind, F.lit("And  THE"), F.lit("tion[, ]+l[ea]"), F.lit(True), F.lit("label"),
                                F.col("text"), calls, F.col("toxic") == 1)
    return d.select("doc_id", passed.alias("passed")).groupBy("passed").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("doc_id").alias("ids"))


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag, min(l_suppkey) AS l_suppkey, max(l_suppkey) AS other FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, l_suppkey FROM f WHERE l_suppkey = other""")
def tool_attribution(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey")
    return board.sole_owners(line, ["l_orderkey"], "l_returnflag", "l_suppkey")


@query("""
SELECT l_suppkey, list_aggregate(list_sort(list(l_returnflag || '=' || n)), 'string_agg', ',') AS classes FROM (
  SELECT l_suppkey, CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'open' END AS l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def failure_classes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("open").alias("failure"))
    out = score.class_counts(line, ["l_suppkey"])
    listed = F.array_sort(F.transform(F.map_entries("failure_classes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("l_suppkey", F.array_join(listed, ",").alias("classes"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS passed FROM orders),
     r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 10)
SELECT o_custkey, count(*) FILTER (passed) AS said, count(*) FILTER (passed AND l_orderkey IS NOT NULL) AS counted
FROM p LEFT JOIN r ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def reached_server(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("task_id"),
                                              (F.col("o_orderstatus") == "F").alias("said"))
    passes = o.withColumn("passed", F.col("said")).withColumn("expected_tools", F.array(F.lit("A")))
    made = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("tool"), (F.col("l_quantity") >= 10).alias("ok"))
    out = score.reached_through_server(passes, made, ["task_id"])
    return out.groupBy("o_custkey").agg(F.count_if("said").alias("said"), F.count_if("passed").alias("counted"))


@query("""
WITH l AS (SELECT l_orderkey, CASE WHEN l_discount > 0.08 THEN 'structural' WHEN l_tax > 0.06 THEN 'null_baseline'
                  WHEN l_quantity > 45 THEN 'construct' ELSE 'plan_power' END AS gate,
                  l_discount > 0.08 OR l_tax > 0.06 OR l_quantity > 45 AS bad,
                  (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS o FROM lineitem),
     f AS (SELECT l_orderkey, count(*) AS n, arg_min(gate, o) FILTER (bad) AS gate FROM l GROUP BY 1)
SELECT l_orderkey, gate AS refused_at,
       CASE gate WHEN 'structural' THEN 'INSUFFICIENT_SURFACE' WHEN 'null_baseline' THEN 'DEGENERATE'
                 WHEN 'construct' THEN 'GATE_FAILED' ELSE 'SCORED' END AS outcome
FROM f""")
def first_refusal(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    gate = F.when(F.col("l_discount") > 0.08, "structural").when(F.col("l_tax") > 0.06, "null_baseline").when(
        F.col("l_quantity") > 45, "construct").otherwise("plan_power")
    reason = F.when(gate == "structural", "too_few_generated").when(
        gate == "null_baseline", "noise_exceeds_signal").when(gate == "construct", "below_min_rate").otherwise("ok")
    rows = line.select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seq"),
        gate.alias("gate"), (gate == "plan_power").alias("ok"), reason.alias("reason"))
    driven = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tasks_driven"))
    return gates.run_outcomes(rows, driven, ["l_orderkey"]).select("l_orderkey", "refused_at", "outcome")


@query("""
WITH v AS (SELECT lang, source, count(*) FILTER (contains(text, 'token = "')) > 0 AS planted,
                  count(*) FILTER (n_chars > 6000) > 0 AS flagged FROM documents GROUP BY ALL),
     r AS (SELECT lang, CASE WHEN NOT planted AND NOT flagged THEN 'passed_valid' WHEN NOT planted THEN 'false_alarm'
                  WHEN NOT flagged THEN 'missed' ELSE 'caught' END AS f FROM v)
SELECT lang, count(*) FILTER (f = 'caught') AS caught, count(*) FILTER (f = 'missed') AS missed,
       count(*) FILTER (f = 'false_alarm') AS false_alarms, count(*) FILTER (f = 'passed_valid') AS passed_valid,
       count(*) FILTER (f IN ('missed', 'false_alarm')) = 0 AS ok
FROM r GROUP BY lang""")
def gate_audit(spark, sf_dir):
    v = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count_if(F.contains("text", F.lit('token = "'))).alias("planted"), F.count_if(F.col("n_chars") > 6000).alias("flagged"))
    rows = gates.audit_rows(v.select(
        "lang", F.col("source").alias("name"), (F.col("planted") == 0).alias("valid"),
        F.lit("structural").alias("catchable_by"), (F.col("flagged") == 0).alias("said_valid")))
    return gates.audit_summary(rows, ["lang"]).select("lang", "caught", "missed", "false_alarms", "passed_valid", "ok")


@query("""
WITH d AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month,
                  list_aggregate(list_sort(list(DISTINCT l_returnflag || l_linestatus)), 'string_agg', ',') AS surface
           FROM lineitem GROUP BY ALL)
SELECT l_suppkey, month, sha256(surface) AS digest,
       sha256(surface) <> lag(sha256(surface)) OVER (PARTITION BY l_suppkey ORDER BY month) AS drifted FROM d""")
def surface_drift(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.concat("l_returnflag", "l_linestatus").alias("tool")).distinct()
    placed = board.row_number(listed, ["l_suppkey", "month"], ["tool"], "position")
    digests = admission.ordered_hash(placed, ["l_suppkey", "month"], "position", "tool", "digest")
    return audit.surface_drift(digests, "l_suppkey", ["month"], "digest").select("l_suppkey", "month", "digest", "drifted")


@query("""
WITH s AS (SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS p1,
                  CAST(count(*) FILTER (l_returnflag = 'A' AND l_quantity > 20) AS DOUBLE) / count(*) AS p2, count(*) AS n
           FROM lineitem GROUP BY 1),
     c AS (SELECT *, (p1 + p2) / 2 AS mid FROM s)
SELECT l_suppkey, CASE WHEN p1 > 0 AND p1 < 1 AND p2 > 0 AND p2 < 1 AND p1 <> p2 THEN CAST(ceil(
         (1.959963986120195 * sqrt(2 * mid * (1 - mid)) + 0.8416212327266186 * sqrt(p1 * (1 - p1) + p2 * (1 - p2))) ** 2
         / ((p1 - p2) ** 2)) AS BIGINT) END AS needed,
       round(list_sum(list_transform(range(0, 5), lambda k: (exp(lgamma(5.0) - lgamma(k + 1.0) - lgamma(5.0 - k))
             * p1 ** k * (1 - p1) ** (4 - k)) ** 2)), 8) AS ties
FROM c""")
def sample_sizes(spark, sf_dir):
    n = F.count(F.lit(1))
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        (F.count_if(F.col("l_returnflag") == "R") / n).alias("p1"),
        (F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 20)) / n).alias("p2"))
    return s.select("l_suppkey", stats.separate(F.col("p1"), F.col("p2")).alias("needed"),
                    F.round(stats.tie_rate(F.col("p1"), F.lit(4)), 8).alias("ties"))


@query("""
SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS examples FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE n_chars < 200)
WHERE r <= 10 GROUP BY lang""")
def first_examples(spark, sf_dir):
    short = table(spark, sf_dir, "documents").where("n_chars < 200").select("lang", "doc_id", "n_chars")
    out = gates.first_rows(short, ["lang"], ["doc_id"], 10, ["n_chars"], "examples")
    return out.select("lang", F.array_join(F.transform("examples", lambda e: e["doc_id"].cast("string")), ",").alias("examples"))


@query("""
SELECT p_brand, count(*) AS tools, count(*) FILTER (NOT (p_type = 'PROMO' OR coalesce(p_size >= 40, false))) AS destructive
FROM part GROUP BY p_brand""")
def destructive_tools(spark, sf_dir):
    from tapelake.operators.pairs import is_destructive

    risky = is_destructive(F.col("p_type") == "PROMO", F.when(F.col("p_size") >= 40, F.lit(False)))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("tools"), F.count_if(risky).alias("destructive"))


@query("""
SELECT conv_id, sha256(coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND text <> ''),
                                arg_max(text, turn) FILTER (role = 'user' AND text <> ''))) AS digest
FROM conversations WHERE role IN ('assistant', 'user') GROUP BY conv_id""")
def final_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "text", "role")
    out = score.final_answer(c.where("role = 'assistant'"), c.where("role = 'user'"), ["conv_id"])
    return out.select("conv_id", F.sha2("final_text", 256).alias("digest"))
