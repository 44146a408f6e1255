"""Trace operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import text, typed
from tapelake.operators import calls, pairs, records, sessions, usage
from tapelake.plans.registry import day, millis, query, table
from tapelake.streaming import live


@query("""
SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'system') AS meta,
       count(*) FILTER (role = 'user') AS message, CAST(0 AS BIGINT) AS event,
       count(*) FILTER (role = 'assistant') AS turn, CAST(0 AS BIGINT) AS "end",
       count(*) FILTER (role NOT IN ('system', 'user', 'assistant')) AS other
FROM conversations GROUP BY conv_id""")
def record_kind_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    record_type = F.when(F.col("role") == "system", "meta").when(F.col("role") == "assistant", "turn")
    kind = records.classify(record_type, F.when(F.col("role") == "user", "in"))
    return c.groupBy("conv_id").agg(*sessions.kind_counts(kind))


@query("""
WITH e AS (SELECT conv_id, turn, role, length(text) AS chars,
                  lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(length(text)) OVER w AS nc
           FROM conversations WHERE role IN ('user', 'assistant')
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(nr = 'assistant', false) AS closed,
       CASE WHEN nr = 'assistant' THEN nt END AS answer_turn,
       CASE WHEN nr = 'assistant' THEN nc END AS answer_chars
FROM e WHERE role = 'user'""")
def turn_pairing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", (F.col("role") == "user").alias("is_use"), F.length("text").alias("chars"))
    out = pairs.pair_next(c, ["conv_id"], ["turn"], "is_use", ["turn", "chars"])
    return out.select("conv_id", "turn", "closed", F.col("next_turn").alias("answer_turn"),
                      F.col("next_chars").alias("answer_chars"))


def _event_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", day("ts").alias("day"), "event_type", millis("ts").alias("ms"), F.struct("ts", "event_id").alias("ord"))
    paired = pairs.pair_first_response(
        e, ["user_id", "day"], "ord", F.col("event_type") == "click", F.col("event_type") == "purchase",
        F.struct("ms"), F.struct("ms"))
    latency = F.greatest(F.lit(0).cast("long"), F.col("response.ms") - F.col("request.ms"))
    return paired.select(
        "user_id", "day", F.col("request.ms").alias("asked_ms"), F.col("response.ms").alias("answered_ms"),
        F.when(F.col("response").isNotNull(), latency).alias("latency_ms"),
        F.col("response").isNull().alias("pending"))


CALLS_SQL = """
WITH q AS (SELECT user_id, CAST(ts AS DATE) AS d, epoch_us(ts) // 1000 AS ms,
                  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r
           FROM events WHERE event_type = 'click'),
     a AS (SELECT user_id, CAST(ts AS DATE) AS d, epoch_us(ts) // 1000 AS ms,
                  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r
           FROM events WHERE event_type = 'purchase'),
     calls AS (SELECT q.user_id, strftime(q.d, '%Y-%m-%d') AS day, q.ms AS asked_ms, a.ms AS answered_ms,
                  CASE WHEN a.ms IS NOT NULL THEN greatest(0, a.ms - q.ms) END AS latency_ms,
                  a.ms IS NULL AS pending
           FROM q LEFT JOIN a ON q.user_id = a.user_id AND q.d = a.d AND a.r = 1 WHERE q.r = 1)
"""


@query(CALLS_SQL + "SELECT * FROM calls")
def call_pairing(spark, sf_dir):
    return _event_calls(spark, sf_dir)


@query(CALLS_SQL + """
SELECT CAST(dayofweek(CAST(day AS DATE)) + 1 AS VARCHAR) AS tool, count(*) AS calls, CAST(0 AS BIGINT) AS errors,
       count(*) FILTER (pending) AS pending, 'mcp' AS origin,
       quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms
FROM calls GROUP BY 1""")
def tool_stats(spark, sf_dir):
    rows = _event_calls(spark, sf_dir).select(
        F.dayofweek("day").cast("string").alias("tool"), "latency_ms", "pending",
        F.lit(None).cast("string").alias("error"), F.lit("mcp").alias("origin"))
    return calls.tool_stats(rows, keys=[])


@query("""
SELECT e.event_id, 'tool' AS source, strftime(e.ts, '%Y-%m-%d') AS day FROM events e
WHERE event_type = 'error' AND NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id
     AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE))
UNION ALL
SELECT event_id, CASE event_type WHEN 'signup' THEN 'llm' ELSE event_type END, strftime(ts, '%Y-%m-%d') FROM events
WHERE event_type NOT IN ('error', 'purchase')""")
def error_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", day("ts"))
    loose = calls.unanswered_by(
        e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id", "day"])
    other = e.where("event_type NOT IN ('error', 'purchase')")
    source = F.when(F.col("event_type") == "signup", "llm").otherwise(F.col("event_type"))
    return (loose.select("event_id", F.lit("tool").alias("source"), "day")
            .unionByName(other.select("event_id", source.alias("source"), "day")))


@query("""
SELECT p.event_id, p.user_id, strftime(p.ts, '%Y-%m-%d') AS day FROM events p
WHERE p.event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id
     AND CAST(c.ts AS DATE) = CAST(p.ts AS DATE) AND c.ts < p.ts)""")
def confirmation_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", day("ts").alias("day"))
    loose = calls.unconfirmed(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"),
                              ["user_id", "day"], "ts")
    return loose.select("event_id", "user_id", "day")


@query("""
SELECT event_type, count(*) AS rows,
       count(*) FILTER (json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS numbers,
       count(*) FILTER (json_type(props, '$.k') = 'VARCHAR') AS texts,
       sum(CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
                THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END) AS total,
       count(*) FILTER (json_type(props, '$.missing') IS NOT NULL) AS missing
FROM events GROUP BY event_type""")
def json_props(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_type", F.try_parse_json("props").alias("v"))
    return v.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count(typed.num("v", "$.k")).alias("numbers"),
        F.count(typed.text("v", "$.k")).alias("texts"), F.sum(typed.first_num("v", "k", "n")).alias("total"),
        F.count_if(typed.present("v", "$.missing")).alias("missing"))


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS calls
FROM events GROUP BY 1, 2""")
def windowed_tools(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.windowed_counts(e, ["event_type"], "1 day").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "calls")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms,
                  lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS prev FROM events),
     n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ms - prev >= 21600000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM e)
SELECT user_id, CAST(s AS BIGINT) AS session, min(ms) AS started_ms, max(ms) AS ended_ms, count(*) AS events
FROM n GROUP BY 1, 2""")
def session_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return live.session_gaps(e, ["user_id"], "ts", 6 * 3600 * 1000, "event_id")


def _line_usage(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    cached = F.col("l_returnflag") == "R"
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand", "p_type", F.concat_ws("-", "p_brand", "p_type").alias("model"), "l_returnflag", "l_linestatus",
        F.col("l_quantity").alias("input_tokens"), F.col("l_extendedprice").alias("output_tokens"),
        F.when(cached, F.col("l_tax")).alias("cache_read_tokens"),
        F.when(cached & (F.col("p_type") == "PROMO"), F.col("l_tax")).alias("cache_creation_tokens"))


@query("""
WITH u AS (SELECT p_brand, count(*) AS calls, sum(l_quantity) AS i, sum(l_extendedprice) AS o,
       sum(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS r,
       sum(CASE WHEN l_returnflag = 'R' AND p_type = 'PROMO' THEN l_tax END) AS w
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT p_brand, calls, round(i, 2) AS input_tokens, round(o, 2) AS output_tokens,
       round(r, 2) AS cache_read_tokens, round(w, 2) AS cache_creation_tokens,
       round(CASE WHEN (r IS NOT NULL OR w IS NOT NULL) AND coalesce(i,0)+coalesce(r,0)+coalesce(w,0) > 0
            THEN coalesce(r, 0) / (coalesce(i,0)+coalesce(r,0)+coalesce(w,0)) END, 9) AS cache_hit_rate
FROM u""")
def usage_rollup(spark, sf_dir):
    out = usage.usage_rollup(_line_usage(spark, sf_dir), ["p_brand"])
    money = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
    return out.select("p_brand", "calls", *[F.round(c, 2).alias(c) for c in money],
                      F.round("cache_hit_rate", 9).alias("cache_hit_rate"))


# Demonstration prices for part brands: exact brand names and one dated variant.
BRAND_PRICES = [("Brand#1", 2.0, 10.0, "2026-01-01"), ("Brand#2-PROMO", 5.0, 25.0, "2026-02-01"),
                ("Brand#2", 3.0, 15.0, "2026-03-01"), ("Brand#7", 1.0, 5.0, "2026-01-15")]
PRICES_SQL = """
prices(priority, id, ip, op) AS (VALUES (0, 'Brand#1', 2.0, 10.0), (1, 'Brand#2-PROMO', 5.0, 25.0),
                                        (2, 'Brand#2', 3.0, 15.0), (3, 'Brand#7', 1.0, 5.0)),
lines AS (SELECT p_brand || '-' || p_type AS model, l_returnflag, l_linestatus, l_quantity AS i, l_extendedprice AS o,
                 CASE WHEN l_returnflag = 'R' THEN l_tax END AS r,
                 CASE WHEN l_returnflag = 'R' AND p_type = 'PROMO' THEN l_tax END AS w
          FROM lineitem JOIN part ON l_partkey = p_partkey),
priced AS (SELECT m.model, p.ip, p.op FROM (SELECT DISTINCT model FROM lines) m JOIN prices p
           ON m.model = p.id OR starts_with(m.model, p.id || '-')
           QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY p.priority) = 1)
"""


@query("WITH " + PRICES_SQL + """,
u AS (SELECT model, count(*) AS calls, sum(i) AS i, sum(o) AS o, sum(r) AS r, sum(w) AS w FROM lines GROUP BY model)
SELECT u.model, calls, ip IS NOT NULL AS priced,
       round(i / 1e6 * ip + coalesce(r, 0) / 1e6 * ip * 0.1 + coalesce(w, 0) / 1e6 * ip * 1.25
             + o / 1e6 * op, 3) AS cost_usd
FROM u LEFT JOIN priced USING (model)""")
def price_join_cost(spark, sf_dir):
    rolled = usage.usage_rollup(_line_usage(spark, sf_dir), ["model"])
    out = usage.priced(rolled, usage.price_table(spark, BRAND_PRICES))
    return out.select("model", "calls", "priced", F.round("cost_usd", 3).alias("cost_usd"))


@query("WITH " + PRICES_SQL + """,
c AS (SELECT model, l_returnflag AS phase, l_linestatus = 'O' AND l_returnflag = 'N' AS failed, i, o FROM lines),
m AS (SELECT model, count(*) FILTER (NOT failed) AS calls, count(*) FILTER (failed) AS failed_calls,
             coalesce(sum(i) FILTER (NOT failed), 0) AS i, coalesce(sum(o) FILTER (NOT failed), 0) AS o
      FROM c GROUP BY model),
mp AS (SELECT m.*, CASE WHEN i <> 0 OR o <> 0 THEN i / 1e6 * ip + o / 1e6 * op END AS usd,
              ip IS NULL AND calls > 0 AS gap FROM m LEFT JOIN priced USING (model))
SELECT 'model' AS level, model AS name, calls, failed_calls, round(i, 2) AS input_tokens, round(o, 2) AS output_tokens,
       round(usd, 3) AS cost_usd, gap OR failed_calls > 0 AS partial FROM mp WHERE calls > 0
UNION ALL
SELECT 'phase', phase, count(*) FILTER (NOT failed), count(*) FILTER (failed),
       round(coalesce(sum(i) FILTER (NOT failed), 0), 2), round(coalesce(sum(o) FILTER (NOT failed), 0), 2), NULL, NULL
FROM c GROUP BY phase HAVING count(*) FILTER (NOT failed) > 0
UNION ALL
SELECT 'total', NULL, CAST(sum(calls) AS BIGINT), CAST(sum(failed_calls) AS BIGINT), round(sum(i), 2), round(sum(o), 2),
       round(sum(usd), 3), bool_or(gap) OR sum(failed_calls) > 0 FROM mp""")
def usage_meter(spark, sf_dir):
    lines = _line_usage(spark, sf_dir)
    none = F.lit(None).cast("double")
    entries = lines.select(
        F.lit("all").alias("run_id"), "model", F.col("l_returnflag").alias("phase"),
        ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("failed"),
        "input_tokens", "output_tokens", none.alias("cache_read_tokens"), none.alias("cache_creation_tokens"))
    out = usage.cost_meter(entries, usage.price_table(spark, BRAND_PRICES))
    return out.select("level", "name", "calls", "failed_calls", F.round("input_tokens", 2).alias("input_tokens"),
                      F.round("output_tokens", 2).alias("output_tokens"), F.round("cost_usd", 3).alias("cost_usd"),
                      "partial")


@query("""
WITH u AS (SELECT 'r' || user_id AS run_id, 'mcp' AS plane, event_type AS tool, count(*) AS calls
           FROM events GROUP BY ALL),
     c AS (SELECT 'r' || conv_id AS run_id, 'agent' AS plane, role AS tool, count(*) AS calls
           FROM conversations GROUP BY ALL)
SELECT * FROM u UNION ALL
SELECT * FROM c WHERE run_id NOT IN (SELECT run_id FROM u)""")
def plane_merge(spark, sf_dir):
    wire = table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("r"), "user_id").alias("run_id"), F.col("event_type").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls")).withColumn("plane", F.lit("mcp"))
    agent = table(spark, sf_dir, "conversations").groupBy(
        F.concat(F.lit("r"), "conv_id").alias("run_id"), F.col("role").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls")).withColumn("plane", F.lit("agent"))
    return sessions.merged_tools(wire.unionByName(agent))


@query("""
WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, count(*) AS lines, count(*) FILTER (prev IS NULL OR prev <> role) AS decisions
FROM r GROUP BY conv_id""")
def decision_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.lit("agent").alias("plane"), F.col("turn").alias("line_no"),
        F.lpad(F.col("turn").cast("string"), 12, "0").alias("t"), F.col("role").alias("corr_id"))
    numbered = records.decisions(records.timeline(lines))
    return numbered.groupBy(F.col("run_id").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.max("decision").alias("decisions"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS task, CASE WHEN event_type <> 'view' THEN event_type END AS phase, count(*) AS n
FROM events GROUP BY 1, 2""")
def correlation_split(spark, sf_dir):
    corr = F.when(F.col("event_type") == "view", F.col("user_id").cast("string")).otherwise(
        F.concat_ws("::", "user_id", "event_type"))
    rows = table(spark, sf_dir, "events").select(corr.alias("corr_id"))
    return rows.groupBy(text.task_of(F.col("corr_id")).alias("task"), text.phase_of(F.col("corr_id")).alias("phase")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare,
  coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)),
      '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug,
  starts_with(url, 'https://') AS linkable
FROM pages""")
def url_slug(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.strip_credentials(url).alias("bare"), text.url_slug(url).alias("slug"),
        text.safe_url(url).isNotNull().alias("linkable"))
