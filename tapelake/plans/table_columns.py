"""Column functions of records, scores and checks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import patterns, stats, text
from tapelake.operators import admission, board, gates, records
from tapelake.plans.registry import query, table


@query("""
SELECT event_type, round(avg(value) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0), 6) AS mean FROM events GROUP BY event_type""")
def finite_means(spark, sf_dir):
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(stats.mean(odd), 6).alias("mean"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'in' WHEN 'purchase' THEN 'out' END AS dir,
       CASE WHEN event_id % 3 = 0 THEN props ELSE event_type END AS payload FROM events""")
def event_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    transport = F.when(F.col("event_type") == "click", "out").when(F.col("event_type") == "purchase", "in").otherwise(F.col("event_type"))
    return e.select("event_id", records.flip_direction(transport).alias("dir"),
                    records.payload(F.when(F.col("event_id") % 3 == 0, F.col("props")), F.col("event_type")).alias("payload"))


@query("""
SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0 AS rankable FROM orders""")
def rankable_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "SCORED").otherwise(F.col("o_orderstatus"))
    rate = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return o.select("o_orderkey", board.rankable(outcome, rate, rate, rate, F.col("o_custkey") % 3).alias("rankable"))


@query("""
SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') OR (o_orderpriority = '3-MEDIUM' AND o_custkey % 2 = 0) AS screenable FROM orders""")
def screenable_checks(spark, sf_dir):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "substring").when(p == "2-HIGH", "regex").when(p == "3-MEDIUM", "judge").otherwise("state")
    return table(spark, sf_dir, "orders").select("o_orderkey", admission.screenable(kind, F.col("o_custkey") % 2 == 0).alias("screenable"))


@query("""
WITH f AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first FROM orders GROUP BY o_custkey)
SELECT f.o_custkey, first AS o_orderkey, o_orderpriority FROM f LEFT JOIN orders o ON f.first = o.o_orderkey""")
def first_failing_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return board.first_failing(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F", ["o_orderkey", "o_orderpriority"])


def _number_sql(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')"


@query(f"""
SELECT p_partkey, p_name || '|' || {_number_sql('p_size')} || '|' || {_number_sql('p_retailprice')} || '|' || p_brand AS leaves FROM part""")
def answer_key_leaves(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.to_json(F.struct("p_name", F.struct(F.array("p_size").alias("sizes"), "p_retailprice").alias("facts"),
                             F.array(F.struct(F.lit(True).alias("ok"), "p_brand")).alias("more")))
    return p.select("p_partkey", F.array_join(patterns.answer_leaves(key), "|").alias("leaves"))


@query(r"""
WITH t AS (SELECT conv_id, turn, text, turn % 4 AS kind FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 0 THEN text WHEN 1 THEN text || E'\n' || 'tail' WHEN 2 THEN text || E'\n' || text ELSE '' END AS flat,
       CASE kind WHEN 1 THEN text WHEN 2 THEN text || E'\n' || text ELSE '' END AS typed FROM t""")
def flattened_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    kind = F.col("turn") % 4
    body = (F.when(kind == 0, F.to_json(F.array("text"))).when(kind == 1, F.concat(F.lit("["), F.to_json(block), F.lit(',"tail"]')))
            .when(kind == 2, F.to_json(F.array(block, block))).otherwise(F.lit("[]")))
    v = F.parse_json(body)
    return c.select("conv_id", "turn", text.block_text(v).alias("flat"), text.typed_text(v, F.parse_json(F.lit("null"))).alias("typed"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name || '@' || c_nationkey WHEN 2 THEN c_name
       ELSE 'mcp-tape@' || c_nationkey END AS label FROM customer""")
def producer_labels(spark, sf_dir):
    c, kind, nation = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    meta = F.to_json(F.struct(F.when(kind == 0, F.col("c_mktsegment")).alias("source"),
                              F.when(kind.isin(1, 2), F.struct(F.col("c_name").alias("name"), F.when(kind == 1, nation).alias("version"))).alias("producer"),
                              F.when(kind == 3, nation).alias("mcpTapVersion")))
    return c.select("c_custkey", records.producer_label(F.parse_json(meta)).alias("label"))


@query("""
WITH o AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'compromised' WHEN '2' THEN 'ok' WHEN '3' THEN 'below_min_rate'
                  ELSE 'under_resolved' END AS reason, o_custkey % 3 AS consumed, o_orderkey % 4 AS size, o_custkey % 4 AS most,
                  o_orderstatus = 'F' AS blocked FROM orders),
     p AS (SELECT *, reason = 'under_resolved' AS u, reason = 'under_resolved' AND size > 0 AND most > consumed AS go,
                  most = 0 OR size = 0 AS never FROM o)
SELECT o_orderkey, go AND NOT blocked AS extend, u AND NOT go AND NOT never AS resolved_to_fail,
       CASE WHEN go AND blocked THEN 'under_resolved_not_extended' WHEN u AND NOT go AND NOT never THEN 'unresolved_after_max_extensions'
            ELSE reason END AS reason,
       CASE WHEN reason = 'compromised' THEN 'COMPROMISED' WHEN reason = 'below_min_rate' THEN 'GATE_FAILED' WHEN NOT u OR go THEN NULL
            WHEN never THEN 'EXTEND_EXHAUSTED' ELSE 'GATE_FAILED' END AS outcome FROM p""")
def extension_branches(spark, sf_dir):
    o, first = table(spark, sf_dir, "orders"), F.substring("o_orderpriority", 1, 1)
    reason = (F.when(first == "1", "compromised").when(first == "2", "ok").when(first == "3", "below_min_rate").otherwise("under_resolved"))
    next_ = gates.resolve_extension(reason, F.col("o_custkey") % 3, F.col("o_orderkey") % 4, F.col("o_custkey") % 4, F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", next_.alias("next")).select("o_orderkey", "next.extend", "next.resolved_to_fail", "next.reason", "next.outcome")


@query(r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Output schema is invalid: ' ELSE '' END || text AS body, 150 + turn * 50 AS status FROM conversations)
SELECT conv_id, turn, CASE WHEN length(body) > 40 THEN left(body, 40) || '... [' || (length(body) - 40) || ' more characters]' ELSE body END AS snippet,
       regexp_matches(body, '(?i)output ?schema|structured ?content') AND regexp_matches(body, '(?i)match|valid|invalid|reject') AS schema_reject,
       status NOT BETWEEN 200 AND 299 AS http_failure FROM c""")
def response_classes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.when(F.col("turn") % 3 == 0, "Output schema is invalid: ").otherwise(""), "text")
    return c.select("conv_id", "turn", text.snippet(body, 40).alias("snippet"), text.is_schema_reject(body).alias("schema_reject"),
                    text.is_http_failure(150 + F.col("turn") * 50).alias("http_failure"))
