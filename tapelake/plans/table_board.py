"""Board analytics over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.operators import audit, board
from tapelake.plans.registry import query, table
from tapelake.sources import sinks


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt,
       count(*) OVER (PARTITION BY o_custkey) AS runs FROM orders""")
def cohort_attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return board.cohorts(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "attempt", "runs")


@query("""
WITH c AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderstatus, count(*) FILTER (n > 1) AS servers, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows,
       count(*) AS total_servers FROM c GROUP BY 1""")
def rerun_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey")
    return board.rerun_summary(o, ["o_custkey"], ["o_orderstatus"])


@query("""
WITH f AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'scored' WHEN o_orderpriority = '1-URGENT' THEN 'free'
                       WHEN o_orderpriority = '2-HIGH' THEN 'cheap' WHEN o_orderpriority = '3-MEDIUM' THEN 'paid'
                       ELSE 'unclassified' END AS family, o_orderpriority AS code, o_orderstatus AS gate FROM orders),
     c AS (SELECT family, code, count(*) AS n FROM f GROUP BY ALL)
SELECT family, list_position(['free', 'cheap', 'paid', 'unclassified', 'scored'], family) AS place,
       CAST(sum(n) AS BIGINT) AS count, string_agg(code || '=' || n, ',' ORDER BY n DESC, code) AS codes,
       (SELECT string_agg(DISTINCT gate, ',' ORDER BY gate) FROM f WHERE f.family = c.family) AS gates
FROM c GROUP BY family""")
def family_buckets(spark, sf_dir):
    p = F.col("o_orderpriority")
    tier = F.when(p == "1-URGENT", "free").when(p == "2-HIGH", "cheap").when(p == "3-MEDIUM", "paid")
    rows = table(spark, sf_dir, "orders").select(
        board.family(F.when(F.col("o_orderstatus") == "F", "SCORED").otherwise("GATE_FAILED"), tier).alias("family"),
        p.alias("code"), F.col("o_orderstatus").alias("gate"))
    out = board.family_buckets(rows, "family", "code", gate="gate")
    codes = F.transform("codes", lambda c: F.concat_ws("=", c["code"], c["count"].cast("string")))
    return out.select("family", board.ladder_place(F.col("family")).alias("place"), "count",
                      F.array_join(codes, ",").alias("codes"), F.array_join("gates", ",").alias("gates"))


@query("""
WITH n AS (SELECT DISTINCT p_brand, p_size // 7 AS run, p_type FROM part),
     r AS (SELECT p_brand, count(DISTINCT run) AS runs FROM n GROUP BY 1),
     c AS (SELECT p_brand, p_type, count(*) AS have FROM n GROUP BY ALL)
SELECT p_brand, p_type FROM c JOIN r USING (p_brand) WHERE runs >= 2 AND have = runs""")
def standing_notes(spark, sf_dir):
    return board.standing_notes(_notes(spark, sf_dir), ["p_brand"], ["run"], "p_type")


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_size") / 7).alias("run"), "p_type")


@query("""
WITH n AS (SELECT DISTINCT p_brand, p_size // 7 AS run, p_type FROM part),
     r AS (SELECT p_brand, count(DISTINCT run) AS runs FROM n GROUP BY 1),
     s AS (SELECT p_brand, p_type FROM n JOIN r USING (p_brand) GROUP BY ALL HAVING count(*) = any_value(runs) AND any_value(runs) >= 2)
SELECT p_brand, p_size // 7 AS run, p_type, count(*) AS n FROM part p
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.p_brand = p.p_brand AND s.p_type = p.p_type) GROUP BY ALL""")
def own_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    standing = board.standing_notes(notes, ["p_brand"], ["run"], "p_type")
    return board.own_notes(notes, standing, ["p_brand"], "p_type").groupBy("p_brand", "run", "p_type").agg(
        F.count(F.lit(1)).alias("n"))


COST_SQL = """
c AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS runner,
             CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice * 0.5 END AS judge, o_orderstatus = 'O' AS part
      FROM orders),
t AS (SELECT *, CASE WHEN runner IS NOT NULL OR judge IS NOT NULL THEN coalesce(runner, 0) + coalesce(judge, 0) END AS total,
             list_filter([CASE WHEN judge IS NULL THEN 'judge usage not recorded' END,
                          CASE WHEN part THEN 'tape cost partial' END], lambda x: x IS NOT NULL) AS gaps FROM c)
"""


def _costs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("runner"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") * 0.5).alias("judge"),
        (F.col("o_orderstatus") == "O").alias("part"))
    rows = rows.withColumn("total_usd", board.null_safe_sum(F.col("runner"), F.col("judge"))).withColumn(
        "reasons", board.floor_reasons((F.col("judge").isNull(), "judge usage not recorded"),
                                       (F.col("part"), "tape cost partial")))
    return board.with_floor(rows, "total_usd", "reasons")


@query("WITH " + COST_SQL + """
SELECT o_orderkey, round(total, 3) AS total_usd, array_to_string(gaps, ',') AS reasons,
       total IS NOT NULL AND len(gaps) = 0 AS complete, total IS NOT NULL AND len(gaps) > 0 AS floor FROM t""")
def cost_floor(spark, sf_dir):
    return _costs(spark, sf_dir).select("o_orderkey", F.round("total_usd", 3).alias("total_usd"),
                                        F.array_join("reasons", ",").alias("reasons"), "complete", "floor")


@query("WITH " + COST_SQL + """
SELECT o_orderpriority, count(*) AS runs, round(sum(total), 3) AS cost_usd, count(total) AS cost_runs,
       count(*) FILTER (total IS NOT NULL AND len(gaps) > 0) AS floor_runs,
       count(total) > 0 AND count(*) FILTER (total IS NOT NULL AND len(gaps) > 0) > 0 AS cost_is_floor
FROM t GROUP BY 1""")
def board_totals(spark, sf_dir):
    out = board.board_totals(_costs(spark, sf_dir), ["o_orderpriority"])
    return out.withColumn("cost_usd", F.round("cost_usd", 3))


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS cum_usd,
       round(sum(o_totalprice) OVER w, 2) + 1000 <= 500000 AS may_continue
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def spend_ledger(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    out = board.spend_until(o, ["o_orderdate", "o_orderkey"], "o_totalprice", 500000.0, 1000.0, ["o_custkey"])
    return out.select("o_orderkey", F.round("cum_usd", 2).alias("cum_usd"), "may_continue")


@query("""
WITH old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
     new AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
SELECT o_orderkey, 'old' AS edition FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)
UNION ALL SELECT o_orderkey, 'new' FROM new""")
def board_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    old = o.where("o_orderdate < timestamp_ntz'2000-01-01'").withColumn("edition", F.lit("old"))
    new = o.where("o_orderdate >= timestamp_ntz'2000-01-01'").withColumn("edition", F.lit("new"))
    return sinks.upsert(old, new, ["o_custkey"]).select("o_orderkey", "edition")


@query("""
WITH have AS (SELECT DISTINCT o_custkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'mcp' ELSE 'agent' END AS plane FROM orders),
     want AS (SELECT c_custkey AS run_id, p AS plane FROM customer, (VALUES ('mcp'), ('agent')) v(p))
SELECT run_id, plane, 'missing plane' AS fault FROM want WHERE NOT EXISTS (
   SELECT 1 FROM have WHERE have.run_id = want.run_id AND have.plane = want.plane)
UNION ALL
SELECT run_id, plane, 'no report' FROM have WHERE run_id NOT IN (SELECT run_id FROM want)""")
def plane_gaps(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "mcp").otherwise("agent").alias("plane"))
    reports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    return sinks.plane_gaps(reports, have)


@query("""
SELECT o_orderkey AS run_id, '{"outcome":"' || CASE WHEN o_orderstatus = 'F' THEN 'SCORED' ELSE 'GATE_FAILED' END || '"'
       || CASE WHEN o_orderstatus = 'F' THEN ',"score":"' || o_orderpriority || '"' ELSE '' END || '}' AS report FROM orders""")
def report_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "SCORED").otherwise("GATE_FAILED").alias("outcome"),
        F.col("o_orderpriority").alias("score"))
    return sinks.report_json(o, ["outcome", "score"])


@query("""
WITH t AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS a,
                  list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS added,
       array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS removed FROM t""")
def surface_delta(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.collect_set(F.when(done, F.col("o_orderpriority"))).alias("a"),
        F.collect_set(F.when(~done, F.col("o_orderpriority"))).alias("b"))
    return t.select("o_custkey", audit.surface_delta(F.col("a"), F.col("b")).alias("d")).select(
        "o_custkey", F.array_join(F.array_sort("d.added"), ",").alias("added"),
        F.array_join(F.array_sort("d.removed"), ",").alias("removed"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS record_id
FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def unique_names(spark, sf_dir):
    from tapelake.functions import text

    base = text.record_id(F.lit(None).cast("string"), F.col("p_name"), F.lit(""))
    part = table(spark, sf_dir, "part").select("p_partkey", base.alias("base"))
    return board.unique_names(part, "base", "p_partkey", "record_id").select("p_partkey", "record_id")


@query("""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+', 0) AS run_id, url FROM pages),
     ids AS (SELECT DISTINCT run_id, CAST(page_id AS VARCHAR) AS id FROM u)
SELECT u.run_id, page_id, id AS task_id FROM u JOIN ids ON u.run_id = ids.run_id AND contains(url, id)
WHERE NOT regexp_matches(substr(' ' || url, position(id IN url), 1), '[A-Za-z0-9_-]')
  AND NOT regexp_matches(substr(url || ' ', position(id IN url) + length(id), 1), '[A-Za-z0-9_-]')""")
def named_tasks(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+", 0).alias("run_id"), "url")
    ids = u.select("run_id", F.col("page_id").cast("string").alias("task_id")).distinct()
    return board.named_tasks(u, ids, ["page_id"], "url")


@query("""
SELECT page_id, CASE WHEN starts_with(url, 'https://') AND NOT contains(url, ';')
    THEN 'https://viewer.example/?trace=' || url_encode(url) || '#view=calls' END AS link FROM pages""")
def viewer_links(spark, sf_dir):
    from tapelake.functions import text

    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.viewer_url("https://viewer.example/", F.col("url"), none).alias("link"))
