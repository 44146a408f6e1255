"""Tables that change: ledgers updated in place and streams that go on where they ended."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapelake.functions import typed
from tapelake.plans.registry import query, table
from tapelake.plans.table_tapes import PAIRED, event_lines
from tapelake.session import scratch_dir
from tapelake.sources import ledger
from tapelake.streaming import live


@query("""
SELECT o_orderkey, 'c' || o_custkey AS slug, CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS version,
       round(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END, 2) AS usd
FROM orders
UNION ALL SELECT -1 - c_custkey, 'c' || c_custkey, 2, round(c_acctbal, 2) FROM customer""")
def ledger_upsert(spark, sf_dir):
    """A spend ledger written once and updated twice: rows of some customers change, then all finished ones, and new rows come."""
    path = f"{scratch_dir(spark)}/spend-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("slug"), "o_totalprice", "o_orderstatus", "o_custkey")

    def entries(rows, version, times):
        return rows.select("o_orderkey", "slug", F.lit(version).alias("version"), F.round(F.col("o_totalprice") * times, 2).alias("usd"))

    ledger.upsert(entries(o, 0, 1), path, ["o_orderkey"], "version", buckets=8)
    ledger.upsert(entries(o.where("o_custkey % 3 = 0"), 1, 2), path, ["o_orderkey"], "version", buckets=8)
    new = table(spark, sf_dir, "customer").select(
        (-1 - F.col("c_custkey")).alias("o_orderkey"), F.concat(F.lit("c"), "c_custkey").alias("slug"), F.lit(2).alias("version"), F.round("c_acctbal", 2).alias("usd"))
    finished = entries(o.where("o_orderstatus = 'F'"), 2, 3)
    earlier = entries(o.where("o_orderstatus = 'F'"), 1, 9)  # the same keys once more in the same update
    ledger.upsert(finished.unionByName(earlier).unionByName(new), path, ["o_orderkey"], "version", buckets=8)
    return ledger.read(spark, path, finished.schema)


@query(PAIRED + """
SELECT run_id, tool, count(*) AS calls, count(*) FILTER (pending) AS pending, count(*) FILTER (bad) AS errors,
       CAST(sum(latency) AS BIGINT) AS latency_ms FROM c GROUP BY ALL""")
def live_calls(spark, sf_dir):
    """The events' lines in three drops, each read by a stream that starts again from its checkpoint; the last drop repeats the first."""
    base = f"{scratch_dir(spark)}/live-{uuid.uuid4().hex}"
    lines = event_lines(spark, sf_dir).select(
        "run_id", "plane", F.concat(F.lit('{"n":'), "line_no", F.lit(","), F.substring("raw_text", 2, 1 << 30)).alias("raw_text"),
        F.pmod(F.xxhash64("line_no"), F.lit(3)).alias("drop"))
    for drops in ((0,), (1,), (2, 0)):
        lines.where(F.col("drop").isin(*drops)).drop("drop").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("run_id string, plane string, raw_text string").parquet(f"{base}/in")
        live.keep_calls(live.call_frames(stream, typed.num("v", "$.n").cast("long")), f"{base}/calls", f"{base}/checkpoint", 8).awaitTermination()
    rows = live.calls_of(spark, f"{base}/calls")
    return rows.groupBy("run_id", "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("pending").alias("pending"), F.count("error").alias("errors"), F.sum("latency_ms").alias("latency_ms"))
