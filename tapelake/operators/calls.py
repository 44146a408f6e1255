"""Per-tool statistics, the error list and confirmation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import text, typed
from tapelake.operators.ordered import equi_join, nearest_rank, row_number
from tapelake.operators.records import messages


def tool_stats(call_rows: DataFrame, keys: Sequence[str] = ("run_id", "plane"), tool: str = "tool") -> DataFrame:
    """Calls, errors, pending, p50/p95 of the timed calls and the pairing they came from."""
    origin = F.when(F.min("origin") != F.max("origin"), "mixed").otherwise(F.min("origin"))
    narrow = call_rows.select(*keys, tool, "latency_ms", F.col("error").isNotNull().alias("failed"), "pending", "origin")
    return nearest_rank(
        narrow, [*keys, tool],
        {"p50_ms": ("latency_ms", 0.5), "p95_ms": ("latency_ms", 0.95)},
        [F.count(F.lit(1)).alias("calls"),
         F.count_if("failed").alias("errors"),
         F.count_if("pending").alias("pending"),
         origin.alias("origin")])


def by_calls(df: DataFrame, name: str) -> DataFrame:
    """Reading order: most calls first, then the name in dictionary order."""
    return df.orderBy(F.desc("calls"), F.collate(F.col(name), "UNICODE"))


def placed(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add `place`, the position in the reading order of ``by_calls`` within the keys; names that only differ in bytes follow those."""
    rows = df.withColumn("__less", -F.col("calls")).withColumn("__name", F.collate(F.col(name), "UNICODE"))
    return row_number(rows, list(keys), ["__less", "__name", name], "place").drop("__less", "__name")


def by_time(df: DataFrame, t: str = "t") -> DataFrame:
    """Reading order of errors: by time, those without one first."""
    return df.orderBy(F.coalesce(F.col(t), F.lit("")))


def unanswered_by(failures: DataFrame, excused: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures whose key has no excuse. Excuses are reduced to their keys first."""
    return equi_join(failures, excused.select(*keys).distinct(), keys, "left_anti")


def error_list(recs: DataFrame, call_rows: DataFrame) -> DataFrame:
    """Tool failures, JSON-RPC errors of other methods, and model-side errors.

    Ids of failed tool calls are matched bare (not by source), and so is the
    method name; an id asked more than once takes its last method.
    """
    failed = call_rows.where(F.col("error").isNotNull())
    tool = failed.select("run_id", "plane", "t", F.lit("tool").alias("source"),
                         F.col("tool").alias("name"), F.col("error").alias("message"))

    raw = F.col("raw")
    frames = messages(recs).select(
        "run_id", "plane", "t", "dir", "line_no", "raw",
        F.try_variant_get(F.when(typed.present(raw, "$.id"), typed.at(raw, "$.id")), "$", "string").alias("id"),
        typed.text(raw, "$.method").alias("method"))
    methods = frames.where((F.col("dir") == "in") & F.col("id").isNotNull() & F.col("method").isNotNull()).groupBy(
        "run_id", "plane", "id").agg(F.max_by("method", "line_no").alias("asked"))
    errors = frames.where((F.col("dir") == "out") & typed.present(raw, "$.error")).select(
        "run_id", "plane", "t", "id", text.error_message(typed.at(raw, "$.error")).alias("message"))
    known = failed.where(F.col("origin") == "mcp").select("run_id", "plane", "id").distinct()
    other = errors.join(known, ["run_id", "plane", "id"], "left_anti").join(
        methods, ["run_id", "plane", "id"], "left")
    rpc = other.select(
        "run_id", "plane", "t", F.lit("jsonrpc").alias("source"),
        F.coalesce("asked", F.concat(F.lit("id "), F.col("id")), F.lit("(notification)")).alias("name"), "message")

    status = F.try_variant_get(typed.at(raw, "$.status"), "$", "string")
    llm = recs.where((F.col("dir") == "event") & (F.col("kind") == "llm.error")).select(
        "run_id", "plane", "t", F.lit("llm").alias("source"),
        F.coalesce(typed.text(raw, "$.endpoint"), typed.text(raw, "$.url"), F.lit("(llm)")).alias("name"),
        F.when(typed.present(raw, "$.error"), text.error_message(typed.at(raw, "$.error")))
        .when(typed.present(raw, "$.status"), F.concat(F.lit("HTTP "), status))
        .otherwise(F.lit("llm error")).alias("message"))
    return tool.unionByName(rpc).unionByName(llm)


def unconfirmed(actions: DataFrame, confirmations: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Actions with no confirmation of the same key strictly before them.

    Only the earliest confirmation of a key matters, so that side shrinks to
    one row per key and the join cannot multiply rows.
    """
    first = confirmations.groupBy(*keys).agg(F.min(at).alias("__first"))
    joined = equi_join(actions, first, keys, "left")
    earlier = F.coalesce(F.col("__first") < F.col(at), F.lit(False))
    return joined.where(~earlier).drop("__first")


def confirmations(recs: DataFrame, call_rows: DataFrame) -> DataFrame:
    """(run_id, corr_id, tool, t): input-required rounds and recorded confirmation events."""
    rounds = call_rows.where("input_required").select("run_id", "corr_id", "tool", "t")
    events = recs.where((F.col("rec") == "event") & (F.col("kind") == "fitness.mrtr_round")).select(
        "run_id", "corr_id", typed.text("raw", "$.tool").alias("tool"), "t")
    return rounds.unionByName(events).where(F.col("t").isNotNull())


def executed(call_rows: DataFrame) -> Column:
    """A call that ran: answered, not failed, not a request for more input."""
    return ~F.col("pending") & F.col("error").isNull() & ~F.col("input_required")
