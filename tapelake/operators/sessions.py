"""Session statistics per tape and the merge of a run's two planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import typed
from tapelake.operators.records import producer_label

KINDS = ("meta", "message", "event", "turn", "end", "other")


def kind_counts(kind: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(kind == k).alias(k) for k in KINDS]]


def sessions(recs: DataFrame) -> DataFrame:
    """One row per tape: first meta, first end, record counts, last time, duration."""
    is_meta, is_end = F.col("rec") == "meta", F.col("rec") == "end"
    # Only the line's own fields travel, never the whole frame.
    meta = F.struct(
        typed.text("v", "$.label").alias("label"),
        F.coalesce(typed.text("v", "$.kind"), F.lit("mcp")).alias("kind"),
        typed.text("v", "$.startedAt").alias("started_at"),
        F.filter(F.transform(typed.items("v", "$.command"), lambda c: typed.raw_text(c)),
                 lambda c: c.isNotNull()).alias("command"),
        producer_label(F.col("v")).alias("producer"))
    end = F.struct(F.col("t"), typed.num("v", "$.durationMs").alias("duration_ms"),
                   typed.text("v", "$.reason").alias("reason"), typed.num("v", "$.exitCode").alias("exit_code"))
    rows = recs.groupBy("run_id", "plane").agg(
        *kind_counts(F.col("rec")), F.max("t").alias("last_t"),
        F.min_by(F.when(is_meta, meta), F.when(is_meta, F.col("line_no"))).alias("m"),
        F.min_by(F.when(is_end, end), F.when(is_end, F.col("line_no"))).alias("e"))
    ended = F.coalesce("e.t", "last_t")
    return rows.select(
        "run_id", "plane", "total", *KINDS,
        F.col("m.label").alias("label"), F.col("m.kind").alias("kind"),
        F.col("m.started_at").alias("started_at"), ended.alias("ended_at"),
        F.coalesce("e.duration_ms", typed.millis_between(F.col("m.started_at"), ended).cast("double"))
        .alias("duration_ms"),
        F.when(F.size("m.command") > 0, F.col("m.command")).alias("command"),
        F.col("m.producer").alias("producer"), F.col("e.reason").alias("end_reason"),
        F.col("e.exit_code").alias("exit_code"))


def _prefer(column: str) -> Column:
    """The wire plane's value, else the agent plane's."""
    return F.coalesce(F.max(F.when(F.col("plane") == "mcp", F.col(column))),
                      F.max(F.when(F.col("plane") == "agent", F.col(column))))


def merged_sessions(session_rows: DataFrame) -> DataFrame:
    """One row per run over its two planes: counts added, earliest start, latest end."""
    rows = session_rows.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in ("total", *KINDS)],
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        *[_prefer(c).alias(c) for c in ("label", "command", "producer", "end_reason")],
        _prefer("duration_ms").alias("__duration"))
    return rows.withColumn("duration_ms", F.coalesce(
        typed.millis_between(F.col("started_at"), F.col("ended_at")).cast("double"), "__duration")).drop("__duration")


def tools_plane(tool_rows: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Which plane a run's tool table is taken from: the wire if it saw any call."""
    return tool_rows.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("plane") == "mcp"), "mcp").otherwise("agent").alias("tools_plane"))


def merged_tools(tool_rows: DataFrame) -> DataFrame:
    """Tool rows of the chosen plane only: both planes describe the same calls."""
    flags = tools_plane(tool_rows)
    return tool_rows.join(flags, "run_id").where(F.col("plane") == F.col("tools_plane")).drop("tools_plane")


def merged_errors(error_rows: DataFrame, tool_rows: DataFrame) -> DataFrame:
    """Errors of both planes, without tool errors of the plane that was not chosen."""
    flags = tools_plane(tool_rows)
    joined = error_rows.join(flags, "run_id", "left")
    chosen = F.col("plane") == F.coalesce("tools_plane", F.lit("agent"))
    return joined.where(chosen | (F.col("source") != "tool")).drop("tools_plane")


def merged_models(model_rows: DataFrame) -> DataFrame:
    """Models of the agent plane when it has any, else of the wire plane."""
    flags = model_rows.groupBy("run_id").agg(
        F.when(F.bool_or(F.col("plane") == "agent"), "agent").otherwise("mcp").alias("__plane"))
    return model_rows.join(flags, "run_id").where(F.col("plane") == F.col("__plane")).drop("__plane")
