"""Record classification and the typed projection of a tape line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import typed
from tapelake.sources.tapes import admitted

EVENT_DIRS = ("event", "command", "telemetry")
DEFAULT_SOURCE = "mcp-tape"  # fixed value: producer of a line that names none


def classify(record_type: Column, direction: Column) -> Column:
    """meta / end / turn by type, then event and message by direction, else other."""
    return (F.when(record_type.isin("meta", "end", "turn"), record_type)
            .when(direction.isin(*EVENT_DIRS), "event")
            .when(direction.isin("in", "out"), "message")
            .otherwise("other"))


def records(lines: DataFrame) -> DataFrame:
    """Typed records: rec, t, dir, kind, source, corr_id and the payload ``raw``."""
    rows = admitted(lines)
    return rows.select(
        "run_id", "plane", "line_no", "v",
        classify(typed.text("v", "$.type"), typed.text("v", "$.dir")).alias("rec"),
        typed.text("v", "$.t").alias("t"),
        typed.text("v", "$.dir").alias("dir"),
        typed.text("v", "$.kind").alias("kind"),
        F.coalesce(typed.text("v", "$.source"), F.lit(DEFAULT_SOURCE)).alias("source"),
        typed.text("v", "$.corr_id").alias("corr_id"),
        F.when(typed.present("v", "$.raw"), typed.at("v", "$.raw"))
        .otherwise(typed.at("v", "$.data")).alias("raw"))


def messages(recs: DataFrame) -> DataFrame:
    return recs.where(F.col("dir").isin("in", "out"))


def turns(recs: DataFrame) -> DataFrame:
    """Turn records with role, model, usage and timing; order by (ord, line_no)."""
    return recs.where(F.col("rec") == "turn").select(
        "run_id", "plane", "line_no", "source", "corr_id", "t",
        F.coalesce("t", F.lit("")).alias("ord"),
        typed.text("v", "$.role").alias("role"),
        F.coalesce(typed.text("v", "$.model"), F.lit("(no model)")).alias("model"),
        F.coalesce(typed.flag("v", "$.echoed"), F.lit(False)).alias("echoed"),
        typed.obj("v", "$.usage").isNotNull().alias("has_usage"),
        typed.num("v", "$.usage.input_tokens").alias("input_tokens"),
        typed.num("v", "$.usage.output_tokens").alias("output_tokens"),
        typed.num("v", "$.usage.cache_read_input_tokens").alias("cache_read_tokens"),
        typed.num("v", "$.usage.cache_creation_input_tokens").alias("cache_creation_tokens"),
        typed.num("v", "$.usage.thinking_tokens").alias("thinking_tokens"),
        typed.num("v", "$.timing.ttft_ms").alias("ttft_ms"),
        typed.num("v", "$.timing.duration_ms").alias("duration_ms"),
        typed.items("v", "$.blocks").alias("blocks"))


def live(turn_rows: DataFrame) -> DataFrame:
    return turn_rows.where(~F.col("echoed"))


def scored_only(rows: DataFrame, tasks: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows whose correlation id is exactly a driven task (phases are left out)."""
    wanted = tasks.select(*keys, F.col("task_id").alias("corr_id")).distinct()
    return rows.join(wanted, [*keys, "corr_id"], "left_semi")


def flip_direction(transport: Column) -> Column:
    """A client's outgoing request is the server's incoming frame."""
    return F.when(transport == "out", "in").when(transport == "in", "out")


def payload(raw: Column, data: Column) -> Column:
    return F.coalesce(raw, data)


def producer_label(meta: Column) -> Column:
    name, version = typed.text(meta, "$.producer.name"), typed.text(meta, "$.producer.version")
    return F.coalesce(
        typed.text(meta, "$.source"), typed.text(meta, "$.producer"),
        F.concat(name, F.lit("@"), version), name,
        F.concat(F.lit("mcp-tape@"), typed.text(meta, "$.mcpTapVersion")))


def timeline(*frames: DataFrame) -> DataFrame:
    """Planes and servers in one table, ordered by (t, plane, line_no) when read."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.withColumn("ord", F.coalesce("t", F.lit("")))


def decisions(rows: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Number the stretches of a timeline over which the correlation id stays the same."""
    from tapelake.operators.ordered import neighbour, running_sum

    order = ["ord", "plane", "line_no"]
    near = neighbour(rows.withColumn("__one", F.lit(1)), keys, order,
                     {"__prev": "corr_id", "__seen": "__one"}, -1)
    starts = F.when(F.col("__seen").isNull() | ~F.col("corr_id").eqNullSafe(F.col("__prev")), 1).otherwise(0)
    numbered = running_sum(near.withColumn("__start", starts), keys, order, {"decision": "__start"})
    return numbered.drop("__prev", "__seen", "__start", "__one")
