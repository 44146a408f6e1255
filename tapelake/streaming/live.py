"""Live tapes with Structured Streaming.

A tape is an append-only file, so a folder of growing tapes is a file stream.
Lines arrive roughly in time order; the watermark on ``ts`` bounds the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapelake.functions import stats, text, typed
from tapelake.operators.records import records
from tapelake.sources import ledger
from tapelake.sources.tapes import TAPE_PATH, parsed


def tape_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Tape lines as they are appended. There is no line number on a stream; order by ``t``."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(path).select(
        F.regexp_extract("_metadata.file_path", TAPE_PATH, 1).alias("run_id"),
        F.regexp_extract("_metadata.file_path", TAPE_PATH, 2).alias("plane"),
        F.lit(None).cast("long").alias("line_no"), F.col("value").alias("raw_text"))
    return parsed(lines.where(F.trim("raw_text") != ""))


def stream_records(lines: DataFrame) -> DataFrame:
    return records(lines).withColumn("ts", F.try_to_timestamp("t"))


def live_pairs(requests: DataFrame, responses: DataFrame, keys: Sequence[str], delay: str, timeout: str) -> DataFrame:
    """Requests with their response, or with NULL once ``timeout`` has passed.

    Both sides: keys, ts, other columns. A key counts once per side within the
    watermark. Unlike the batch pairing, a response must not precede its request.
    """
    ask = requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    answer = responses.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    left = ask.select(*[F.col(c).alias(f"req_{c}") for c in ask.columns])
    right = answer.select(*[F.col(c).alias(f"res_{c}") for c in answer.columns])
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"req_{k}") == F.col(f"res_{k}"))
    window = (F.col("res_ts") >= F.col("req_ts")) & (F.col("res_ts") <= F.col("req_ts") + F.expr(f"INTERVAL {timeout}"))
    joined = left.join(right, match & window, "left")
    latency = F.unix_millis("res_ts") - F.unix_millis("req_ts")
    return joined.withColumn("latency_ms", latency).withColumn("pending", F.col("res_ts").isNull())


def windowed_counts(rows: DataFrame, keys: Sequence[str], width: str, delay: str | None = None,
                    latency: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts per tumbling window and key, with an approximate p95 when a latency is given."""
    source = rows if delay is None else rows.withWatermark(ts, delay)
    aggs = [F.count(F.lit(1)).alias("calls")]
    if latency:
        aggs.append(F.percentile_approx(latency, 0.95).alias("p95_ms_approx"))
    out = source.groupBy(F.window(ts, width), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), *keys,
                      *[c for c in out.columns if c not in (*keys, "window")])


def running_verdict(outcomes: DataFrame, keys: Sequence[str], passed: str, threshold: float,
                    alpha: float = 0.05) -> DataFrame:
    """Gate verdict per suite as outcomes arrive (update mode)."""
    summed = outcomes.groupBy(*keys).agg(F.count_if(passed).alias("k"), F.count(F.lit(1)).alias("n"))
    return summed.withColumn("outcome", stats.gate_outcome("k", "n", threshold, alpha))


def sessions(rows: DataFrame, keys: Sequence[str], gap: str, delay: str | None = None, ts: str = "ts") -> DataFrame:
    """Stretches of activity with no gap of ``gap`` or more (streaming, or batch over modest groups)."""
    source = rows if delay is None else rows.withWatermark(ts, delay)
    out = source.groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*keys, F.col("session_window.start").alias("started"), "events")


def session_gaps(rows: DataFrame, keys: Sequence[str], ts: str, gap_ms: int, tie: str) -> DataFrame:
    """The batch form for groups of any size: one row per session, with its number."""
    from tapelake.operators.ordered import neighbour, running_sum

    at = rows.withColumn("__ms", F.unix_millis(ts))
    near = neighbour(at, keys, ["__ms", tie], {"__before": "__ms"}, -1)
    starts = (F.col("__before").isNull() | (F.col("__ms") - F.col("__before") >= gap_ms)).cast("long")
    numbered = running_sum(near.withColumn("__start", starts), keys, ["__ms", tie], {"session": "__start"})
    return numbered.groupBy(*keys, "session").agg(
        F.min("__ms").alias("started_ms"), F.max("__ms").alias("ended_ms"), F.count(F.lit(1)).alias("events"))


CALL = "struct<ord:bigint,t:string,tool:string,corr_id:string>"
ANSWER = "struct<ord:bigint,t:string,error:string,protocol_error:boolean>"
LIVE_CALLS = f"run_id string, plane string, source string, id string, request {CALL}, response {ANSWER}"


def call_frames(lines: DataFrame, order: Column, method: str = "tools/call") -> DataFrame:
    """Frames of tool calls and their answers in the shape of LIVE_CALLS, one side of each row NULL.

    lines: run_id, plane, raw_text. ``order`` is a long over the parsed line ``v`` that tells which of two frames came first.
    """
    rows = records(parsed(lines).withColumn("line_no", order))
    raw = F.col("raw")
    asks = (F.col("dir") == "in") & F.coalesce(typed.raw_text(raw, "$.method") == method, F.lit(False))
    failed = typed.present(raw, "$.error")
    reason = F.when(failed, text.error_message(typed.at(raw, "$.error"))).otherwise(text.tool_error(raw))
    request = F.struct(F.col("line_no").alias("ord"), "t", F.coalesce(typed.text(raw, "$.params.name"), F.lit("(unknown)")).alias("tool"), "corr_id")
    answer = F.struct(F.col("line_no").alias("ord"), "t", reason.alias("error"), failed.alias("protocol_error"))
    frames = rows.select(
        "run_id", "plane", "source", F.try_variant_get(F.when(typed.present(raw, "$.id"), typed.at(raw, "$.id")), "$", "string").alias("id"),
        F.when(asks, request).cast(CALL).alias("request"), F.when(F.col("dir") == "out", answer).cast(ANSWER).alias("response"))
    return frames.where(F.col("id").isNotNull() & (F.col("request").isNotNull() | F.col("response").isNotNull()))


def paired(frames: DataFrame) -> DataFrame:
    """The last request and the first answer of each key. Frames that come twice, late or in any order change nothing."""
    keys = ["run_id", "plane", "source", "id"]
    return frames.groupBy(*keys).agg(F.max_by("request", "request.ord").alias("request"), F.min_by("response", "response.ord").alias("response"))


def keep_calls(frames: DataFrame, path: str, checkpoint: str, buckets: int = ledger.BUCKETS) -> StreamingQuery:
    """Keep a table of calls up to date from a stream of frames; ``calls_of`` reads it.

    Every micro-batch is reduced to one row per call and merged into the table (``ledger.update``), which rewrites the buckets it touches. The
    batch's number is the update's tag, so a batch that Spark repeats after a lost driver is applied once, and the checkpoint lets the stream go on where it
    ended. No frame is too late: state is the table itself, not memory.
    """
    def merge(batch: DataFrame, number: int) -> None:
        ledger.update(paired(batch), path, ["run_id", "plane", "source", "id"], lambda old, new: paired(old.unionByName(new)), f"{checkpoint}#{number}", buckets)

    return frames.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def calls_of(spark: SparkSession, path: str) -> DataFrame:
    """The calls of a table that ``keep_calls`` writes: those asked for, with latency and error, pending while unanswered."""
    rows = ledger.read(spark, path, LIVE_CALLS).where("request IS NOT NULL")
    return rows.select(
        "run_id", "plane", "source", "id", F.col("request.tool").alias("tool"), F.col("request.t").alias("t"), F.col("response.t").alias("end_t"),
        F.when(F.col("response").isNotNull(), typed.millis_between(F.col("request.t"), F.col("response.t"))).alias("latency_ms"),
        F.col("response.error").alias("error"), F.coalesce("response.protocol_error", F.lit(False)).alias("protocol_error"),
        F.col("response").isNull().alias("pending"))
