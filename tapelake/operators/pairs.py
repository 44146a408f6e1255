"""Pairing requests with responses and tool uses with their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import text, typed
from tapelake.operators.ordered import neighbour
from tapelake.operators.records import live, messages

CALL_COLUMNS = [
    "run_id", "plane", "source", "id", "tool", "t", "end_t", "latency_ms", "error", "protocol_error",
    "execution_error", "input_required", "pending", "origin", "corr_id", "args", "line_no", "pos"]


def pair_first_response(
    rows: DataFrame, keys: Sequence[str], order: str, is_request: Column, is_response: Column,
    request: Column, response: Column,
) -> DataFrame:
    """keys, request, response: one row per key that has a request.

    A key asked twice keeps its last request, a key answered twice its first
    answer, wherever the two sit in the file; an answer without a request is
    left out. Both sides are reduced in one aggregation, so a key of any size
    shrinks to one row before the shuffle.
    """
    return (
        rows.where(is_request | is_response)
        .groupBy(*keys)
        .agg(F.max_by(F.when(is_request, request), F.when(is_request, F.col(order))).alias("request"),
             F.min_by(F.when(is_response, response), F.when(is_response, F.col(order))).alias("response"))
        .where(F.col("request").isNotNull()))


def _frames(recs: DataFrame) -> DataFrame:
    return messages(recs).select(
        "run_id", "plane", "source", "line_no", "t", "dir", "corr_id", "raw",
        F.try_variant_get(F.when(typed.present("raw", "$.id"), typed.at("raw", "$.id")), "$", "string").alias("id"),
        typed.raw_text("raw", "$.method").alias("method"))


def wire_calls(recs: DataFrame, method: str = "tools/call") -> DataFrame:
    """One row per request of ``method`` on the wire plane."""
    raw = F.col("raw")
    failed = typed.present(raw, "$.error")
    reason = F.when(failed, text.error_message(typed.at(raw, "$.error"))).otherwise(text.tool_error(raw))
    paired = pair_first_response(
        _frames(recs).where(F.col("id").isNotNull()),
        ["run_id", "plane", "source", "id"], "line_no",
        (F.col("dir") == "in") & F.coalesce(F.col("method") == method, F.lit(False)), F.col("dir") == "out",
        F.struct("t", "corr_id", "line_no",
                 F.coalesce(typed.text(raw, "$.params.name"), F.lit("(unknown)")).alias("tool"),
                 F.to_json(typed.at(raw, "$.params.arguments")).alias("args")),
        F.struct("t", "corr_id", reason.alias("error"), failed.alias("protocol_error"),
                 text.input_required(raw).alias("input_required")))
    req, res = F.col("request"), F.col("response")
    false = F.lit(False)
    return paired.select(
        "run_id", "plane", "source", "id", req["tool"].alias("tool"), req["t"].alias("t"),
        res["t"].alias("end_t"), typed.millis_between(req["t"], res["t"]).alias("latency_ms"),
        res["error"].alias("error"),
        F.coalesce(res["protocol_error"], false).alias("protocol_error"),
        F.coalesce(~res["protocol_error"] & res["error"].isNotNull(), false).alias("execution_error"),
        F.coalesce(~res["protocol_error"] & res["input_required"], false).alias("input_required"),
        res.isNull().alias("pending"), F.lit("mcp").alias("origin"),
        F.coalesce(req["corr_id"], res["corr_id"]).alias("corr_id"), req["args"].alias("args"),
        req["line_no"].alias("line_no"), F.lit(0).alias("pos"))


def pair_next(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], opens: str, carried: Sequence[str]
) -> DataFrame:
    """Opening rows with the ``carried`` columns of the very next row if that one closes.

    A key that is opened again before it closes leaves the earlier opening
    unanswered; a close with nothing open is left out. ``opens`` is a boolean
    column and must be part of nothing else than this decision.
    """
    near = neighbour(rows, keys, order, {"__next_opens": opens, **{f"next_{c}": c for c in carried}}, 1)
    closed = F.coalesce(~F.col("__next_opens"), F.lit(False))
    return near.where(F.col(opens)).select(
        *rows.columns, closed.alias("closed"),
        *[F.when(closed, F.col(f"next_{c}")).alias(f"next_{c}") for c in carried])


def turn_calls(turn_rows: DataFrame) -> DataFrame:
    """One row per tool use of the live turns, with the result that closes it."""
    b = F.col("b")
    blocks = live(turn_rows).select(
        "run_id", "plane", "source", "corr_id", "t", "ord", "line_no", F.posexplode("blocks").alias("pos", "b"))
    is_use = typed.text(b, "$.type") == "tool_use"
    is_result = typed.text(b, "$.type") == "tool_result"
    id_path = F.when(is_use, typed.at(b, "$.id")).when(is_result, typed.at(b, "$.tool_use_id"))
    failed = F.coalesce(typed.flag(b, "$.is_error"), F.lit(False))
    # Inside one turn results come before uses: a result answers an earlier turn.
    steps = blocks.where(is_use | is_result).select(
        "run_id", "plane", "source", F.try_variant_get(id_path, "$", "string").alias("id"),
        "ord", "line_no", is_use.alias("is_use"), "pos", "t", "corr_id",
        F.coalesce(typed.text(b, "$.name"), F.lit("(unknown)")).alias("tool"),
        F.to_json(typed.at(b, "$.input")).alias("args"),
        failed.alias("failed"),
        F.when(failed, F.coalesce(F.nullif(text.block_text(typed.at(b, "$.content")), F.lit("")),
                                  F.lit("tool error"))).alias("error"),
    ).where(F.col("id").isNotNull())
    paired = pair_next(steps, ["run_id", "plane", "source", "id"],
                       ["ord", "line_no", "is_use", "pos"], "is_use", ["t", "error", "failed"])
    false = F.lit(False)
    return paired.select(
        "run_id", "plane", "source", "id", "tool", "t", F.col("next_t").alias("end_t"),
        typed.millis_between(F.col("t"), F.col("next_t")).alias("latency_ms"),
        F.col("next_error").alias("error"), false.alias("protocol_error"),
        F.coalesce("next_failed", false).alias("execution_error"), false.alias("input_required"),
        (~F.col("closed")).alias("pending"), F.lit("turn").alias("origin"), "corr_id", "args",
        "line_no", "pos")


def calls(recs: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Every call of every plane, from both kinds of pairing."""
    return wire_calls(recs).unionByName(turn_calls(turn_rows))


def tool_catalogue(recs: DataFrame) -> DataFrame:
    """Tools a run advertised: name, description, schema and annotations.

    Taken from the last answered ``tools/list`` of each run; a tool listed more
    than once on it counts once.
    """
    raw = F.col("raw")
    paired = pair_first_response(
        _frames(recs).where(F.col("id").isNotNull()), ["run_id", "plane", "source", "id"], "line_no",
        (F.col("dir") == "in") & F.coalesce(F.col("method") == "tools/list", F.lit(False)), F.col("dir") == "out",
        F.struct("line_no"), F.struct("line_no", typed.items(raw, "$.result.tools").alias("tools")))
    listed = paired.where(F.col("response.tools").isNotNull())
    last = listed.groupBy("run_id").agg(F.max_by("response.tools", "response.line_no").alias("tools"))
    tool = F.col("tool")
    rows = last.select("run_id", F.posexplode("tools").alias("pos", "tool")).select(
        "run_id", "pos", typed.text(tool, "$.name").alias("name"),
        typed.text(tool, "$.description").alias("description"),
        F.to_json(typed.at(tool, "$.inputSchema")).alias("input_schema"),
        typed.flag(tool, "$.annotations.readOnlyHint").alias("read_only"),
        typed.flag(tool, "$.annotations.destructiveHint").alias("destructive_hint"),
        F.to_json(tool).alias("definition"))
    return rows.where(F.col("name").isNotNull()).groupBy("run_id", "name").agg(*[
        F.min_by(c, "pos").alias(c)
        for c in ("description", "input_schema", "read_only", "destructive_hint", "definition")])


def is_destructive(read_only: Column, hint: Column) -> Column:
    """Destructive unless declared read-only or declared not destructive."""
    return ~(F.coalesce(read_only, F.lit(False)) | F.coalesce(~hint, F.lit(False)))
