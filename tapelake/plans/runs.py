"""Whole-run plans put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.operators import admission, calls, pairs, records, score, sessions, usage
from tapelake.session import written
from tapelake.sources import tapes


def ingest(lines: DataFrame) -> DataFrame:
    """Classify every line once and keep the result: all later plans read this table."""
    return written(records.records(lines), "records")


def trace_stats(lines: DataFrame, prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """The statistics of every tape and run, as tables keyed by run_id (and plane).

    ``plane_*`` tables hold each plane by itself; the others are merged per run
    (tools and models of one plane only, errors and sessions of both).
    """
    prices = usage.price_table(lines.sparkSession) if prices is None else prices
    recs = ingest(lines)
    turns = records.turns(recs)
    every = written(pairs.calls(recs, turns), "calls")
    tools = written(calls.tool_stats(every), "tools")
    models = written(usage.priced(usage.model_usage(turns), prices), "models")
    errors = calls.error_list(recs, every)
    session_rows = sessions.sessions(recs).join(tapes.skipped_lines(lines), ["run_id", "plane"], "left")
    return {
        "records": recs, "calls": every,
        "plane_sessions": session_rows, "plane_tools": tools, "plane_models": models, "plane_errors": errors,
        "sessions": sessions.merged_sessions(session_rows), "tools": sessions.merged_tools(tools),
        "models": sessions.merged_models(models), "errors": sessions.merged_errors(errors, tools),
        "summary": usage.model_summary(sessions.merged_models(models), turns),
        "prices_as_of": usage.prices_as_of(prices),
    }


def run_scores(lines: DataFrame, tasks: DataFrame, outcomes: DataFrame,
               prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores of every run: task results, tool attribution and the score itself.

    Only lines of driven tasks count; the reference and null passes of a gate
    carry a phase in their correlation id and are left out here.
    """
    prices = usage.price_table(lines.sparkSession) if prices is None else prices
    recs = ingest(lines)
    catalogue = written(pairs.tool_catalogue(recs), "catalogue")
    driven = records.scored_only(recs, tasks)
    turns = records.turns(driven)
    chosen = written(score.chosen_calls(pairs.calls(driven, turns)), "chosen")
    results = written(score.task_results(
        tasks, outcomes, chosen, driven, score.task_usage(turns, prices), catalogue), "results")
    return {"tasks": results, "tools": score.tool_attribution(chosen, results, driven, catalogue),
            "scores": score.score_block(results)}


def suite_admission(raw: DataFrame, tools: DataFrame, context: DataFrame, cold: DataFrame,
                    target: int = admission.SUITE_TASKS, exclude_destructive: bool = False) -> DataFrame:
    """The synthesis ledger: one row per candidate with its fate. Written before it is
    returned, so it exists whatever happens to the suite afterwards."""
    screened = admission.screen(raw, tools, context, exclude_destructive=exclude_destructive)
    admitted = admission.null_screen(admission.admit(screened), cold)
    return written(admission.trim(admitted, target), "ledger")


def compact_ledger(ledger: DataFrame, cold: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One row per run: yield, drops by rule (a small map) and the null screen's counts."""
    rules = admission.drop_ledger(ledger, keys, "reason").groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "dropped")))).alias("drops_by_rule"))
    balance = admission.reconcile(ledger, keys, "reason", "trimmed")
    screen = admission.screen_summary(cold, keys)
    screen = screen.select(*keys, *[F.col(c).alias(f"screen_{c}") for c in screen.columns if c not in keys])
    rate = F.try_divide(F.col("admitted"), F.col("candidates"))
    return balance.join(rules, list(keys), "left").join(screen, list(keys), "left").withColumn("admission_rate", rate)
