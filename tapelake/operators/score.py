"""Task outcomes, tool attribution and the score of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import stats, text, typed
from tapelake.operators.calls import confirmations, executed, unconfirmed
from tapelake.operators.ordered import nearest_rank
from tapelake.operators.pairs import is_destructive
from tapelake.operators.sessions import tools_plane
from tapelake.operators.usage import TOOL_OVERHEAD, cost_usd, with_price

# --- success predicates and task rollup ------------------------------------


def check_passed(kind: Column, value: Column, pattern: Column, pattern_ok: Column, tool: Column,
                 final_text: Column, calls: Column, judged: Column) -> Column:
    """One task's success predicate; NULL when it cannot be decided.

    ``calls`` is array<struct<tool,ok,text>>. A pattern that does not compile is
    a defect of the suite, so it decides nothing and is never compiled here.
    """
    any_pattern = F.concat(F.lit("(?i)"), pattern)
    right = lambda c: (c["tool"] == tool) & c["ok"]
    return (F.when(kind == "substring", F.contains(text.collapse(final_text), text.collapse(value)))
            .when(kind == "regex", F.when(pattern_ok, F.regexp_like(final_text, any_pattern)))
            .when(kind == "tool_called", F.exists(calls, right))
            .when(kind == "tool_result_matches",
                  F.when(pattern_ok, F.exists(calls, lambda c: right(c) & F.regexp_like(c["text"], any_pattern))))
            .when(kind == "judge", judged))


def failure_class(success: Column, budget: Column, abandoned: Column, schema_reject: Column,
                  protocol: Column, tool_error: Column, loop_error: Column) -> Column:
    """The class a task is reported under, worst cause first; NULL for none."""
    return (F.when(budget, "budget-exhausted")
            .when(abandoned, "mrtr-abandoned")
            .when(schema_reject, "schema-validation-reject")
            .when(protocol, "protocol-error")
            .when(tool_error & success, "execution-error-recovered")
            .when(tool_error, "execution-error-fatal")
            .when(loop_error & ~success, "protocol-error"))


def task_rollup(steps: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("run_id", "task_id")) -> DataFrame:
    """Outcome per task from its recorded call statuses and check result.

    steps: keys, seq, tool, status. verdicts: keys, check_passed, budget_exhausted, loop_error.
    """
    bad = F.col("status") != "ok"
    seen = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tool_calls"), F.bool_or(bad).alias("any_bad"),
        *[F.bool_or(F.col("status") == s).alias(n) for s, n in (
            ("mrtr-abandoned", "abandoned"), ("schema-validation-reject", "schema_reject"),
            ("protocol-error", "protocol"), ("tool-error", "tool_error"))],
        F.max_by(F.when(bad, F.col("tool")), F.when(bad, F.col("seq"))).alias("last_bad"),
        F.max_by("tool", "seq").alias("last_tool"))
    no = F.lit(False)
    joined = verdicts.join(seen, list(keys), "left")
    success = F.coalesce("check_passed", no)
    budget = F.coalesce("budget_exhausted", no)
    failure = failure_class(
        success, budget, *[F.coalesce(c, no) for c in ("abandoned", "schema_reject", "protocol", "tool_error")],
        F.col("loop_error").isNotNull())
    return joined.select(
        *keys, success.alias("success"),
        (success & ~F.coalesce("any_bad", no) & ~budget).alias("first_try"), failure.alias("failure"),
        F.when(failure.isNotNull(), F.coalesce("last_bad", "last_tool")).alias("failure_tool"),
        budget.alias("budget_exhausted"), F.coalesce("abandoned", no).alias("mrtr_abandoned"),
        F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"))


def final_answer(turn_texts: DataFrame, tool_texts: DataFrame, keys: Sequence[str] = ("run_id", "task_id")) -> DataFrame:
    """The last assistant turn with text, else the last tool text. Both: keys, seq, text."""
    filled = lambda df, n: df.where(F.col("text") != "").groupBy(*keys).agg(
        F.max_by("text", "seq").alias(n))
    both = filled(turn_texts, "said").join(filled(tool_texts, "shown"), list(keys), "full")
    return both.select(*keys, F.coalesce("said", "shown").alias("final_text"))


# --- score ---------------------------------------------------------------------


def task_outcomes(tasks: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Every suite task with its outcome; a task never reported is a failure."""
    no = F.lit(False)
    joined = tasks.join(outcomes, [*keys, "task_id"], "left")
    success = F.coalesce("success", no)
    return joined.withColumn("reported", F.col("success").isNotNull()).withColumn(
        "first_try", F.coalesce("first_try", no) & success).withColumn("success", success)


def net_tokens(gross: Column, overhead: Column, turn_count: Column) -> Column:
    """Tokens without the fixed cost of carrying the tool definitions; gross if that is unknown."""
    return gross - F.coalesce(overhead, F.lit(0)) * turn_count


def task_usage(turn_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens, net tokens and cost per (run_id, task_id), from live assistant turns.

    Usage is summed per model before pricing. A task any of whose models has no
    price has no cost.
    """
    spoken = turn_rows.where((F.col("role") == "assistant") & ~F.col("echoed") & F.col("corr_id").isNotNull())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    usage = spoken.groupBy("run_id", F.col("corr_id").alias("task_id"), "model").agg(
        F.count(F.lit(1)).alias("turns"),
        *[F.sum(zero(c)).alias(c) for c in (
            "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    spark = turn_rows.sparkSession
    overhead = spark.createDataFrame(
        [(i, m, o) for i, (m, o) in enumerate(TOOL_OVERHEAD)], "priority int, price_id string, overhead int")
    usage = with_price(with_price(usage, prices), overhead, values=("overhead",))
    gross = F.col("input_tokens") + F.col("output_tokens")
    cost = cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"),
                    F.col("cache_creation_tokens"), F.col("input_per_mtok"), F.col("output_per_mtok"))
    return usage.groupBy("run_id", "task_id").agg(
        F.sum("turns").alias("turns"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(net_tokens(gross, F.col("overhead"), F.col("turns"))).alias("net_tokens"),
        F.bool_or(F.col("overhead").isNull()).alias("overhead_unknown"),
        F.when(F.bool_or(F.col("input_per_mtok").isNull()), F.lit(None)).otherwise(F.sum(cost)).alias("cost_usd"))


def chosen_calls(call_rows: DataFrame) -> DataFrame:
    """Calls of the wire plane where a run has any, else of the agent plane."""
    flags = tools_plane(call_rows)
    return call_rows.join(flags, "run_id").where(F.col("plane") == F.col("tools_plane"))


def destructive_calls(call_rows: DataFrame, catalogue: DataFrame, recs: DataFrame) -> DataFrame:
    """Executed calls of destructive tools that nothing confirmed beforehand."""
    known = catalogue.select("run_id", F.col("name").alias("tool"), "read_only", "destructive_hint")
    ran = call_rows.where(executed(call_rows)).join(known, ["run_id", "tool"], "left").where(
        is_destructive(F.col("read_only"), F.col("destructive_hint")))
    return unconfirmed(ran, confirmations(recs, call_rows), ["run_id", "corr_id", "tool"], "t")


def task_results(tasks: DataFrame, outcomes: DataFrame, call_rows: DataFrame, recs: DataFrame,
                 usage: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per suite task: success, calls, tokens, cost, failure, unconfirmed calls.

    call_rows: the chosen plane's calls, phases left out.
    """
    no, zero = F.lit(False), F.lit(0)
    keys = ["run_id", "task_id"]
    wire = call_rows.groupBy("run_id", F.col("corr_id").alias("task_id")).agg(
        F.count(F.lit(1)).alias("tool_calls"), F.count_if("input_required").alias("mrtr_rounds"),
        F.bool_or("protocol_error").alias("protocol"), F.bool_or("execution_error").alias("tool_error"))
    rejects = recs.where(F.col("kind") == "fitness.schema_reject").select(
        "run_id", F.col("corr_id").alias("task_id"), F.lit(True).alias("schema_reject")).distinct()
    loose = destructive_calls(call_rows, catalogue, recs).groupBy(
        "run_id", F.col("corr_id").alias("task_id")).agg(F.count(F.lit(1)).alias("unconfirmed_calls"))
    rows = (task_outcomes(tasks, outcomes).join(wire, keys, "left").join(rejects, keys, "left")
            .join(usage, keys, "left").join(loose, keys, "left"))
    derived = failure_class(
        F.col("success"), F.coalesce("budget_exhausted", no), F.coalesce("mrtr_abandoned", no),
        F.coalesce("schema_reject", no), F.coalesce("protocol", no), F.coalesce("tool_error", no), no)
    return rows.select(
        *keys, "position", "reported", "first_try", "success", derived.alias("failure"),
        F.coalesce("failure_tool", F.lit(None)).alias("failure_tool"),
        F.coalesce("tool_calls", zero).alias("tool_calls"), F.coalesce("mrtr_rounds", zero).alias("mrtr_rounds"),
        "input_tokens", "output_tokens", "net_tokens", "cost_usd",
        F.coalesce("unconfirmed_calls", zero).alias("unconfirmed_calls"))


def score_block(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Success intervals over all tasks; means over the completed ones only (NULL if none)."""
    done = F.col("success")
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first_try").alias("first_try_k"),
        F.count_if(done).alias("eventual_k"),
        F.avg(F.when(done, F.col("tool_calls"))).alias("mean_calls"),
        F.avg(F.when(done, F.col("net_tokens"))).alias("mean_tokens"),
        F.avg(F.when(done, F.col("cost_usd"))).alias("mean_cost_usd"),
        F.sum("unconfirmed_calls").alias("unconfirmed_calls"))
    return out.withColumn("first_try", stats.wilson(F.col("first_try_k"), F.col("n"))).withColumn(
        "eventual", stats.wilson(F.col("eventual_k"), F.col("n")))


def class_counts(class_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of (keys, failure) to one map<failure, count> per key."""
    counted = class_rows.where(F.col("failure").isNotNull()).groupBy(*keys, "failure").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure", "n")))).alias("failure_classes"))


def tool_attribution(call_rows: DataFrame, results: DataFrame, recs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls, errors, latency and failure classes per tool.

    Wire errors are classed by the frame and by whether their task got there in
    the end; schema rejects come from their events; only the two terminal
    classes the wire cannot show are taken from the task's outcome.
    """
    keys = ["run_id", "tool"]
    tasks = results.select("run_id", F.col("task_id").alias("corr_id"), "success")
    failed = call_rows.where(F.col("error").isNotNull()).join(tasks, ["run_id", "corr_id"], "left")
    wire = failed.select(*keys, F.when(F.col("protocol_error"), "protocol-error").when(
        F.coalesce("success", F.lit(False)), "execution-error-recovered").otherwise("execution-error-fatal").alias("failure"))
    rejects = recs.where(F.col("kind") == "fitness.schema_reject").select(
        "run_id", typed.text("raw", "$.tool").alias("tool"), F.lit("schema-validation-reject").alias("failure"))
    last = call_rows.groupBy("run_id", F.col("corr_id").alias("task_id")).agg(
        F.max_by("tool", F.struct("t", "line_no", "pos")).alias("last_tool"))
    terminal = results.where(F.col("failure").isin("budget-exhausted", "mrtr-abandoned")).join(
        last, ["run_id", "task_id"]).select("run_id", F.coalesce("failure_tool", "last_tool").alias("tool"), "failure")
    classes = class_counts(wire.unionByName(rejects).unionByName(terminal), keys)
    rows = nearest_rank(call_rows, keys,
                        {"p50_ms": ("latency_ms", 0.5), "p95_ms": ("latency_ms", 0.95)},
                        [F.count(F.lit(1)).alias("calls"), F.count("error").alias("errors")])
    known = catalogue.select("run_id", F.col("name").alias("tool"), "read_only", "destructive_hint")
    return rows.join(classes, keys, "left").join(known, keys, "left").select(
        *keys, "calls", "errors", "p50_ms", "p95_ms", "failure_classes",
        is_destructive(F.col("read_only"), F.col("destructive_hint")).alias("declared_destructive"))


def reached_through_server(passes: DataFrame, call_rows: DataFrame, keys: Sequence[str] = ("run_id", "task_id")) -> DataFrame:
    """A reference pass counts only with a successful call of an expected tool.

    passes: keys, passed, expected_tools. call_rows: keys, tool, ok.
    """
    wanted = passes.select(*keys, F.explode("expected_tools").alias("tool")).distinct()
    reached = wanted.join(call_rows.where("ok").select(*keys, "tool").distinct(), [*keys, "tool"]).select(
        *keys, F.lit(True).alias("__hit")).distinct()
    out = passes.join(reached, list(keys), "left")
    return out.withColumn("passed", F.coalesce("passed", F.lit(False)) & F.coalesce("__hit", F.lit(False))).drop("__hit")
