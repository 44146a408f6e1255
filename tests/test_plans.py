import json

from pyspark.sql import functions as F

from conftest import rows
from tapelake.operators import board, redact
from tapelake.plans import runs
from tapelake.sources import tapes as source
from test_admission import CASES, tools_of
from test_board import reports, run
from tapes import OUTCOMES, agent, lines, wire


def test_trace_stats_of_two_runs(spark):
    data = lines("r1", "mcp", wire()) + lines("r1", "agent", agent()) + lines("r2", "agent", agent() + ["broken"])
    out = runs.trace_stats(source.lines_of(spark, data))
    tools = {(r.run_id, r.tool): (r.plane, r.calls) for r in out["tools"].collect()}
    assert tools["r1", "seat_map"] == ("mcp", 4) and tools["r2", "seat_map"] == ("agent", 1)
    merged = {r.run_id: r for r in out["sessions"].collect()}
    assert (merged["r1"].total, merged["r2"].total) == (33, 10)
    assert rows(out["errors"], "run_id", "source", "name") == [("r1", "tool", "find_slot")] * 2
    assert rows(out["plane_sessions"], "run_id", "plane", "skipped_lines") == [("r1", "agent", 0), ("r1", "mcp", 0), ("r2", "agent", 1)]
    assert out["summary"].count() == 2 and out["prices_as_of"].first().as_of == "2026-08-19"


def test_scores_leave_gate_passes_out(spark):
    extra = [{**r, "corr_id": "v1::construct"} for r in wire() if r.get("corr_id") == "v1"]
    data = lines("r1", "mcp", wire() + extra) + lines("r1", "agent", agent())
    tasks = spark.createDataFrame([("r1", f"v{i}", i) for i in range(1, 6)], "run_id string, task_id string, position int")
    told = spark.createDataFrame([("r1", *o) for o in OUTCOMES],
                                 "run_id string, task_id string, first_try boolean, success boolean, budget_exhausted boolean, failure_tool string"
                                 ).withColumn("mrtr_abandoned", F.lit(False))
    out = runs.run_scores(source.lines_of(spark, data), tasks, told)
    s = out["scores"].first()
    assert (s.first_try_k, s.n, s.unconfirmed_calls) == (3, 5, 1)
    assert {r.tool: r.calls for r in out["tools"].collect()}["seat_map"] == 4


def test_suite_ledger(spark):
    raw = spark.createDataFrame([("r", i, json.dumps(c)) for i, c in enumerate(CASES.values())], "run_id string, position int, t string")
    raw = raw.select("run_id", "position", F.parse_json("t").alias("task"))
    context = spark.createDataFrame([("r", 0, "Tools are used anonymously.")], "run_id string, text_no int, text string")
    cold = spark.createDataFrame([("r", "second", True, None, 9, 2)],
                                 "run_id string, task_id string, cold_passed boolean, error string, input_tokens int, output_tokens int")
    ledger = runs.suite_admission(raw, tools_of(spark), context, cold, target=2)
    r = runs.compact_ledger(ledger, cold).first()
    assert (r.candidates, r.reconciles, r.admitted, r.screen_deleted) == (len(CASES), True, 2, 1)
    assert r.drops_by_rule["null_screen"] == 1 and r.drops_by_rule["malformed"] == 1 and r.screen_input_tokens == 9


def test_spend_entries(spark):
    doc = run("s#1", "SCORED", trace_stats={"models": {"perModel": [{"estCostUsd": 0.1}, {"estCostUsd": None}]}}, score={"tasks": [{}, {}]})
    known = run("s#2", "SCORED")
    known["run"]["judgeUsage"] = {"estCostUsd": 0.3}
    got = {r.run_id: r for r in board.spend_entries(reports(spark, doc, known)).collect()}
    assert (got["s#1"].est_usd, got["s#1"].judge_usd, got["s#1"].judge_measured, got["s#1"].tasks) == (0.52, None, False, 2)
    assert (got["s#2"].est_usd, got["s#2"].judge_measured) == (0.3, True)


def test_a_long_secret_list_goes_in_passes(spark, monkeypatch):
    monkeypatch.setattr(redact, "NEEDLES", 2)
    df = spark.createDataFrame([(1, "abcdef-abcdefgh"), (2, "nothing"), (3, None), (4, "zzzzzz qqqqqq")], "id int, body string")
    secrets = spark.createDataFrame([("abcdef",), ("abcdefgh",), ("qqqqqq",), ("tiny",)], "secret string")
    assert rows(redact.scrub(df, "body", secrets), "id", "body") == [
        (1, "[REDACTED]-[REDACTED]"), (2, "nothing"), (3, None), (4, "zzzzzz [REDACTED]")]
