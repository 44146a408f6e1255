import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapelake.operators import board
from tapelake.sources import sinks
from tapelake.sources import tapes as source


def reports(spark, *docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "file_order int, t string")
    return source.reports_of(df.select("file_order", F.parse_json("t").alias("r")))


def test_ranking_equals_the_pairwise_rule(spark, group_limit):
    rng = random.Random(2)
    data = []
    for band in ("x", "y"):
        for i in range(25):
            low = rng.randint(0, 12) / 20
            data.append((band, f"s{i:02d}", low + 0.05, low, low + rng.randint(0, 4) / 20))
    df = spark.createDataFrame(data, "band string, slug string, rate double, low double, high double")
    ranked = board.dominance_rank(df, ["band"], "low", "high")
    got = {(r.band, r.slug): r for r in board.display_order(ranked, ["band"], "rate", "slug", "low", "high").collect()}
    rank = {(b, s): 1 + sum(1 for o in data if o[0] == b and o[3] > h) for b, s, _, _, h in data}
    overlap = lambda a, b: a[3] <= b[4] and b[3] <= a[4]
    for row in data:
        peers = [o for o in data if o[0] == row[0] and o[1] != row[1] and rank[o[:2]] == rank[row[:2]] and overlap(o, row)]
        r = got[row[:2]]
        assert (r.rank, r.tied, r.group_size) == (rank[row[:2]], bool(peers), len(peers) + 1), row
    for band in ("x", "y"):
        shown = sorted((r for r in data if r[0] == band), key=lambda r: (-r[2], r[1]))
        for above, row in zip([None, *shown], shown):
            assert got[row[:2]].overlaps_above == bool(above and overlap(above, row))
        total = next(r for r in board.separation(ranked, ["band"]).collect() if r.band == band)
        assert total.separated == sum(1 for a in data for b in data if a[0] == b[0] == band and a[3] > b[4])


def test_cohorts_and_names(spark, group_limit):
    df = spark.createDataFrame([("s", "2026-02", 0), ("s", None, 1), ("s", "2026-01", 2), ("s", "2026-02", 3), ("t", None, 4)],
                               "slug string, started string, seq int")
    assert rows(board.cohorts(df, ["slug"], "started", "seq"), "seq", "attempt", "runs") == [
        (0, 2, 4), (1, 4, 4), (2, 1, 4), (3, 3, 4), (4, 1, 1)]
    r = board.rerun_summary(df, ["slug"]).first()
    assert (r.servers, r.rows, r.total_servers) == (1, 4, 2)


def greedy_names(bases):
    taken, out = set(), []
    for base in bases:
        n, got = 2, base
        while got in taken:
            got, n = f"{base}-{n}", n + 1
        taken.add(got)
        out.append(got)
    return out


@pytest.mark.parametrize("bases", [
    ["a", "a", "a-2", "a", "b"], ["a-2", "a", "a", "a"], ["a-2", "a-2", "a", "a", "a-2-2"], ["x"] * 6, ["a", "b", "a-3", "a", "a", "a"]])
def test_names_stay_unique(spark, bases):
    df = spark.createDataFrame(list(enumerate(bases)), "seq int, base string")
    assert [r.id for r in board.unique_names(df, "base", "seq", "id").orderBy("seq").collect()] == greedy_names(bases)


def run(id, outcome, refused=None, records=(), **extra):
    return {"server": {"slug": id.split("#")[0]}, "run": {"id": id, "startedAt": "2026-01-01", "generatorVersion": "g/2", "runnerModel": "m"},
            "outcome": outcome, "gates": {"records": list(records), "refusedAt": refused, **extra.pop("gates", {})}, **extra}


SCORED = run("s1", "SCORED", score={"firstTrySuccess": {"rate": .5, "low": .3, "high": .7, "k": 5, "n": 10}, "runnerModel": "mm",
                                    "tasks": [{"taskId": "t1", "failure": "protocol-error"}, {"taskId": "t2"}]})
REFUSED = run("s2", "GATE_FAILED", "construct", [
    {"gate": "structural", "ok": False, "costTier": "free", "reason": "x", "detail": {"nGenerated": 3, "nRequested": 20}},
    {"gate": "suite_size", "ok": False}, {"gate": "protocol_hygiene", "ok": False},
    {"gate": "construct", "ok": False, "costTier": "paid", "reason": "below_min_rate", "verdict": {"k": 22, "n": 30}}])


def test_refusals_families_and_stories(spark):
    df = reports(spark, SCORED, REFUSED, run("s3", "GATE_FAILED", None, [{"gate": "null_baseline", "ok": False, "costTier": "cheap"}]),
                 run("s4", "GATE_FAILED", "gone"))
    got = {r.run_id: (r.gate, r.family) for r in board.refusals(df).collect()}
    assert got == {"s1": (None, "scored"), "s2": ("construct", "paid"), "s3": ("null_baseline", "cheap"), "s4": ("gone", "unclassified")}
    stories = rows(board.failed_gates(df).where("run_id = 's2'"), "story_no", "gate")
    assert stories == [(1, "construct"), (2, "structural")]
    d = {r.run_id: r for r in board.decisive(df).collect()}
    assert (d["s1"].k, d["s1"].n, d["s2"].k, d["s2"].n, d["s3"].k) == (5, 10, 22, 30, None)
    buckets = {r.family: r for r in board.family_buckets(board.refusals(df), "family", "outcome", "gate", "generator").collect()}
    assert [(c.code, c["count"]) for c in buckets["paid"].codes] == [("GATE_FAILED", 1)] and buckets["paid"].gates == ["construct"]
    first = df.where("run_id = 's1'").first()
    assert (first.runner_model, first.generator, first.first_try.k) == ("mm", "g/2", 5)


def test_costs(spark):
    tape = lambda usd, **k: {"models": {"cost": {"totalUsd": usd, "unpricedModels": [], **k}, "summary": {"assistantTurns": 3}}}
    judge = {"model": "j", "calls": 2, "estCostUsd": 0.5, "byModel": [{"model": "j", "estCostUsd": 0.5}]}
    df = reports(
        spark, run("whole", "SCORED", trace_stats=tape(1.0), judgeUsage=judge),
        run("nojudge", "SCORED", trace_stats=tape(1.0)),
        run("partial", "SCORED", trace_stats=tape(1.0, unpricedModels=["x"]), judgeUsage={**judge, "partial": True, "failedCalls": 1}),
        run("counts", "SCORED", judgeUsage=[{"phase": "a", "calls": 2}, {"phase": "b", "usd": 0.25}, {"junk": 1}]),
        run("nothing", "SCORED"))
    got = {r.run_id: r for r in board.run_costs(df).collect()}
    assert (got["whole"].total_usd, got["whole"].complete, got["whole"].excluded) == (1.5, True, [])
    assert (got["nojudge"].total_usd, got["nojudge"].floor, got["nojudge"].excluded) == (1.0, True, ["judge usage not recorded"])
    assert got["partial"].excluded == ["judge usage partial", "judge calls failed", "tape model unpriced"]
    assert (got["counts"].judge.calls, got["counts"].judge_usd, got["counts"].judge.present) == (2, 0.25, True)
    assert (got["nothing"].total_usd, got["nothing"].floor, got["nothing"].complete) == (None, False, False)
    s = board.board_stats(df).first()
    assert (s.runs, s.servers, s.scored, s.cost_runs, s.floor_runs, s.cost_is_floor, s.judge_runs) == (5, 5, 5, 4, 2, True, 3)
    assert s.cost_usd == pytest.approx(4.25)


def test_notes(spark):
    notes = [("g", 1, "all"), ("g", 2, "all"), ("g", 1, "one"), ("g", 1, "one"), ("g", 2, "all"), ("solo", 3, "mine"), ("h", 4, "x"), ("h", 5, None)]
    df = spark.createDataFrame(notes, "g string, run int, note string")
    standing = board.standing_notes(df, ["g"], ["run"], "note")
    assert rows(standing, "g", "note") == [("g", "all")]
    assert rows(board.own_notes(df, standing, ["g"], "note"), "g", "run", "note") == [("g", 1, "one"), ("g", 1, "one"), ("h", 4, "x"), ("solo", 3, "mine")]


def test_extension_ledger(spark):
    batch = lambda i, b, a, **k: {"index": i, "pooledBefore": b, "pooledAfter": a, "taskIds": [f"e{i}-t1"], **k}
    recorded = run("a", "SCORED", gates={"extensions": [
        batch(1, {"k": 32, "n": 36}, {"k": 38, "n": 42}, dropped={"admission": 2, "duplicate": 1}), batch(2, {"k": 38, "n": 42}, {"k": 43, "n": 48})],
        "extensionPolicy": {"maxExtensions": 2, "extensionSize": 6}})
    derived = run("b", "SCORED", gates={"extensions": [{"k": 5, "n": 6, "pooledAfter": {"k": 37, "n": 42}, "gate": "construct"}]})
    df = reports(spark, recorded, derived)
    batches = board.extension_batches(df).cache()
    got = {(r.run_id, r["index"]): r for r in batches.collect()}
    assert (got["a", 1].counts.k, got["a", 1].counts.n, got["a", 1].derived_from_pool, got["a", 1].dropped) == (6, 6, True, 3)
    led = {r.run_id: r for r in board.extension_ledger(batches).collect()}
    assert (led["a"].consumed, led["a"].initial.k, led["a"].pooled.n, led["a"].exhausted, led["a"].initial_derived) == (2, 32, 48, True, False)
    assert (led["b"].initial.k, led["b"].initial.n, led["b"].initial_derived, led["b"].exhausted) == (32, 36, True, False)
    noted = run("c", "SCORED", records=[{"gate": "construct", "detail": {"extensionsConsumed": 1, "extensions": [{"k": 1, "n": 2, "outcome": "PASS"}]}},
                                        {"gate": "variance", "detail": {"extensionsUsed": 2}}])
    both = reports(spark, {**recorded, "gates": {**recorded["gates"], "records": [{"gate": "construct", "detail": {"extensions": [{"k": 9, "n": 9}]}}]}}, noted)
    assert rows(board.extension_batches(both), "run_id", "gate", "verdict_after") == [
        ("a", "construct", None), ("a", "construct", None), ("c", "construct", "PASS")]
    assert rows(board.extensions_counted(both), "run_id", "gate", "consumed") == [("c", "construct", 1), ("c", "variance", 2)]
    p = {r.run_id: r for r in board.extension_protocol(df).collect()}
    assert p["a"].registered and p["a"].ledger_entries == 2 and not p["b"].registered and p["b"].stated


def test_correlation_ids_and_focus(spark):
    doc = run("a", "SCORED", gates={"extensions": [{"taskIds": ["e1-x"]}]}, records=[
        {"gate": "construct", "ok": True, "detail": {"n": 3, "taskId": "t1"}},
        {"gate": "null_baseline", "ok": True, "detail": {"rates": [{"label": "no-tools", "taskId": "t2"}, {"label": "odd", "taskId": "t9"}]}},
        {"gate": "answer_leak", "ok": False, "detail": {"leaks": [{"id": "t2"}]}}, {"gate": "structural", "ok": False, "detail": {"failures": ["zz"]}}],
        score={"tasks": [{"taskId": "t1"}, {"taskId": "t2"}]})
    df = reports(spark, doc)
    known = board.correlation_ids(df)
    assert {r.corr_id for r in known.collect()} == {
        "t1", "t2", "e1-x", "e1-x::construct", "t1::construct", "t2::construct", "t2::null-no-tools"}
    assert dict(rows(board.gate_focus(df, known), "gate", "corr_id")) == {
        "construct": "t1::construct", "null_baseline": "t2::null-no-tools", "answer_leak": "t2"}
    prose = spark.createDataFrame([("a", 1, "see t1, and t22"), ("a", 2, "xt1 then t1"), ("a", 3, "t2")], "run_id string, no int, body string")
    # the second text names t1 as a token, but its first occurrence is a fragment
    assert rows(board.named_tasks(prose, board.task_ids(df), ["no"], "body"), "no", "task_id") == [(1, "t1"), (3, "t2")]


def test_a_report_is_gone_through_once(spark):
    df = reports(spark, run("a", "SCORED", gates={"extensions": [{"k": 1, "n": 2}]}, score={"tasks": [{"taskId": "t1"}]}))
    for out in (board.extension_batches(df), board.correlation_ids(df), board.task_ids(df)):
        assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_odd_fields_of_reports_read_as_missing(spark):
    """Fields of another JSON type, and records and batches that are no objects, name nothing and stop nothing."""
    doc = run("a", "SCORED", gates={"extensionPolicy": {"maxExtensions": "3"}, "extensions": [
        7, None, {"gate": 5, "k": "1", "n": 4, "pooledAfter": {"passed": 2, "total": 3.5}, "taskIds": ["e1", 4, ""]}]}, records=[
        "junk", None, {"gate": "construct", "detail": "none"}, {"gate": "null_baseline", "detail": {"rates": [3, {"label": "no-tools", "taskId": 9}]}},
        {"gate": "variance", "detail": {"batches": [{"hits": 1, "size": 2}], "leaks": [None, {"task": "e1"}]}}], score={"tasks": [1, {"taskId": 2}, {"taskId": "t1"}]})
    df = reports(spark, doc)
    got = sorted(board.extension_batches(df).collect(), key=lambda b: (b.gate, b.seq))
    assert [(b.gate, b.seq, b.most, b.counts and tuple(b.counts), b.after and tuple(b.after), b.task_ids) for b in got] == [
        ("construct", 0, None, None, None, None), ("construct", 1, None, None, None, None), ("construct", 2, None, None, (2, 3.5), ["e1"]),
        ("variance", 0, None, (1, 2), None, None)]
    known = board.correlation_ids(df)
    assert {r.corr_id for r in known.collect()} == {"t1", "e1", "e1::construct"}
    assert rows(board.gate_focus(df, known), "gate", "corr_id") == [("variance", "e1")]


def test_lineage(spark):
    doc = run("a", "SCORED", records=[{"gate": "structural", "detail": {"synthesis": {"seed": 9, "lineage": {"extraNote": "x", "deep": {}}}}}])
    doc["run"].update(generatorSeed=7, suiteLineage={"parentRunId": "p", "seed": 8})
    got = dict(rows(board.lineage(reports(spark, doc)), "label", "value"))
    assert got == {"generator seed": "7", "parent run": "p", "extra note": "x"}


def test_forced_attribution(spark):
    classes = spark.createDataFrame([("r", "a", "p", 1), ("r", "a", "q", 1), ("r", "b", "q", 2), ("r", "c", "z", 0), ("r", "d", "w", 1)],
                                    "run_id string, tool string, failure string, count int")
    tasks = spark.createDataFrame([("r", "t1", "p"), ("r", "t2", "q"), ("r", "t3", "z"), ("r", "t4", "w"), ("r", "t5", None)],
                                  "run_id string, task_id string, failure string")
    declared = spark.createDataFrame([("r", "d", "t5"), ("r", "d", "ghost")], "run_id string, tool string, task_id string")
    assert rows(board.forced_attribution(classes, tasks, declared), "tool", "task_id") == [("a", "t1"), ("d", "t5")]


def test_hygiene_tools_and_screen(spark):
    doc = run("a", "SCORED", records=[{"gate": "suite_size", "detail": {"toolCount": 4, "nullScreenDropped": 2}},
                                      {"gate": "structural", "detail": {"synthesis": {"nullScreen": {"enabled": True, "screened": 5, "dropped": 9}}}}],
              probes={"findings": [{"id": "x", "pass": True}, {"id": "y"}, "junk", {"id": "z", "pass": "yes"}], "specCurrency": "2026-07-28"},
              trace_stats={"tools": [{"calls": 3, "errors": 1}, {"calls": 2, "pending": 2}]})
    df = reports(spark, doc)
    assert rows(board.report_findings(df), "id", "pass") == [("x", True), ("y", None), ("z", None)]
    r = df.select(board.tool_totals(F.col("r")).alias("t"), board.advertised_tools(F.col("r")).alias("n"),
                  board.null_screen_of(F.col("r")).alias("s"), board.spec_currency(F.col("r")).alias("c")).first()
    assert tuple(r.t) == (2, 5, 1, 2) and r.n == 4 and r.c.version == "2026-07-28"
    assert (r.s.enabled, r.s.dropped, r.s.screened) == (True, 2, 5)


def test_sinks_and_scans(spark, tmp_path):
    lines = [("r1", "mcp", i, f'{{"n": {i}}}') for i in range(50)] + [("r2", "agent", 0, "oops")]
    df = source.lines_of(spark, lines)
    out = str(tmp_path / "published")
    sinks.write_tapes(df, out, 4)
    back = spark.read.text(out)
    assert back.count() == 51 and {(r.run_id, r.plane) for r in back.select("run_id", "plane").distinct().collect()} == {("r1", "mcp"), ("r2", "agent")}
    files = sorted((tmp_path / "published" / "run_id=r1" / "plane=mcp").glob("part-*.txt"))
    assert "".join(f.read_text() for f in files).splitlines() == [f'{{"n": {i}}}' for i in range(50)]

    for run_id, plane, body in (("a", "mcp", ['{"type":"meta"}', "", "x", '{"type":"end"}']), ("b", "mcp", ['{"type":"meta"}', '{"type":"meta"}'])):
        (tmp_path / "traces" / run_id).mkdir(parents=True)
        (tmp_path / "traces" / run_id / f"{plane}.jsonl").write_text("\n".join(body) + "\n")
    scan = source.tape_lines(spark, str(tmp_path / "traces" / "*"))
    assert [r.raw_text for r in scan.where("run_id = 'a'").orderBy("line_no").collect()] == ['{"type":"meta"}', "x", '{"type":"end"}']
    assert rows(source.session_faults(scan), "run_id", "metas") == [("b", 2)]
    assert dict(rows(source.skipped_lines(scan), "run_id", "skipped_lines")) == {"a": 1, "b": 0}

    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "slug string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "slug string, v int")
    assert rows(sinks.upsert(old, new, ["slug"]), "slug", "v") == [("a", 1), ("b", 2), ("c", 2), (None, 1)]
    (tmp_path / "runs.json").write_text(json.dumps([SCORED, REFUSED, 7]))
    assert rows(source.run_reports(spark, str(tmp_path / "runs.json")), "run_id", "outcome") == [("s1", "SCORED"), ("s2", "GATE_FAILED")]


def test_a_tape_split_over_many_tasks_keeps_its_order(spark, tmp_path):
    (tmp_path / "big").mkdir()
    body = "\n".join(json.dumps({"i": i, "pad": "x" * 900}) for i in range(12_000))
    (tmp_path / "big" / "mcp.jsonl").write_text(body + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        scan = source.tape_lines(spark, str(tmp_path / "big"))
        assert scan.rdd.getNumPartitions() > 1
        got = [r.i for r in scan.orderBy("line_no").select(F.try_variant_get("v", "$.i", "int").alias("i")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(12_000))


def test_spend(spark, group_limit):
    df = spark.createDataFrame([("all", i, usd) for i, usd in enumerate([5.0, None, 6.0, 4.0, 1.0])], "board string, i int, usd double")
    out = board.spend_until(df, ["i"], "usd", 17.0, 1.6, ["board"])
    assert rows(out, "i", "cum_usd", "may_continue") == [(0, 5.0, True), (1, 5.0, True), (2, 11.0, True), (3, 15.0, True), (4, 16.0, False)]
