import json
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapelake.functions import documents, patterns, text
from tapelake.operators import admission


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def sequential(cands):
    """Admission one candidate at a time."""
    seen, judged, out = set(), False, {}
    for pos, id, before, after, judge in cands:
        if id in seen:
            out[pos] = "duplicate-id"
        elif before:
            out[pos] = before
        elif judge and judged:
            out[pos] = "check-too-permissive"
        else:
            judged = judged or judge
            out[pos] = after
            if not after:
                seen.add(id)
    return out


def test_admission_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    data, want = [], {}
    for run in range(120):
        cands = [(pos, rng.choice("abc"), rng.choice([None, None, "malformed"]), rng.choice([None, None, None, "destructive-excluded"]),
                  rng.random() < 0.35) for pos in range(rng.randint(1, 9))]
        data += [(run, *c) for c in cands]
        want.update({(run, pos): r for pos, r in sequential(cands).items()})
    df = spark.createDataFrame(data, "run_id int, position int, task_id string, before string, after string, is_judge boolean")
    got = {(r.run_id, r.position): r.reason for r in admission.admit(df).collect()}
    assert got == want


def test_trim_and_reconcile(spark, group_limit):
    data = [("s", i, "null_screen" if i == 2 else "malformed" if i == 4 else None) for i in range(10)]
    df = spark.createDataFrame(data, "run_id string, position int, reason string")
    out = admission.trim(df, 5)
    # eight of ten are kept, and the suite takes the first five of them
    assert rows(out.where("trimmed"), "position") == [(7,), (8,), (9,)]
    r = admission.reconcile(out, ["run_id"], "reason", "trimmed").first()
    assert (r.candidates, r.admitted, r.trimmed, r.dropped, r.screen_deleted, r.rejected) == (10, 5, 3, 2, 1, 1)
    assert r.reconciles and r.shortfall == 0
    ledger = admission.drop_ledger(out, ["run_id"], "reason")
    assert rows(ledger, "rule", "dropped") == [("malformed", 1), ("null_screen", 1)]


def test_payloads(spark):
    replies = [("bare", '[{"id": "a"}, 3, {"id": "b"}]'), ("fenced", 'Sure!\n```json\n{"tasks": [{"id": "c"}]}\n```\nbye'),
               ("prose", 'Here: {"tasks": [{"id": "d"}, null]} done'), ("none", "no json"), ("broken", "[1, 2")]
    df = spark.createDataFrame(replies, "run_id string, reply string")
    got = admission.payload_tasks(df, ["run_id"], "reply").select(
        "run_id", "position", F.try_variant_get("task", "$.id", "string").alias("id"))
    assert rows(got, "run_id", "position", "id") == [("bare", 0, "a"), ("bare", 1, "b"), ("fenced", 0, "c"), ("prose", 0, "d")]
    lost = {r.run_id: r.entries_discarded for r in admission.discarded_entries(df, ["run_id"], "reply").collect()}
    assert (lost["bare"], lost["prose"], lost["fenced"]) == (1, 1, 0)


def test_prompts_and_params(spark):
    listed = F.parse_json(F.lit('[{"name": "a", "value": "x$1"}, {"name": "n", "value": 3}, {"value": "lost"}]'))
    keyed = F.parse_json(F.lit('{"a": "x", "flag": true, "deep": {"z": 1}}'))
    r = one(spark, p=admission.bound_params(listed), q=admission.bound_params(keyed),
            t=text.render_prompt(F.lit("{{a}} and {{ n }}, {{gone}} {{a}}!"), admission.bound_params(listed)))
    assert (r.p, r.q, r.t) == ({"a": "x$1", "n": "3"}, {"a": "x", "flag": "true"}, "x$1 and 3, {{gone}} x$1!")
    s = one(spark, left=text.placeholders(F.lit("{{gone}} {{ b.c-d }} {x}")), id=text.task_slug(F.lit("  Hello, World! "), F.lit(3)),
            blank=text.task_slug(F.lit("--"), F.lit(3)))
    assert (s.left, s.id, s.blank) == (["gone", "b.c-d"], "hello-world", "task-4")


@pytest.mark.parametrize("pattern,run", [
    ("abc", 3), ("[0-9]{3,}", 0), (r"\d+", 0), (".*", 0), (r"\[[a-zA-Z]+\]", 1), ("abc?d", 2), ("abc+d", 3), ("ab{0,2}cde", 3),
    ("ab{2}cd", 2), (r"a\.b\.c", 5), ("foo|barbaz", 6), ("(abc)d", 3), (r"\\dx", 3), ("x{2", 1), ("a*", 0), (r"v1\.2", 4), ("", 0)])
def test_longest_literal_run(spark, pattern, run):
    assert one(spark, r=patterns.longest_literal_run(F.lit(pattern))).r == run


def test_pattern_validation(spark):
    cases = {"abc": True, "(?i)abc": True, "a++": False, "(?>a)": False, "(a": False, "(?P<n>x)": True, "(?<n>x)": True, "": False,
             "(?R)": False, r"\(\?>": True, "a{1,3}+": False, "(?(1)a)": False, '{"id":': True, r"(?P<user_id>\d+)": True, "(?P<a>x)(?P=a)": True,
             "a{,3}": True, "(?#c)abc": True, "[[]": True, "(?a)": False, "[a&&b]": True, "(?'q'x)\\k<q>": True, "(?s)a.b": True, "(?m)^a": True,
             "(?m)a$": False, "(a)?\\1": False, "(?<=a*)b": False, "[z-a]": False, "a{2,1}": False, "^*": False, "(" * 5000: False, "\\": False}
    df = spark.createDataFrame([(c,) for c in cases], "p string").select("p", patterns.validated("p").alias("v"))
    assert {r.p: r.v.ok for r in df.collect()} == cases


def test_accepted_patterns_compile_in_java_and_match_alike(spark):
    rng = random.Random(17)
    pieces = ["a", "b", "{", "}", "]", "[", "(", ")", "|", "*", "+", "?", "{2}", "{,2}", "{1,}", "^", "$", ".", "\\d", "\\W", "\\b", "[ab]", "[^a", "&&", "-", "(?:",
              "(?=", "(?<!", "(?P<n>", "(?P=n)", "\\1", "(?#x)", "(?i)", "\\x41", "\\u00e9", "\\.", "[\\s\\D]", '"id":', "(?>", "++", "\\k<n>", "😀", "\\q", "[]", "[^]"]
    java, accepted = spark._jvm.java.util.regex.Pattern, 0
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        ok, pattern, _ = patterns._verdict(text)
        if ok:
            accepted += 1
            java.compile(pattern)  # must not raise
    assert accepted > 400
    shared = [p for p in pieces if p not in ("]", "}", "{", "[", "[^a", "{,2}", "^", "$", "[]", "[^]", "&&", "\\q", "(?#x)", "(?i)", "[\\s\\D]", "😀")]
    rows = []
    while len(rows) < 300:
        text = "".join(rng.choice(shared) for _ in range(rng.randrange(1, 7)))
        ok, pattern, _ = patterns._verdict(text)
        if ok:
            subject = "".join(rng.choice('ab1A"id: -.\n') for _ in range(8))
            rows.append((text, pattern, subject, re.search(text, subject, re.ASCII) is not None))
    df = spark.createDataFrame(rows, "text string, pattern string, subject string, want boolean")
    assert df.where("(subject rlike pattern) <> want").collect() == []


def test_numbers_of_answer_keys_print_as_in_javascript(spark):
    cases = {"1e-7": "1e-7", "12345678901234567890": "12345678901234567000", "1e21": "1e+21", "0.000001": "0.000001", "-2.50": "-2.5", "5e-324": "5e-324",
             "100.0": "100", "-0.0": "0", "1e400": "Infinity"}
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", patterns.answer_leaves("k").alias("l"))
    assert {r.k: r.l for r in df.collect()} == {k: [v] for k, v in cases.items()}
    deep = "[" * 5000 + "]" * 5000
    assert spark.createDataFrame([(deep,)], "k string").select(patterns.answer_leaves("k").alias("l")).first().l == []


def test_answer_leaves(spark):
    key = json.dumps({"a": "Hi", "b": [3, 2.5, True, None, {"c": 1.0}]})
    df = spark.createDataFrame([(key,), ("not json",), (None,)], "k string").select(patterns.answer_leaves("k").alias("l"))
    assert [r.l for r in df.collect()] == [["Hi", "3", "2.5", "1"], [], None]


def test_leak_rules(spark):
    cases = [("The port is 3 0 7.", "307", False), ("port 307!", "307", True), ("13075", "307", False), ("ano-ny mous", "anonymous", True),
             ("it is on", "on", False), ("Blue  Whale", "blue whale", True)]
    df = spark.createDataFrame(cases, "t string, p string, want boolean").withColumn("got", text.contains_phrase(F.col("t"), F.col("p"), 3))
    for r in df.collect():
        assert r.got == r.want, r


TOOLS = [("r", "create_record", None, None, True, '{"properties": {"title": {}}}'),
         ("r", "get_record", None, True, None, '{"properties": {"record_id": {}, "page_token": {}}, "required": ["record_id"]}'),
         ("r", "list_things", "Returns the id of a thing", True, None, '{"properties": {"api_key": {}}}'),
         ("r", "move_thing", None, True, None, '{"properties": {"thingId": {}}, "required": []}')]


def tools_of(spark):
    return spark.createDataFrame(TOOLS, "run_id string, name string, description string, read_only boolean, destructive_hint boolean, input_schema string")


def test_handle_chains(spark):
    got = admission.handle_chains(tools_of(spark))
    assert rows(got, "consumer", "param", "producer", "required") == [
        ("get_record", "record_id", "create_record", True), ("move_thing", "thingId", "list_things", False)]
    cands = spark.createDataFrame([("r", 0, ["get_record"]), ("r", 1, ["create_record", "get_record"]), ("r", 2, ["move_thing"])],
                                  "run_id string, position int, expected_tools array<string>")
    chained = {r.position: r.chained_tools for r in admission.chain_tools(cands, got).collect()}
    assert chained == {0: ["create_record", "get_record"], 1: ["create_record", "get_record"], 2: ["move_thing"]}


def candidate(**over):
    base = {"id": "ok", "prompt": "Which harbour does the ferry use?", "expectedTools": ["get_record"], "serverRequiredBecause": "volatile",
            "check": {"kind": "substring", "where": "final_text", "value": "Rotterdam"}, "answerKey": {"port": "Rotterdam"}}
    return {**base, **over}


CASES = {
    "malformed": candidate(prompt="  "),
    "no-expected-tools": candidate(expectedTools=[]),
    "unknown-tool": candidate(expectedTools=["nope"]),
    "no-server-requirement": candidate(serverRequiredBecause="because"),
    "answer-leak": candidate(prompt="Is it Rotter-dam?"),
    "context-answer-leak": candidate(answerKey="anonymous", check={"kind": "substring", "where": "final_text", "value": "anonymous"}),
    "context-answer-leak ": candidate(params={"city": "rotterdam"}),
    "invalid-check": candidate(check={"kind": "regex", "where": "final_text", "pattern": "(a"}),
    "invalid-check ": candidate(check=None),
    "check-too-permissive": candidate(check={"kind": "substring", "where": "final_text", "value": "ab "}),
    "check-too-permissive ": candidate(check={"kind": "regex", "where": "final_text", "pattern": r"\d+"}),
    "check-too-permissive  ": candidate(check={"kind": "tool_called", "tool": "get_record"}),
    "check-matches-prompt": candidate(check={"kind": "regex", "where": "final_text", "pattern": "FERRY"}),
    "check-matches-prompt ": candidate(check={"kind": "substring", "where": "final_text", "value": "the ferry"}),
    "destructive-excluded": candidate(destructive=True),
    None: candidate(expectedTools=["get_record", "get_record"]),
    "duplicate-id": candidate(),
    "ok2": candidate(id="second", errorPath=True, check={"kind": "tool_called", "tool": "get_record"}),
    "judge": candidate(id="judge 1", check={"kind": "judge", "rubric": "good?"}),
    "check-too-permissive j": candidate(id="judge 2", check={"kind": "judge", "rubric": "good?"}),
    "ok3": candidate(id="third", check={"kind": "tool_result_matches", "tool": "get_record", "pattern": "harbour [0-9]+"}),
}


def test_every_drop_reason(spark):
    raw = spark.createDataFrame([("r", i, json.dumps(c)) for i, c in enumerate(CASES.values())], "run_id string, position int, t string")
    raw = raw.select("run_id", "position", F.parse_json("t").alias("task"))
    tools = tools_of(spark).where("name <> 'create_record'").unionByName(
        spark.createDataFrame([("r", "create_record", None, None, False, '{"properties": {}}')], tools_of(spark).schema))
    context = spark.createDataFrame([("r", 0, "Tools are used anonymously."), ("r", 1, "Fetch a record")], "run_id string, text_no int, text string")
    chains = admission.handle_chains(tools)
    screened = admission.screen(raw, tools, context, chains, exclude_destructive=True)
    got = {r.position: r for r in admission.admit(screened).collect()}
    for i, name in enumerate(CASES):
        want = None if name in (None, "ok2", "judge", "ok3") else name.split(" ")[0]
        assert got[i].reason == want, (name, got[i].reason)
    admitted = got[list(CASES).index(None)]
    assert (admitted.chained_tools, admitted.deduped) == (["create_record", "get_record"], 1)
    assert got[4].leak_phrase == "Rotterdam"


def test_null_screen_keeps_failed_probes(spark):
    kept = spark.createDataFrame([("r", "a", None), ("r", "b", None), ("r", "c", "malformed"), ("r", "d", None)], "run_id string, task_id string, reason string")
    cold = spark.createDataFrame([("r", "a", True, None, 5, 1), ("r", "b", None, "timeout", None, None), ("r", "c", True, None, 5, 1)],
                                 "run_id string, task_id string, cold_passed boolean, error string, input_tokens int, output_tokens int")
    got = dict(rows(admission.null_screen(kept, cold), "task_id", "reason"))
    assert got == {"a": "null_screen", "b": None, "c": "malformed", "d": None}
    s = admission.screen_summary(cold).first()
    assert (s.screened, s.dropped, s.errors, s.input_tokens) == (2, 2, 1, 10)


def test_rewrites_pair_by_id_then_place(spark, group_limit):
    task = lambda i, x: ("r", i, f"t{i}", json.dumps({"x": x}))
    cands = spark.createDataFrame([task(i, "old") for i in range(4)], "run_id string, position long, task_id string, t string")
    replies = spark.createDataFrame([("r", 0, "t3", '{"x": "by id"}'), ("r", 1, "blank", '{"x": "by place"}')], cands.schema)
    parse = lambda df: df.select("run_id", "position", "task_id", F.parse_json("t").alias("task"))
    off = spark.createDataFrame([("r", 3), ("r", 1)], "run_id string, position long")
    out = admission.rewrites(parse(cands), parse(replies), off)
    shown = out.select("position", "matched_by", F.try_variant_get("task", "$.x", "string").alias("x"))
    # t1 is the first offender, so place pairs it with the first reply
    assert rows(shown, "position", "matched_by", "x") == [
        (0, None, "old"), (1, "position", "by id"), (2, None, "old"), (3, "id", "by id")]


def sequential_batch(tasks, pool):
    keys, fates = set(pool), {}
    void = any(leak or bad for _, leak, bad, _, _ in tasks)
    for i, leak, bad, invalid, key in tasks:
        if leak:
            fates[i] = "answer_leak"
        elif bad:
            fates[i] = "property"
        elif invalid:
            fates[i] = "admission"
        elif key in keys:
            fates[i] = "duplicate"
        else:
            keys.add(key)
            fates[i] = "voided" if void else "admitted"
    return fates


def test_batches_equal_the_sequential_rule(spark):
    rng = random.Random(9)
    data, want = [], {}
    for b in range(60):
        tasks = [(i, rng.random() < 0.08, rng.random() < 0.08, rng.random() < 0.2, rng.choice("pqrst")) for i in range(rng.randint(1, 8))]
        data += [(b, *t) for t in tasks]
        want.update({(b, i): f for i, f in sequential_batch(tasks, {"p"}).items()})
    df = spark.createDataFrame(data, "batch int, i int, leak boolean, bad boolean, invalid boolean, key string")
    pool = spark.createDataFrame([("p",), ("p",)], "key string")
    out = admission.screen_batches(df, pool, ["batch"], "i", "key", F.col("leak"), F.col("bad"), F.col("invalid"))
    assert {(r.batch, r.i): r.fate for r in out.collect()} == want


def test_keys_and_hashes(spark):
    a = admission.content_key(F.lit(" Do  IT "), F.array(F.lit("b"), F.lit("a"), F.lit("a")), F.lit("{}"))
    b = admission.content_key(F.lit("do it"), F.array(F.lit("a"), F.lit("b")), F.lit("{}"))
    r = one(spark, a=a, b=b, c=admission.canonical(F.lit('{"b": 1.0, "a": [2, null]}')), seed=admission.extension_seed(F.lit(7), F.lit(2)))
    assert r.a == r.b and r.c == '{"a":[2,null],"b":1}' and r.seed == 2007
    items = spark.createDataFrame([("s", i, f"x{i}") for i in range(1, 8)], "run_id string, position int, item string")
    whole = admission.ordered_hash(items, ["run_id"], "position", "item", "h").first().h
    import hashlib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert whole == sha(",".join(f"x{i}" for i in range(1, 8)))


def test_suite_and_surface_hashes(spark):
    import hashlib

    plain = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    sha = lambda v: hashlib.sha256(plain(v).encode()).hexdigest()
    suite = [{"id": "b", "prompt": "x", "expectedTools": ["t"]}, {"id": "a", "destructive": False}]
    tasks = spark.createDataFrame([("r", i + 1, json.dumps(t)) for i, t in enumerate(suite)], "run_id string, suite_no int, task string")
    settings = {"version": "g/2", "knobs": {"z": 1, "a": True}}
    suites = spark.createDataFrame([("r", json.dumps(settings), 7, "orig"), ("empty", "{}", 1, "none")],
                                   "run_id string, generator string, seed int, suite_hash string")
    got = dict(rows(admission.suite_hashes(tasks, suites.drop("suite_hash")), "run_id", "suite_hash"))
    assert got == {"r": sha({"generator": settings, "seed": 7, "tasks": suite}), "empty": sha({"generator": {}, "seed": 1, "tasks": []})}
    batches = spark.createDataFrame([("r", 1, "h1"), ("r", 2, None)], "run_id string, index int, batch_hash string")
    pooled = dict(rows(admission.pooled_suite_hashes(tasks, batches, suites), "run_id", "pooled_hash"))
    assert pooled["r"] == sha({"kind": "pooled-suite/1", "originalSuiteHash": "orig", "batchSuiteHashes": ["h1", None], "tasks": suite})
    listing = [{"name": "z", "description": "d", "extra": 1}, {"name": "a", "inputSchema": {"b": 1, "a": []}}]
    tools = spark.createDataFrame([("r", t["name"], json.dumps(t)) for t in listing], "run_id string, name string, definition string")
    want = sha([{"name": "a", "inputSchema": {"b": 1, "a": []}}, {"name": "z", "description": "d"}])
    assert rows(admission.surface_digests(tools), "digest") == [(want,)]


def test_repairs_and_evidence(spark):
    wanted = [
        candidate(id="a", expectedTools=["get_record", "get_record"], check={"kind": "regex", "where": "final_text", "pattern": "(?i)(?P<n>Rott)er"}),
        candidate(id="b", expectedTools=["get_record", "nope", "gone"]),
        candidate(id="c", answerKey={"z": "harbour", "a": "ferry"}),
        candidate(id="a"),
        candidate(id="e", check={"kind": "regex", "where": "final_text", "pattern": "(?P<n>a"}),
        candidate(id="f", check={"kind": "judge", "rubric": "good?"}),
        candidate(id="g", expectedTools=["get_record", "get_record"], check={"kind": "judge", "rubric": "good?"}),
        candidate(id="h", expectedTools=["move_it"])]
    raw = spark.createDataFrame([("r", i, json.dumps(c)) for i, c in enumerate(wanted)], "run_id string, position int, source string")
    raw = raw.withColumn("task", F.parse_json("source"))
    more = [("r", "move_it", None, True, None, '{"properties": {"box_id": {}}, "required": ["box_id"]}')]
    tools = tools_of(spark).unionByName(spark.createDataFrame(more, tools_of(spark).schema))
    context = spark.createDataFrame([], "run_id string, text_no int, text string")
    edges = admission.surface_edges(admission.surfaces(tools, context))
    two = spark.createDataFrame([("r", "move_it", "box_id", True, p) for p in ("make_box", "open_box")], edges.schema)
    got = admission.admit(admission.screen(raw, tools, context, edges.unionByName(two)))
    repairs = rows(admission.repair_rows(got), "task_id", "repair_no", "rule", "place", "before", "after")
    assert repairs == sorted([
        ("a", 0, "expected-tools-dedupe", "get_record", "2", "1"),
        ("a", 1, "check-pattern-dialect", "flags (?i), group (?P<name>)", "(?i)(?P<n>Rott)er", "(?<n>Rott)er"),
        ("a", 2, "handle-chain", "get_record.record_id", None, "create_record"),
        ("c", 0, "handle-chain", "get_record.record_id", None, "create_record"),
        ("f", 0, "handle-chain", "get_record.record_id", None, "create_record"),
        ("g", 0, "expected-tools-dedupe", "get_record", "2", "1")][:3] + [
        ("f", 0, "handle-chain", "get_record.record_id", None, "create_record"), ("g", 0, "expected-tools-dedupe", "get_record", "2", "1")], key=repr)
    drops = {(r.task_id, r.position): r for r in admission.drop_rows(got).collect()}
    assert {k[0]: v.reason for k, v in drops.items() if k[1] != 3} == {
        "b": "unknown-tool", "c": "answer-leak", "e": "invalid-check", "g": "check-too-permissive", "h": "unchained-handle"}
    assert (drops["b", 1].unknown_tools, drops["b", 1].expected_tools) == (["nope", "gone"], ["get_record", "nope", "gone"])
    assert (drops["c", 2].phrase, drops["c", 2].source) == ("harbour", "prompt")  # as written, not by name
    assert (drops["e", 4].check_kind, drops["e", 4].check_pattern, drops["g", 6].check_kind) == ("regex", "(?P<n>a", "judge")
    assert drops["h", 7].unchained == "move_it.box_id" and drops["a", 3].prompt_excerpt is None


def test_listings_give_the_same_chains_as_edges(spark):
    context = spark.createDataFrame([("r", 0, "x")], "run_id string, text_no int, text string")
    own = admission.surface_edges(admission.surfaces(tools_of(spark), context))
    assert rows(own, "consumer", "param", "required", "producer") == rows(
        admission.handle_chains(tools_of(spark)), "consumer", "param", "required", "producer")


def test_documents_are_read_as_written(spark):
    task = '{"params": {"b": 1, "10": "x", "a": true, "2": 2.50}, "answerKey": {"z": "u", "1": ["v", 1e21], "a": null, "z": "w"}}'
    df = spark.createDataFrame([(task,), ('{"params": [{"name": "q", "value": 1}, {"name": "q", "value": "2"}]}',), ("[1]",), ("no",), (None,)], "t string")
    got = [(r.s.leaves, r.s.params and [tuple(p) for p in r.s.params]) for r in df.select(documents.task_source("t").alias("s")).collect()]
    assert got == [(["v", "1e+21", "w"], [("2", "2.5"), ("10", "x"), ("b", "1"), ("a", "true")]), ([], [("q", "2")]), ([], []), ([], []), (None, None)]
    replies = spark.createDataFrame([("r", 'x [ {"b": 1, "a": [2]} , 3, {"c": "]"}] y'), ("s", '{"z": {"tasks": 1}, "tasks": [{"d": 1}]}')], "run_id string, reply string")
    assert rows(admission.task_rows(replies, ["run_id"], "reply"), "run_id", "position", "source") == [
        ("r", 0, '{"b": 1, "a": [2]}'), ("r", 1, '{"c": "]"}'), ("s", 0, '{"d": 1}')]


def test_canonical_documents(spark):
    cases = {'{"b": 1.0, "a": [2, null, {"d": false, "c": "\\u001f"}]}': '{"a":[2,null,{"c":"\\u001f","d":false}],"b":1}',
             '{"\uff5e": 1, "😀": 2, "é": 3, "z": 4, "Z": 5, "10": 6, "9": 7, "010": 8}': '{"9":7,"10":6,"010":8,"Z":5,"z":4,"é":3,"😀":2,"\uff5e":1}',
             '[1e-7, 9007199254740993, -0.0, 1e400, 1E2, 0.1, "\\/", "\\ud800", "\u2028"]': '[1e-7,9007199254740992,0,null,100,0.1,"/","\\ud800","\u2028"]'}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", admission.canonical(F.col("t")).alias("c")).collect()} == cases
