import json

from pyspark.sql import functions as F

from conftest import rows
from tapelake.operators import pairs, records
from tapelake.sources import ledger
from tapelake.sources import tapes as source
from tapelake.streaming import live
from tapes import agent, lines, wire


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def write_run(root, run, late="2026-08-19T11:00:00Z"):
    folder = root / run
    folder.mkdir(parents=True)
    for plane, recs in (("mcp", wire()), ("agent", agent())):
        (folder / f"{plane}.jsonl").write_text("\n".join(json.dumps(r) for r in recs) + "\n")
    return folder


def test_live_pairs_equal_batch_once_time_has_passed(spark, tmp_path):
    write_run(tmp_path / "in", "r1")
    (tmp_path / "in" / "zz").mkdir()
    later = {"t": "2026-08-19T12:00:00Z", "dir": "in", "raw": {"id": 1, "method": "ping"}}
    for i in range(3):
        (tmp_path / "in" / "zz" / "mcp.jsonl").write_text(json.dumps(later) + "\n")
    recs = live.stream_records(live.tape_stream(spark, str(tmp_path / "in"), 1)).where("plane = 'mcp' AND ts IS NOT NULL")
    frames = recs.withColumn("id", F.try_variant_get("raw", "$.id", "string")).withColumn(
        "method", F.try_variant_get("raw", "$.method", "string")).where("id IS NOT NULL")
    keys = ["run_id", "source", "id"]
    asked = frames.where("dir = 'in' AND method = 'tools/call'").select(*keys, "ts")
    done = frames.where("dir = 'out'").select(*keys, "ts")
    out = drain(spark, live.live_pairs(asked, done, keys, "5 seconds", "60 seconds"), "live_pairs")
    batch = records.records(source.lines_of(spark, lines("r1", "mcp", wire())))
    want = rows(pairs.wire_calls(batch), "id", "latency_ms", "pending")
    got = rows(out, "req_id", "latency_ms", "pending")
    assert [r for r in got if not r[2]] == [r for r in want if not r[2]]
    assert {r for r in got if r[2]} <= {r for r in want if r[2]}


def test_windows_and_running_verdict(spark, tmp_path):
    data = [("a", f"2026-01-01T00:0{m}:00Z", m % 3 != 0, 10 * m) for m in range(9)]
    src = str(tmp_path / "outcomes")
    spark.createDataFrame(data, "tool string, t string, ok boolean, ms int").withColumn("ts", F.to_timestamp("t")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    counts = drain(spark, live.windowed_counts(stream, ["tool"], "5 minutes", "1 minute", "ms"), "windows", "complete")
    assert sorted(r.calls for r in counts.collect()) == [4, 5]
    verdict = drain(spark, live.running_verdict(stream, ["tool"], "ok", 0.9), "verdicts", "complete").first()
    assert (verdict.k, verdict.n, verdict.outcome) == (6, 9, "EXTEND")


def test_session_windows_equal_the_batch_form(spark, tmp_path, group_limit):
    minutes = [0, 1, 2, 10, 11, 30]
    data = [("u", i, f"2026-01-01T00:{m:02d}:00Z") for i, m in enumerate(minutes)]
    df = spark.createDataFrame(data, "u string, i int, t string").withColumn("ts", F.to_timestamp("t"))
    batch = live.session_gaps(df, ["u"], "ts", 5 * 60 * 1000, "i")
    assert rows(batch, "session", "events") == [(1, 3), (2, 2), (3, 1)]
    src = str(tmp_path / "turns")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = drain(spark, live.sessions(stream, ["u"], "5 minutes", "1 minute"), f"sessions_{group_limit}", "complete")
    assert sorted(r.events for r in out.collect()) == [1, 2, 3]


def ledger_rows(spark, path, schema):
    return rows(ledger.read(spark, path, schema), "k", "v", "n")


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k int, v string, n int"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    assert ledger_rows(spark, path, schema) == []
    assert ledger.upsert(make(*[(i, "old", 0) for i in range(40)], (None, "nobody", 0)), path, ["k"], "n", buckets=8) == 8
    before = {r.bucket: r.folder for r in ledger.manifest(spark, path)}
    assert ledger.upsert(make((3, "late", 1), (3, "new", 2)), path, ["k"], "n", "batch 1") == 1
    after = {r.bucket: r.folder for r in ledger.manifest(spark, path)}
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 8
    want = sorted([(i, "old", 0) for i in range(40) if i != 3] + [(3, "new", 2), (None, "nobody", 0)], key=repr)
    assert ledger_rows(spark, path, schema) == want
    assert ledger.upsert(make((4, "again", 9)), path, ["k"], "n", "batch 1") == 0  # a batch that is repeated
    (tmp_path / "table" / "data" / "left" / "__bucket=1").mkdir(parents=True)  # folders of a writer that was lost
    assert ledger_rows(spark, path, schema) == want
    assert ledger.upsert(make(), path, ["k"], "n") == 0 and ledger_rows(spark, path, schema) == want
    assert ledger.upsert(make((None, "somebody", 3)), path, ["k"], "n") == 1
    assert (None, "somebody", 3) in ledger_rows(spark, path, schema) and len(ledger_rows(spark, path, schema)) == 41


def test_live_calls_go_on_after_a_restart(spark, tmp_path):
    """Frames in any order, twice and late; the table equals the batch pairing, also when a batch is applied twice."""
    data = [("r", "mcp", i, json.dumps({**r, "n": i})) for i, r in enumerate(wire())]
    batch = records.records(source.lines_of(spark, data))
    order = lambda: F.try_variant_get("v", "$.n", "long")
    df = spark.createDataFrame([(a, b, d) for a, b, _, d in data], "run_id string, plane string, raw_text string")
    half = df.withColumn("part", F.monotonically_increasing_id() % 3)
    for part in ("part = 2", "part = 0", "part = 1 OR part = 2"):
        half.where(part).drop("part").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        live.keep_calls(live.call_frames(stream, order()), str(tmp_path / "t"), str(tmp_path / "c"), 4).awaitTermination(120)
    want = rows(pairs.wire_calls(batch), "id", "tool", "latency_ms", "pending", "error")
    assert rows(live.calls_of(spark, str(tmp_path / "t")), "id", "tool", "latency_ms", "pending", "error") == want
    frames = live.paired(live.call_frames(df, order()))
    ledger.update(frames, str(tmp_path / "t"), ["run_id", "plane", "source", "id"], lambda old, new: live.paired(old.unionByName(new)))
    assert rows(live.calls_of(spark, str(tmp_path / "t")), "id", "tool", "latency_ms", "pending", "error") == want
