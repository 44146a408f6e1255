import hashlib
import random

from tapelake.llm import capture_index
import cases


def pages(seed=3):
    rng = random.Random(seed)
    bodies = [" ".join(cases.words(rng, n)) for n in (10, 150, 250, 400)] + ["é" * 499, "é" * 500, "", None, "x\r\n\r\ny" * 300]
    urls = ["http://a.example.org/x", "https://b.example.org/x?q=1#t", "ftp://a.example.org", None, "", "no scheme", "http://A.example.ORG/é \n",
            "http://example.com/" + "p" * 3000]
    out = [(i, rng.choice(urls), rng.choice(bodies)) for i in range(150)]
    return out + [(7, out[7][1], out[7][2]), (None, urls[0], bodies[1]), (None, None, None)]


def expected(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            first[body] = max(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        refers = first.get(body)
        refers = None if refers == page else refers
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip_through_both_levels(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "LINES_PER_BLOCK", 4)
    rows = pages()
    df = cases.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = capture_index.round_trip(df).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")


def test_lookup_of_some_keys_and_of_absent_ones(spark, tmp_path):
    rows = [(i, f"http://h{i % 9}.net/p{i % 40}", f"<p>{i}</p>") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = capture_index.write_archives(df, f"file://{tmp_path}/archives")
    index = capture_index.build_index(captures, f"file://{tmp_path}/index", lines_per_block=3)
    keys = spark.createDataFrame([("net,h1)/p1",), ("net,h4)/p13",), ("absent",), ("",)], "key string")
    got = capture_index.read_captures(keys, index, f"file://{tmp_path}/index", f"file://{tmp_path}/archives", "bigint").collect()
    want = [(i, f"<p>{i}</p>".encode()) for i, url, _ in rows if url in ("http://h1.net/p1", "http://h4.net/p13")]
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == want


def test_archives_close_at_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(capture_index, "ARCHIVE_BYTES", 1)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    captures = capture_index.write_archives(df, f"file://{tmp_path}/archives")
    assert captures.select("file").distinct().count() >= captures.count() - 1


def test_keys(spark):
    df = spark.createDataFrame([("http://WWW.Example.COM/A?b#c",), ("x://h",), ("none",), (None,), ("",)], "u string")
    assert [r[0] for r in df.select(capture_index.url_key(df["u"])).collect()] == ["com,example,www)/A?b#c", "h)", "none", "", ""]


def test_empty_table(spark):
    assert capture_index.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
