import random
import re

import pytest

from tapelake.llm import web_trust
import cases


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def rule(host, path):
    found = [r for _, r in web_trust.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
             and path.startswith(r[r.index("/"):])]
    return max(found, key=len, default=None)


def walk(edges, seeds, rounds, damping=0.85):
    out = {}
    for a, _, n in edges:
        out[a] = out.get(a, 0) + n
    mass = dict(seeds)
    for _ in range(rounds):
        new = {}
        for a, b, n in edges:
            if a in mass:
                new[b] = new.get(b, 0) + damping * mass[a] * n / out[a]
        left = 1 - sum(new.values())
        for h, s in seeds.items():
            new[h] = new.get(h, 0) + s * left
        mass = new
    return mass


@pytest.fixture
def rows():
    rng = random.Random(6)
    hosts = ["a.org", "org", "b.example.org", "example.org", "x.com", "com", "Y.com", "n1.net", "n2.net", "n3.net", "evilorg", "h:80"]
    paths = ["", "/", "/es/1", "/en/1", "/en/2", "/fr/", "/de/x", "?q=/de/", "#f", "/de", "/en/15?a#b"]
    out = []
    for i in range(120):
        links = " ".join(rng.choice(['<a href="http://%s/z">', "<A HREF=//%s>", "<a href = 'https://%s?x'>"]) % h for h in rng.sample(hosts, 2))
        out.append((i, rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(paths), links + '<a href="/local">'))
    return out + [(500, None, "x"), (501, "no url", None), (502, "", ""), (503, "a://b://c/d", ""), (504, "http:///p", ""), (505, "x://org/\n", ""),
                  (None, "http://a.org/", ""), (7, out[7][1], out[7][2])]


def test_rules_and_propagation(spark, rows):
    df = cases.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = web_trust.judge(df).collect()
    assert len(got) == len(rows)
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = parts(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule(host, path))
    edges, seeds = {}, {"allow": {}, "block": {}}
    for _, url, html in rows:
        host, path = parts(url)
        if not host:
            continue
        for other in {x.lower() for x in re.findall(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s<>]+)", html)} - {host}:
            edges[host, other] = edges.get((host, other), 0) + 1
        own = {name: v for v, name in web_trust.RULES}.get(rule(host, path))
        if own:
            seeds[own][host] = seeds[own].get(host, 0) + 1
    share = {v: {h: n / sum(s.values()) for h, n in s.items()} for v, s in seeds.items()}
    trust = walk([(a, b, n) for (a, b), n in edges.items()], share["allow"], web_trust.ROUNDS)
    distrust = walk([(b, a, n) for (a, b), n in edges.items()], share["block"], web_trust.ROUNDS)
    for r in got:
        t, d = trust.get(r["host"], 0.0), distrust.get(r["host"], 0.0)
        assert r["trust"] == pytest.approx(t) and r["distrust"] == pytest.approx(d)
        own = {name: v for v, name in web_trust.RULES}.get(r["rule"])
        assert r["verdict"] == (own or ("block" if d > web_trust.THRESHOLD * (t + d) else "allow"))


def test_empty_and_linkless(spark):
    assert web_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    one = web_trust.judge(spark.createDataFrame([(1, "http://x.com/de/1", None), (2, "http://x.com/en", None)], "page_id long, url string, html string"))
    assert sorted((r["page_id"], r["verdict"]) for r in one.collect()) == [(1, "block"), (2, "block")]
