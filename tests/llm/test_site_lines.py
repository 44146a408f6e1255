import random
from collections import Counter

import pytest

from tapelake.llm import site_lines
import cases


def expected(rows, ratio=0.1, least=3):
    hosts, lines = Counter(), Counter()
    for _, text, _, host, _ in rows:
        hosts[host or ""] += 1
        for line in {x.strip(" \t\n\x0b\f\r") for x in (text or "").split("\n")} - {""}:
            lines[host or "", line] += 1
    out = []
    for doc_id, text, _, host, _ in rows:
        h = host or ""
        kept = None if text is None else [x for x in text.split("\n") if not (
            lines[h, x.strip(" \t\n\x0b\f\r")] >= least and lines[h, x.strip(" \t\n\x0b\f\r")] > ratio * hosts[h])]
        out.append((doc_id, None if text is None else "\n".join(kept), 0 if text is None else text.count("\n") + 1 - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_lines_go_by_their_share_of_the_host(spark, monkeypatch, limit):
    monkeypatch.setattr(site_lines, "BROADCAST_LINES", limit)
    rng = random.Random(4)
    rows = cases.odd_rows()
    for i in range(300):
        host = rng.choice(["hot"] * 5 + ["b", None, "", "tiny"]) if i > 3 else "tiny2"
        own = [" ".join(cases.words(rng, 4)) for _ in range(rng.randrange(4))]
        shared = [f" menu {k} " for k in range(5) if rng.random() < k / 8] + ([""] if i % 4 else [])
        rows.append((100 + i, "\n".join(rng.sample(own + shared, len(own + shared))), "en", host, 0))
    df = cases.clashing(cases.frame(spark, rows))
    out = site_lines.drop_lines(df)
    assert [c for c in out.columns if c != "n_dropped"] == [c for c in df.columns if c != "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("size,gone", [(2, 0), (3, 1), (19, 1), (20, 1), (40, 1)])
def test_a_footer_goes_from_hosts_of_every_size(spark, size, gone):
    rows = [(i, f"own line {i}\nall rights reserved", "en", "host", 0) for i in range(size)] + [(99, "all rights reserved", "en", "other", 0)]
    got = {r["doc_id"]: r["n_dropped"] for r in site_lines.drop_lines(cases.frame(spark, rows)).collect()}
    assert got == {**{i: gone for i in range(size)}, 99: 0}


def test_empty_table(spark):
    assert site_lines.drop_lines(cases.frame(spark, [])).count() == 0
