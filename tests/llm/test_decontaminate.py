import hashlib
import random
import re

import pytest

from tapelake.llm import decontaminate
import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words_of(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    out, cut = [], []
    for doc_id, text, *_ in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[tuple(w[i:i + k])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        cut.append([x for i, x in enumerate(w) if i not in hit])
    return out, cut


@pytest.fixture
def data():
    rng = random.Random(2)
    items = [(i, " ".join(cases.words(rng, rng.choice([0, 1, 3, 9, 10, 11, 25]), 30))) for i in range(12)] + [(50, None), (51, "Eins ZWEI"), (51, "Eins ZWEI")]
    docs = cases.odd_rows()
    for i in range(100, 140):
        w = cases.words(rng, rng.randrange(60), 30)
        if i % 3 == 0:
            w += ["...".join((rng.choice(items)[1] or "x").upper().split(" "))] + cases.words(rng, 5, 30)
        docs.append((i, ", ".join(w), "en", "s", 0))
    return docs, items


@pytest.mark.parametrize("block", [100_000, 7])
def test_report_and_removal(spark, data, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    docs, items = data
    df, bench = cases.clashing(cases.frame(spark, docs)), spark.createDataFrame(items, "item_id long, text string")
    want, cut = expected(docs, items)
    assert sorted(map(tuple, decontaminate.report(df, bench).collect()), key=repr) == sorted(want, key=repr)
    kept = decontaminate.remove_documents(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect() if r["text"]) == \
        sorted((d[0], d[1]) for d, w in zip(docs, want) if not w[5] and d[0] is not None and d[1])
    spans = decontaminate.remove_spans(df, bench)
    assert spans.columns == df.columns
    got = sorted((r["doc_id"] or -1, words_of(r["text"])) for r in spans.collect())
    assert got == sorted((d[0] or -1, c) for d, c in zip(docs, cut))


def test_empty_tables(spark, data):
    docs, items = data
    empty, bench = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.report(cases.frame(spark, docs), empty).collect()} == {0}
    assert decontaminate.report(cases.frame(spark, []), bench).count() == 0
