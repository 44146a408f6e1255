import random
import zlib

import pytest

from tapelake.llm import toxicity
import cases

BAD = ["blorkish", "snarfle", "grumpot"]


def rows(n, seed=1):
    """Toxic texts hold an inflected form of a bad word; some forms only occur in held-out rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = cases.words(rng, rng.randrange(5, 120), 3000)
        bad = rng.random() < 0.3
        if bad:
            w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "s", "ed", f"x{i % 7}", str(i)])
        out.append((i, " ".join(w), "en", "s", 0, int(bad)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    data = rows(1500)
    docs = cases.frame(spark, [r[:5] for r in data])
    labels = spark.createDataFrame([(r[0], r[5]) for r in data] + [(3, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    return docs, {r[0]: r[5] for r in data}, toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, fitted):
    docs, truth, model = fitted
    got = toxicity.score(docs, model).select("doc_id", "score", "predicted").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum(truth[r["doc_id"]] == r["predicted"] for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_odd_rows_and_names(spark, fitted):
    _, _, model = fitted
    df = cases.clashing(cases.frame(spark, cases.odd_rows()))
    got = toxicity.score(df, model)
    assert set(got.columns) == set(df.columns)  # score and predicted are replaced
    found = {}
    for r in got.collect():
        assert r["predicted"] == (r["score"] >= 0.5)
        assert found.setdefault(r["text"] or "", r["score"]) == r["score"]  # NULL and empty texts alike, ties equal
    other = toxicity.score(df, model, score="s1", predicted="p1")
    assert other.columns == [*df.columns, "s1", "p1"]


def test_inputs_other_than_the_text_are_not_used(spark, fitted):
    docs, _, model = fitted
    one = docs.limit(50)
    two = one.selectExpr("doc_id + 5 as doc_id", "text", "'xx' as lang", "'other' as source", "0 as n_chars")
    assert [r["score"] for r in toxicity.score(one, model).orderBy("doc_id").collect()] == \
        [r["score"] for r in toxicity.score(two, model).orderBy("doc_id").collect()]


def test_without_both_classes(spark):
    docs = cases.frame(spark, [r[:5] for r in rows(50)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    empty = cases.frame(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_every_character_of_long_words_counts(spark, fitted):
    word = "".join(chr(0x4E00 + i) for i in range(101))
    pieces = [p.decode() for p in toxicity.tokens(word.encode())]
    assert all(any(word[i:i + n] in p for p in pieces) for n in toxicity.SIZES for i in range(len(word) - n + 1))
    assert toxicity.tokens(b"Short words") == [b"short", b"words"]
    assert max(len(toxicity.features(p.encode())) for p in pieces) <= toxicity.WIDTH
    _, _, model = fitted
    plain, glued = (toxicity.score(cases.frame(spark, [(1, t, "en", "s", 0)]), model).first()["score"] for t in ("q" * 120, "q" * 60 + "blorkish" * 6 + "q" * 12))
    assert glued > plain
