import hashlib
import random
import re

from pyspark.sql import functions as F

from tapelake.llm import personal_data
import cases

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def card(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
    return "".join(map(str, digits + [-total % 10]))


def data():
    rng = random.Random(9)
    rows = cases.odd_rows()
    for i in range(100, 500):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        make = [lambda: f"a{i}.b@m{i}.example.com", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: card(rng),
                lambda: str(rng.randrange(10**15, 10**16)), lambda: phone, lambda: f"{phone} {card(rng)}"]
        rows.append((i, " ".join(x for w in cases.words(rng, 8) for x in (w, rng.choice(make)() if rng.random() < .3 else "né")), "en", "s", 0))
    alphabet = "09 .-+()@a%é😀\n_"
    rows += [(1000 + i, "".join(rng.choice(alphabet) for _ in range(60)), "en", "s", 0) for i in range(300)]
    rows += [(2000, "9" * 60_000, "", "", 0), (2001, "1 " * 30_000, "", "", 0), (2002, "a" * 60_000 + "@b" + ".c" * 20_000, "", "", 0), (2003, "+1" + " (" * 30_000 + "2", "", "", 0),
             (2004, "1.2.3.4.5.6.7.8 0001.0255.3.4 a@b.cc_d@e.f x@y.z", "", "", 0), (2005, f"+1 (208) 555-1177 {card(rng)} tail", "", "", 0),
             (2006, "write to joe (at) site [dot] example please", "", "", 0)]
    return rows


def test_base_spans_and_what_the_trees_add(spark):
    rows = data()
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, []).append(text)
    got = personal_data.report(cases.clashing(cases.frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted(((i, hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=repr) == want
    by_id = {r["doc_id"]: r for r in got}
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        found = [base(t) for t in texts[r["doc_id"]]]
        assert any(set(b) <= set(spans) for b in found)
        assert any([sum(s.startswith(k) for s in b) for k in PATTERNS] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] for b in found)
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
    assert by_id[2005]["spans"] == "card:18:34,phone:0:17"
    assert by_id[2006]["spans"].startswith("email:9:")


def test_redacted_text(spark):
    df = cases.frame(spark, [(1, "mail é a@b.cc or +1 555 123 4567.", "", "", 0), (2, "nothing", "", "", 0)])
    found = personal_data.spans(df)
    both = df.join(found, F.col("doc_id") == F.col("id"))
    got = {r[0]: r[1] for r in both.select("doc_id", personal_data.redacted(F.col("text"), F.col("spans"))).collect()}
    assert got == {1: "mail é [email] or [phone].", 2: "nothing"}


def test_trees_fall_back_without_labels(spark):
    assert personal_data.report(cases.frame(spark, [])).count() == 0
    assert personal_data.train([]) == (0.0, [])
    got = personal_data.report(cases.frame(spark, [(1, "plain text", "", "", 0)])).collect()
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_rows_of_equal_scores_are_accepted_together_in_any_order():
    good, bad, worse = [("card", 3, v, 0, 0, 0, side, 1, 0) for v, side in ((1, 1), (0, 1), (0, 2))]
    rows = [(good, 100, 100), (bad, 5, 0), (worse, 500, 0)]
    model = (0.0, [((2, "=", 1), (None, 1.0, 1.0), (None, -1.0, -1.0))])
    assert personal_data.thresholds(rows, model) == personal_data.thresholds(rows[::-1], model) == {"card": 1.0}
