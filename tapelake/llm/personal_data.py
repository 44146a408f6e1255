"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose overlapping spans: the four base patterns, and wider or tighter shapes of the same kinds that the base
patterns miss (an e-mail spelled out, a card number next to other digits, a phone number without plus or followed by more
digits). Every candidate gets format features (digits, checksum, octets, separators) and context features (the characters on
both sides, a cue word before). Boosted trees of two levels learn on counts of equal feature rows over the whole corpus: a
candidate on the same place as a base match is positive if that match passed its test and negative if it failed; others
have no label. The trees become one SQL expression; per kind, the lowest score with PRECISION among labelled candidates
is the threshold. Base spans always stay; accepted candidates that touch no base span are added, the best of those that overlap.

Positions are code points, ends exclusive. A pattern's matches are found by marking them and cutting the text at the marks,
and their places are a running sum of lengths. Quantifiers are possessive where that changes nothing, so that long runs need neither
deep recursion nor time beyond linear. One row for each document and a few for each match are shuffled, no text.

NULL and empty texts have no spans. NULL ids pass. Repeated rows each get their own result. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.session import written

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "", "�"
AFTER_WORD = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
# (kind, is base, pattern, text that must be there); possessive forms of the given base patterns come first
GENERATORS = (
    ("email", True, AFTER_WORD + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])++", ""),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("email", False, r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}+"
                     r"(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\.)[A-Za-z0-9-]{1,63}+){1,8}+", "at"),
    ("card", False, r"(?<![0-9])[0-9]{16,19}+(?![0-9])", ""),
    ("card", False, r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", ""),
    ("phone", False, r"\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{2,4}+\)?[\x20.-]?[0-9]{3,4}+[\x20.-][0-9]{3,4}+(?![0-9])", "+"),
    ("phone", False, r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", ""),
)
CUES = r"(?i)\b(?:tel|phone|call|mobile|fax|card|visa|credit|mail|contact|ip|host|address)\b[^A-Za-z0-9]*$"
FEATURES = ("kind", "digits", "valid", "plus", "parens", "gaps", "left", "right", "cue")
TREES, RATE, PRECISION = 24, 0.4, 0.9


def _cut(text: Column, pattern: str) -> Column:
    """Parts of a text, in turn between and inside the matches."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    twice = F.transform(each, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, part: Column, digits: Column) -> Column:
    """The test of a kind's match: octets, digits and checksum, or digits."""
    count = F.length(digits)
    bare = F.transform(F.split(part, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    octets = F.forall(bare, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", octets)
            .when(kind == "card", count.between(16, 19) & F.when(count.between(16, 19), _luhn(digits)).otherwise(False))
            .otherwise(count.between(8, 15)))


def _side(char: Column) -> Column:
    """0 nothing, 1 blank, 2 letter, 3 digit, 4 other."""
    return (F.when(char.isNull() | (char == ""), 0).when(char.rlike(r"^[\x09-\x0D\x20]"), 1)
            .when(char.rlike(r"^[0-9]"), 3).when(char.rlike(r"^(?:\p{L}|_)"), 2).otherwise(4))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, id, kind, base, start, end, valid and features) for each candidate, and one of kind NULL for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    some = F.contains("text", F.lit("@")) | F.col("text").rlike("[0-9]") | F.col("text").rlike(r"(?i)[(\[{]at[)\]}]")
    clean = F.when(some, F.translate("text", MARK, OTHER))
    rows = rows.select("row", "id", clean.alias("text"))
    digit = F.col("text").rlike("[0-9]")

    def asked(needs: str, kind: str) -> Column:
        return (F.contains("text", F.lit(needs)) if needs else F.lit(True)) & (F.lit(True) if kind == "email" else digit)

    found = [F.struct(F.lit(i).alias("generator"), F.when(asked(needs, kind), _cut(F.col("text"), pattern)).alias("parts"))
             for i, (kind, _, pattern, needs) in enumerate(GENERATORS)]
    document = F.struct(F.lit(-1).alias("generator"), F.array(F.lit("")).alias("parts"))
    several = F.when(F.col("text").isNotNull(), F.filter(F.array(*found), lambda g: F.size(g["parts"]) > 1)).otherwise(F.array())
    cut = rows.select("row", "id", F.explode(F.concat(F.array(document), several)).alias("g"))
    cut = cut.select("row", "id", "g.generator", F.posexplode("g.parts").alias("at", "part"))
    inside = F.col("at") % 2 == 1
    kinds = F.array(*[F.lit(g[0]) for g in GENERATORS])
    bases = F.array(*[F.lit(g[1]) for g in GENERATORS])
    cut = cut.withColumn("kind", F.when(F.col("generator") >= 0, F.get(kinds, "generator"))).withColumn(
        "digits", F.when(inside, F.regexp_replace("part", "[^0-9]", "")))
    count = F.length("digits")
    cut = cut.select(
        "row", "id", "generator", "at", "kind", F.get(bases, "generator").alias("base"), F.length("part").alias("size"),
        F.when(inside, _valid(F.col("kind"), F.col("part"), F.col("digits"))).alias("valid"),
        F.when(inside, F.when(count < 8, 0).when(count < 13, 1).when(count < 16, 2).when(count < 20, 3).otherwise(4)).alias("digits"),
        F.when(inside, F.col("part").startswith("+").cast("int")).alias("plus"),
        F.when(inside, F.contains("part", F.lit("(")).cast("int")).alias("parens"),
        F.when(inside, F.least(F.length(F.regexp_replace("part", r"[^\x20.-]", "")), F.lit(4))).alias("gaps"),
        F.when(~inside, F.substring("part", 1, 1)).alias("head"), F.when(~inside, F.expr("right(part, 24)")).alias("tail"))
    order = Window.partitionBy("row", "generator").orderBy("at")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.repartition("row").select(
        *[c for c in cut.columns if c not in ("head", "tail")], before.alias("start"),
        F.lag("tail").over(order).alias("tail"), F.lead("head").over(order).alias("head"))
    out = placed.where("generator < 0 OR at % 2 = 1").select(
        "row", "id", "kind", "base", "start", (F.col("start") + F.col("size")).alias("end"), F.col("valid").cast("int").alias("valid"),
        "digits", "plus", "parens", "gaps", _side(F.expr("right(tail, 1)")).alias("left"), _side(F.col("head")).alias("right"),
        F.coalesce(F.col("tail").rlike(CUES).cast("int"), F.lit(0)).alias("cue"))
    same = Window.partitionBy("row", "kind", "start", "end")
    return out.withColumn("label", F.when(F.col("kind").isNotNull(), F.max(F.when(F.col("base"), F.col("valid"))).over(same)))


def train(rows: list[tuple]) -> tuple[float, list[tuple]]:
    """Boosted trees of two levels for (features, count, positives) rows: the first log odds and (split, splits, leaves)."""
    rows = [(x, n, p) for x, n, p in rows if n]
    total, positive = sum(n for _, n, _ in rows), sum(p for _, _, p in rows)
    if not total:
        return 0.0, []
    start = math.log((positive + 0.5) / (total - positive + 0.5))
    scores, trees = [start] * len(rows), []
    asked = sorted({(f, op, x[f]) for x, _, _ in rows for f in range(len(FEATURES)) for op in ("=", "<=") if not (f == 0 and op == "<=")},
                   key=repr)

    def best(own: list[int]) -> tuple | None:
        top, found = 1e-6, None
        g, h = sum(grads[i] for i in own), sum(curves[i] for i in own)
        for split in asked:
            inside = [i for i in own if _fits(rows[i][0], split)]
            if not inside or len(inside) == len(own):
                continue
            gi, hi = sum(grads[i] for i in inside), sum(curves[i] for i in inside)
            gain = gi * gi / (hi + 1) + (g - gi) ** 2 / (h - hi + 1) - g * g / (h + 1)
            if gain > top:
                top, found = gain, split
        return found

    for _ in range(TREES):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [p - n * c for (_, n, p), c in zip(rows, chance)]
        curves = [n * c * (1 - c) for (_, n, _), c in zip(rows, chance)]
        first = best(list(range(len(rows))))
        if first is None:
            break
        sides = [[i for i, r in enumerate(rows) if _fits(r[0], first) == side] for side in (True, False)]
        tree = [first]
        for own in sides:
            then = best(own)
            groups = [[i for i in own if _fits(rows[i][0], then) == side] for side in (True, False)] if then else [own, own]
            leaves = [RATE * sum(grads[i] for i in g) / (sum(curves[i] for i in g) + 1) for g in groups]
            tree.append((then, *leaves))
            for g, leaf in list(zip(groups, leaves))[:2 if then else 1]:
                for i in g:
                    scores[i] += leaf
        trees.append(tuple(tree))
    return start, trees


def _test(split: tuple) -> Column:
    f, op, value = split
    return F.col(FEATURES[f]) == F.lit(value) if op == "=" else F.col(FEATURES[f]) <= F.lit(value)


def score_column(model: tuple[float, list[tuple]]) -> Column:
    """The trees as one expression: the log odds of a candidate."""
    start, trees = model
    out = F.lit(start)
    for first, yes, no in trees:
        sides = [F.when(_test(then), F.lit(a)).otherwise(F.lit(b)) if then else F.lit(a) for then, a, b in (yes, no)]
        out = out + F.when(_test(first), sides[0]).otherwise(sides[1])
    return out


def thresholds(rows: list[tuple], model: tuple[float, list[tuple]]) -> dict[str, float]:
    """Per kind, the lowest score from which on the share of positives is at least PRECISION; none if never."""
    start, trees = model

    def score(x: tuple) -> float:
        s = start
        for first, yes, no in trees:
            then, a, b = yes if _fits(x, first) else no
            s += a if then is None or _fits(x, then) else b
        return s
    out = {}
    for kind in KINDS:
        tied: dict[float, list[int]] = {}  # rows of equal scores are accepted together
        for x, more, positive in rows:
            if x[0] == kind:
                group = tied.setdefault(round(score(x), 9), [0, 0])
                group[0], group[1] = group[0] + more, group[1] + positive
        n = p = 0
        for s, (more, positive) in sorted(tied.items(), reverse=True):
            n, p = n + more, p + positive
            if p >= PRECISION * n:
                out[kind] = s
    return out


def _fits(x: tuple, split: tuple) -> bool:
    f, op, value = split
    return x[f] == value if op == "=" else x[f] <= value


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: row, id, base (base spans) and spans (all), arrays of (place of kind, start, end, kind) in order."""
    found = written(candidates(docs, key, text), "candidates")
    # equal feature rows are few: the product of the features' values bounds them
    table = [(tuple(r[f] for f in FEATURES), r["n"], r["p"]) for r in
             found.where("label IS NOT NULL").groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()]
    table.sort(key=repr)
    model = train(table)
    accepted = F.lit(False)
    for kind, least in thresholds(table, model).items():
        accepted = accepted | ((F.col("kind") == kind) & (F.col("score") >= least - 1e-9))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    own = F.struct(place.alias("place"), "start", "end", "kind")
    is_base = F.col("base") & (F.col("valid") == 1)
    more = F.col("kind").isNotNull() & ~F.col("base") & F.col("label").isNull() & accepted
    marked = found.withColumn("score", score_column(model)).select(
        "row", "id", F.when(is_base, own).alias("b"),
        F.when(more, F.struct(F.col("score"), (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), own.alias("span"))).alias("m"))
    gathered = marked.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list("b")).alias("base"), F.collect_set("m").alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["span"]["end"]) & (m["span"]["start"] < b["end"])))
    best = F.filter("free", lambda m: ~F.exists("free", lambda o: (o["span"]["start"] < m["span"]["end"])
                                               & (m["span"]["start"] < o["span"]["end"]) & (o > m)))
    gathered = gathered.withColumn("free", free)
    return gathered.select("row", "id", "base", F.array_sort(F.array_union("base", F.transform(best, lambda m: m["span"]))).alias("spans"))


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: key, counts of base spans, base_sha256, spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = map(count, KINDS)
    return spans(docs, key, text).select(F.col("id").alias(key), *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
                                         _joined("spans").alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """A text with each span replaced by its kind in brackets, from the last to the first. Spans that overlap an earlier replacement's
    rest are cut to what is left of it."""
    last = F.array_sort(found, lambda a, b: (b["start"] - a["start"]).cast("int"))
    begin = F.struct(text.alias("text"), F.length(text).cast("long").alias("limit"))
    done = F.aggregate(last, begin, lambda acc, s: F.struct(
        F.overlay(acc["text"], F.concat(F.lit("["), s["kind"], F.lit("]")), (s["start"] + 1).cast("int"),
                  (F.least(s["end"], acc["limit"]) - s["start"]).cast("int")).alias("text"), s["start"].cast("long").alias("limit")))
    return done["text"]
