"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned against every window of every text.

Both sides are normalised alike: A-Z lower-cased, words cut at every other ASCII character. An item's windows are its
runs of `n` words; an item of fewer words, but not none, is one window. Each document position looks its window's
64-bit hash up in the broadcast set and a hit is verified word by word.

The set is broadcast in blocks of at most BLOCK_WINDOWS windows, so a benchmark of any size takes as many scans as it
has blocks. Built-in functions only. Only one row for each document, and one for each hit, are shuffled.

NULL and empty texts have no words and are clean; NULL or empty items have no windows. Repeated document rows each get
their own result; repeated items count once. Documents may have any further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import columns, fresh, words_column

N = 10
BLOCK_WINDOWS = 100_000  # of some 100 to 300 bytes each


def windows(items: DataFrame, key: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """Each distinct window once: gram_hash, k (its words), gram (the words) and the items that hold it."""
    cut = (items.select(F.col(key).cast("string").alias("item"), words_column(F.col(text)).alias("w"))
           .where("size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(n))))
    grams = cut.select("item", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("at")) \
        .select("item", "k", F.slice("w", F.col("at") + 1, F.col("k")).alias("gram"))
    return (grams.groupBy("k", "gram").agg(F.collect_set("item").alias("items"))
            .withColumn("gram_hash", _hash(F.col("gram"), F.lit(0), F.col("k"), n)))


def _hash(words: Column, at: Column, k: Column, n: int) -> Column:
    """Hash of the k words from `at`, k at most n. A word past the array's end is NULL, which leaves a hash as it is."""
    last = [F.when(k > i, F.get(words, at + i)) if i else F.get(words, at) for i in range(n)]
    return F.xxhash64(k, *last)


def hits(docs: DataFrame, grams: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """Per document row: n_words, the start and length of each window found, and the windows' items.

    A row at position -1 stands for the document itself, so that one pass gives clean documents too.
    """
    sizes = [r["k"] for r in grams.select("k").distinct().collect()] or [n]  # at most n values
    blocks = max(1, -(-grams.count() // BLOCK_WINDOWS))
    named = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    cut = named.select("id", F.xxhash64("text", F.length("text")).alias("digest"), words_column(F.col("text")).alias("w"))
    found = None
    for block in range(blocks):
        part = grams if blocks == 1 else grams.where(F.pmod("gram_hash", F.lit(blocks)) == block)
        part = F.broadcast(part.select(F.col("k").alias("gk"), "gram", "gram_hash", "items"))
        first = F.lit(-1) if not block else F.lit(0)
        at = cut.select("id", "digest", "w", F.explode(F.sequence(first, F.size("w"))).alias("at"))
        if len(sizes) > 1:
            at = at.withColumn("k", F.explode(F.when(F.col("at") < 0, F.array(F.lit(sizes[0])))
                                              .otherwise(F.array(*map(F.lit, sizes)))))
        else:
            at = at.withColumn("k", F.lit(sizes[0]))
        inside = (F.col("at") >= 0) & (F.col("at") + F.col("k") <= F.size("w"))
        at = at.withColumn("h", F.when(inside, _hash(F.col("w"), F.col("at"), F.col("k"), n)))
        # one 64-bit join key; words are compared only where it matches
        match = F.coalesce((F.col("k") == F.col("gk"))
                           & (F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("gk")) == F.col("gram")), F.lit(False))
        same = (F.col("h") == F.col("gram_hash")) & match
        rows = (at.join(part, same, "left").where("at < 0 OR gk IS NOT NULL")
                .select("id", "digest", F.when(F.col("at") < 0, F.size("w")).alias("n_words"),
                        F.when(F.col("at") >= 0, F.struct("at", F.col("gk").alias("k"))).alias("hit"), "items"))
        found = rows if found is None else found.unionByName(rows)
    return (found.groupBy("id", "digest")
            .agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
                 F.collect_set("hit").alias("hits"), F.collect_set("items").alias("items"))
            .select("id", "digest", "n_words", "copies", "hits", F.array_distinct(F.flatten("items")).alias("items")))


def spans(found: DataFrame) -> DataFrame:
    """Result of `hits` with `hit_words`: the distinct positions of the words inside any window found."""
    runs = F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["k"] - 1))
    return found.withColumn("hit_words", F.array_sort(F.array_distinct(F.flatten(runs))))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", n: int = N) -> DataFrame:
    """Per document row: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = spans(hits(docs, windows(items, item_key, item_text, n), key, text, n))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("id").alias(key), F.col("n_words").cast("long").alias("n_words"),
                       F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
                       (F.size("hit_words") > 0).alias("contaminated"))


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, n: int) -> tuple[DataFrame, Column]:
    """(id, digest, hit_words) of documents with hits under names that `docs` has not, and the join condition."""
    found = spans(hits(docs, windows(items, item_key, item_text, n), key, text, n).where("size(hits) > 0"))
    names = {c: fresh(docs, f"_{c}") for c in ("id", "digest", "hit_words")}
    found = found.select(*[F.col(c).alias(name) for c, name in names.items()])
    body = F.coalesce(F.col(text), F.lit(""))
    return found, F.col(key).eqNullSafe(F.col(names["id"])) & (F.xxhash64(body, F.length(body)) == F.col(names["digest"]))


def remove_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                     item_text: str = "text", n: int = N) -> DataFrame:
    """The documents that hold no window, columns and rows as they came."""
    found, same = _found(docs, items, key, text, item_key, item_text, n)
    return docs.join(found, same, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", n: int = N) -> DataFrame:
    """The documents with the words of each window found taken out, together with the gaps before them."""
    found, same = _found(docs, items, key, text, item_key, item_text, n)
    gone = F.col(found.columns[2])
    gap, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(text, F.lit(f"({gap}(?:{word})?)"), 1)  # gap and word, in order; a last gap alone
    left = F.filter(pieces, lambda p, i: ~F.array_contains(gone, i))
    out = dict(zip(docs.columns, columns(docs)))
    out[text] = F.when(gone.isNull(), F.col(text)).otherwise(F.array_join(left, "")).alias(text)
    return docs.join(found, same, "left").select(*out.values())
