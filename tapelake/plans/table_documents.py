"""Documents as written: canonical form, reading order of leaves, collated reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import documents, text
from tapelake.operators import admission, calls
from tapelake.plans.registry import query, table
from tapelake.plans.table_admission import _documents


@query("""
SELECT p_partkey, sha256(CASE WHEN p_partkey % 2 = 1
         THEN '{"9":' || p_partkey || ',"10":null,"Z":"' || p_brand || '","ü":{"a":[1e-7,9007199254740992,0,1.5],"b":' || p_size || '},"😀":true,"～":"' || p_name || '"}'
         ELSE '{"a":{"c":[1,2.5],"d":"' || p_type || '"},"b":' || p_size || '}' END) AS digest FROM part""")
def canonical_documents(spark, sf_dir):
    """Every second document has fields beyond ASCII, array indexes as fields and numbers that doubles print in another way."""
    odd = F.concat(F.lit('{"ü": {"b": '), "p_size", F.lit(', "a": [1e-7, 9007199254740993, -0.0, 1.50]}, "～": "'), "p_name", F.lit('", "😀": true, "Z": "'),
                   "p_brand", F.lit('", "10": null, "9": '), "p_partkey", F.lit("}"))
    plain = F.concat(F.lit('{"b": '), "p_size", F.lit(', "a": {"d": "'), "p_type", F.lit('", "c": [1, 2.5]}}'))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 1, odd).otherwise(plain).alias("doc"))
    return rows.select("p_partkey", F.sha2(admission.canonical(F.col("doc")), 256).alias("digest"))


@query("""
WITH b AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents),
     p AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS po, unnest([w[5], w[3], w[2], w[4]]) AS p FROM b),
     t AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS place, unnest(['prompt', 'params', 'params', 'context']) AS source,
                  unnest([array_to_string(w[10:14], ' '), array_to_string(w[15:16], ' '), array_to_string(w[17:18], ' '), array_to_string(w[19:40], ' ')]) AS body FROM b)
SELECT doc_id, arg_min(p, place * 10 + po) AS phrase, arg_min(source, place * 10 + po) AS source FROM p JOIN t USING (doc_id)
WHERE p <> '' AND CASE WHEN length(p) >= 6 THEN contains(replace(body, ' ', ''), p) ELSE source <> 'context' AND list_contains(string_split(body, ' '), p) END
GROUP BY doc_id""")
def first_leak(spark, sf_dir):
    """Answer leaves and parameters in the order an ECMAScript object lists them: array indexes first, then as written."""
    d = _documents(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w"))
    word = lambda i: F.coalesce(F.get("w", F.lit(i - 1)), F.lit(""))
    some = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    part = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    task = part('{"answerKey": {"b": "', word(2), '", "10": "', word(3), '", "a": ["', word(4), '", 1e3], "2": "', word(5),
                '"}, "params": {"y": "', some(15, 2), '", "x": "', some(17, 2), '"}}')
    rows = d.select("doc_id", some(10, 5).alias("prompt"), some(19, 22).alias("shown"), documents.task_source(task).alias("read"))
    phrases = F.filter(F.transform("read.leaves", lambda p: F.struct(p.alias("phrase"), text.squash(p).alias("key"), text.collapse(p).alias("words"))),
                       lambda p: F.length(p["key"]) >= admission.MIN_PHRASE)
    context = F.array(F.struct(F.lit(0).cast("long").alias("text_no"), text.squash(F.col("shown")).alias("squashed")))
    leak = admission.first_leak(F.col("prompt"), F.col("read.params"), context, phrases)
    return rows.select("doc_id", leak.alias("leak")).where("leak IS NOT NULL").select("doc_id", "leak.phrase", "leak.source")


@query(r"""
WITH w AS (SELECT regexp_extract(text, '[A-Za-zÀ-ÿ]{3,}') AS name, lang FROM documents),
     c AS (SELECT lang, name, count(*) AS calls FROM w WHERE name <> '' GROUP BY ALL)
SELECT lang, name, calls, row_number() OVER (PARTITION BY lang ORDER BY calls DESC, name COLLATE en, name) AS place FROM c""")
def tools_order(spark, sf_dir):
    """The first words of the documents as names of tools: mixed case and accents, most of them with equal counts."""
    name = F.regexp_extract("text", "[A-Za-zÀ-ÿ]{3,}", 0)
    rows = _documents(spark, sf_dir).select("lang", name.alias("name")).where("name <> ''").groupBy("lang", "name").agg(F.count(F.lit(1)).alias("calls"))
    return calls.placed(rows, "name", ["lang"])
