"""Admission, containment and redaction over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import patterns, text
from tapelake.operators import admission, redact
from tapelake.plans.registry import query, table
from tapelake.session import spread, written



def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


# Whitespace as the collapse rule sees it (Unicode White_Space), for RE2.
SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FLAT = f"lower(trim(regexp_replace(text, '{SPACES}', ' ', 'g')))"
SQUASHED = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
PLANTED = r'\btoken\s*=\s*"[0-9a-f]{40}"'


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {FLAT}")
def content_dedupe(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        "doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("key"))
    return admission.keep_first(docs, ["key"], "doc_id").select("doc_id")


@query(f"""
WITH d AS (SELECT doc_id, source, {FLAT} AS flat,
                  CASE WHEN contains(text, 'token = "') THEN 'answer_leak' WHEN n_chars < 60 THEN 'property'
                       WHEN lang = 'es' AND n_chars > 3000 THEN 'admission' END AS stage FROM documents),
     b AS (SELECT DISTINCT {FLAT} AS flat FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
     f AS (SELECT source, flat, min(doc_id) AS first FROM d WHERE stage IS NULL AND flat NOT IN (SELECT flat FROM b) GROUP BY ALL),
     v AS (SELECT source, coalesce(bool_or(stage IN ('answer_leak', 'property')), false) AS void FROM d GROUP BY source)
SELECT d.doc_id, v.void, CASE WHEN stage IS NOT NULL THEN stage
       WHEN d.flat IN (SELECT flat FROM b) OR f.first < d.doc_id THEN 'duplicate'
       WHEN v.void THEN 'voided' ELSE 'admitted' END AS fate
FROM d JOIN v USING (source) LEFT JOIN f ON f.source = d.source AND f.flat = d.flat""")
def batch_screen(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(
        "doc_id", "source", "lang", "n_chars", F.sha2(text.collapse(F.col("text")), 256).alias("key"),
        F.contains("text", F.lit('token = "')).alias("leak"))
    labels = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    pool = docs.join(labels, "doc_id", "left_semi").select("key")
    out = admission.screen_batches(
        docs, pool, ["source"], "doc_id", "key", F.col("leak"), F.col("n_chars") < 60,
        (F.col("lang") == "es") & (F.col("n_chars") > 3000))
    return out.select("doc_id", "void", "fate")


SENTENCES = """
phrases AS (SELECT item_id, CAST(i AS INTEGER) AS rank, s[i] AS phrase FROM (
    SELECT item_id, string_split(text, '. ') AS s FROM benchmark), range(1, 200) r(i) WHERE i <= len(s)),
"""


WORD_MATCH = "regexp_matches(d.flat, '(^|[^a-z0-9])' || regexp_escape(k.words) || '($|[^a-z0-9])')"


@query("WITH " + SENTENCES + f"""
k AS (SELECT item_id, rank, {SQUASHED.format('phrase')} AS key, lower(trim(regexp_replace(phrase, '{SPACES}', ' ', 'g'))) AS words FROM phrases),
d AS (SELECT doc_id, {SQUASHED.format('text')} AS squashed, {FLAT} AS flat FROM documents)
SELECT item_id, rank, doc_id FROM k JOIN d ON contains(d.squashed, k.key) WHERE length(k.key) >= 6
UNION ALL SELECT item_id, rank, doc_id FROM k JOIN d ON {WORD_MATCH} WHERE length(k.key) BETWEEN 3 AND 5""")
def leak_scan(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("rank", "phrase"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return admission.corpus_leaks(items.withColumn("rank", F.col("rank") + 1), docs, ["item_id", "rank"], ["doc_id"]).select(
        "item_id", "rank", "doc_id")


@query("WITH " + SENTENCES + f"""
w AS (SELECT DISTINCT unnest(string_split(lower(trim(regexp_replace(phrase, '{SPACES}', ' ', 'g'))), ' ')) AS words FROM phrases),
k AS (SELECT words FROM w WHERE length({SQUASHED.format('words')}) BETWEEN 3 AND 5),
d AS (SELECT doc_id, {FLAT} AS flat FROM documents)
SELECT words AS word, doc_id FROM k JOIN d ON {WORD_MATCH}""")
def short_leaks(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("phrase"))
    words = items.select(F.explode(F.split(text.collapse(F.col("phrase")), " ")).alias("word")).distinct()
    short = words.where(F.length(text.squash(F.col("word"))).between(3, 5))
    docs = _documents(spark, sf_dir).select("doc_id", text.collapse(F.col("text")).alias("text"))
    from tapelake.operators.containment import word_hits
    return word_hits(short.withColumn("phrase", F.col("word")), docs, ["word"], ["doc_id"], "phrase", "text")


REJECT_SQL = f"""
d AS (SELECT doc_id, source, lang, n_chars, {FLAT} AS flat,
             CASE WHEN n_chars < 60 THEN 'malformed' WHEN lang = 'de' AND n_chars > 2500 THEN 'unknown-tool'
                  WHEN contains(text, 'token = "') THEN 'answer-leak' END AS before,
             CASE WHEN n_chars > 8000 THEN 'destructive-excluded' END AS after,
             coalesce(toxic = 1, false) AS judge FROM documents LEFT JOIN labels USING (doc_id)),
pl AS (SELECT source, flat, min(doc_id) AS plain FROM d WHERE before IS NULL AND after IS NULL AND NOT judge GROUP BY ALL),
st AS (SELECT d.source, min(d.doc_id) AS seat FROM d LEFT JOIN pl ON d.source = pl.source AND d.flat = pl.flat
       WHERE judge AND before IS NULL AND (plain IS NULL OR d.doc_id < plain) GROUP BY 1),
j AS (SELECT d.*, coalesce(d.doc_id = seat, false) AS seated FROM d LEFT JOIN st ON d.source = st.source),
ow AS (SELECT source, flat, min(doc_id) AS owner FROM j
       WHERE before IS NULL AND after IS NULL AND (NOT judge OR seated) GROUP BY ALL),
r AS (SELECT j.doc_id, j.source, CASE WHEN owner < j.doc_id THEN 'duplicate-id' WHEN before IS NOT NULL THEN before
             WHEN judge AND NOT seated THEN 'check-too-permissive' ELSE after END AS reason
      FROM j LEFT JOIN ow ON j.source = ow.source AND j.flat = ow.flat),
s AS (SELECT *, CASE WHEN reason IS NULL THEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY source ORDER BY doc_id)
                     END AS suite_no FROM r)
"""


def _admitted(spark, sf_dir):
    docs = _documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    n = F.col("n_chars")
    before = F.when(n < 60, "malformed").when((F.col("lang") == "de") & (n > 2500), "unknown-tool").when(
        F.contains("text", F.lit('token = "')), "answer-leak")
    rows = docs.select(
        "source", F.col("doc_id").alias("position"), F.sha2(text.collapse(F.col("text")), 256).alias("task_id"),
        before.alias("before"), F.when(n > 8000, "destructive-excluded").alias("after"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_judge"))
    return admission.trim(admission.admit(rows, ["source"]), 20, ["source"])


@query("WITH " + REJECT_SQL + "SELECT doc_id, reason, coalesce(suite_no > 20, false) AS trimmed FROM s")
def admission_order(spark, sf_dir):
    return _admitted(spark, sf_dir).select(F.col("position").alias("doc_id"), "reason", "trimmed")


@query("WITH " + REJECT_SQL + """
SELECT source, 'rule' AS kind, reason AS name, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT source, 'yield', 'candidates', count(*) FROM s GROUP BY source
UNION ALL SELECT source, 'yield', 'admitted', count(*) FILTER (suite_no <= 20) FROM s GROUP BY source
UNION ALL SELECT source, 'yield', 'trimmed', count(*) FILTER (suite_no > 20) FROM s GROUP BY source
UNION ALL SELECT source, 'yield', 'shortfall', 0 FROM s GROUP BY source""")
def drop_ledger(spark, sf_dir):
    rows = written(_admitted(spark, sf_dir), "ledger")
    rules = admission.drop_ledger(rows, ["source"], "reason").select(
        "source", F.lit("rule").alias("kind"), F.col("rule").alias("name"), F.col("dropped").alias("n"))
    balance = admission.reconcile(rows, ["source"], "reason", "trimmed")
    figures = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n"))
                        for c in ("candidates", "admitted", "trimmed", "shortfall")])
    yields = balance.select("source", F.lit("yield").alias("kind"), F.explode(figures).alias("f")).select(
        "source", "kind", "f.name", "f.n")
    return rules.unionByName(yields)


@query("""
SELECT lang, count(*) FILTER (quality IS NOT NULL) AS screened, count(*) FILTER (quality = 1 AND toxic = 0) AS dropped,
       count(*) FILTER (quality IS NULL) AS errors, CAST(sum(n_chars) AS BIGINT) AS input_tokens,
       CAST(sum(quality) AS BIGINT) AS output_tokens
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def null_screen(spark, sf_dir):
    cold = _documents(spark, sf_dir).select("doc_id", "lang", F.col("n_chars").alias("input_tokens")).join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    cold = cold.withColumn("error", F.when(F.col("quality").isNull(), "no answer")).withColumn(
        "cold_passed", (F.col("quality") == 1) & (F.col("toxic") == 0)).withColumn(
        "output_tokens", F.col("quality").cast("long"))
    return admission.screen_summary(cold, ["lang"])


@query("""
WITH names AS (SELECT DISTINCT p_brand, p_size, p_name FROM part),
     words AS (SELECT DISTINCT p_brand, p_size, regexp_extract(p_name, '[a-z]+$', 0) AS word FROM part),
     hits AS (SELECT w.p_brand, w.p_size, word, p_name FROM words w JOIN names n
              ON w.p_brand = n.p_brand AND w.p_size = n.p_size AND contains(p_name, word))
SELECT p_brand, p_size, word, min(p_name) AS producer FROM hits GROUP BY ALL HAVING count(*) = 1""")
def handle_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_name")
    names = part.distinct().withColumn("lowered", F.lower("p_name"))
    words = part.select("p_brand", "p_size", F.regexp_extract("p_name", "[a-z]+$", 0).alias("word")).distinct()
    hits = admission.name_matches(words.withColumn("entity", F.col("word")), names, ["p_brand", "p_size"], ["word"],
                                  "entity", ["p_name"], "lowered")
    return hits.groupBy("p_brand", "p_size", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min("p_name").alias("producer")).where("n = 1").drop("n")


@query("""
WITH p AS (SELECT *, '(?i)' || p_name || '[0-9]+' || p_type || '?' || CASE WHEN p_size % 5 = 0 THEN '(' ELSE '' END AS pattern
           FROM part)
SELECT p_partkey, p_size % 5 <> 0 AS ok, greatest(length(p_name), length(p_type) - 1) AS literal_run FROM p""")
def check_shape(spark, sf_dir):
    broken = F.when(F.col("p_size") % 5 == 0, "(").otherwise("")
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(
        F.lit("(?i)"), "p_name", F.lit("[0-9]+"), "p_type", F.lit("?"), broken).alias("pattern"))
    return part.select("p_partkey", patterns.validated("pattern").alias("v"),
                       patterns.longest_literal_run(F.col("pattern")).alias("literal_run")).select(
        "p_partkey", "v.ok", "literal_run")


@query("""
SELECT c_custkey, 'Bill ' || c_name || ' of ' || c_mktsegment || ' by {{due}}' AS prompt, 'due' AS unresolved FROM customer""")
def render_prompts(spark, sf_dir):
    params = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    prompt = text.render_prompt(F.lit("Bill {{name}} of {{ segment }} by {{due}}"), params)
    return table(spark, sf_dir, "customer").select("c_custkey", prompt.alias("prompt")).withColumn(
        "unresolved", F.array_join(text.placeholders(F.col("prompt")), ","))


@query("""
WITH p AS (SELECT conv_id, turn, lower(trim(text)) AS raw FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(raw, '[^a-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''),
       'task-' || (turn + 1)) AS slug FROM p""")
def task_slugs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.task_slug(F.col("text"), F.col("turn")).alias("slug"))


@query("""
SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey)) AS suite_hash
FROM orders GROUP BY o_custkey""")
def suite_hash(spark, sf_dir):
    from tapelake.operators.ordered import row_number

    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", F.concat_ws(":", "o_orderkey", "o_orderpriority").alias("item"))
    placed = row_number(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "position")
    return admission.ordered_hash(placed, ["o_custkey"], "position", "item", "suite_hash")


# The value rules DuckDB's engine can run (it has no lookbehind), plus the planted shape.
FLAT_RULES = [p for p in redact.VALUE_PATTERNS if "(?<" not in p] + [PLANTED]


def _redacted_sql() -> str:
    out = "text"
    for p in FLAT_RULES:
        out = f"regexp_replace({out}, '{p}', '[REDACTED]', 'g')"
    return out


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '{PLANTED}')) AS hits, sha256({_redacted_sql()}) AS digest FROM documents""")
def redact_docs(spark, sf_dir):
    body = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", redact.hits(body, PLANTED).alias("hits"),
        F.sha2(redact.redact_text(body, FLAT_RULES), 256).alias("digest"))


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '鍵' WHEN 1 THEN 'clé' WHEN 2 THEN 'ключ' ELSE '' END AS before,
           CASE doc_id % 3 WHEN 0 THEN 'sk-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 24)
                WHEN 1 THEN 'AKIA' || upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) ELSE 'ghp_' || md5(CAST(doc_id AS VARCHAR)) || 'abcd' END AS secret,
           regexp_extract_all(text, '[a-z]+') AS w FROM documents)
SELECT doc_id, before || '[REDACTED]' || ' ' || array_to_string(w, ' ') AS note, '[REDACTED]' AS token, CAST(doc_id AS VARCHAR) AS tokens,
       len(w) AS words FROM s""")
def redact_tape_json(spark, sf_dir):
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    before = F.element_at(F.array(F.lit("鍵"), F.lit("clé"), F.lit("ключ"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    secret = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sk-"), F.substring(key, 1, 24))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("AKIA"), F.upper(F.substring(key, 1, 16)))).otherwise(F.concat(F.lit("ghp_"), key, F.lit("abcd")))
    d = _documents(spark, sf_dir).withColumn("w", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(
        F.concat(before, secret, F.lit(" "), F.array_join("w", " ")).alias("note"), F.struct(secret.alias("deep")).alias("token"),
        F.col("doc_id").alias("tokens")).alias("raw")))
    clean = redact.redact_tapes(d.select("doc_id", F.size("w").cast("long").alias("words"), line.alias("raw_text")))
    part = [F.get_json_object("raw_text", f"$.raw.{c}").alias(c) for c in ("note", "token", "tokens")]
    return clean.select("doc_id", *part, "words")


@query("""
SELECT o_orderkey, 'paid by ref-' || o_custkey || ' for ' || CASE WHEN o_orderkey % 2 = 1 THEN '[REDACTED]' ELSE 'key-' || o_orderkey || '-' || o_custkey END
       || '.' AS note FROM orders""")
def scrub_many(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.concat_ws("-", F.lit("key"), "o_orderkey", "o_custkey")
    secrets = o.where("o_orderkey % 2 = 1").select(key.alias("secret"))
    notes = o.select("o_orderkey", F.concat(F.lit("paid by ref-"), "o_custkey", F.lit(" for "), key, F.lit(".")).alias("note"))
    return redact.scrub(notes, "note", secrets)


@query("""
SELECT p_partkey, p_partkey % 6 <> 5 AS ok, CASE WHEN p_partkey % 6 <> 5 THEN contains(lower(p_name || ' {"id": 7}' || p_type || p_type), CASE p_partkey % 6
    WHEN 0 THEN lower(p_name) || ' {"id":' WHEN 1 THEN '7}' || lower(p_type) || lower(p_type) WHEN 2 THEN lower(p_name) WHEN 3 THEN '"id": 7}' ELSE '{,3}' END)
    END AS matches FROM part""")
def pattern_dialect(spark, sf_dir):
    shapes = F.array(F.concat("p_name", F.lit(' {"id":')), F.concat(F.lit(r"(?P<digit_1>\d)\}(?P<kind>"), "p_type", F.lit(")(?P=kind)")),
                     F.concat(F.lit("(?#the name)(?i)"), "p_name"), F.lit(r"(?'q'\W)id\k<q>: [0-9]}"), F.lit("{,3}"), F.concat("p_name", F.lit("++")))
    subject = F.concat("p_name", F.lit(' {"id": 7}'), "p_type", "p_type")
    p = table(spark, sf_dir, "part").select("p_partkey", subject.alias("subject"), F.get(shapes, (F.col("p_partkey") % 6).cast("int")).alias("pattern"))
    seen = p.select("p_partkey", "subject", patterns.validated("pattern").alias("v"))
    hit = F.regexp_like("subject", F.concat(F.lit("(?i)"), F.coalesce("v.java_pattern", F.lit(""))))
    return seen.select("p_partkey", "v.ok", F.when(F.col("v.ok"), hit).alias("matches"))


@query("""
SELECT conv_id, turn, sha256(replace(replace(text, 'therou', '[REDACTED]'), 'leation', '[REDACTED]')) AS digest FROM conversations""")
def scrub_secrets(spark, sf_dir):
    secrets = spark.createDataFrame([("therou",), ("leation",), ("the",)], "secret string")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return redact.scrub(c, "text", secrets).select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


@query("""
SELECT event_id, '{"k":"[REDACTED]"}' AS props, '{"k":' || json_extract_string(props, '$.k') || '}' AS counted FROM events""")
def redact_props(spark, sf_dir):
    hide = redact.Rules.of([{"type": "path", "path": "$.k"}])
    e = spread(table(spark, sf_dir, "events").select("event_id", "props"))
    # a key rule leaves numbers alone; a path rule does not
    keep = redact.Rules.of([], keys=[r"^k$"])
    return e.select("event_id", redact.redact_json(F.col("props"), hide).alias("props"),
                    redact.redact_json(F.col("props"), keep).alias("counted"))


@query("""
WITH t AS (SELECT DISTINCT p_brand, p_name AS name FROM part)
SELECT p_brand, sha256('[' || string_agg('{"name":"' || name || '"}', ',' ORDER BY name) || ']') AS digest FROM t GROUP BY p_brand""")
def surface_digest(spark, sf_dir):
    tools = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name")).distinct()
    tools = tools.withColumn("definition", F.to_json(F.struct("name", F.lit(1).alias("not_surface"))))
    return admission.surface_digests(tools, ["p_brand"])
