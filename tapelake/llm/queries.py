"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.llm import byte_bpe, capture_index, decontaminate, pair_search, personal_data, piece_bpe, set_join, site_lines, substring_chains, topk_search, toxicity, web_trust, whitening
from tapelake.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANK_FILE = "byte_bpe_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_substring_dedup(spark, sf_dir):
    return substring_chains.repeated(table(spark, sf_dir, "documents")).withColumnRenamed("ref", "ref_doc_id")


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM r""")
def op2_warc(spark, sf_dir):
    return (capture_index.round_trip(table(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     g AS (SELECT DISTINCT item, least(len(w), 10) AS k, w[i:i + least(len(w), 10) - 1] AS gram
           FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
     p AS (SELECT r, k, i, w[i:i + k - 1] AS gram FROM
             (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
     h AS (SELECT r, item, k, i FROM p JOIN g USING (k, gram)),
     n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM h) GROUP BY r),
     t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)""")
def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
     e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS shared FROM e a JOIN e b USING (x)
           WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
           HAVING 100 * count(*) >= 90 * (total - count(*))),
     r AS (SELECT doc_id AS v, doc_id AS reached FROM documents UNION SELECT r.v, p.b FROM r JOIN p ON r.reached = p.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT v, min(reached) AS component_id FROM r GROUP BY v) c ON s.doc_id = c.v""")
def op4_ngram_jaccard_join(spark, sf_dir):
    return set_join.clusters(table(spark, sf_dir, "documents"))


@query()
def op5_byte_level_bpe(spark, sf_dir):
    pieces = byte_bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), pieces, public_tokenizers.PATTERN)


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM documents),
     l AS (SELECT r, host, i, raw, trim(raw, E' \t\n\x0B\f\r') AS line
           FROM (SELECT r, host, unnest(range(len(s))) AS i, s[i + 1] AS raw
                 FROM (SELECT r, host, string_split(text, E'\n') AS s FROM d WHERE text IS NOT NULL))),
     c AS (SELECT host, line, count(DISTINCT r) AS pages FROM l WHERE line <> '' GROUP BY ALL),
     b AS (SELECT host, line FROM c JOIN (SELECT host, count(*) AS n FROM d GROUP BY host) USING (host)
           WHERE pages >= 3 AND pages > 0.1 * n),
     k AS (SELECT r, coalesce(string_agg(raw, E'\n' ORDER BY i) FILTER (b.line IS NULL), '') AS text,
                  count(b.line) AS n_dropped FROM l LEFT JOIN b USING (host, line) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(k.text) AS text_sha256,
       CAST(length(k.text) AS BIGINT) AS n_chars, k.text AS text FROM d LEFT JOIN k USING (r)""")
def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return site_lines.drop_lines(docs).select(
        "doc_id", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.length("text").cast("long").alias("n_chars"), "text")


@query()
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return (toxicity.score(docs.select("doc_id", "text"), model)
            .select("doc_id", F.coalesce(toxicity.remainder() == 0, F.lit(False)).alias("held_out"), "score", "predicted"))


@query()
def op8_url_filters(spark, sf_dir):
    return web_trust.judge(table(spark, sf_dir, "pages"))


@query()
def op10_personal_data(spark, sf_dir):
    return personal_data.report(table(spark, sf_dir, "documents"))


@query()
def op9_exact_topk_search(spark, sf_dir):
    """Queries are the whole texts of the rows whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = topk_search.top_k(docs, docs.where("doc_id % 50 = 0"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query()
def op11_sentencepiece(spark, sf_dir):
    return piece_bpe.digests(table(spark, sf_dir, "documents"), piece_bpe.read_model(public_tokenizers.path(PIECE_FILE)))


@query()
def op12_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS words FROM t WHERE len(w) > 0),
     d AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * n) // words AS m, w FROM t, g WHERE len(w) > 0),
     p AS (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(w) AS term FROM d) GROUP BY ALL),
     f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, g GROUP BY term),
     q AS (SELECT DISTINCT item_id, text FROM benchmark),
     a AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term, sha256(coalesce(text, '')) AS digest FROM q),
     s AS (SELECT item_id, digest, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM a JOIN p USING (term) JOIN f USING (term) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id, digest ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s) WHERE rank <= 10""")
def op13_ranked_lexical_search(spark, sf_dir):
    found = pair_search.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
