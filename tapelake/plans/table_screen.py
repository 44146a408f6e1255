"""Candidate tasks made of the supplied documents, screened, admitted and accounted for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import documents
from tapelake.operators import admission
from tapelake.plans.registry import query, table
from tapelake.plans.table_admission import FLAT, SQUASHED, _documents
from tapelake.session import written

WORD = "[a-z]{4,}"


def _candidates(spark, sf_dir):
    """One candidate task per document as JSON text, fields in an order of their own."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    rows = _documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("run_id"), F.coalesce("lang", F.lit("")).alias("lang"),
                                            (F.coalesce("n_chars", F.lit(0)) % 60).alias("k"), words.alias("w"))
    rows = rows.select("*", *[F.coalesce(F.get("w", F.lit(i)), F.lit("")).alias(f"w{i + 1}") for i in range(4)])
    k, read = F.col("k"), F.concat(F.lit("read_"), F.col("lang"))
    tools = (F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(read, F.lit("lost_tool")))
             .when(k % 3 == 0, F.array(F.lit("open_box"), read, read)).otherwise(F.array(read)))
    null = F.lit(None).cast("string")
    kind = k % 6
    tool = F.when(kind == 3, "open_box").when(kind == 4, F.when(k % 4 == 0, "lost_tool").otherwise("open_box"))
    pattern = F.when(kind == 2, F.concat(F.lit("(?i)"), F.col("w4"), F.lit("[0-9]+"))).when(
        kind == 4, F.concat(F.lit("(?P<n>"), F.col("w4"), F.lit(")")))
    check = F.struct(
        F.element_at(F.array(*map(F.lit, ("substring", "substring", "regex", "tool_called", "tool_result_matches", "judge"))),
                     (kind + 1).cast("int")).alias("kind"),
        F.when(kind < 3, "final_text").otherwise(null).alias("where"), F.when(kind < 2, F.col("w4")).otherwise(null).alias("value"),
        tool.alias("tool"), pattern.alias("pattern"), F.when(kind == 5, "Is it right?").otherwise(null).alias("rubric"))
    task = F.struct(
        F.concat(F.lit("T "), (F.col("doc_id") % 97).cast("string")).alias("id"),
        F.when(k == 0, "  ").otherwise(F.concat(F.lit("Tell {{what}} of "), F.col("lang"))).alias("promptTemplate"),
        F.struct(F.col("w1").alias("what")).alias("params"), tools.alias("expectedTools"),
        F.when(k % 10 == 4, "because").otherwise("volatile").alias("serverRequiredBecause"),
        F.struct(F.col("w2").alias("z"), F.col("w3").alias("a")).alias("answerKey"),
        check.alias("check"), (k % 12 == 3).alias("errorPath"), (k % 15 == 7).alias("destructive"))
    return rows.select("run_id", F.col("doc_id").alias("position"), F.to_json(task).alias("source"))


def _surfaces(spark, sf_dir):
    """(tools, context): what each source lists, and the head of its first document."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("run_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    readers = docs.select("run_id", F.concat(F.lit("read_"), F.col("lang")).alias("name")).distinct().withColumn("input_schema", F.lit("{}"))
    box = F.array(F.struct(F.lit("make_box").alias("name"), F.lit("{}").alias("input_schema")), F.struct(
        F.lit("open_box").alias("name"), F.lit('{"properties": {"box_id": {}}, "required": ["box_id"]}').alias("input_schema")))
    boxes = docs.select("run_id").distinct().select("run_id", F.inline(box))
    tools = readers.unionByName(boxes).select(
        "run_id", "name", F.lit(None).cast("string").alias("description"), (F.col("name") != "make_box").alias("read_only"),
        F.when(F.col("name") == "make_box", F.lit(False)).alias("destructive_hint"), "input_schema")
    context = docs.groupBy("run_id").agg(F.min("doc_id").alias("text_no"), F.min_by(F.substring("text", 1, 400), "doc_id").alias("text"))
    return tools, context


CANDIDATES = f"""
b AS (SELECT doc_id, coalesce(source, '') AS run_id, coalesce(lang, '') AS lang, coalesce(n_chars, 0) % 60 AS k, text,
             regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
c AS (SELECT doc_id, run_id, lang, k, k % 6 AS kind, 't-' || (doc_id % 97) AS task_id, coalesce(w[1], '') AS w1, coalesce(w[2], '') AS w2,
             coalesce(w[3], '') AS w3, coalesce(w[4], '') AS w4,
             CASE WHEN k = 0 THEN '' ELSE 'Tell ' || coalesce(w[1], '') || ' of ' || lang END AS prompt FROM b),
x AS (SELECT run_id, {SQUASHED.format("coalesce(arg_min(substring(text, 1, 400), doc_id), '')")} AS said FROM b WHERE text IS NOT NULL GROUP BY run_id),
l AS (SELECT *, {SQUASHED.format('prompt')} AS sq, {FLAT.replace('text', 'prompt')} AS fl, CASE WHEN k % 3 = 0 AND k > 0 THEN 2 ELSE 0 END AS twice
      FROM c LEFT JOIN x USING (run_id)),
h AS (SELECT *, CASE WHEN hit2 THEN w2 WHEN hit3 THEN w3 END AS prompt_leak,
             CASE WHEN length(w2) >= 6 AND contains(said, w2) THEN w2 WHEN length(w3) >= 6 AND contains(said, w3) THEN w3 END AS context_leak
      FROM (SELECT *, length(w2) >= 3 AND CASE WHEN length(w2) >= 6 THEN contains(sq, w2) ELSE regexp_matches(fl, '(^|[^a-z0-9])' || w2 || '($|[^a-z0-9])') END AS hit2,
                      length(w3) >= 3 AND CASE WHEN length(w3) >= 6 THEN contains(sq, w3) ELSE regexp_matches(fl, '(^|[^a-z0-9])' || w3 || '($|[^a-z0-9])') END AS hit3,
                      CASE WHEN length(w4) >= 6 THEN contains(sq, w4) ELSE regexp_matches(fl, '(^|[^a-z0-9])' || w4 || '($|[^a-z0-9])') END AS asked FROM l)),
q AS (SELECT *, CASE WHEN kind < 2 THEN CASE WHEN w4 = '' THEN 'invalid-check' WHEN asked THEN 'check-matches-prompt' END
                     WHEN kind = 2 THEN CASE WHEN w4 = '' THEN 'check-too-permissive' END
                     WHEN kind = 3 THEN CASE WHEN k % 12 <> 3 THEN 'check-too-permissive' END
                     WHEN kind = 4 THEN CASE WHEN k % 4 = 0 THEN 'invalid-check' WHEN w4 = '' THEN 'check-too-permissive' END END AS refused FROM h),
d AS (SELECT *, CASE WHEN k = 0 THEN 'malformed' WHEN k = 1 THEN 'no-expected-tools' WHEN k = 2 THEN 'unknown-tool'
                     WHEN k % 10 = 4 THEN 'no-server-requirement' WHEN prompt_leak IS NOT NULL THEN 'answer-leak'
                     WHEN context_leak IS NOT NULL THEN 'context-answer-leak' ELSE refused END AS before,
             CASE WHEN k % 15 = 7 THEN 'destructive-excluded' END AS after, kind = 5 AS judge FROM q),
pl AS (SELECT run_id, task_id, min(doc_id) AS plain FROM d WHERE before IS NULL AND after IS NULL AND NOT judge GROUP BY ALL),
st AS (SELECT d.run_id, min(d.doc_id) AS seat FROM d LEFT JOIN pl USING (run_id, task_id)
       WHERE judge AND before IS NULL AND (plain IS NULL OR d.doc_id < plain) GROUP BY 1),
j AS (SELECT d.*, coalesce(d.doc_id = seat, false) AS seated FROM d LEFT JOIN st USING (run_id)),
ow AS (SELECT run_id, task_id, min(doc_id) AS owner FROM j WHERE before IS NULL AND after IS NULL AND (NOT judge OR seated) GROUP BY ALL),
r AS (SELECT j.*, CASE WHEN owner < doc_id THEN 'duplicate-id' WHEN before IS NOT NULL THEN before
                       WHEN judge AND NOT seated THEN 'check-too-permissive' ELSE after END AS reason
      FROM j LEFT JOIN ow USING (run_id, task_id)),
"""


@query("WITH " + CANDIDATES + """
m AS (SELECT *, coalesce(reason <> 'duplicate-id', true) AND prompt <> '' AS early,
             before IS NULL AND coalesce(reason NOT IN ('check-too-permissive', 'duplicate-id'), true) AS late FROM r),
f AS (SELECT doc_id, 1 AS o, 'expected-tools-dedupe' AS rule, 'read_' || lang AS place, '3' AS old, '2' AS new FROM m WHERE early AND twice = 2
      UNION ALL SELECT doc_id, 2, 'check-pattern-dialect', CASE kind WHEN 2 THEN 'flags (?i)' ELSE 'group (?P<name>)' END,
             CASE kind WHEN 2 THEN '(?i)' || w4 || '[0-9]+' ELSE '(?P<n>' || w4 || ')' END,
             CASE kind WHEN 2 THEN w4 || '[0-9]+' ELSE '(?<n>' || w4 || ')' END FROM m WHERE late AND kind IN (2, 4)
      UNION ALL SELECT doc_id, 3, 'handle-chain', 'open_box.box_id', NULL, 'make_box' FROM m WHERE late AND twice = 2),
e AS (SELECT doc_id, reason, CASE WHEN reason = before AND reason IN ('answer-leak', 'context-answer-leak') THEN coalesce(prompt_leak, context_leak) END AS phrase,
             CASE WHEN reason = before AND reason IN ('answer-leak', 'context-answer-leak') THEN CASE WHEN prompt_leak IS NULL THEN 'context' ELSE 'prompt' END END AS place,
             CASE WHEN reason = 'unknown-tool' THEN 'lost_tool' END AS unknown,
             coalesce(reason IN ('invalid-check', 'check-matches-prompt', 'check-too-permissive'), false) AS checked, kind, k, w4, prompt
      FROM r WHERE reason IS NOT NULL)
SELECT doc_id, 'repair' AS kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS no, rule, place, old, new, NULL AS phrase,
       NULL AS check_kind, NULL AS excerpt FROM f
UNION ALL SELECT doc_id, 'drop', NULL, reason, coalesce(place, unknown), CASE WHEN checked AND kind = 2 THEN '(?i)' || w4 || '[0-9]+' WHEN checked AND kind = 4 THEN '(?P<n>' || w4 || ')' END,
       CASE WHEN checked AND kind = 2 THEN w4 || '[0-9]+' WHEN checked AND kind = 4 THEN '(?<n>' || w4 || ')' END, phrase,
       CASE WHEN checked THEN ['substring', 'substring', 'regex', 'tool_called', 'tool_result_matches', 'judge'][kind + 1] END,
       CASE WHEN reason IN ('unknown-tool', 'no-server-requirement') OR phrase IS NOT NULL OR checked THEN substring(prompt, 1, 200) END FROM e
UNION ALL SELECT doc_id, 'task', NULL, NULL, CASE WHEN twice = 2 THEN 'make_box,open_box,read_' || lang ELSE 'read_' || lang END, NULL, NULL, NULL, NULL, NULL
       FROM r WHERE reason IS NULL""")
def screen_tasks(spark, sf_dir):
    raw = _candidates(spark, sf_dir).withColumn("task", F.parse_json("source"))
    tools, context = _surfaces(spark, sf_dir)
    rows = written(admission.admit(admission.screen(raw, tools, context, exclude_destructive=True)), "admitted")
    null = F.lit(None).cast("string")

    def line(df, kind, **columns):
        names = ("rule", "place", "old", "new", "phrase", "check_kind", "excerpt")
        no = columns.pop("no", F.lit(None))
        return df.select(F.col("position").alias("doc_id"), F.lit(kind).alias("kind"), no.cast("int").alias("no"),
                         *[columns.get(n, null).alias(n) for n in names])

    repairs = line(admission.repair_rows(rows), "repair", no=F.col("repair_no"), rule=F.col("rule"), place=F.col("place"), old=F.col("before"),
                   new=F.col("after"))
    drops = line(admission.drop_rows(rows), "drop", rule=F.col("reason"), old=F.col("check_pattern"), new=F.col("check_pattern_repaired"),
                 place=F.coalesce("source", F.array_join("unknown_tools", ",")), phrase=F.col("phrase"), check_kind=F.col("check_kind"),
                 excerpt=F.col("prompt_excerpt"))
    tasks = line(rows.where("reason IS NULL"), "task", place=F.array_join("chained_tools", ","))
    return repairs.unionByName(drops).unionByName(tasks)
