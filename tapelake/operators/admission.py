"""Admission of candidate tasks into a suite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import documents, text, typed
from tapelake.functions.patterns import answer_leaves, longest_literal_run, validated
from tapelake.operators.containment import phrase_hits, shipped, word_hits
from tapelake.operators.ordered import equi_join, row_number
from tapelake.operators.pairs import is_destructive
from tapelake.session import written

# The limits of the check policy and of the leak scan.
MIN_PHRASE = 3
MIN_CONTEXT_PHRASE = 6
MIN_SUBSTRING = 4
MIN_LITERAL_RUN = 3
JUDGE_CHECKS = 1
SERVER_REQUIREMENTS = ("volatile", "long-tail", "server-minted", "verbatim-quote", "cross-reference")
SUITE_TASKS = 12
EXCERPT = 200

# --- reading model output ----------------------------------------------------------


def payload_text(reply: Column) -> Column:
    """The JSON text in a model reply (bare, fenced or inside prose) that holds a list of tasks; NULL without one."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))

    def listed(candidate: Column) -> Column:
        start = F.regexp_instr(candidate, F.lit(r"[\[{]"))
        tail = F.substring(candidate, start, F.length(candidate))
        closer = F.when(tail.startswith("["), F.lit("]")).otherwise(F.lit("}"))
        last = F.length(tail) + 1 - F.position(closer, F.reverse(tail))
        body = F.when(start > 0, F.substring(tail, F.lit(1), last.cast("int")))
        return F.when(_listed(F.try_parse_json(body)).isNotNull(), body)

    return F.coalesce(listed(fenced), listed(reply))


def _listed(parsed: Column) -> Column:
    return F.coalesce(typed.items(parsed), typed.items(parsed, "$.tasks"))


def task_payload(reply: Column) -> Column:
    """The list of tasks in a model reply as array<variant>."""
    return _listed(F.try_parse_json(payload_text(reply)))


def task_rows(replies: DataFrame, keys: Sequence[str], reply: str) -> DataFrame:
    """keys, position, task (variant), source (JSON text as written): entries that are objects, in order."""
    sources = replies.select(*keys, documents.entry_sources(payload_text(F.trim(reply))).alias("sources"))
    rows = sources.select(*keys, F.posexplode("sources").alias("entry", "source")).withColumn("task", F.try_parse_json("source"))
    good = rows.where(typed.is_object(F.col("task")))
    return row_number(good, keys, ["entry"], "position").withColumn("position", F.col("position") - 1).drop("entry")


def payload_tasks(replies: DataFrame, keys: Sequence[str], reply: str) -> DataFrame:
    """keys, position, task (variant): entries that are objects, in order."""
    rows = replies.select(*keys, F.posexplode(task_payload(F.trim(reply))).alias("entry", "task"))
    good = rows.where(typed.is_object(F.col("task")))
    return row_number(good, keys, ["entry"], "position").withColumn("position", F.col("position") - 1).drop("entry")


def discarded_entries(replies: DataFrame, keys: Sequence[str], reply: str) -> DataFrame:
    tasks = task_payload(F.trim(F.col(reply)))
    objects = F.filter(tasks, typed.is_object)
    return replies.select(*keys, (F.size(tasks) - F.size(objects)).alias("entries_discarded"))


def bound_params(params: Column) -> Column:
    """Parameters as map<string,string>, from an object or an array of {name, value}."""
    listed = F.map_from_entries(F.filter(
        F.transform(typed.items(params), lambda p: F.struct(
            typed.text(p, "$.name").alias("key"), typed.scalar(p, "$.value").alias("value"))),
        lambda e: e["key"].isNotNull() & e["value"].isNotNull()))
    keyed = F.map_filter(
        F.transform_values(F.try_variant_get(typed.obj(params), "$", "map<string,variant>"),
                           lambda _, v: typed.scalar(v)),
        lambda k, v: (k != "") & v.isNotNull())
    return F.coalesce(listed, keyed, F.create_map().cast("map<string,string>"))


# --- keys and hashes -------------------------------------------------------------------


def content_key(prompt: Column, tools: Column, check: Column) -> Column:
    """What makes two tasks the same: collapsed prompt, distinct tools, the check verbatim."""
    return F.sha2(F.to_json(F.struct(
        text.collapse(prompt).alias("prompt"), F.array_sort(F.array_distinct(tools)).alias("tools"),
        check.alias("check"))), 256)


def keep_first(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of every key, in one aggregation: a group of copies of any size
    leaves the map side as one row per task."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return first.select(*key, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*rows.columns)


# What VARIANT would sort, print or refuse in another way than an ECMAScript program: signs beyond ASCII, escapes, unusual numbers,
# fields that are array indexes. Only such documents leave the JVM.
UNUSUAL = r'[^\x20-\x7E]|\\[^"\\nt]|[0-9][eE]|[0-9.]{16}|-0|"[0-9]+"\s*:'


def canonical(value: Column) -> Column:
    """JSON text with fields sorted by UTF-16 units and numbers as ECMAScript prints them."""
    unusual = F.regexp_like(value, F.lit(UNUSUAL))
    return F.coalesce(documents.canonical_text(F.when(unusual, value)), F.to_json(F.parse_json(F.when(~unusual, value))))


def ordered_body(rows: DataFrame, keys: Sequence[str], position: str, item: str, name: str) -> DataFrame:
    """Each group's items joined by commas in the order of ``position``, ready to be hashed.

    One definition at every size. A group is what one published document holds (a suite's tasks, a listing's tools), so its
    body is no longer than that document, which is one row already; groups of many documents have no such hash.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(item).alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda e: e["v"]), ",").alias(name))


def ordered_hash(rows: DataFrame, keys: Sequence[str], position: str, item: str, name: str) -> DataFrame:
    """sha256 over ``ordered_body``."""
    return ordered_body(rows, keys, position, item, "__body").select(*keys, F.sha2(F.col("__body"), 256).alias(name))


def suite_hashes(tasks: DataFrame, suites: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """sha256 over the canonical JSON of generator settings, seed and ordered tasks.

    tasks: keys, suite_no, task (JSON text). suites: keys, generator (JSON text), seed.
    """
    rows = tasks.withColumn("__item", canonical(F.col("task")))
    bodies = ordered_body(rows, keys, "suite_no", "__item", "__body")
    text_ = F.concat(F.lit('{"generator":'), canonical(F.col("generator")), F.lit(',"seed":'), F.col("seed").cast("string"),
                     F.lit(',"tasks":['), F.coalesce("__body", F.lit("")), F.lit("]}"))
    return suites.join(bodies, list(keys), "left").select(*keys, F.sha2(text_, 256).alias("suite_hash"))


def pooled_suite_hashes(tasks: DataFrame, batches: DataFrame, suites: DataFrame,
                        keys: Sequence[str] = ("run_id",), kind: str = "pooled-suite/1") -> DataFrame:
    """Hash of a suite with its extension batches: lineage hashes and all ordered tasks.

    ``kind`` is the tag the producer puts into the hashed text. tasks: keys, suite_no, task. batches: keys, index (from 1), batch_hash. suites: keys, suite_hash.
    """
    bodies = ordered_body(tasks.withColumn("__item", canonical(F.col("task"))), keys, "suite_no", "__item", "__body")
    quoted = F.coalesce(F.concat(F.lit('"'), "batch_hash", F.lit('"')), F.lit("null"))
    lineage = ordered_body(batches.withColumn("__item", quoted), keys, "index", "__item", "__batches")
    rows = suites.join(bodies, list(keys), "left").join(lineage, list(keys), "left")
    text_ = F.concat(F.lit('{"batchSuiteHashes":['), F.coalesce("__batches", F.lit("")), F.lit(f'],"kind":"{kind}",'),
                     F.lit('"originalSuiteHash":"'), F.col("suite_hash"), F.lit('","tasks":['),
                     F.coalesce("__body", F.lit("")), F.lit("]}"))
    return rows.select(*keys, F.sha2(text_, 256).alias("pooled_hash"))


# The fields of a tool that make up its surface.
SURFACE_FIELDS = ("name", "title", "description", "inputSchema", "outputSchema", "annotations")


def surface_digests(tools: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """sha256 over the canonical JSON array of a listing's tools, sorted by name.

    tools: keys, name (unique), definition (JSON text).
    """
    fields = F.map_filter(F.try_variant_get(F.try_parse_json("definition"), "$", "map<string,variant>"),
                          lambda f, _: f.isin(*SURFACE_FIELDS))
    rows = row_number(tools.withColumn("__item", canonical(F.to_json(fields))), keys, ["name"], "__no")
    return ordered_body(rows, keys, "__no", "__item", "__body").select(
        *keys, F.sha2(F.concat(F.lit("["), F.col("__body"), F.lit("]")), 256).alias("digest"))


# --- leak scan ---------------------------------------------------------------------------


def leak_phrases(answer_key: Column) -> Column:
    return F.filter(answer_leaves(answer_key), lambda p: F.length(text.squash(p)) >= MIN_PHRASE)


def own_leak(prompt: Column, params: Column, phrases: Column) -> Column:
    """First phrase readable in the task's own prompt, else in a parameter: struct(phrase, source)."""
    def hits(body: Column) -> Column:
        return F.filter(phrases, lambda p: text.contains_phrase(body, p, MIN_PHRASE))

    in_params = F.flatten(F.transform(F.map_values(params), hits))
    no = F.lit(None).cast("struct<phrase:string,source:string>")
    return (F.when(F.size(hits(prompt)) > 0, F.struct(F.get(hits(prompt), F.lit(0)).alias("phrase"),
                                                      F.lit("prompt").alias("source")))
            .when(F.size(in_params) > 0, F.struct(F.get(in_params, F.lit(0)).alias("phrase"),
                                                  F.lit("params").alias("source"))).otherwise(no))


def context_leaks(phrases: DataFrame, context: DataFrame, on: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """The first phrase of each task that the shared context gives away.

    phrases: on, ids, rank, phrase. context: on, text_no, text. First by text,
    then by phrase. Keys of six squashed characters or more match by squashed
    containment; shorter ones are below the context floor.
    """
    keyed = phrases.withColumn("__key", text.squash(F.col("phrase"))).where(
        F.length("__key") >= MIN_CONTEXT_PHRASE)
    squashed = context.withColumn("__text", text.squash(F.col("text")))
    hits = phrase_hits(keyed, squashed, [*ids, "rank"], ["text_no"], "__key", "__text", MIN_CONTEXT_PHRASE, on)
    first = hits.groupBy(*on, *ids).agg(F.min(F.struct("text_no", "rank")).alias("h"))
    found = first.select(*on, *ids, F.col("h.rank").alias("rank"))
    return found.join(phrases.select(*on, *ids, "rank", "phrase"), [*on, *ids, "rank"]).select(
        *on, *ids, F.col("phrase").alias("context_phrase"))


def corpus_leaks(phrases: DataFrame, corpus: DataFrame, phrase_ids: Sequence[str], text_ids: Sequence[str],
                 floor: int = MIN_PHRASE) -> DataFrame:
    """Every (phrase, text) pair where the text gives the phrase away.

    phrases: ids, phrase. corpus: ids, text. Keys of LONG_PHRASE squashed characters or more go through squashed grams,
    shorter ones, from ``floor`` up, through whole words.
    """
    keys = phrases.withColumn("__key", text.squash(F.col("phrase"))).withColumn(
        "__words", text.collapse(F.col("phrase"))).where(F.length("__key") >= floor)
    long_ = phrase_hits(keys.where(F.length("__key") >= text.LONG_PHRASE), corpus.withColumn("__text", text.squash(F.col("text"))),
                        phrase_ids, text_ids, "__key", "__text", text.LONG_PHRASE)
    short = word_hits(keys.where(F.length("__key") < text.LONG_PHRASE), corpus.withColumn("__text", text.collapse(F.col("text"))),
                      phrase_ids, text_ids, "__words", "__text")
    return long_.unionByName(short)


# --- handle chains -------------------------------------------------------------------------

# Verbs that open the name of a tool that makes something.
PRODUCER_VERBS = ("create", "new", "add", "insert", "register", "open", "start", "begin", "make", "upload",
                  "import", "submit", "provision")
# Last words of a parameter that takes a handle.
HANDLE_WORDS = ("id", "ids", "handle", "uuid", "ref", "key", "token")
# Parameters that look like handles and are not.
NOT_HANDLES = (
    "api_key", "apikey", "auth_token", "access_token", "bearer_token", "secret_key", "session_token",
    "next_token", "page_token", "continuation_token", "pagination_token", "cursor", "next_cursor",
    "page_cursor", "request_id", "trace_id", "correlation_id", "idempotency_key", "sort_key", "partition_key")
RETURNS_HANDLE = r"returns?[^.]{0,40}\b(id|handle|identifier|token)\b"  # fixed value


def snake(name: Column) -> Column:
    spaced = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(spaced, "[^a-z0-9]+", "_")


def _words(name: Column) -> Column:
    return F.filter(F.split(snake(name), "_"), lambda w: w != "")


def is_handle(param: Column) -> Column:
    words = _words(param)
    last = F.try_element_at(words, F.lit(-1))
    return ~snake(param).isin(*NOT_HANDLES) & F.coalesce(last.isin(*HANDLE_WORDS), F.lit(False))


def entity(param: Column) -> Column:
    words = _words(param)
    return F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), "_")).otherwise("")


def is_producer(name: Column, description: Column) -> Column:
    head = F.regexp_extract(F.lower(name), "[a-z0-9]+", 0)
    return head.isin(*PRODUCER_VERBS) | F.coalesce(
        F.regexp_like(F.lower(description), F.lit(RETURNS_HANDLE)), F.lit(False))


def name_matches(wanted: DataFrame, names: DataFrame, on: Sequence[str], want_ids: Sequence[str],
                 entity_col: str, name_ids: Sequence[str], name_col: str) -> DataFrame:
    """(on, want_ids, name_ids) where a name contains the entity; entities of any length."""
    return phrase_hits(wanted, names, want_ids, name_ids, entity_col, name_col, 1, on)


def handle_chains(tools: DataFrame) -> DataFrame:
    """Edges producer -> consumer: a handle parameter whose entity names exactly one producer.

    tools: run_id, name, description, input_schema (JSON text).
    """
    schema = F.try_parse_json("input_schema")
    needed = F.transform(F.coalesce(typed.items(schema, "$.required"), F.array().cast("array<variant>")),
                         lambda r: typed.raw_text(r))
    params = F.map_keys(F.try_variant_get(typed.obj(schema, "$.properties"), "$", "map<string,variant>"))
    wanted = tools.select(
        "run_id", F.col("name").alias("consumer"), needed.alias("needed"), F.explode(params).alias("param")
    ).where(is_handle(F.col("param"))).select(
        "run_id", "consumer", "param", F.array_contains("needed", F.col("param")).alias("required"),
        entity(F.col("param")).alias("entity")).where("entity <> ''")
    producers = tools.where(is_producer(F.col("name"), F.col("description"))).select(
        "run_id", F.col("name").alias("producer"), F.lower("name").alias("lowered"))
    hits = name_matches(wanted, producers, ["run_id"], ["consumer", "param", "required"], "entity",
                        ["producer"], "lowered").where("producer <> consumer")
    keys = ["run_id", "consumer", "param", "required"]
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("producer").alias("producer")).where(
        "n = 1").drop("n")


def chain_tools(candidates: DataFrame, chains: DataFrame) -> DataFrame:
    """Put the producer of every required handle in front of the expected tools.

    candidates: run_id, position, expected_tools. Adds chained_tools and
    unchained (a required handle that more than one tool could produce).
    """
    keys = ["run_id", "position"]
    makers = chains.groupBy("run_id", F.col("consumer").alias("tool"), "param").agg(
        F.bool_or("required").alias("required"), F.min("producer").alias("producer"),
        (F.min("producer") != F.max("producer")).alias("ambiguous"))
    required = makers.where("required")
    spread = candidates.select(*keys, "expected_tools", F.posexplode("expected_tools").alias("i", "tool"))
    missing = spread.join(required, ["run_id", "tool"]).where(
        ~F.array_contains("expected_tools", F.col("producer")))
    per = missing.groupBy(*keys, "producer").agg(F.min(F.struct("i", "param")).alias("at"))
    front = per.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "producer")), asc=False), lambda e: e["producer"]).alias("front"))
    loose = missing.where("ambiguous").select(*keys, F.lit(True).alias("__loose")).distinct()
    out = candidates.join(front, keys, "left").join(loose, keys, "left")
    return out.withColumn("chained_tools", F.concat(
        F.coalesce("front", F.array().cast("array<string>")), "expected_tools")).withColumn(
        "unchained", F.coalesce("__loose", F.lit(False))).drop("front", "__loose")


# --- the task rules -------------------------------------------------------------------------


def check_reason(check: Column, prompt: Column, error_path: Column, tool_known: Column, verdict: Column,
                 java: Column) -> Column:
    """Why a check is refused, apart from the one-judge-per-suite rule; NULL when it is fine.

    check: variant. verdict: result of ``validated`` on its pattern.
    """
    kind = typed.text(check, "$.kind")
    value, pattern = typed.text(check, "$.value"), typed.text(check, "$.pattern")
    where_ok = F.coalesce(typed.text(check, "$.where") == "final_text", F.lit(False))
    rubric = typed.text(check, "$.rubric")
    invalid, loose, prompted = F.lit("invalid-check"), F.lit("check-too-permissive"), F.lit("check-matches-prompt")
    short_run = longest_literal_run(java) < MIN_LITERAL_RUN
    any_case = F.concat(F.lit("(?i)"), java)
    substring = (F.when(~where_ok | value.isNull(), invalid)
                 .when(F.length(F.trim(value)) < MIN_SUBSTRING, loose)
                 .when(text.contains_phrase(prompt, value, 1), prompted))
    regex = (F.when(~where_ok | pattern.isNull() | ~verdict, invalid).when(short_run, loose)
             .when(F.when(verdict, F.regexp_like(prompt, any_case)), prompted))
    called = F.when(~tool_known, invalid).when(~error_path, loose)
    matches = F.when(~tool_known | pattern.isNull() | ~verdict, invalid).when(short_run, loose)
    judge = F.when(rubric.isNull() | (F.trim(rubric) == ""), invalid)
    return (F.when(kind == "substring", substring).when(kind == "regex", regex)
            .when(kind == "tool_called", called).when(kind == "tool_result_matches", matches)
            .when(kind == "judge", judge).otherwise(invalid))


TOOLS = "array<struct<name:string,risky:boolean>>"
CHAINS = "array<struct<tool:string,param:string,required:boolean,producers:array<string>>>"
CONTEXT = "array<struct<text_no:bigint,squashed:string>>"
REPAIR = "array<struct<rule:string,place:string,before:string,after:string>>"


def surfaces(tools: DataFrame, context: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """One row per run of what its candidates are checked against: tools, handle chains and context texts.

    A run's row holds one published listing and the texts shown beside it, which were one document each before. tools: run_id, name,
    description, read_only, destructive_hint, input_schema (JSON text); a name listed twice counts once. context: run_id, text_no, text.
    chains: edges as ``handle_chains`` gives them; without them they are read from the listing.
    """
    schema = F.try_parse_json("input_schema")
    needed = F.transform(F.coalesce(typed.items(schema, "$.required"), F.array().cast("array<variant>")), lambda r: typed.raw_text(r))
    params = F.map_keys(F.try_variant_get(typed.obj(schema, "$.properties"), "$", "map<string,variant>"))
    wanted = F.filter(
        F.transform(F.filter("params", is_handle), lambda p: F.struct(
            p.alias("param"), F.array_contains("needed", p).alias("required"), entity(p).alias("entity"))),
        lambda w: w["entity"] != "")
    listed = tools.where(F.col("name").isNotNull()).select(
        "run_id", "name", is_destructive(F.col("read_only"), F.col("destructive_hint")).alias("risky"),
        is_producer(F.col("name"), F.col("description")).alias("makes"), needed.alias("needed"), params.alias("params"))
    listed = listed.withColumn("wanted", F.coalesce(wanted, F.array()))
    once = listed.groupBy("run_id", "name").agg(
        F.bool_or("risky").alias("risky"), F.bool_or("makes").alias("makes"), F.flatten(F.collect_list("wanted")).alias("wanted"))
    tool = once.schema
    kind = "struct<name:string,risky:boolean,makes:boolean,wanted:array<struct<param:string,required:boolean,entity:string>>>"
    edge = "struct<tool:string,param:string,required:boolean,producers:array<string>>"
    said = "struct<text_no:bigint,squashed:string>"

    def part(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select("run_id", *[(value if n == name else F.lit(None)).cast(t).alias(n)
                                     for n, t in (("tool", kind), ("edge", edge), ("said", said))])

    rows = part(once, "tool", F.struct(*[c for c in tool.names if c != "run_id"])).unionByName(
        part(context, "said", F.struct(F.col("text_no").cast("long"), text.squash(F.col("text")))))
    if chains is not None:
        each = chains.groupBy("run_id", "consumer", "param").agg(
            F.bool_or("required").alias("required"), F.array_sort(F.collect_set("producer")).alias("producers"))
        rows = rows.unionByName(part(each, "edge", F.struct("consumer", "param", "required", "producers")))
    per = rows.groupBy("run_id").agg(*[F.array_sort(F.collect_list(c)).alias(f"{c}s") for c in ("tool", "edge", "said")])

    def edges(consumer: Column) -> Column:
        found = F.transform(consumer["wanted"], lambda w: F.struct(
            consumer["name"].alias("tool"), w["param"].alias("param"), w["required"].alias("required"),
            F.transform(F.filter("tools", lambda t: t["makes"] & (t["name"] != consumer["name"]) & F.contains(F.lower(t["name"]), w["entity"])),
                        lambda t: t["name"]).alias("producers")))
        return F.filter(found, lambda e: F.size(e["producers"]) == 1)

    own = F.col("edges") if chains is not None else F.flatten(F.transform("tools", edges))
    return per.select("run_id", F.transform("tools", lambda t: F.struct(t["name"], t["risky"])).cast(TOOLS).alias("surface"),
                      F.array_sort(own.cast(CHAINS)).alias("chains"), F.col("saids").cast(CONTEXT).alias("context"))


def surface_edges(surface: DataFrame) -> DataFrame:
    """The handle chains of ``surfaces`` as edges: run_id, consumer, param, required, producer."""
    rows = surface.select("run_id", F.explode("chains").alias("c"))
    return rows.select("run_id", F.col("c.tool").alias("consumer"), "c.param", "c.required", F.explode("c.producers").alias("producer"))


def chained(expected: Column, chains: Column) -> Column:
    """Expected tools with the producers of their required handles in front: struct(tools, repairs, unchained).

    Tools are taken in order and a tool's parameters by name. A handle whose producer is there needs nothing; one that a single tool makes gets
    that tool put in front; one that several could make stops the pass, and names its tool and parameter.
    """
    needs = F.flatten(F.transform(expected, lambda tool: F.filter(chains, lambda c: (c["tool"] == tool) & c["required"])))
    start = F.struct(expected.alias("tools"), F.array().cast(REPAIR).alias("repairs"), F.lit(None).cast("string").alias("unchained"))

    def step(acc: Column, need: Column) -> Column:
        there = F.forall(need["producers"], lambda p: F.array_contains(acc["tools"], p))
        maker = F.get(need["producers"], F.lit(0))
        place = F.concat_ws(".", need["tool"], need["param"])
        repair = F.struct(F.lit("handle-chain").alias("rule"), place.alias("place"),
                          F.lit(None).cast("string").alias("before"), maker.alias("after"))
        return (F.when(acc["unchained"].isNotNull() | there, acc)
                .when(F.size(need["producers"]) > 1, F.struct(acc["tools"], acc["repairs"], place.alias("unchained")))
                .otherwise(F.struct(F.concat(F.array(maker), acc["tools"]).alias("tools"),
                                    F.concat(acc["repairs"], F.array(repair)).alias("repairs"), acc["unchained"])))

    return F.aggregate(needs, start, step)


def first_leak(prompt: Column, params: Column, context: Column, phrases: Column) -> Column:
    """The first phrase that is given away: struct(phrase, source). First by place (prompt, parameters, context texts), then by phrase.

    phrases: array of struct(phrase, key, words); params: array of struct(name, value); context: array of squashed texts.
    """
    def inside(body: Column) -> Column:
        both = F.struct(text.squash(body).alias("squashed"), text.collapse(body).alias("words"))
        return typed.let(both, lambda b: F.filter(phrases, lambda p: F.when(
            F.length(p["key"]) >= text.LONG_PHRASE, F.contains(b["squashed"], p["key"])).otherwise(text.has_word(b["words"], p["words"]))))

    def first(found: Column, source: str) -> Column:
        return F.when(F.size(found) > 0, F.struct(F.get(found, F.lit(0))["phrase"].alias("phrase"), F.lit(source).alias("source")))

    said = F.flatten(F.transform(context, lambda c: F.filter(
        phrases, lambda p: (F.length(p["key"]) >= MIN_CONTEXT_PHRASE) & F.contains(c["squashed"], p["key"]))))
    return F.coalesce(first(inside(prompt), "prompt"), first(F.flatten(F.transform(params, lambda p: inside(p["value"]))), "params"),
                      first(said, "context"))


def screen(raw: DataFrame, tools: DataFrame, context: DataFrame, chains: DataFrame | None = None,
           exclude_destructive: bool = False) -> DataFrame:
    """The rules that look at one candidate alone, in one pass: ``before`` and ``after`` the judge count, with what they changed and saw.

    raw: run_id, position, task (variant), and if it is there source, the task's JSON text as written, which decides the order of
    parameters and answer leaves. tools, context, chains: see ``surfaces``. ``before`` is the first failing rule up to the check policy, ``after``
    the first one behind it. Every candidate meets its run's surface once; all rules are expressions over that row. ``repairs`` lists
    what was mended before the check rule, ``late_repairs`` behind it; ``evidence`` what a refused candidate is refused on.
    """
    t = F.col("task")
    listed = F.filter(F.transform(F.coalesce(typed.items(t, "$.expectedTools"), F.array().cast("array<variant>")),
                                  lambda e: typed.raw_text(e)), lambda e: e.isNotNull())
    template = F.coalesce(typed.text(t, "$.promptTemplate"), typed.raw_text(t, "$.prompt"), F.lit(""))
    source = F.col("source") if "source" in raw.columns else F.to_json("task")
    check = typed.at(t, "$.check")
    rows = raw.select(
        "run_id", "position", text.task_slug(typed.raw_text(t, "$.id"), F.col("position")).alias("task_id"),
        template.alias("template"), listed.alias("listed"), F.array_distinct(listed).alias("expected_tools"),
        typed.text(t, "$.serverRequiredBecause").alias("requirement"), check.alias("check"),
        typed.raw_text(t, "$.check.tool").alias("check_tool"),
        F.coalesce(typed.flag(t, "$.errorPath"), F.lit(False)).alias("error_path"),
        F.coalesce(typed.flag(t, "$.destructive"), F.lit(False)).alias("flagged"),
        F.when(typed.present(t, "$.answerKey"), F.to_json(typed.at(t, "$.answerKey"))).alias("answer_key"),
        documents.task_source(source).alias("read"),
        validated(F.coalesce(typed.text(t, "$.check.pattern"), F.lit(""))).alias("pattern"))
    params = F.map_from_entries(F.transform(F.coalesce("read.params", F.array().cast("array<struct<name:string,value:string>>")),
                                            lambda p: F.struct(p["name"], p["value"])))
    phrases = F.filter(F.transform(F.coalesce("read.leaves", F.array().cast("array<string>")), lambda p: F.struct(
        p.alias("phrase"), text.squash(p).alias("key"), text.collapse(p).alias("words"))), lambda p: F.length(p["key"]) >= MIN_PHRASE)
    rows = rows.withColumn("prompt", F.trim(text.render_prompt(F.col("template"), params))).withColumn("phrases", phrases)
    rows = written(rows, "candidates")  # parsed and rendered only here

    rows = rows.join(shipped(surfaces(tools, context, chains)), "run_id", "left")
    names = F.transform(F.coalesce("surface", F.array().cast(TOOLS)), lambda s: s["name"])
    rows = rows.withColumn("unknown", F.array_except("expected_tools", names)).withColumn(
        "tool_known", F.coalesce(F.array_contains(names, F.col("check_tool")), F.lit(False))).withColumn(
        "leak", first_leak(F.col("prompt"), F.coalesce("read.params", F.array()), F.coalesce("context", F.array().cast(CONTEXT)),
                           F.col("phrases"))).withColumn(
        "chained", chained(F.col("expected_tools"), F.coalesce("chains", F.array().cast(CHAINS))))
    # a tool that the surface lacks counts as destructive
    safe = F.transform(F.filter(F.coalesce("surface", F.array().cast(TOOLS)), lambda s: ~s["risky"]), lambda s: s["name"])
    rows = rows.withColumn("destructive", (F.size(F.array_except(F.col("chained.tools"), safe)) > 0) | F.col("flagged"))
    refused = check_reason(F.col("check"), F.col("prompt"), F.col("error_path"), F.col("tool_known"),
                           F.coalesce("pattern.ok", F.lit(False)), F.coalesce("pattern.java_pattern", F.lit("")))
    before = (
        F.when(F.col("prompt") == "", "malformed")
        .when(F.size("expected_tools") == 0, "no-expected-tools")
        .when(F.size("unknown") > 0, "unknown-tool")
        .when(~F.coalesce(F.col("requirement").isin(*SERVER_REQUIREMENTS), F.lit(False)), "no-server-requirement")
        .when(F.col("leak.source") == "prompt", "answer-leak")
        .when(F.col("leak").isNotNull(), "context-answer-leak")
        .otherwise(refused))
    rows = rows.withColumn("before", before).withColumn("after", F.when(F.col("chained.unchained").isNotNull(), "unchained-handle").when(
        F.col("destructive") & F.lit(exclude_destructive), "destructive-excluded"))

    none = F.lit(None).cast("string")
    lost = F.size("listed") - F.size("expected_tools")
    twice = F.filter("expected_tools", lambda e: F.size(F.filter("listed", lambda x: x == e)) > 1)
    deduped = F.struct(F.lit("expected-tools-dedupe").alias("rule"), F.array_join(twice, ", ").alias("place"),
                       F.size("listed").cast("string").alias("before"), F.size("expected_tools").cast("string").alias("after"))
    kind = typed.text("check", "$.kind")
    translated = F.struct(F.lit("check-pattern-dialect").alias("rule"), F.array_join("pattern.foreign", ", ").alias("place"),
                          typed.text("check", "$.pattern").alias("before"), F.col("pattern.repaired").alias("after"))
    foreign = kind.isin("regex", "tool_result_matches") & (F.size("pattern.foreign") > 0)
    empty = F.array().cast(REPAIR)
    repairs = F.when((F.col("prompt") != "") & (lost > 0), F.array(deduped)).otherwise(empty)
    late = F.concat(F.when(F.coalesce(foreign, F.lit(False)), F.array(translated)).otherwise(empty), F.col("chained.repairs"))

    unknown = F.coalesce(F.col("before") == "unknown-tool", F.lit(False))
    leaked = F.coalesce(F.col("before").isin("answer-leak", "context-answer-leak"), F.lit(False))
    by_check = refused.isNotNull() & F.coalesce(F.col("before") == refused, F.lit(False)) & ~leaked
    evidence = F.struct(
        F.when(leaked, F.col("leak.phrase")).alias("phrase"), F.when(leaked, F.col("leak.source")).alias("source"),
        F.when(unknown, F.col("expected_tools")).alias("expected_tools"), F.when(unknown, F.col("unknown")).alias("unknown_tools"),
        F.when(by_check, F.coalesce(typed.raw_text("check", "$.kind"), F.lit("none"))).alias("check_kind"),
        *[F.when(by_check, typed.raw_text("check", f"$.{c}")).alias(f"check_{c}") for c in ("pattern", "value", "tool")],
        F.when(by_check & (F.size("pattern.foreign") > 0), F.col("pattern.repaired")).alias("check_pattern_repaired"),
        F.when(F.col("before").isNull() & (F.col("after") == "unchained-handle"), F.col("chained.unchained")).alias("unchained"),
        F.when(unknown | leaked | by_check | (F.col("before") == "no-server-requirement"), F.substring("prompt", 1, EXCERPT)).alias("prompt_excerpt"))
    return rows.select(
        "run_id", "position", "task_id", "prompt", "expected_tools", F.col("chained.tools").alias("chained_tools"), lost.alias("deduped"),
        "check", "answer_key", "destructive", F.col("leak.phrase").alias("leak_phrase"),
        F.coalesce(kind == "judge", F.lit(False)).alias("is_judge"), "before", "after",
        repairs.cast(REPAIR).alias("repairs"), late.cast(REPAIR).alias("late_repairs"), evidence.alias("evidence"), none.alias("__none")).drop("__none")


def repair_rows(admitted: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, position, task_id, repair_no, rule, place, before, after: what was mended, as far as each candidate got.

    admitted: what ``admit`` returns for screened candidates. A repeated id and an empty prompt end a candidate before any repair, a check
    that is refused before those behind it.
    """
    behind = F.col("before").isNull() & ~F.coalesce(F.col("reason") == "check-too-permissive", F.lit(False))
    made = F.when(F.coalesce(F.col("reason") == "duplicate-id", F.lit(False)), F.array().cast(REPAIR)).when(
        behind, F.concat("repairs", "late_repairs")).otherwise(F.col("repairs"))
    rows = admitted.select(*keys, "position", "task_id", F.posexplode(made).alias("repair_no", "r"))
    return rows.select(*keys, "position", "task_id", "repair_no", "r.*")


def drop_rows(admitted: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, position, task_id, reason and the evidence of every candidate that was dropped; a repeated id is dropped before it is looked at."""
    second_judge = F.col("before").isNull() & (F.col("reason") == "check-too-permissive")
    excerpt = F.substring("prompt", 1, EXCERPT)
    seen = F.when(second_judge, F.col("evidence").withField("check_kind", F.lit("judge")).withField("prompt_excerpt", excerpt)).otherwise(
        F.col("evidence"))
    own = F.when(F.coalesce(F.col("reason") != "duplicate-id", F.lit(False)), seen)
    rows = admitted.where(F.col("reason").isNotNull()).select(*keys, "position", "task_id", "reason", own.alias("e"))
    return rows.select(*keys, "position", "task_id", "reason", "e.*")


def admit(screened: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Admission in file order, as aggregates. Adds ``reason`` (NULL: admitted).

    An id belongs to its first *admitted* task, and one judge check is allowed
    per suite, so both rules depend on what was admitted before. Of the judge
    candidates that reach their check, the first whose id is still free takes
    the suite's place; with that settled, the admitted row of an id is its first
    clean one, and every later row with the id is a duplicate.
    """
    screened = written(screened, "screened")
    k = list(keys)
    clean = F.col("before").isNull() & F.col("after").isNull()
    plain = screened.where(clean & ~F.col("is_judge")).groupBy(*k, "task_id").agg(F.min("position").alias("first"))
    judges = screened.where(F.col("is_judge") & F.col("before").isNull()).select(
        *k, "task_id", "position", clean.alias("clean"))
    free = equi_join(judges, plain, [*k, "task_id"], "left", nulls=False).where(
        F.col("first").isNull() | (F.col("position") < F.col("first")))
    seat = free.groupBy(*k).agg(
        F.min("position").alias("__seat"), F.min_by(F.struct("task_id", "clean"), "position").alias("s"))
    seated_clean = seat.where("s.clean").select(*k, F.col("s.task_id").alias("task_id"), F.col("__seat").alias("first"))
    owner = plain.unionByName(seated_clean).groupBy(*k, "task_id").agg(F.min("first").alias("__owner"))
    rows = equi_join(screened, owner, [*k, "task_id"], "left", nulls=False)
    rows = equi_join(rows, seat.drop("s"), k, "left", nulls=False)
    duplicate = F.coalesce(F.col("__owner") < F.col("position"), F.lit(False))
    seated = F.coalesce(F.col("position") == F.col("__seat"), F.lit(False))
    reason = (F.when(duplicate, "duplicate-id").when(F.col("before").isNotNull(), F.col("before"))
              .when(F.col("is_judge") & ~seated, "check-too-permissive").otherwise(F.col("after")))
    return rows.withColumn("reason", reason).drop("__seat", "__owner")


def screenable(kind: Column, has_judge: Column) -> Column:
    """Kinds a model with no tools can be graded on."""
    return kind.isin("substring", "regex") | ((kind == "judge") & has_judge)


def null_screen(admitted: DataFrame, cold: DataFrame, keys: Sequence[str] = ("run_id", "task_id")) -> DataFrame:
    """Drop tasks a model without the server passed; a failed probe keeps its task.

    cold: keys, cold_passed (NULL: not gradable), error.
    """
    out = admitted.join(cold.select(*keys, "cold_passed"), list(keys), "left")
    passed = F.coalesce("cold_passed", F.lit(False)) & F.col("reason").isNull()
    return out.withColumn("reason", F.when(passed, "null_screen").otherwise(F.col("reason"))).drop("cold_passed")


def screen_summary(cold: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Screened (without failed probes), dropped, errors and tokens per suite."""
    failed = F.col("error").isNotNull()
    return cold.groupBy(*keys).agg(
        F.count_if(~failed).alias("screened"), F.count_if(~failed & F.col("cold_passed")).alias("dropped"),
        F.count_if(failed).alias("errors"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))


def trim(rows: DataFrame, target: int = SUITE_TASKS, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mark kept tasks beyond the target as trimmed (surplus, not a drop)."""
    kept = rows.withColumn("__kept", F.col("reason").isNull())
    placed = row_number(kept, [*keys, "__kept"], ["position"], "__no")
    number = F.when(F.col("__kept"), F.col("__no"))
    return placed.withColumn("suite_no", number).withColumn(
        "trimmed", F.coalesce(number > target, F.lit(False))).drop("__kept", "__no")


def drop_ledger(rows: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Candidates per rule."""
    return rows.where(F.col(reason).isNotNull()).groupBy(*keys, F.col(reason).alias("rule")).agg(
        F.count(F.lit(1)).alias("dropped"))


def by_dropped(ledger: DataFrame) -> DataFrame:
    """Reading order of drop rules: most drops first, then the rule."""
    return ledger.orderBy(F.desc("dropped"), "rule")


def reconcile(rows: DataFrame, keys: Sequence[str], reason: str, trimmed: str) -> DataFrame:
    """candidates = admitted + dropped + trimmed, with the screen's deletions apart."""
    dropped = F.col(reason).isNotNull()
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~dropped & ~F.col(trimmed)).alias("admitted"),
        F.count_if(~dropped & F.col(trimmed)).alias("trimmed"),
        F.count_if(F.coalesce(F.col(reason) == "null_screen", F.lit(False))).alias("screen_deleted"),
        F.count_if(dropped).alias("dropped"))
    short = F.col("candidates") - F.col("admitted") - F.col("dropped") - F.col("trimmed")
    rejected = F.col("candidates") - F.col("admitted") - F.col("trimmed") - F.col("screen_deleted")
    return (out.withColumn("rejected", F.greatest(F.lit(0).cast("long"), rejected))
            .withColumn("shortfall", short).withColumn("reconciles", short == 0))


def rewrites(candidates: DataFrame, replies: DataFrame, offenders: DataFrame,
             keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Pair each offender with its rewrite: by id, else by place if the counts agree.

    candidates: keys, position, task_id, task. replies: keys, position, task_id,
    task. offenders: keys, position. Adds matched_by and the replaced task.
    """
    k = list(keys)
    by_id = replies.groupBy(*k, "task_id").agg(F.max_by("task", "position").alias("__by_id"))
    placed = row_number(offenders, k, ["position"], "__no")
    counts = equi_join(offenders.groupBy(*k).agg(F.count(F.lit(1)).alias("__have")),
                       replies.groupBy(*k).agg(F.count(F.lit(1)).alias("__got")), k, "left")
    numbered = replies.select(*k, (F.col("position") + 1).alias("__no"), F.col("task").alias("__by_place"))
    mark = equi_join(equi_join(placed, numbered, [*k, "__no"], "left"), counts, k, "left")
    mark = mark.select(*k, "position", F.lit(True).alias("__offender"),
                       F.when(F.col("__have") == F.col("__got"), F.col("__by_place")).alias("__by_place"))
    rows = equi_join(equi_join(candidates, mark, [*k, "position"], "left"), by_id, [*k, "task_id"], "left")
    use_id = F.col("__offender") & F.col("__by_id").isNotNull()
    use_place = F.col("__offender") & F.col("__by_place").isNotNull()
    return rows.withColumn("matched_by", F.when(use_id, "id").when(use_place, "position")).withColumn(
        "task", F.when(use_id, F.col("__by_id")).when(use_place, F.col("__by_place")).otherwise(F.col("task"))
    ).drop("__by_id", "__by_place", "__offender")


def extension_seed(base: Column, index: Column) -> Column:
    return base + 1000 * index


def screen_batches(batch: DataFrame, pool: DataFrame | None, batch_keys: Sequence[str], order: str,
                   key: str, leak: Column, violated: Column, invalid: Column) -> DataFrame:
    """Free gates over extension batches. Adds ``fate`` and ``void``.

    A leak or a broken property voids the whole batch; an invalid or repeated
    task is dropped alone. Content must be new to the pool and, among the
    otherwise good tasks of the batch, the first of its kind.
    """
    stage = F.when(leak, "answer_leak").when(violated, "property").when(invalid, "admission")
    rows = written(batch.withColumn("__stage", stage), "batches")
    if pool is not None:
        old = pool.select(key).distinct().withColumn("__old", F.lit(True))
        rows = equi_join(rows, old, [key], "left")
    else:
        rows = rows.withColumn("__old", F.lit(None).cast("boolean"))
    fresh = F.col("__stage").isNull() & F.col("__old").isNull()
    first = rows.where(fresh).groupBy(*batch_keys, key).agg(F.min(order).alias("__first"))
    flags = rows.groupBy(*batch_keys).agg(
        F.bool_or(F.coalesce(F.col("__stage").isin("answer_leak", "property"), F.lit(False))).alias("void"))
    rows = equi_join(equi_join(rows, first, [*batch_keys, key], "left"), flags, batch_keys, "left")
    repeated = F.col("__old").isNotNull() | F.coalesce(F.col("__first") < F.col(order), F.lit(False))
    fate = F.coalesce("__stage", F.when(repeated, "duplicate"),
                      F.when(F.col("void"), "voided"), F.lit("admitted"))
    return rows.withColumn("fate", fate).drop("__stage", "__old", "__first")
