"""String, URL and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelake.functions import typed

MODERN_REVISION = "2026-07-28"  # fixed value: first revision of the modern era
PHASES = "::"


def collapse(c: Column) -> Column:
    """Whitespace runs to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def squash(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def quoted(c: Column) -> Column:
    """A Java pattern that matches ``c`` literally."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def has_word(text: Column, phrase: Column) -> Column:
    """``phrase`` in ``text`` with no letter or digit touching either end (both collapsed)."""
    pattern = F.concat(F.lit("(^|[^a-z0-9])"), quoted(phrase), F.lit("($|[^a-z0-9])"))
    return (F.length(phrase) > 0) & F.regexp_like(text, pattern)


# Squashed length from which a phrase is matched by squashed containment.
LONG_PHRASE = 6


def contains_phrase(text: Column, phrase: Column, floor: int) -> Column:
    """Containment that ignores spacing and punctuation; short phrases need word edges."""
    key = squash(phrase)
    return (F.when(F.length(key) < floor, F.lit(False))
            .when(F.length(key) >= LONG_PHRASE, F.contains(squash(text), key))
            .otherwise(has_word(collapse(text), collapse(phrase))))


def task_of(corr: Column) -> Column:
    return F.split_part(corr, F.lit(PHASES), F.lit(1))


def phase_of(corr: Column) -> Column:
    return F.nullif(F.split_part(corr, F.lit(PHASES), F.lit(2)), F.lit(""))


def is_modern(revision: Column) -> Column:
    return F.regexp_like(revision, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & (revision >= MODERN_REVISION)


def strip_credentials(url: Column) -> Column:
    """Drop user info, query and fragment; text that is not a URL stays as it is."""
    parsed = F.try_parse_url(url, F.lit("HOST"))
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return F.when(parsed.isNull(), url).otherwise(bare)


def url_slug(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    slug = F.regexp_replace(F.regexp_replace(host, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def percent_encode(c: Column) -> Column:
    """encodeURIComponent's alphabet."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def safe_url(url: Column) -> Column:
    ok = url.startswith("https://") & F.try_parse_url(url, F.lit("HOST")).isNotNull()
    return F.when(ok, url)


def trace_param(mcp: Column, agent: Column) -> Column:
    """Both planes' links, percent-encoded and joined; NULL when neither is usable."""
    links = F.array_compact(F.array(*[
        F.when(~F.contains(safe_url(u), F.lit(";")), percent_encode(safe_url(u))) for u in (mcp, agent)]))
    return F.when(F.size(links) > 0, F.array_join(links, ";"))


def viewer_url(base: str, mcp: Column, agent: Column) -> Column:
    return F.concat(F.lit(base + "?trace="), trace_param(mcp, agent), F.lit("#view=calls"))


def focus_url(base: Column, mcp: Column, agent: Column, corr: Column, known: Column) -> Column:
    """A link onto one correlation id; only for ids the record itself carries."""
    link = F.concat(base, F.lit("?trace="), trace_param(mcp, agent),
                    F.lit("#view=events&corr="), percent_encode(corr))
    return F.when((F.length(corr) > 0) & F.array_contains(known, corr), link)


def record_id(run_id: Column, slug: Column, suite_prefix: Column) -> Column:
    base = F.coalesce(F.nullif(run_id, F.lit("")),
                      F.concat_ws("-", slug, F.coalesce(suite_prefix, F.lit("no-suite"))))
    safe = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("run"))


def task_slug(raw: Column, position: Column) -> Column:
    """Task id from free text; a blank one is named by its 0-based position."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("task-"), (position + 1).cast("string")))


PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"


def placeholders(prompt: Column) -> Column:
    return F.regexp_extract_all(prompt, F.lit(PLACEHOLDER), F.lit(1))


def render_prompt(template: Column, params: Column) -> Column:
    """Fill placeholders from a string map in one pass; unknown ones stay."""
    spans = F.regexp_extract_all(template, F.lit(r"(?s)(.*?)(\{\{\s*[A-Za-z0-9_.-]+\s*\}\}|$)"), F.lit(0))

    def fill(piece: Column) -> Column:
        key = F.regexp_extract(piece, PLACEHOLDER, 1)
        head = F.regexp_replace(piece, PLACEHOLDER + "$", "")
        value = F.try_element_at(params, key)
        return F.when((key != "") & value.isNotNull(), F.concat(head, value)).otherwise(piece)

    return F.array_join(F.transform(spans, fill), "")


def snippet(body: Column, limit: int = 400) -> Column:
    """The head of a body, with the number of characters left out."""
    rest = F.length(body) - limit
    return F.when(rest > 0, F.concat(F.substring(body, 1, limit), F.lit("... ["), rest.cast("string"),
                                     F.lit(" more characters]"))).otherwise(body)


def is_schema_reject(message: Column) -> Column:
    return (F.regexp_like(message, F.lit("(?i)output ?schema|structured ?content"))
            & F.regexp_like(message, F.lit("(?i)match|valid|invalid|reject")))


def is_http_failure(status: Column) -> Column:
    return F.when(status.isNotNull(), (status < 200) | (status >= 300))


# --- error and result text of wire frames ----------------------------------


def error_message(err: Column) -> Column:
    """Readable text of a JSON-RPC error value."""
    def read(e: Column) -> Column:
        def coded(parts: Column) -> Column:
            return F.when(parts["code"].isNull(), parts["message"]).otherwise(
                F.concat(parts["message"], F.lit(" (code "), parts["code"], F.lit(")")))

        parts = F.struct(typed.text(e, "$.message").alias("message"),
                         F.try_variant_get(e, "$.code", "string").alias("code"))
        return F.coalesce(typed.raw_text(e), typed.let(parts, coded), F.to_json(e))

    return typed.let(err, read)


def tool_error(raw: Column) -> Column:
    """The reason a successful response reports a failed tool; NULL when it does not."""
    def read(result: Column) -> Column:
        texts = F.filter(F.transform(typed.items(result, "$.content"), lambda b: typed.text(b, "$.text")),
                         lambda t: t.isNotNull())
        joined = F.nullif(F.trim(F.array_join(texts, " ")), F.lit(""))
        return F.when(typed.flag(result, "$.isError"), F.coalesce(joined, F.lit("tool reported an error")))

    return typed.let(typed.at(raw, "$.result"), read)


def input_required(raw: Column) -> Column:
    def read(result: Column) -> Column:
        failed = F.coalesce(typed.flag(result, "$.isError"), F.lit(False))
        return (typed.present(result, "$.input_required")
                | F.coalesce(typed.text(result, "$.status") == "input_required", F.lit(False))
                | (typed.present(result, "$.requestState") & ~failed))

    return F.coalesce(typed.let(typed.at(raw, "$.result"), read), F.lit(False))


def block_text(content: Column) -> Column:
    """Flatten a string or an array of blocks to text, blocks joined by newlines."""
    parts = F.filter(
        F.transform(typed.items(content), lambda b: F.coalesce(typed.text(b), typed.text(b, "$.text"))),
        lambda t: t.isNotNull())
    return (F.when(~typed.present(content), F.lit(""))
            .when(typed.items(content).isNotNull(), F.array_join(parts, "\n"))
            .when(typed.is_object(content), F.to_json(content))
            .otherwise(F.try_variant_get(content, "$", "string")))


def typed_text(content: Column, structured: Column | None = None) -> Column:
    """Join text-typed blocks by newlines; without any, fall back to structured content."""
    parts = F.filter(
        F.transform(typed.items(content),
                    lambda b: F.when(typed.text(b, "$.type") == "text", typed.raw_text(b, "$.text"))),
        lambda t: t.isNotNull())
    joined = F.array_join(parts, "\n")
    if structured is None:
        return F.trim(F.coalesce(joined, F.lit("")))
    fallback = F.when(typed.obj(structured).isNotNull(), F.to_json(structured))
    return F.when(F.size(parts) > 0, joined).otherwise(F.coalesce(fallback, F.lit("")))


# --- numbers as lines --------------------------------------------------------


def verdict_line(k: Column, n: Column, threshold: Column, p_value: Column, alpha: Column) -> Column:
    tiny = F.regexp_replace(F.format_string("%.2e", p_value), r"e([+-])0*(\d)", "e$1$2")
    p_text = F.when(p_value < 0.0001, tiny).otherwise(F.format_string("%.4f", p_value))
    parts = F.array_compact(F.array(
        F.format_string("%d of %d", k.cast("long"), n.cast("long")),
        F.when(threshold.isNotNull(), F.format_string("against a threshold of %.2f", threshold)),
        F.when(p_value.isNotNull(), F.concat(F.lit("p = "), p_text)),
        F.when(alpha.isNotNull(), F.concat(F.lit("alpha = "), alpha.cast("string")))))
    return F.when(k.isNotNull() & n.isNotNull(), F.array_join(parts, ", "))
