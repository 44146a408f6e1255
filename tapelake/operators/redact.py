"""Publish-time redaction of tapes, reports and flat text.

Scoring reads unredacted rows; these functions only make the publish copy. A
tape line is nested JSON, so it goes through one Arrow UDF (map only, no
shuffle). A flat text column stays on the JVM as a chain of replacements.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.operators import containment
from tapelake.session import written

MARK = "[REDACTED]"

# Secret shapes, as written for a regular expression engine with
# lookbehind, each with a text that every match contains (a cheap first look).
VALUE_RULES = (
    (r"\bAKIA[0-9A-Z]{16}\b", "AKIA"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "sk-"),
    (r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "gh"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "github_pat_"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "eyJ"),
    (r"[Aa]uthorization\s*:\s*.+", "uthorization"),
    (r"[Bb]earer\s+[A-Za-z0-9._\-+/=]+", "earer"),
    (r"\b(?:xoxb|xoxa|xoxp|xoxr|xoxs)-[A-Za-z0-9-]{10,}", "xox"),
    (r"\b(?:rk_live|sk_live)_[A-Za-z0-9]{8,}\b", "k_live_"),
    (r"(?<=://[^/\s:@]{1,128}:)[^/\s@]+(?=@)", "://"),
    (r"""[^\s"]{0,256}\.env(?:\.[A-Za-z0-9._\-]+)?\b""", ".env"),
    (r"""[^\s"]{0,256}\bid_(?:rsa|ed25519|ecdsa|dsa)\b[^\s"]{0,256}""", "id_"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "AIza"),
)
VALUE_PATTERNS = tuple(p for p, _ in VALUE_RULES)
HINTS = dict(VALUE_RULES)
# Fields replaced wherever they sit.
SECRET_PATHS = tuple(f"$..{name}" for name in (
    "api_key", "apiKey", "token", "bearer", "secret", "password", "passwd", "pwd", "private_key", "privateKey",
    "access_key", "accessKey", "authorization", "Authorization"))
# Key names of a tape (found anywhere in the name) and of a report (the whole name).
TAPE_KEYS = (r"password", r"passwd", r"\bpwd\b", r"secret", r"token", r"api[_-]?key", r"authorization",
             r"^bearer$", r"private[_-]?key", r"access[_-]?key")
REPORT_KEYS = (r"^password$", r"^passwd$", r"^pwd$", r"^secret[_-]?[a-z]*$",
               r"^(?:auth|access|refresh|id|session|bearer|api)?[_-]?tokens?$", r"^api[_-]?key$",
               r"^authorization$", r"^bearer$", r"^private[_-]?key$", r"^access[_-]?key(?:[_-]?id)?$")
# Replay fields of a turn, by the type of the block around them.
OPAQUE = {"signature": ("thinking", "redacted_thinking"), "data": ("redacted_thinking", "reasoning.encrypted"),
          "encrypted_content": ("thinking", "reasoning"), "thoughtSignature": ("thinking", "tool_use")}
MEDIA_BYTES = 1 << 20
BLOB_CHARS = 8 * 1024
SECRET_CHARS = 6

DEFAULT_RULES = (
    *({"type": "path", "path": p} for p in SECRET_PATHS),
    *({"type": "regex", "pattern": p} for p in VALUE_PATTERNS),
    {"type": "drop-media", "minBytes": MEDIA_BYTES},
)

STEP = re.compile(r"\.\.(?P<deep>\w+)|\.(?P<name>\w+)|\[(?P<index>\d+|\*)\]")
URL_PASSWORD = "(?<=://[^/\\s:@]{1,128}:)"


# What `\\s`, `\\b` and `.` mean in the rules, spelled out so that Python and Java agree on them.
BLANK = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PIECE = re.compile(r"\\.|\[|\]|\.|[^\\\[\].]+", re.S)


@cache
def spelled(pattern: str) -> str:
    """A rule with its blanks, word edges and dots spelled out: letters of other scripts are no word characters."""
    out, inside = [], False
    for piece in PIECE.findall(pattern):
        if piece == "[":
            inside = True
        elif piece == "]":
            inside = False
        elif piece == r"\s":
            piece = BLANK if inside else f"[{BLANK}]"
        elif piece == r"\b" and not inside:
            piece = EDGE
        elif piece == "." and not inside:
            piece = r"[^\n\r\u2028\u2029]"
        out.append(piece)
    return "".join(out)


def path_steps(path: str) -> tuple[tuple[str, str], ...]:
    """A JSON path as steps: a name, an index, any index, or a name at any depth."""
    if not path.startswith("$"):
        raise ValueError(f"path must start with $: {path}")
    out, at = [], 1
    while at < len(path):
        step = STEP.match(path, at)
        if not step:
            raise ValueError(f"cannot read path {path} at {at}")
        kind = next(k for k in ("deep", "name", "index") if step[k])
        out.append(("any", "") if step[kind] == "*" else (kind, step[kind]))
        at = step.end()
    return tuple(out)


def fits(steps: tuple, path: tuple) -> bool:
    """Whether the steps lead from the root to a value's keys, each taken as a whole."""
    if steps and (not path or steps[-1][0] != "any" and steps[-1][1] != path[-1]):
        return False
    places = {0}
    for kind, name in steps:
        if kind == "deep":
            places = {q + 1 for q in range(min(places), len(path)) if path[q] == name}
        else:
            places = {q + 1 for q in places if q < len(path) and (kind == "any" or path[q] == name)}
        if not places:
            return False
    return len(path) in places


def value_pattern(pattern: str) -> tuple[re.Pattern, str, str]:
    """A value rule for ``re``, which has no variable lookbehind: keep that part as a group."""
    hint = HINTS.get(pattern, "")
    if pattern.startswith(URL_PASSWORD):
        return re.compile(spelled(r"(://[^/\s:@]{1,128}:)" + pattern[len(URL_PASSWORD):]), re.ASCII), r"\1" + MARK, hint
    return re.compile(spelled(pattern), re.ASCII), MARK, hint


@dataclass(frozen=True)
class Rules:
    """Compiled rules. An unknown rule type is an error: nothing may slip through."""

    values: tuple = ()
    paths: tuple = ()
    cuts: tuple = ()
    media_bytes: int | None = None
    keys: re.Pattern = field(default_factory=lambda: re.compile("|".join(TAPE_KEYS), re.I | re.ASCII))

    @staticmethod
    def of(rules=DEFAULT_RULES, keys=TAPE_KEYS) -> Rules:
        values, paths, cuts, media = [], [], [], None
        for rule in rules:
            kind = rule.get("type")
            if kind == "regex" and rule.get("pattern"):
                values.append(value_pattern(rule["pattern"]))
            elif kind == "path" and rule.get("path"):
                paths.append(path_steps(rule["path"]))
            elif kind == "truncate" and rule.get("path") and rule.get("maxBytes", 0) > 0:
                cuts.append((path_steps(rule["path"]), rule["maxBytes"]))
            elif kind == "drop-media" and rule.get("minBytes", 0) > 0:
                media = rule["minBytes"] if media is None else min(media, rule["minBytes"])
            else:
                raise ValueError(f"unknown or incomplete redaction rule: {rule}")
        return Rules(tuple(values), tuple(paths), tuple(cuts), media, re.compile("|".join(keys), re.I | re.ASCII))


BASE64 = re.compile(r"[A-Za-z0-9+/=\r\n]+")
MEDIA = re.compile(r"[A-Za-z0-9+/=\r\n_-]+")


def _bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _size_guards(s: str, path: tuple, rules: Rules) -> str:
    for steps, limit in rules.cuts:
        if fits(steps, path):  # the first rule for a path is the only one
            size = _bytes(s)
            if size > limit:
                s = f"{s[:limit]} [truncated, original {size} bytes]"
            break
    if rules.media_bytes is not None and len(s) >= rules.media_bytes:
        uri = s.startswith("data:") and ";base64," in s[:256]
        if uri or (MEDIA.fullmatch(s[:512]) and MEDIA.fullmatch(s[-64:])):
            return f"[media dropped: {_bytes(s)} bytes]"
    return s


@lru_cache(maxsize=1 << 16)
def _secret_key(keys: re.Pattern, key: str) -> bool:
    return keys.search(key) is not None


def _secret_path(paths: tuple, path: tuple) -> bool:
    return any(fits(p, path) for p in paths)


def _clean_string(value: str, rules: Rules, path: tuple, key: str, holder: str | None, in_turn: bool) -> str:
    """Size guards, paths, key names, value patterns. `holder` is the type of the object around the value."""
    if in_turn and holder in OPAQUE.get(key, ()):
        return value
    value = _size_guards(value, path, rules)
    if path and _secret_path(rules.paths, path) or key and _secret_key(rules.keys, key):
        return MARK
    if len(value) >= BLOB_CHARS and BASE64.fullmatch(value):
        return value
    for pattern, mark, hint in rules.values:
        if hint in value:
            value = pattern.sub(mark, value)
    return value


BODY = r'[^"\\\x00-\x1f]*'
TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<string>"' + BODY + r'(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})' + BODY + r')*")'
                   r'|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<sign>[\[\]{}:,]))')
LONE = re.compile("[\ud800-\udfff]")


def _tokens(line: str) -> tuple[list[str], dict[int, str | None]] | None:
    """The tokens of a JSON text, and for each object (by its first token) its `type`; None if it is no JSON.

    A state for each open bracket instead of recursion, so that depth has no limit.
    """
    tokens, types, stack, at = [], {}, [], 0
    want, end = "value", len(line.rstrip(" \t\n\r"))
    named = None  # the key whose value comes next
    while at < end:
        found = TOKEN.match(line, at)
        if not found or found.end() > end or want == "nothing":
            return None
        kind, text, at = found.lastgroup, found[found.lastgroup], found.end()
        closing = text == "}" and want in ("key or end", "comma") or text == "]" and want in ("value or end", "comma")
        if kind == "sign" and closing and stack and tokens[stack[-1]] == ("{" if text == "}" else "["):
            stack.pop()
        elif want.startswith("value") and (kind != "sign" or text in "[{"):
            if stack and named == "type" and tokens[stack[-1]] == "{":
                types[stack[-1]] = json.loads(text) if kind == "string" else None
            if kind == "sign":
                stack.append(len(tokens))
                tokens.append(text)
                want = "key or end" if text == "{" else "value or end"
                continue
        elif want.startswith("key") and kind == "string":
            named, want = json.loads(text), "colon"
            tokens.append(text)
            continue
        elif want == "colon" and text == ":":
            want = "value"
            tokens.append(text)
            continue
        elif want == "comma" and text == "," and stack:
            want = "key" if tokens[stack[-1]] == "{" else "value"
            tokens.append(text)
            continue
        else:
            return None
        tokens.append(text)
        want = "comma" if stack else "nothing"
    return (tokens, types) if want == "nothing" else None


def _written(value: str) -> str:
    """A string as JSON; half of a surrogate pair goes back as its escape."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def clean_line(line: str, rules: Rules) -> str:
    """A JSON text with every secret replaced. Numbers and untouched strings keep their text; a line that is no JSON is one string."""
    parsed = _tokens(line)
    if parsed is None:
        return _clean_string(line, rules, (), "", None, False)
    tokens, types = parsed
    in_turn = tokens[0] == "{" and types.get(0) == "turn"
    out, at = [], 0
    stack = []  # of open brackets: first token, path, key that names the values, place in an array
    path, key = (), ""
    while at < len(tokens):
        text = tokens[at]
        if text in "]}":
            stack.pop()
            out.append(text)
        elif text in ",:":
            out.append(text)
        elif stack and tokens[stack[-1][0]] == "{" and tokens[at + 1] == ":":
            name = json.loads(text)
            path, key = (*stack[-1][1], name), name
            out += [text, ":"]
            at += 1
        else:
            holder = next((types.get(f[0]) for f in reversed(stack) if tokens[f[0]] == "{"), None) if in_turn else None
            if stack and tokens[stack[-1][0]] == "[":
                frame = stack[-1]
                path, key = (*frame[1], str(frame[3])), frame[2]
                frame[3] += 1
            if text[0] == '"':
                value = json.loads(text)
                clean = _clean_string(value, rules, path, key, holder, in_turn)
                out.append(text if clean == value else _written(clean))
            elif path and _secret_path(rules.paths, path) or text in "[{" and key and _secret_key(rules.keys, key):
                out.append(_written(MARK))
                depth = text in "[{"
                while depth:
                    at += 1
                    depth += (tokens[at] in "[{") - (tokens[at] in "]}")
            else:
                out.append(text)
                if text in "[{":
                    stack.append([at, path, key, 0])
        at += 1
    return "".join(out)


REFUSED = json.dumps(MARK)
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of Arrow batches, about PIECE_BYTES of them at a time: a batch has thousands of rows, and a row may be long."""
    for batch in batches:
        step = max(1, PIECE_BYTES * len(batch) // max(1, batch.nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step).to_pylist()


def redact_json(text: Column, rules: Rules) -> Column:
    """A JSON text with every secret replaced; text that is not JSON is treated as one string.

    A line that cannot be cleaned becomes REFUSED as a whole instead of failing the job; count `out = REFUSED` to see how many.
    """
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(line):
            if line is None:
                return None
            try:
                return clean_line(line, rules)
            except (ValueError, IndexError, KeyError, RecursionError, MemoryError, UnicodeError):
                return REFUSED
        for lines in pieces(batches):
            yield pa.array(map(one, lines), pa.string())
    return run(text)


def redact_tapes(lines: DataFrame, rules: Rules | None = None) -> DataFrame:
    return lines.withColumn("raw_text", redact_json(F.col("raw_text"), rules or Rules.of()))


def redact_reports(reports: DataFrame, column: str = "report", secrets: DataFrame | None = None) -> DataFrame:
    """Reports match whole key names, so measured figures survive; known secrets go too."""
    out = reports.withColumn(column, redact_json(F.col(column), Rules.of(keys=REPORT_KEYS)))
    return out if secrets is None else scrub(out, column, secrets)


def redact_text(text: Column, patterns=VALUE_PATTERNS) -> Column:
    """Flat text, on the JVM."""
    def step(p: str):
        def run(t: Column) -> Column:
            done = F.regexp_replace(t, spelled(p), MARK)
            return F.when(F.contains(t, F.lit(HINTS[p])), done).otherwise(t) if p in HINTS else done
        return run

    out = text
    for p in patterns:
        # bound by a one-element array, so each step names the text before it only once
        out = F.transform(F.array(out), step(p)).getItem(0)
    blob = (F.length(text) >= BLOB_CHARS) & F.regexp_like(text, F.lit(r"^[A-Za-z0-9+/=\r\n]+$"))
    return F.when(blob, text).otherwise(out)


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(spelled(pattern)))


NEEDLES = 100_000  # secrets, of SHIPPED_BYTES in all, that a broadcast variable carries; more are searched for in a join


@lru_cache(maxsize=2)
def _automaton(secrets: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for place, secret in enumerate(secrets):
        found.add_word(secret, place)
    found.make_automaton()
    return found


def scrub(df: DataFrame, column: str, secrets: DataFrame) -> DataFrame:
    """Replace known secret values, longest first, so one inside another is not left in half.

    ``secrets`` has one column ``secret``. What a text holds is searched for in the text as it came, and then replaced. A list of checked size
    travels as a broadcast variable. A longer one stays in Spark: its secrets are numbered, found by their byte grams and joined to the rows
    that hold them, with the same result. No secret is ever a constant of a plan.
    """
    spark = df.sparkSession
    needles = secrets.where(F.length("secret") >= SECRET_CHARS).select("secret").distinct()
    size = needles.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("secret") + 64).alias("bytes")).first()
    if not size["n"]:
        return df
    if size["n"] <= NEEDLES and size["bytes"] <= containment.SHIPPED_BYTES:
        own = sorted((r["secret"] for r in needles.collect()), key=lambda v: (-len(v), v))
        return _scrubbed(df, column, spark.sparkContext.broadcast(tuple(own)))
    needles = written(needles.withColumn("__secret_no", F.monotonically_increasing_id()), "needles")
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "scrubbed")
    found = containment.phrase_hits(needles, rows, ["__secret_no"], ["__row"], "secret", column, SECRET_CHARS)
    longest = F.array_sort(F.collect_list(F.struct((-F.length("secret")).alias("less"), "secret")))
    held = found.join(needles, "__secret_no").groupBy("__row").agg(longest.alias("__held"))
    clean = F.aggregate(F.coalesce("__held", F.array().cast("array<struct<less:int,secret:string>>")), F.col(column),
                        lambda t, e: F.replace(t, e["secret"], F.lit(MARK)))
    return rows.join(held, "__row", "left").withColumn(column, clean).select(*df.columns)


def _scrubbed(df: DataFrame, column: str, secrets) -> DataFrame:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ordered = secrets.value
        found = _automaton(ordered)

        def one(text):
            if text is None:
                return None
            for place in sorted({place for _, place in found.iter(text)}):
                text = text.replace(ordered[place], MARK)
            return text
        for texts in pieces(batches):
            yield pa.array(map(one, texts), pa.string())
    return df.withColumn(column, run(F.col(column)))
