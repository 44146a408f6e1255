"""JSON documents in the reading order and the number forms of ECMAScript.

VARIANT sorts an object's fields and keeps exact numbers. Where the order in which a document was written decides (the first leaf that leaks, the
order of parameters) or where a hash must equal one that a JavaScript program takes, documents are read from their text here: fields come
in the order an ECMAScript object lists them (array indexes ascending, then the others as they first appear; a repeated field keeps
its place and takes the last value), numbers are doubles. Text that is no JSON, or is nested too deeply to be read, gives NULL.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
LAST_INDEX = (1 << 32) - 2
SURROGATE = re.compile("[\ud800-\udfff]")


def _is_index(name: str) -> bool:
    return INDEX.fullmatch(name) is not None and int(name) <= LAST_INDEX


def _object(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    indexes = sorted((n for n in found if _is_index(n)), key=int)
    return {**{n: found[n] for n in indexes}, **found} if indexes else found


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=float, parse_constant=_refuse)


def load(text: str):
    return _DECODER.decode(text)


def number(value: int | float) -> str:
    """A number as JavaScript prints it: the shortest digits of the nearest double."""
    value = float(value)
    if value != value or value in (float("inf"), float("-inf")):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    mantissa, _, exponent = f"{abs(value)!r}".lower().partition("e")
    whole, _, rest = mantissa.partition(".")
    rest = "" if rest == "0" else rest
    digits, point = (whole + rest).lstrip("0"), len(whole) + int(exponent or 0) - (len(whole + rest) - len((whole + rest).lstrip("0")))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        text = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = f"{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return f"-{text}" if value < 0 else text


def leaves(value) -> list[str]:
    """Strings and numbers of a document, in reading order."""
    out, rest = [], [value]
    while rest:
        value = rest.pop()
        if isinstance(value, str):
            out.append(value)
        elif isinstance(value, float):
            out.append(number(value))
        elif isinstance(value, dict):
            rest += reversed(value.values())
        elif isinstance(value, list):
            rest += reversed(value)
    return out


def _quoted(text: str) -> str:
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def canonical(value) -> str:
    """A document without blanks, fields sorted by UTF-16 units; fields that are array indexes come first, as in any object."""
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, float):
        return number(value) if abs(value) < float("inf") else "null"
    if isinstance(value, dict):
        names = sorted(value, key=lambda n: (0, int(n), b"") if _is_index(n) else (1, 0, n.encode("utf-16-be", "surrogatepass")))
        return "{" + ",".join([f"{_quoted(n)}:{canonical(value[n])}" for n in names]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "null" if value is None else "true" if value else "false"


def params(value) -> list[tuple[str, str]]:
    """Named strings, numbers and booleans of an object or of a list of {name, value}, in the order an object lists them."""
    if isinstance(value, list):
        pairs = [(e.get("name"), e.get("value")) for e in value if isinstance(e, dict)]
    else:
        pairs = list(value.items()) if isinstance(value, dict) else []
    kept = []
    for name, v in pairs:
        if not isinstance(name, str) or not name:
            continue
        if isinstance(v, str):
            kept.append((name, v))
        elif isinstance(v, bool):
            kept.append((name, "true" if v else "false"))
        elif isinstance(v, float) and abs(v) < float("inf"):
            kept.append((name, number(v)))
    return list(_object(kept).items())


def _plain(text: str) -> str:
    return SURROGATE.sub("�", text)  # a lone surrogate has no UTF-8


def _read(text: str | None, body, broken=None):
    if text is None:
        return None
    try:
        return body(load(text))
    except (ValueError, RecursionError):
        return broken


@F.pandas_udf(T.ArrayType(T.StringType()))
def answer_leaves(keys: pd.Series) -> pd.Series:
    """Strings and numbers of a JSON answer key, in reading order; [] for text that is no JSON."""
    return keys.map(lambda text: _read(text, lambda v: list(map(_plain, leaves(v))), []))


@F.pandas_udf(T.StringType())
def canonical_text(documents: pd.Series) -> pd.Series:
    """The canonical form of each document."""
    return documents.map(lambda text: _read(text, canonical))


TASK_SOURCE = T.StructType([
    T.StructField("leaves", T.ArrayType(T.StringType())),
    T.StructField("params", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])))])


@F.pandas_udf(TASK_SOURCE)
def task_source(tasks: pd.Series) -> pd.DataFrame:
    """The answer key's leaves and the bound parameters of a task's JSON text, in reading order."""
    def one(value):
        if not isinstance(value, dict):
            return [], []
        return list(map(_plain, leaves(value.get("answerKey")))), [
            {"name": _plain(n), "value": _plain(v)} for n, v in params(value.get("params"))]

    found = [_read(text, one, ([], [])) or (None, None) for text in tasks]
    return pd.DataFrame({"leaves": [f[0] for f in found], "params": [f[1] for f in found]})


def _entries(text: str, at: int) -> list[str]:
    """The source of each element of the array that opens at `at`."""
    blank = re.compile(r"[ \t\n\r]*")
    out, at = [], blank.match(text, at + 1).end()
    while text[at:at + 1] != "]":
        end = _DECODER.raw_decode(text, at)[1]
        out.append(text[at:end])
        at = blank.match(text, end).end()
        if text[at:at + 1] == ",":
            at = blank.match(text, at + 1).end()
    return out


def sources(text: str) -> list[str] | None:
    """The source of each element of an array, or of the array under `tasks` of an object."""
    value = load(text)
    if isinstance(value, list):
        return _entries(text, text.index("["))
    if not (isinstance(value, dict) and isinstance(value.get("tasks"), list)):
        return None
    found, at = None, text.index("{") + 1
    field = re.compile(r"[ \t\n\r,]*")
    while text[at := field.match(text, at).end()] != "}":  # of repeated fields the last counts
        name, end = _DECODER.raw_decode(text, at)
        at = re.compile(r"[ \t\n\r]*:[ \t\n\r]*").match(text, end).end()
        if name == "tasks":
            found = at
        at = _DECODER.raw_decode(text, at)[1]
    return _entries(text, found)


def entries_of(text: str | None) -> list[str] | None:
    try:
        return None if text is None else sources(text)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def entry_sources(lists: pd.Series) -> pd.Series:
    """The source text of each element of a JSON array, or of the array under `tasks` of an object; NULL for anything else."""
    return lists.map(entries_of)
