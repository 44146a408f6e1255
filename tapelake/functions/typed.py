"""Typed readers over VARIANT columns.

Spark's variant getters cast silently ("12" reads as 12.0, true as 1.0), so
each reader first checks the JSON type. Anything of another type is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(v: Column | str, path: str = "$") -> Column:
    return _col(v) if path == "$" else F.try_variant_get(_col(v), path, "variant")


def shaped(v: Column | str, shape: str, path: str = "$") -> Column:
    """An object's fields in one walk over it, instead of one walk a field; read fields of type variant with the readers below."""
    return F.try_variant_get(_col(v), path, shape)


def let(value: Column, body) -> Column:
    """Work ``value`` out once and hand it to ``body``; keeps a repeated part out of the plan's code."""
    return F.transform(F.array(value), body).getItem(0)


def json_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def num(v: Column | str, path: str = "$") -> Column:
    """A finite JSON number as double."""
    return F.when(
        F.left(json_type(at(v, path)), F.lit(3)).isin("BIG", "DOU", "FLO", "DEC"),
        F.try_variant_get(_col(v), path, "double"))


def text(v: Column | str, path: str = "$") -> Column:
    """A non-empty JSON string."""
    return F.when(json_type(at(v, path)) == "STRING", F.nullif(F.try_variant_get(_col(v), path, "string"), F.lit("")))


def raw_text(v: Column | str, path: str = "$") -> Column:
    """A JSON string, the empty one included."""
    return F.when(json_type(at(v, path)) == "STRING", F.try_variant_get(_col(v), path, "string"))


def flag(v: Column | str, path: str = "$") -> Column:
    return F.when(json_type(at(v, path)) == "BOOLEAN", F.try_variant_get(_col(v), path, "boolean"))


def is_object(v: Column) -> Column:
    """An object reads as a struct of no fields; the schema of a large one is never worked out."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def obj(v: Column | str, path: str = "$") -> Column:
    got = at(v, path)
    return F.when(is_object(got), got)


def items(v: Column | str, path: str = "$") -> Column:
    """The elements of a JSON array; nothing else reads as an array."""
    return F.try_variant_get(_col(v), path, "array<variant>")


def present(v: Column | str, path: str = "$") -> Column:
    """True when the field exists and is not JSON null."""
    got = at(v, path)
    return got.isNotNull() & ~F.is_variant_null(got)


def scalar(v: Column | str, path: str = "$") -> Column:
    """A string, number or boolean printed as text; other types are NULL."""
    got = at(v, path)
    return F.when(
        json_type(got).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"),
        F.try_variant_get(got, "$", "string"))


def first_num(v: Column | str, *fields: str) -> Column:
    return F.coalesce(*[num(v, f"$.{f}") for f in fields])


def first_text(v: Column | str, *fields: str) -> Column:
    return F.coalesce(*[text(v, f"$.{f}") for f in fields])


def usage_entry(v: Column | str) -> Column:
    """One usage block under any of its spellings; NULL when it carries nothing."""
    entry = F.struct(
        first_text(v, "model", "judgeModel", "name").alias("model"),
        first_text(v, "phase", "stage", "label", "purpose").alias("phase"),
        first_num(v, "calls", "requests", "count", "n").alias("calls"),
        first_num(v, "inputTokens", "input_tokens", "input").alias("input_tokens"),
        first_num(v, "outputTokens", "output_tokens", "output").alias("output_tokens"),
        first_num(v, "costUsd", "estCostUsd", "totalUsd", "usd", "cost").alias("cost_usd"),
    )
    carried = F.coalesce(*[entry[f].cast("string") for f in (
        "model", "phase", "calls", "input_tokens", "output_tokens", "cost_usd")])
    return F.when(carried.isNotNull(), entry)


COUNTS = {"k": ("k", "passed", "successes", "hits"), "n": ("n", "total", "attempts", "size", "tasks")}
COUNT_FIELDS = ", ".join(f"`{f}` variant" for names in COUNTS.values() for f in names)


def counts(v: Column | str) -> Column:
    """A (k, n) pair under any of its spellings; NULL unless both are there and n > 0."""
    return let(shaped(v, f"struct<{COUNT_FIELDS}>"), counts_of)


def counts_of(fields: Column) -> Column:
    """The same from fields read as COUNT_FIELDS."""
    k, n = (F.coalesce(*[num(fields[f]) for f in names]) for names in COUNTS.values())
    return let(F.struct(k.alias("k"), n.alias("n")), lambda p: F.when(p["k"].isNotNull() & (p["n"] > 0), p))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from one ISO timestamp to another, never below zero."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.greatest(F.lit(0).cast("long"), F.unix_millis(b) - F.unix_millis(a)))
