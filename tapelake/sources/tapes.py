"""Scans: tapes, run reports, recorded bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.functions import typed

# Rows within one input split are numbered in the low 33 bits; the split's
# start in units of 64 KiB sits above them, so splits of one file must start that
# far apart, and a file may have 64 TiB.
ROW_BITS, SPLIT_BITS = 33, 16
SPLIT_KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
TAPE_PATH = r"([^/]+)/([^/]+)\.jsonl$"


def tape_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per non-blank line: run_id, plane, line_no, raw_text, v.

    Files are read as splittable text, so one huge tape spreads over many
    tasks. ``line_no`` grows in file order and needs no shuffle: it is built
    from the split's offset and the row's place in the split, so it is a
    position to order by, not a consecutive number. ``v`` is NULL for a line
    that is not JSON.
    """
    for key in SPLIT_KEYS:  # the least size of a split is the smaller of the two
        if _bytes(spark.conf.get(key)) < 1 << SPLIT_BITS:
            raise ValueError(f"{key} must be 64 KiB or more: line numbers come from the splits' offsets")
    scan = spark.read.text(list(paths))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    split = F.shiftright(F.col("_metadata.file_block_start"), SPLIT_BITS)
    placed = scan.select(
        F.regexp_extract("_metadata.file_path", TAPE_PATH, 1).alias("run_id"),
        F.regexp_extract("_metadata.file_path", TAPE_PATH, 2).alias("plane"),
        (F.shiftleft(split, ROW_BITS) + row).alias("line_no"),
        F.col("value").alias("raw_text"))
    return parsed(placed.where(F.trim("raw_text") != ""))


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.removesuffix("b")]


def parsed(lines: DataFrame) -> DataFrame:
    return once(lines, F.try_parse_json("raw_text"), "v")


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is costly to work out and read by many filters.

    Filters are pushed below a plain projection, each with its own copy of the
    value. They stop at a one-element explode, so a line is parsed one time.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def lines_of(spark: SparkSession, rows: list[tuple[str, str, int, str]]) -> DataFrame:
    """Tape lines from memory: (run_id, plane, line_no, raw_text)."""
    schema = "run_id string, plane string, line_no long, raw_text string"
    return parsed(spark.createDataFrame(rows, schema))


def admitted(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object or array; anything else is no record."""
    return lines.where(F.col("v").isNotNull() & F.regexp_like("raw_text", F.lit(r"^\s*[\[{]")))


def skipped_lines(lines: DataFrame) -> DataFrame:
    """Malformed lines per tape."""
    return lines.groupBy("run_id", "plane").agg(F.count_if(F.col("v").isNull()).alias("skipped_lines"))


def session_faults(lines: DataFrame) -> DataFrame:
    """Tapes that do not hold exactly one meta line."""
    metas = F.count_if(typed.text("v", "$.type") == "meta")
    return lines.groupBy("run_id", "plane").agg(metas.alias("metas")).where("metas != 1")


def rpc_body(body: Column) -> Column:
    """The JSON-RPC object in a recorded body: plain JSON or server-sent events."""
    plain = F.try_parse_json(body)
    blocks = F.split(F.regexp_replace(body, r"\r\n?", "\n"), r"\n\n+")

    def data(block: Column) -> Column:
        rows = F.filter(F.split(block, "\n"), lambda r: r.startswith("data:"))
        return F.array_join(F.transform(rows, lambda r: F.regexp_replace(r, "^data: ?", "")), "\n")

    def is_rpc(v: Column) -> Column:
        return F.coalesce(typed.text(v, "$.jsonrpc") == "2.0", F.lit(False))

    events = F.filter(F.transform(blocks, lambda b: F.try_parse_json(data(b))), is_rpc)
    return F.when(is_rpc(plain), plain).otherwise(F.get(events, F.lit(0)))


WILSON = T.StructType([
    T.StructField("rate", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("k", T.LongType()),
    T.StructField("n", T.LongType())])


def report_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Run reports stored one per line: the splittable form for a large corpus."""
    scan = spark.read.text(list(paths)).where(F.trim("value") != "")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    split = F.shiftright(F.col("_metadata.file_block_start"), SPLIT_BITS)
    placed = scan.select((F.shiftleft(split, ROW_BITS) + row).alias("file_order"), "value")
    return reports_of(once(placed, F.try_parse_json("value"), "r"))


def run_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per run report, from published files that each hold a JSON array.

    An array is one JSON value, so a file is read whole; keep a corpus as
    ``report_lines``. The report stays open (later fields survive): ``r`` is
    the whole report, ``file_order`` its place in the array.
    """
    raw = spark.read.text(list(paths), wholetext=True)
    return reports_of(raw.select(F.posexplode(
        F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("file_order", "r")))


def reports_of(rows: DataFrame) -> DataFrame:
    """Typed columns over report rows (file_order, r)."""
    r = "r"
    recorded = F.lit("unrecorded generator")
    synthesis = gate_record(F.col(r), "structural")
    first_try = F.struct(*[typed.num(r, f"$.score.firstTrySuccess.{f}").alias(f)
                           for f in ("rate", "low", "high", "k", "n")])
    return rows.where(typed.is_object(F.col(r))).select(
        "file_order", r,
        F.coalesce(typed.text(r, "$.server.slug"), typed.text(r, "$.server.url"),
                   typed.scalar(r, "$.run.id"), F.lit("unnamed server")).alias("slug"),
        typed.text(r, "$.run.id").alias("run_id"),
        F.coalesce(typed.text(r, "$.run.generatorVersion"),
                   typed.text(synthesis, "$.detail.synthesis.generatorVersion"), recorded).alias("generator"),
        F.coalesce(typed.text(r, "$.score.runnerModel"), typed.text(r, "$.run.runnerModel"),
                   F.lit("unrecorded runner model")).alias("runner_model"),
        typed.text(r, "$.run.suiteHash").alias("suite_hash"),
        F.substring(typed.text(r, "$.run.suiteHash"), 1, 12).alias("suite_prefix"),
        typed.text(r, "$.run.startedAt").alias("started_at"),
        F.coalesce(typed.raw_text(r, "$.outcome"), F.lit("UNKNOWN_OUTCOME")).alias("outcome"),
        first_try.alias("first_try"))


def gate_records(r: Column) -> Column:
    return F.coalesce(typed.items(r, "$.gates.records"), F.array().cast("array<variant>"))


def gate_record(r: Column, gate: str) -> Column:
    """The first record of a gate."""
    return F.get(F.filter(gate_records(r), lambda g: F.coalesce(typed.text(g, "$.gate") == gate, F.lit(False))),
                 F.lit(0))
