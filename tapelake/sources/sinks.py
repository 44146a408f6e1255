"""Sinks: publish copies, reports, ledgers, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.operators.ordered import equi_join


def write_tapes(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ``raw_text`` under run_id=/plane=, line order kept.

    Range partitioning cuts a huge tape into several files whose names sort in
    line order, so no task holds a whole tape.
    """
    order = ["run_id", "plane", "line_no"]
    ranged = (lines.repartitionByRange(partitions, *order) if partitions
              else lines.repartitionByRange(*order))
    (ranged.sortWithinPartitions(*order)
     .select("run_id", "plane", F.col("raw_text").alias("value"))
     .write.partitionBy("run_id", "plane").text(path))


def report_json(reports: DataFrame, columns: Sequence[str], score: str = "score") -> DataFrame:
    """One JSON text per report; the score key is absent unless the run is SCORED."""
    kept = F.when(F.col("outcome") == "SCORED", F.col(score)).alias(score)
    body = F.struct(*[c for c in columns if c != score], kept)
    return reports.select("run_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("report"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not rewritten, plus every new row."""
    kept = equi_join(old, new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def plane_gaps(reports: DataFrame, planes: DataFrame, keys: Sequence[str] = ("run_id",),
               expected: Sequence[str] = ("mcp", "agent")) -> DataFrame:
    """Reports that lack a plane, and planes without a report."""
    wanted = reports.select(*keys, F.explode(F.array(*[F.lit(p) for p in expected])).alias("plane"))
    have = planes.select(*keys, "plane").distinct()
    missing = equi_join(wanted, have, [*keys, "plane"], "left_anti").withColumn("fault", F.lit("missing plane"))
    orphan = equi_join(have, reports.select(*keys).distinct(), keys, "left_anti").withColumn(
        "fault", F.lit("no report"))
    return missing.unionByName(orphan)
