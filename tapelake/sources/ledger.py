"""A keyed table in files that is updated in place: only buckets that change are written.

Rows lie in folders, a number fixed by the first update, by a hash of their keys. An update writes the buckets it touches into new folders and then, last, a manifest that names
the folder of every bucket. Readers follow the newest manifest, so a driver or executor lost on the way leaves the table as it was; folders no
manifest names can be deleted. One writer at a time. A tag (the batch of a stream) that the newest manifest carries is not applied again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.operators.ordered import equi_join
from tapelake.session import written

BUCKETS = 64
MANIFEST = "version long, buckets int, bucket int, folder string, tag string"


def manifest(spark: SparkSession, path: str) -> list:
    """The rows of the newest manifest, one per bucket that holds rows; [] for a table that is not there yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = rows.agg(F.max("version")).first()[0]
    return [] if last is None else rows.where(F.col("version") == last).collect()


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return _folders(spark, [r["folder"] for r in manifest(spark, path) if r["folder"]], schema)


def _folders(spark: SparkSession, folders: list[str], schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def update(new: DataFrame, path: str, keys: Sequence[str], combine: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None,
           buckets: int = BUCKETS) -> int:
    """Replace the rows of every touched bucket by combine(old rows, new rows); returns the number of buckets written.

    ``combine`` gets the rows of the touched buckets only, which hold all rows of the new rows' keys, and returns the table's columns.
    """
    spark = new.sparkSession
    before = manifest(spark, path)
    if tag is not None and before and before[0]["tag"] == tag:
        return 0
    buckets = before[0]["buckets"] if before else buckets
    schema, bucket = new.schema, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    staged = written(new, "ledger")
    touched = {r[0] for r in staged.select(bucket).distinct().collect()}  # at most `buckets`
    folders = {r["bucket"]: r["folder"] for r in before}
    old = _folders(spark, [folders[b] for b in touched if folders.get(b)], schema)
    rows = combine(old, staged).select(*new.columns).withColumn("__bucket", bucket)
    data = f"{path}/data/{uuid.uuid4().hex}"
    if touched:
        rows.repartition("__bucket").write.partitionBy("__bucket").parquet(data)
        kept = {r[0] for r in spark.read.parquet(data).select("__bucket").distinct().collect()}
        folders |= {b: f"{data}/__bucket={b}" if b in kept else None for b in touched}
    version = max((r["version"] for r in before), default=0) + 1
    lines = [(version, buckets, b, f, tag) for b, f in sorted(folders.items())] or [(version, buckets, 0, None, tag)]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(touched)


def upsert(new: DataFrame, path: str, keys: Sequence[str], order: str, tag: str | None = None, buckets: int = BUCKETS) -> int:
    """Rows replace those of the same key; of several new rows of a key the last by ``order`` counts. NULL keys are equal."""
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*new.columns)
    return update(last, path, keys, lambda old, rows: equi_join(old, rows.select(*keys), keys, "left_anti").unionByName(rows), tag, buckets)
