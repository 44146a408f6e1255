"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Slices that an ordered pass cuts its rows into; unset, Spark's shuffle partitions and AQE decide.
SLICES_KEY = "spark.tapelake.slices"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "tapelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults. Cluster settings stay the caller's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def slices(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICES_KEY, "0"))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="tapelake-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def spread(scan: DataFrame) -> DataFrame:
    """Rows over every core when a scan has fewer splits than cores.

    For work that is heavy per row (grams, regular expressions). A large table
    has splits enough and stays as it is. Meant for scans: on them, counting
    the splits starts no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


# For tables whose rows take some MB. By default a Parquet writer keeps a hundred rows before it looks at their size, and a reader takes
# all rows of a row group, up to some thousand, as one batch.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
