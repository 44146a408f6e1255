"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each group of near copies stays,
documents with benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and reads every row of `docs`. All but the last return the columns of
`documents`, `n_chars` brought up to date where a text changed. Rows of NULL id or text go through like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.llm import byte_bpe, decontaminate, set_join, site_lines, toxicity
from tapelake.llm.common import columns, fresh
from tapelake.llm.queries import RANK_FILE
from tapelake.plans.registry import table
from tapelake.session import written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "_score"), fresh(docs, "_predicted")
    return toxicity.score(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 0).select(columns(docs))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that too many of a source's documents hold; the documents stay."""
    dropped = fresh(docs, "_dropped")
    out = site_lines.drop_lines(docs, dropped=dropped)
    changed = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return set_join.keep_one(docs, k=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their round trip, as digests."""
    pieces = byte_bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return byte_bpe.digests(docs, pieces, public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic_documents), ("line_dedup", boilerplate_lines), ("ngram_jaccard_join", near_copies),
          ("benchmark_decontamination", benchmark_passages), ("byte_level_bpe", token_ids)]
ORACLE_SQL = None  # SQL has neither the trained scores nor the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
