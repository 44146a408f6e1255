"""Documents with what operators must stand: NULLs, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_rows(seed=5):
    rng = random.Random(seed)
    base = words(rng, 60)
    near = base[:30] + ["other"] + base[31:]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
            (8, "One  TWO"), (9, "Ünï 漢字 😀 x"), (10, " ".join(words(rng, 30_000, 9000))), (11, "a" * 50_000), (12, " ".join(base)),
            (12, " ".join(base)), (None, " ".join(words(rng, 40))), (None, None), (13, "\n".join(["same line"] * 30))]
    return [(i, t, None if i == 7 else "en", None if i == 8 else f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The table with further columns whose names operators might want for themselves."""
    names = ("id score predicted row v key digest ids decoded hits items w at k h n copies _id _text_hash _one_stays _gone _host _kept "
             "_dropped _score _predicted n_dropped component _digest _hit_words item_id host a.b").split()
    return df.withColumns({n: F.lit("mine") for n in names if n not in df.columns})


def most_rows_read_at_once(table):
    """Of a written table: the rows of its largest row group."""
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    return max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups))
