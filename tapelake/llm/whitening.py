"""Whitening of embeddings by a covariance with multiplicities.

Entries become integers (`floor(1024 * c) + 100000`). Rows of the same integer vector are grouped first, so that everything after works
once for each distinct vector: sums and the covariance take the group's size as the weight (or one, if asked), and a distinct vector is
whitened once and joined back to its rows. The covariance is a weighted product of centred matrices in each task, summed in Spark; only sums,
its cells (dimension squared) and a few aggregates come to the driver.

Vectors that are NULL or hold NULL, NaN or infinite entries are dropped. Of vectors of several lengths those of the most common length stay (of
equals the longest), the others are dropped. Integers are held within 2^52 either way. `deviation` is NULL where it doesn't fit a long. A
component without variance (at most 1e-12 of the trace) has NULL for `whitened`, and is left out of `identity_error`; a trace of zero gives NULL
for `explained`. Repeated rows and keys, and NULL keys, are rows of their own; further columns are ignored. An empty table gives no rows.
Vectors that hold more than one in HOT of the rows, fewer than HOT, are joined by a broadcast, so that no task gets all of one's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import quoted, small_batches
from tapelake.session import written

SCALE, SHIFT, EDGE = 1024, 100000, 1 << 52
HOT = 200
DIMENSIONS = 4096  # the driver holds one covariance matrix
FLAT = 1e-12


@dataclass(frozen=True)
class Fit:
    """Rows and sums of the fit list, and its components by falling variance."""
    n: int
    sums: list[int]
    trace: float
    variances: np.ndarray
    directions: np.ndarray  # one column per component


def integer_rows(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, x) of the rows whose vector is whole, finite and of the common length."""
    entry = F.transform(F.col(quoted(embedding)), lambda c: c.cast("double"))
    rows = df.select(F.col(quoted(key)).alias("key"), entry.alias("c")).where("c IS NOT NULL").where(
        ~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    length = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    edge = float(EDGE)
    held = F.transform("c", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, F.lit(edge)), F.lit(-edge))) + SHIFT,
                                                         F.lit(EDGE)), F.lit(-EDGE)))
    return rows.where(F.size("c") == (length["d"] if length else 0)).select("key", held.alias("x"))


def grouped(rows: DataFrame) -> DataFrame:
    """(x, copies): the distinct vectors, written."""
    return written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    top = max(int(np.abs(x).max(initial=0)), 1)
    if n * top < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit(vectors: DataFrame, components: int, weigh: bool = True) -> Fit | None:
    """The fit over the written distinct vectors; None where there are none."""
    def weights(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).to_numpy() if weigh else np.ones(len(batch), np.int64)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in filter(len, batches):
            x, w = _matrix(batch.column(0)), weights(batch)
            own = int(w.sum())
            exact = own * int(np.abs(x).max(initial=0)) < 1 << 62
            part = [int(v) for v in (w @ x if exact else w.astype(object) @ x.astype(object))]
            n, total = n + own, part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            number = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, number),
                                              pa.array([n] * len(total), pa.int64())], ["i", "s", "n"])

    with small_batches(vectors.sparkSession):
        sums = vectors.mapInArrow(partial_sums, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        found = sorted(sums.collect())
        if not found:
            return None
        n, d, total = found[0]["n"], len(found), [int(r["s"]) for r in found]
        if d > DIMENSIONS:
            raise ValueError(f"vectors of more than {DIMENSIONS} entries")

        def partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            product = np.zeros((d, d))
            for batch in filter(len, batches):
                z = _centred(_matrix(batch.column(0)), n, total).astype(float) / n
                product += (z * weights(batch)[:, None]).T @ z
            i, j = np.triu_indices(d)
            if product.any():
                yield pa.RecordBatch.from_arrays([pa.array((i * d + j).astype(np.int64)), pa.array(product[i, j])], ["cell", "v"])

        cells = vectors.mapInArrow(partial_products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    covariance = np.zeros(d * d)
    covariance[cells.column("cell").to_numpy()] = cells.column("v").to_numpy() / n
    covariance = covariance.reshape(d, d)
    covariance += np.triu(covariance, 1).T
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    directions = directions[:, order]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))])
    return Fit(n, total, float(np.trace(covariance)), values[order].clip(0), directions * signs)


def whitened(vectors: DataFrame, model: Fit) -> DataFrame:
    """(x, copies, deviation, w): each distinct vector whitened once, written."""
    live = model.variances > FLAT * model.trace if model.trace else np.zeros(len(model.variances), bool)
    n, sums = model.n, model.sums
    scaled = model.directions[:, live] / np.sqrt(model.variances[live])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            z = _centred(_matrix(batch.column(0)), n, sums)
            top = int(np.abs(z).max(initial=0))
            if z.dtype == object or z.shape[1] * top * top >= 1 << 62:
                deviation = [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in z]
            else:
                deviation = (z * z).sum(axis=1)
            w = np.zeros((len(batch), len(live)))
            w[:, live] = (z.astype(float) / n) @ scaled
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(live))
            values = pa.array(w.ravel(), mask=np.tile(~live, len(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, values)],
                                             ["x", "copies", "deviation", "w"])

    with small_batches(vectors.sparkSession):
        return written(vectors.mapInArrow(run, "x array<long>, copies long, deviation long, w array<double>"), "whitened")


def identity_error(done: DataFrame, model: Fit, weigh: bool = True) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    live = [i for i, v in enumerate(model.variances) if model.trace and v > FLAT * model.trace]
    if not live:
        return None
    weight = F.col("copies") if weigh else F.lit(1)
    means = done.agg(*[(F.sum(weight * F.col("w")[i]) / model.n).alias(f"m{i}") for i in live]).first()
    z = {i: F.col("w")[i] - F.lit(means[f"m{i}"]) for i in live}
    cells = [(i, j) for i in live for j in live if i <= j]
    found = done.agg(*[(F.sum(weight * z[i] * z[j]) / model.n).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def whiten(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = 8, weigh: bool = True) -> DataFrame:
    """Per row and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = integer_rows(df, key, embedding)
    vectors = grouped(rows)
    model = fit(vectors, components, weigh)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.select(F.col("key").alias(key), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in kinds.split(", ")]).limit(0)
    done = whitened(vectors, model)
    error = identity_error(done, model, weigh)
    frequent = done.where(F.col("copies") * HOT > vectors.agg(F.sum("copies")).first()[0])
    hot = frequent.count()
    parts = done.join(frequent.select("x"), "x", "left_anti") if hot else done
    out = rows.join(parts.select("x", "deviation", "w"), "x")
    if hot:  # fewer than HOT vectors
        out = out.unionByName(rows.join(F.broadcast(frequent.select("x", "deviation", "w")), "x"))
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.variances])
    out = out.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                      "whitened", explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
