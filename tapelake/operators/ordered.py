"""Ordered passes over groups of any size.

A window whose partition key is a run, a server or a suite puts the whole group
into one task. Here the rows are range-partitioned on (keys, order) instead, so a
large group is cut into slices of a partition's size each, the slices are written
once (slice numbers must not change if an executor is lost), each slice is
scanned on its own, and one row per slice carries the state across. Groups of
every size take this one way.

``order`` must identify a row within its group, so that ties cannot pile up in
one slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.session import slices, written

SLICE = "__slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with slice numbers, written. Their number follows the session's shuffle partitions, or `spark.tapelake.slices`."""
    cut = slices(df.sparkSession)
    ranged = df.repartitionByRange(cut, *keys, *order) if cut else df.repartitionByRange(*keys, *order)
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _edges(per_slice: DataFrame, keys: Sequence[str]):
    """Window over the slice summaries of one group (a few thousand rows at most)."""
    return Window.partitionBy(*keys).orderBy(SLICE)


def _on(keys: Sequence[str]) -> list[str]:
    return [*keys, SLICE]


def _join_slices(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in _on(keys)],
                         *[c for c in right.columns if c not in _on(keys)])
    cond = F.lit(True)
    for k in _on(keys):
        cond = cond & left[k].eqNullSafe(right[f"__r_{k}"])
    return left.join(right, cond, "left").drop(*[f"__r_{k}" for k in _on(keys)])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column],
) -> DataFrame:
    """Add inclusive running sums of ``sums`` within each group."""
    exprs = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    cut = sliced(df, keys, order)
    w = Window.partitionBy(*_on(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(e).over(w).alias(n) for n, e in exprs.items()])
    totals = cut.groupBy(*_on(keys)).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in exprs.items()])
    before = _edges(totals, keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *_on(keys), *[F.sum(f"__t_{n}").over(before).alias(f"__b_{n}") for n in exprs])
    out = _join_slices(local, carried, keys)
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[F.when(F.col(n).isNull() & F.col(f"__b_{n}").isNull(), F.lit(None))
          .otherwise(F.coalesce(n, zero) + F.coalesce(f"__b_{n}", zero)).alias(n) for n in exprs])


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], test: Column, before: str, total: str) -> DataFrame:
    """Add how many rows of the group up to this one pass ``test``, and how many of the whole group."""
    cut = sliced(df, keys, order)
    one = F.when(test, 1).otherwise(0).cast("long")
    w = Window.partitionBy(*_on(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__own", F.sum(one).over(w))
    per = cut.groupBy(*_on(keys)).agg(F.sum(one).alias("__t"))
    ahead = _edges(per, keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*_on(keys), F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__b"),
                         F.sum("__t").over(Window.partitionBy(*keys)).alias(total))
    return _join_slices(local, carried, keys).select(*df.columns, (F.col("__own") + F.col("__b")).alias(before), total)


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position of each row within its group."""
    cut = sliced(df, keys, order)
    local = cut.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*_on(keys)).orderBy(*order)).cast("long"))
    sizes = cut.groupBy(*_on(keys)).agg(F.count(F.lit(1)).alias("__n"))
    before = _edges(sizes, keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*_on(keys), F.sum("__n").over(before).alias("__b"))
    return _join_slices(local, carried, keys).select(
        *df.columns, (F.col("__rn") + F.coalesce("__b", F.lit(0))).alias(name))


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], step: int,
) -> DataFrame:
    """Add the previous (step=-1) or next (step=1) row's values within the group."""
    assert step in (-1, 1)
    shift = F.lag if step < 0 else F.lead
    cut = sliced(df, keys, order)
    w = Window.partitionBy(*_on(keys)).orderBy(*order)
    payload = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    local = cut.select("*", shift(payload).over(w).alias("__near"))
    rank = F.struct(*order)
    edge = F.max_by(payload, rank) if step < 0 else F.min_by(payload, rank)
    ends = cut.groupBy(*_on(keys)).agg(edge.alias("__edge"))
    carried = ends.select(*_on(keys), shift("__edge").over(_edges(ends, keys)).alias("__far"))
    out = _join_slices(local, carried, keys)
    near = F.coalesce("__near", "__far")
    return out.select(*df.columns, *[near[n].alias(n) for n in values])


DIGIT = 16  # bits of a value that one pass of the selection settles


def ordered_bits(value: Column, kind: T.DataType) -> Column:
    """A long that orders, bit by bit from the top and without sign, as the values do. Integers, decimals of up to 18 digits,
    timestamps, dates and floating-point numbers; -0.0 counts as 0.0."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size = F.abs(value.cast("double"))
        near = F.floor(F.log2(size)).cast("int")
        up, down = F.pow(F.lit(2.0), near + 1) <= size, F.pow(F.lit(2.0), near) > size
        power = F.greatest(F.lit(-1022), F.when(up, near + 1).when(down, near - 1).otherwise(near))
        whole = ((power + 1022).cast("long") * (1 << 52)) + (size / F.pow(F.lit(2.0), power) * float(1 << 52)).cast("long")
        bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(whole)
        signed = F.when(value < 0, -bits).otherwise(bits)
    elif isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise ValueError("decimals of more than 18 digits")
        signed = (value * F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast("long")
    elif isinstance(kind, T.TimestampType):
        signed = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        signed = F.unix_date(value).cast("long")
    else:
        signed = value.cast("long")
    return signed.bitwiseXOR(F.lit(-1 << 63))


def _select(rows: DataFrame, keys: Sequence[str], value: str, bits: str, top: int, wanted: Mapping[str, float]) -> DataFrame:
    """(keys, a column per wanted fraction): exact nearest ranks by radix selection.

    The values share all bits above the lowest `top`. A pass counts them by their next DIGIT bits, combined on the map side, finds the bucket
    that holds each rank in at most 2^DIGIT counts of a group, and the next pass looks into that bucket only.
    """
    picks, name, rank, before = None, "__name", "__rank", "__before"
    for done in range(0, max(top, 1), DIGIT):
        shift = max(0, top - done - DIGIT)
        prefix = F.shiftrightunsigned(bits, shift)
        first = F.struct(F.col("__p"), (F.col("__cum") - F.col("__c")).alias(before), F.col("__v"))
        if picks is None:
            counted = rows.groupBy(*keys, prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__c"), F.min(value).alias("__v"))
            w = Window.partitionBy(*keys)
            counted = counted.select("*", F.sum("__c").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)).alias("__cum"),
                                     F.sum("__c").over(w).alias("__n"))
            ranks = {n: F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * F.col("__n")).cast("long")) for n, p in wanted.items()}
            found = counted.groupBy(*keys).agg(*[F.min(F.when(F.col("__cum") >= r, F.struct(r.alias(rank), first.alias("at")))).alias(n)
                                                 for n, r in ranks.items()])
            found = found.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.col(n).alias("f")) for n in wanted])).alias("e"))
            picks = found.select(*keys, f"e.{name}", f"e.f.{rank}", "e.f.at.*")
        else:
            inside = rows.withColumn("__p", F.shiftrightunsigned(bits, shift + min(DIGIT, top - done)))
            inside = equi_join(inside, picks.drop("__v"), [*keys, "__p"], "inner")
            counted = inside.groupBy(*keys, name, rank, before, prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__c"), F.min(value).alias("__v"))
            w = Window.partitionBy(*keys, name).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
            counted = counted.withColumn("__cum", F.col(before) + F.sum("__c").over(w))
            found = counted.groupBy(*keys, name, rank).agg(F.min(F.when(F.col("__cum") >= F.col(rank), first)).alias("at"))
            picks = found.select(*keys, name, rank, "at.*")
    return picks.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col("__v"))).alias(n) for n in wanted])


def nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, tuple[str, float]],
    aggs: Sequence[Column] = (),
) -> DataFrame:
    """Group by ``keys`` with ``aggs`` plus nearest-rank percentiles, exact for groups of any size.

    ``ranks`` maps an output name to (value column, fraction). NULL and NaN values do not count; a group without values gives NULL. The
    rows are written once, so select what is needed before; one more job finds how many bits the values differ in, which sets the number of
    passes (one for values within 2^16 of each other, at most four).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(dict.fromkeys(c for c, _ in ranks.values()))

    def finite(c: str) -> Column:
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) if isinstance(types[c], (T.DoubleType, T.FloatType)) else F.col(c)

    rows = written(df.withColumns({f"__b{i}": ordered_bits(finite(c), types[c]) for i, c in enumerate(columns)}), "ranked")
    ends = rows.agg(*[f(f"__b{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("low", F.min), ("high", F.max))]).first()
    out = rows.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__rows"))
    for i, column in enumerate(columns):
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        wanted = {n: p for n, (c, p) in ranks.items() if c == column}
        if low is None:
            out = out.withColumns({n: F.lit(None).cast(types[column]) for n in wanted})
            continue
        top = ((low ^ high) & ((1 << 64) - 1)).bit_length()
        valued = rows.where(F.col(f"__b{i}").isNotNull())
        out = equi_join(out, _select(valued, keys, column, f"__b{i}", top, wanted), keys, "left")
    return out.drop("__rows")


def equi_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, nulls: bool = True
) -> DataFrame:
    """Join on ``keys``; right keys are dropped.

    NULL keys are equal, as in a grouping. Where keys cannot be NULL, pass
    ``nulls=False``: plain equality lets Spark keep the partitioning that a
    grouping or window on the same keys has already made.
    """
    tagged = right.select(*[F.col(k).alias(f"__j_{k}") for k in keys],
                          *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        a, b = left[k], tagged[f"__j_{k}"]
        cond = cond & (a.eqNullSafe(b) if nulls else a == b)
    joined = left.join(tagged, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__j_{k}" for k in keys])
