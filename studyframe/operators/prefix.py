"""Global prefix sums and consecutive row ids without a single-partition window (G1).

``Window.orderBy(x)`` with no partition moves every row into one task.  Here the
order key is cut into ``B`` ranges at approximate quantiles (the B cut points
reach the driver), each range's totals form a B-row table whose own window
gives every range the totals of the ranges before it, that table is broadcast
back, and the row-level window runs only inside a range.  Everything is a
function of the data values, not of physical partition ids, so a recomputed
task after an executor loss produces identical results.
"""

from __future__ import annotations

import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default_buckets(spark) -> int:
    """Range buckets are window tasks: two per core of the cluster."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return max(1, int(buckets))
    return default_buckets(df.sparkSession)


def accuracy(buckets: int) -> int:
    """Quantile accuracy that resolves so many ranges."""
    return max(1000, 10 * int(buckets))


def _number(df: DataFrame, key: str):
    """A number that never falls as the key rises (text: six bytes after the common start)."""
    kind = df.schema[key].dataType
    k = F.col(f"`{key}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        ends = df.agg(F.min(k).alias("lo"), F.max(k).alias("hi")).first()
        lo, hi = (v.encode() if isinstance(v, str) else bytes(v or b"") for v in (ends["lo"] or "", ends["hi"] or ""))
        same = len(os.path.commonprefix([lo, hi]))
        raw = F.encode(k, "UTF-8") if isinstance(kind, T.StringType) else k
        return F.conv(F.rpad(F.hex(F.substring(raw, same + 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(k.cast("timestamp")).cast("double")
    return k.cast("double")


def with_range_bucket(df: DataFrame, key: str, buckets: int | None = None, out: str = "_rb") -> DataFrame:
    """Adds an integer range bucket of ``key`` (any ordered type): never falls as the key rises, balanced by quantile."""
    b = _bucket_count(df, buckets)
    if b == 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / b for i in range(1, b)]
    number = _number(df, key)
    row = df.agg(F.percentile_approx(number, probs, accuracy(b)).alias("q")).first()
    cuts = sorted({float(v) for v in (row["q"] or []) if v is not None})
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf")] + cuts + [float("inf")]
    tmp = "_rb_key"
    bz = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return bz.transform(df.withColumn(tmp, number)).drop(tmp).withColumn(out, F.col(out).cast("int"))


def _bucket_offsets(b: DataFrame, aggs: dict, order_desc: bool = False) -> DataFrame:
    """Per range bucket, ``aggs`` over the bucket and the same aggregates over all
    earlier (or later) buckets.  The table has one row per bucket (bounded by
    the bucket count), so its window is small and it is broadcast back."""
    tot = b.groupBy("_rb").agg(*[fn(c).alias(c) for c, fn in aggs.items()])
    order = F.col("_rb").desc() if order_desc else F.col("_rb").asc()
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outs = []
    for c, fn in aggs.items():
        outs.append(fn(F.col(c)).over(w).alias(f"_off_{c}"))
    return tot.select("_rb", *outs)


def prefix_sums(df: DataFrame, key: str, sums, tiebreak=(), buckets: int | None = None,
                prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sums`` in ``(key, *tiebreak)`` order, over the whole frame."""
    sums = list(sums)
    b = with_range_bucket(df, key, buckets)
    offs = _bucket_offsets(b, {s: F.sum for s in sums})
    w = (Window.partitionBy("_rb").orderBy(F.col(key), *[F.col(t) for t in tiebreak])
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = b.join(F.broadcast(offs), "_rb", "left")
    for s in sums:
        out = out.withColumn(f"{prefix}{s}", F.coalesce(F.col(f"_off_{s}"), F.lit(0)) + F.sum(s).over(w))
    return out.drop("_rb", *[f"_off_{s}" for s in sums])


def row_index(df: DataFrame, key: str, tiebreak=(), name: str = "row_id", buckets: int | None = None) -> DataFrame:
    """Consecutive 0-based ids in ``(key, *tiebreak)`` order (C2 row ids)."""
    out = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], tiebreak, buckets)
    return out.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one")


def suffix_min(df: DataFrame, key: str, value: str, out: str, tiebreak=(), buckets: int | None = None) -> DataFrame:
    """``out`` = min of ``value`` over all rows at or after this one in ``(key, *tiebreak)`` order.

    Same range-bucket scheme as ``prefix_sums``: the minimum over all later
    buckets comes from the small per-bucket table; a window runs inside a bucket.
    """
    b = with_range_bucket(df, key, buckets)
    offs = _bucket_offsets(b, {value: F.min}, order_desc=True)
    w = (Window.partitionBy("_rb").orderBy(F.col(key), *[F.col(t) for t in tiebreak])
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    inside = F.min(value).over(w)
    later = F.col(f"_off_{value}")
    res = F.when(later.isNull(), inside).otherwise(F.least(inside, later))
    return b.join(F.broadcast(offs), "_rb", "left").withColumn(out, res).drop("_rb", f"_off_{value}")
