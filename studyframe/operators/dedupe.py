"""Duplicate detection over complete, normalised keys (K1–K5).

A window ``partitionBy(keys)`` would sort every member of a key group inside one
task, so a key holding a third of the rows would sit in one task.  Instead the
group facts the masks need — first source order and group size — are computed
with ``groupBy`` (partial aggregation before the shuffle, so a hot key sends one
row per map task) and joined back on the keys; AQE's skew-join splits a hot key
on the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X


def _as_list(id_cols):
    if id_cols is None:
        return []
    if isinstance(id_cols, str):
        return [id_cols]
    return list(id_cols)


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def masks(df: DataFrame, id_cols, order_cols) -> DataFrame:
    """Adds ``_dup_later`` (later member of a duplicate group) and ``_dup_group``
    (any member of a group of two or more); rows with an incomplete key are never
    duplicates.  ``order_cols`` fix what "first" means.
    """
    id_cols = _as_list(id_cols)
    if not id_cols:
        return df.withColumns({"_dup_later": F.lit(False), "_dup_group": F.lit(False)})
    missing = [c for c in id_cols if c not in df.columns]
    if missing:
        raise ValueError(f"ID columns not found: {missing}")
    order_cols = _as_list(order_cols)
    if not order_cols:
        raise ValueError("an explicit source order is required to tell first from later rows")
    keys = [X.key_normalise(c, _is_text(df, c)) for c in id_cols]
    parts = []
    for k, c in zip(keys, id_cols):
        text = (k + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else k).cast("string")
        parts += [F.length(text).cast("string"), text]  # lengths keep neighbours apart
    whole = parts[1].isNotNull()
    for p in parts[3::2]:
        whole &= p.isNotNull()
    # a digest is the key, so texts are not shuffled for it
    keyed = df.withColumns({"_key": F.when(whole, F.sha2(F.concat_ws(":", *parts), 256)),
                            "_ord": F.struct(*[F.col(c) for c in order_cols])})
    groups = (keyed.where(F.col("_key").isNotNull()).groupBy("_key")
              .agg(F.min("_ord").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    # an incomplete key meets no digest; it is spread by the order so that such rows do not share a task
    apart = F.concat(F.lit("~"), F.xxhash64("_ord").cast("string"))
    joined = keyed.withColumn("_on", F.coalesce("_key", apart)).drop("_key").join(groups.withColumnRenamed("_key", "_on"), "_on", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("_n").isNotNull().alias("_dup_group"),
        F.coalesce(F.col("_ord") > F.col("_first"), F.lit(False)).alias("_dup_later"),
    )


def report(df: DataFrame, id_cols, order_cols, include_first: bool = True) -> DataFrame:
    """K3: rows in duplicate groups (``include_first``) or later duplicates only."""
    m = masks(df, id_cols, order_cols)
    flag = "_dup_group" if include_first else "_dup_later"
    return m.where(F.col(flag)).drop("_dup_group", "_dup_later")


def drop_later(df: DataFrame, id_cols, order_cols) -> DataFrame:
    """K4: drop later duplicates; incomplete keys are always kept."""
    if not _as_list(id_cols):
        return df
    return masks(df, id_cols, order_cols).where(~F.col("_dup_later")).drop("_dup_group", "_dup_later")


def encounter_overview(df: DataFrame, id_cols) -> DataFrame:
    """K5: unique vs repeat encounters over the raw key values (NULLs compare equal)."""
    id_cols = _as_list(id_cols)
    if not id_cols:
        raise ValueError("encounter_overview needs at least one ID column")
    # count(DISTINCT struct) groups NULL fields as equal, like pandas on raw values.
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*id_cols)).alias("u"))
    return agg.select(
        F.col("n").alias("n_rows"),
        F.col("u").alias("n_unique"),
        (F.col("n") - F.col("u")).alias("n_repeat"),
        F.coalesce(F.round(F.try_divide(F.col("u") * 100.0, F.col("n")), 2), F.lit(0.0)).alias("unique_pct"),
        F.coalesce(F.round(F.try_divide((F.col("n") - F.col("u")) * 100.0, F.col("n")), 2), F.lit(0.0)).alias("repeat_pct"),
    )
