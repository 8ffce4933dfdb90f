"""Operator 7: a reproducible shuffle by a Feistel permutation with cycle walking.

Rows get global row numbers 0..n-1. A keyed Feistel network permutes the smallest
rectangle of about sqrt(n) x sqrt(n) cells that holds them; a number that lands
outside 0..n-1 walks on through the permutation until it is inside. Shard and slot
follow by division, so both can be computed from a row number alone, and a row
number from shard and slot by the inverse.

Law ``rows``: shard sizes differ by one row at most, slots have no gaps.

Row numbers: rows are ordered by a hash of id, size and checksum inside about sqrt(n)
hash buckets; bucket totals (about sqrt(n) rows, broadcast) give the offsets. Equal
rows are interchangeable. Nulls: a null text has no bytes; null ids are ordinary
values. An empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyframe.session import materialize

ROUNDS = 6
#: Steps of a walk; the chance of a longer one is nil (see ``permute``) and raises an error.
WALK = 64


def _mix(value: Column, round_: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed), F.lit(round_)), F.lit(modulus).cast("long"))


def _turn(round_: int, rows: int, cols: int, seed: int, backward: bool):
    """One round: the halves take turns in being moved by a hash of the other one."""

    def left(s: Column) -> Column:
        shift = _mix(s["r"], round_, seed, rows)
        return F.struct(F.pmod(s["l"] - shift if backward else s["l"] + shift, F.lit(rows).cast("long")).alias("l"), s["r"].alias("r"))

    def right(s: Column) -> Column:
        shift = _mix(s["l"], round_, seed, cols)
        return F.struct(s["l"].alias("l"), F.pmod(s["r"] - shift if backward else s["r"] + shift, F.lit(cols).cast("long")).alias("r"))

    return right if round_ % 2 else left


def _network(x: Column, rows: int, cols: int, seed: int, backward: bool = False) -> Column:
    right = F.pmod(x, F.lit(cols).cast("long"))
    left = ((x - right) / F.lit(cols)).cast("long")
    state = F.struct(left.alias("l"), right.alias("r"))
    for k in (range(ROUNDS - 1, -1, -1) if backward else range(ROUNDS)):
        state = F.transform(F.array(state), _turn(k, rows, cols, seed, backward))[0]
    return F.transform(F.array(state), lambda s: s["l"] * F.lit(cols).cast("long") + s["r"])[0]


def permute(x: Column, n: int, seed: int = 42, backward: bool = False) -> Column:
    """The place of row number ``x`` of ``n`` in the shuffle (or back again).

    The rectangle has fewer than sqrt(n)+1 cells too many, so for n up to 4096 a walk
    cannot be longer than ``WALK`` steps and beyond that a step stays outside with a
    chance below 1/sqrt(n); a longer walk raises an error instead of a wrong place.
    """
    rows = max(1, math.isqrt(max(n - 1, 0)) + 1)
    cols = max(1, -(-n // rows))
    first = _network(x, rows, cols, seed, backward)
    # the walk: nearly all rows are inside at once, and a step is only taken outside
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first,
                         lambda at, _: F.when(at < F.lit(n), at).otherwise(_network(at, rows, cols, seed, backward)))
    return F.when(first < F.lit(n), first).otherwise(
        F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("a walk of the permutation did not end")).cast("long")))


def number_rows(base: DataFrame, n: int, order: list[str], column: str = "row_number") -> DataFrame:
    """Global row numbers 0..n-1 that depend on the rows alone."""
    buckets = math.isqrt(n) + 1
    h = F.xxhash64(F.lit("number"), *order)
    keyed = base.withColumns({"_h": h, "_bucket": F.pmod(h, F.lit(buckets))})
    totals = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_h", *order)
    return (keyed.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
            .join(F.broadcast(offsets), "_bucket")  # isqrt(n) + 1 rows at most
            .withColumn(column, F.col("_before") + F.col("_rank"))
            .drop("_h", "_bucket", "_rank", "_before"))


def shard_rows(df: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, row_number, position, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col), (F.octet_length(text).cast("long") + F.lit(8)).alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"))
    base = materialize(base, "shard-base")
    n = base.count()
    numbered = number_rows(base, n, [id_col, "text_crc32", "size"])
    placed = numbered.withColumn("position", permute(F.col("row_number"), n, seed))
    return placed.withColumns({"shard": F.pmod("position", F.lit(shards)).cast("int"),
                               "slot": ((F.col("position") - F.pmod("position", F.lit(shards))) / F.lit(shards)).cast("long")})
