"""Top-k per group without sorting a whole group in one task.

A plain ``row_number() over (partition by g order by …)`` sorts every row of a
group in a single task.  Here rows are first ranked inside ``(g, salt)`` slices
(``salt`` = hash of the row's tie-break value), only the best ``k`` of each slice
survive, and the final rank runs over at most ``salts × k`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group, order, k: int, salt_cols, salts: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group in ``order`` (a list of sort Columns).

    ``order`` must be total (end with a unique tie-break) for a deterministic
    result; ``salt_cols`` pick the slice a row is pre-ranked in (four slices per core).
    """
    group = [group] if isinstance(group, str) else list(group)
    salts = salts or 4 * max(16, df.sparkSession.sparkContext.defaultParallelism)
    salt_cols = [salt_cols] if isinstance(salt_cols, str) else list(salt_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
