"""Bootstrap intervals for effect sizes (I10, L16 helper).

Resampling n rows with replacement is replaced by Poisson(1) weights per row and
replicate (the standard large-data bootstrap). Equal rows are counted first: a sum
of c Poisson(1) weights is Poisson(c), so every distinct value (or cell) is drawn
once per replicate from its count.

The weights come from a counter-based generator: the key of a value is a hash of seed,
predictor and value, replicate k takes the k-th number of that key's stream. They are made
as a matrix for a block of values and all replicates at once, and do not depend on blocks,
partitioning or recomputed executors. What a block adds is a small summary (a vector of
replicates for each sum); summaries are merged by a tree, 64 at a time, so no task holds
more than one block of weights and a few vectors a predictor, however many values there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one block: a matrix of BLOCK x replicates is made at a time.
BLOCK = 256
#: Summaries merged at once.
FAN = 64
#: Counts up to this one are drawn with a lookup table of 16 bits.
LOOKUP = 32
#: Counts above this one are drawn by the normal law with a correction of the skew (within 0.001 of a unit).
NORMAL = 10_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ----------------------------------------------------------------- weights

def _numbers(keys: np.ndarray, n: int) -> np.ndarray:
    """(keys x n) uniform 32-bit numbers: the streams of the keys (splitmix64, two numbers a step)."""
    with np.errstate(over="ignore"):
        z = keys[:, None] + (np.arange(1, (n + 1) // 2 + 1, dtype=np.uint64) * _GOLDEN)[None, :]
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z.view(np.uint32)[:, :n]


@lru_cache(maxsize=1024)
def _poisson_bounds(c: int) -> tuple[int, np.ndarray]:
    """(lowest value, bounds): a number u of 32 bits gives the lowest value plus the bounds that are at most u."""
    reach = 14 * int(np.sqrt(c)) + 30
    low, high = max(0, c - reach), c + reach
    k = np.arange(low, high + 1, dtype=float)
    # from the mode outwards by the ratio of neighbours
    mode = c - low
    up = np.cumprod(c / k[mode + 1:])
    down = np.cumprod(k[mode:0:-1] / c)[::-1] if mode else np.zeros(0)
    mass = np.concatenate([down, [1.0], up])
    bounds = np.floor(np.cumsum(mass / mass.sum()) * 2.0**32)
    return low, bounds[bounds < 2.0**32].astype(np.uint32)


@lru_cache(maxsize=LOOKUP)
def _poisson_lookup(c: int) -> tuple[np.ndarray, np.ndarray]:
    """(value by the upper 16 bits, whether the lower bits decide)."""
    low, bounds = _poisson_bounds(c)
    upper = np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
    first = np.searchsorted(bounds, upper, side="right")
    return (low + first).astype(np.float32), first != np.searchsorted(bounds, upper | np.uint32(0xFFFF), side="right")


@lru_cache(maxsize=1)
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, quantiles) of the normal law on a fine grid."""
    z = np.linspace(-6.5, 6.5, 130_001)
    return np.array([0.5 * math.erfc(-x / math.sqrt(2.0)) for x in z]), z


def _large_poisson(c: int, u: np.ndarray) -> np.ndarray:
    z = np.interp((u + 0.5) / 2.0**32, *_normal_table())
    return np.rint(c + math.sqrt(c) * z + (z * z - 1.0) / 6.0)


def poisson_weights(keys: np.ndarray, counts: np.ndarray, n_boot: int) -> np.ndarray:
    """(values x replicates): Poisson(count) weights of each value, from the stream of its key."""
    u = _numbers(keys.astype(np.int64).view(np.uint64), n_boot)
    out = np.zeros(u.shape)
    for c in np.unique(counts):
        if c <= 0:
            continue
        rows = slice(None) if (counts == c).all() else np.flatnonzero(counts == c)
        own = u[rows]
        if c > NORMAL:
            out[rows] = _large_poisson(int(c), own)
            continue
        low, bounds = _poisson_bounds(int(c))
        if c <= LOOKUP:
            value, open_ = _poisson_lookup(int(c))
            upper = own >> np.uint32(16)
            w = value[upper]
            unsure = open_[upper]
            if unsure.any():
                w[unsure] = low + np.searchsorted(bounds, own[unsure], side="right")
        else:
            w = low + np.searchsorted(bounds, own, side="right")
        out[rows] = w
    return out


def _key(seed: int, *cols):
    """The stream key of a value, made on the JVM side."""
    return F.xxhash64(F.lit(int(seed)), *cols).alias("key")


# ----------------------------------------------------------------- merging

def _pack(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, "<f8").tobytes()


def _unpack(b: bytes, n_boot: int) -> np.ndarray:
    return np.frombuffer(b, "<f8").reshape(-1, n_boot)


def _merged(parts: DataFrame, n_boot: int, merge, finish) -> DataFrame:
    """(column, rep, r) from summaries (column, part, sums): merged in order of ``part``, FAN at a time, then finished."""

    def some(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [_unpack(b, n_boot) for b in pdf.sort_values("part", kind="stable")["sums"]]
        return pd.DataFrame({"column": [key[0]], "part": [key[1]], "sums": [_pack(merge(rows))]})

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = finish(merge([_unpack(b, n_boot) for b in pdf.sort_values("part", kind="stable")["sums"]]))
        ok = np.isfinite(r)
        return pd.DataFrame({"column": key[0], "rep": np.flatnonzero(ok).astype("int32"), "r": r[ok]})

    parts = parts.groupBy("column", F.floor(F.col("part") / FAN).cast("int").alias("above")).applyInPandas(some, "column string, part int, sums binary")
    return parts.groupBy("column").applyInPandas(last, "column string, rep int, r double")


def _added(rows: list[np.ndarray]) -> np.ndarray:
    """Sums of summaries; the first holds the shape."""
    return np.sum(rows, axis=0)


# ----------------------------------------------------------------- the statistics

def pearson_replicates(long: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``long``: (column string, x double, y double) over complete pairs.

    Returns (column, rep, r) for every replicate where r is defined. x and y are
    centred on their means first, so large offsets cost no digits.
    """
    B = int(n_boot)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for c, rows in pdf.groupby("column").indices.items():
                own = pdf.iloc[rows]
                dx, dy = (own["x"] - own["mx"]).to_numpy(), (own["y"] - own["my"]).to_numpy()
                basis = np.stack([np.ones(len(dx)), dx, dy, dx * dx, dy * dy, dx * dy])
                keys, counts = own["key"].to_numpy(), own["n"].to_numpy()
                for k in range(0, len(dx), BLOCK):
                    part = basis[:, k:k + BLOCK] @ poisson_weights(keys[k:k + BLOCK], counts[k:k + BLOCK], B)
                    acc[c] = acc[c] + part if c in acc else part
        if acc:
            yield pd.DataFrame({"column": list(acc), "part": TaskContext.get().partitionId(), "sums": [_pack(v) for v in acc.values()]})

    def finish(s: np.ndarray) -> np.ndarray:
        n, sx, sy, sxx, syy, sxy = s
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((n >= 3) & (vx > 0) & (vy > 0), (n * sxy - sx * sy) / (np.sqrt(vx) * np.sqrt(vy)), np.nan)

    pairs = long.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("key", _key(seed, "column", "x", "y"))
    means = long.groupBy("column").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    # one row per predictor: a bounded broadcast
    parts = pairs.join(F.broadcast(means), "column").mapInPandas(draw, "column string, part int, sums binary")
    return _merged(parts, B, _added, finish)


def _ordered_merge(rows: list[np.ndarray]) -> np.ndarray:
    """Summaries (w1, w0, U) of neighbouring stretches of values, lowest first, as one: pairs across
    stretches are the class-1 weights above times the class-0 weights below."""
    w1, w0, u = (np.array(x) for x in rows[0])
    for v1, v0, v in rows[1:]:
        u += v + v1 * w0
        w1 += v1
        w0 += v0
    return np.stack([w1, w0, u])


def rank_biserial_replicates(counts: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``counts``: (column, bucket, value double, c1 long, c0 long), buckets in value order.

    Returns (column, rep, r) with r = 2·U1/(n1·n0) − 1 of each resampled table, over
    the values themselves. The values of a bucket stream through one task in order; a block
    gives, per replicate, its weights of both classes and the U of its own pairs.
    """
    B = int(n_boot)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            # rows are sorted: a run of rows of one bucket is a slice
            turn = np.flatnonzero((pdf["column"].to_numpy()[1:] != pdf["column"].to_numpy()[:-1]) | (pdf["bucket"].to_numpy()[1:] != pdf["bucket"].to_numpy()[:-1])) + 1
            for a, b in zip([0, *turn], [*turn, len(pdf)]):
                own = pdf.iloc[a:b]
                here = (own["column"].iloc[0], int(own["bucket"].iloc[0]))
                if here != at:
                    if at is not None:
                        out.append((*at, _pack(now)))
                    at, now = here, np.zeros((3, B))
                k1, k0, c1, c0 = (own[c].to_numpy() for c in ("key1", "key", "c1", "c0"))
                for k in range(0, len(own), BLOCK):
                    s = slice(k, k + BLOCK)
                    one, zero = poisson_weights(k1[s], c1[s], B), poisson_weights(k0[s], c0[s], B)
                    below = np.cumsum(zero, 0)
                    total = below[-1].copy()
                    below -= 0.5 * zero
                    now = _ordered_merge([now, np.stack([one.sum(0), total, np.einsum("ij,ij->j", one, below)])])
            if out:
                yield pd.DataFrame(out, columns=["column", "part", "sums"])
        if at is not None:
            yield pd.DataFrame([(*at, _pack(now))], columns=["column", "part", "sums"])

    def finish(s: np.ndarray) -> np.ndarray:
        n1, n0, u = s
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((n1 >= 2) & (n0 >= 2), 2.0 * u / (n1 * n0) - 1.0, np.nan)

    rows = counts.select("column", "bucket", "value", "c1", "c0", F.xxhash64(F.lit(int(seed)), "column", "value", F.lit(1)).alias("key1"), _key(seed, "column", "value"))
    rows = rows.repartition("column", "bucket").sortWithinPartitions("column", "bucket", "value")
    return _merged(rows.mapInPandas(draw, "column string, part int, sums binary"), B, _ordered_merge, finish)


def cramers_v_replicates(cells: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``cells``: (column, y, x, n), y with few levels.  Returns (column, rep, r) with r = Cramér's V
    (no continuity correction) of each resampled table; levels absent from a
    resample drop out of that table, as they would from a cross-tabulation.

    With row sums r, column sums c and weights w, chi-square / N = Σ w²/(r·c) − 1. The sum
    over x of w²/c is additive over the levels of x, so one pass with the cells of a level side
    by side gives all: for each y the vectors r and Σ w²/c, and the number of levels seen.
    What is shuffled is the cells, once; their weights never are.
    """
    B = int(n_boot)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        acc: dict[tuple[str, str], np.ndarray] = {}
        levels: dict[str, np.ndarray] = {}

        def add(column: str, own: pd.DataFrame) -> None:
            """Whole levels of one predictor, in order of x."""
            x = own["x"].to_numpy()
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            ends = np.r_[starts[1:], len(own)]
            k = 0
            while k < len(starts):
                # as many whole levels as fill a block
                stop = max(int(np.searchsorted(ends, ends[k] - 1 + BLOCK, side="right")), k + 1)
                a, b = starts[k], ends[stop - 1]
                w = poisson_weights(own["key"].to_numpy()[a:b], own["n"].to_numpy()[a:b], B)
                across = np.add.reduceat(w, starts[k:stop] - a, axis=0)
                per = np.repeat(across, ends[k:stop] - starts[k:stop], axis=0)
                share = np.divide(w * w, per, out=np.zeros_like(w), where=per > 0)
                levels[column] = levels.get(column, 0) + (across > 0).sum(0)
                y = own["y"].to_numpy()[a:b]
                for v in np.unique(y):
                    part = np.stack([w[y == v].sum(0), share[y == v].sum(0)])
                    acc[column, v] = acc.get((column, v), 0) + part
                k = stop

        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            # the last level may go on in the next batch
            open_ = (pdf["column"] == pdf["column"].iloc[-1]) & (pdf["x"] == pdf["x"].iloc[-1])
            rest = pdf[open_]
            for c, own in pdf[~open_].groupby("column", sort=False):
                add(c, own)
        if rest is not None:
            for c, own in rest.groupby("column", sort=False):
                add(c, own)
        part = TaskContext.get().partitionId()
        rows = [(c, part, y, _pack(v)) for (c, y), v in acc.items()] + [(c, part, None, _pack(v)) for c, v in levels.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["column", "part", "y", "sums"])

    def some(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = _added([_unpack(b, B) for b in pdf.sort_values("part", kind="stable")["sums"]])
        return pd.DataFrame({"column": [key[0]], "part": [key[2]], "y": [key[1]], "sums": [_pack(total)]})

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        width = _added([_unpack(b, B) for b in pdf.loc[pdf["y"].isna(), "sums"]])[0]
        n, terms, height = np.zeros(B), np.zeros(B), np.zeros(B)
        for _, own in pdf[pdf["y"].notna()].groupby("y", sort=True):
            r, q = _added([_unpack(b, B) for b in own["sums"]])
            n += r
            height += r > 0
            terms += np.divide(q, r, out=np.zeros(B), where=r > 0)
        least = np.minimum(height, width)
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.where(least >= 2, np.sqrt(np.maximum(terms - 1.0, 0.0) / (least - 1)), np.nan)
        ok = np.isfinite(v)
        return pd.DataFrame({"column": key[0], "rep": np.flatnonzero(ok).astype("int32"), "r": v[ok]})

    rows = cells.select("column", F.col("y").cast("string").alias("y"), F.col("x").cast("string").alias("x"), "n").where("y is not null and x is not null")
    rows = rows.withColumn("key", _key(seed, "column", "y", "x")).repartition("column", "x").sortWithinPartitions("column", "x", "y")
    kind = "column string, part int, y string, sums binary"
    parts = rows.mapInPandas(draw, kind)
    parts = parts.groupBy("column", "y", F.floor(F.col("part") / FAN).cast("int").alias("above")).applyInPandas(some, kind)
    return parts.groupBy("column").applyInPandas(last, "column string, rep int, r double")


def percentile_ci(reps: DataFrame, n_boot: int, ci_level: float) -> dict:
    """Column → (ci_low, ci_high) from replicate values (linear percentiles), or
    (None, None) when fewer than max(10, 10% of n_boot) replicates are valid."""
    a = (1.0 - ci_level) / 2.0
    rows = reps.groupBy("column").agg(
        F.count("r").alias("k"), F.percentile("r", F.array(F.lit(a), F.lit(1.0 - a))).alias("q")).collect()
    need = max(10, int(n_boot * 0.10))
    out = {}
    for r in rows:
        out[r["column"]] = (r["q"][0], r["q"][1]) if r["k"] >= need else (None, None)
    return out
