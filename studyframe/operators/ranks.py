"""Values at wanted ranks, and value statistics, without shuffling whole columns.

``select`` finds exact order statistics by narrowing brackets:

1. a quantile sketch gives cuts just below and above every wanted place;
2. one pass counts (and adds up) the rows between and on the cuts, exactly: a few rows a column;
3. only rows strictly inside a bracket that holds a wanted rank are shuffled, about 6 / ACCURACY
   of the column a bracket. A rank that falls on a cut needs none. A bracket that still holds more
   than ``MOST_INSIDE`` rows is narrowed again in the same way.

The sketch only decides how much is shuffled: counts are exact, so the values are, too.

``value_stats`` gives exact distinct counts and modes, for which every distinct value has to meet
its likes once. Values travel as sorted, packed arrays with their counts, some two bytes a value.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the quantile sketch: ranks are known to within 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Rows inside one bracket that a task sorts at most; a fuller bracket is narrowed again.
MOST_INSIDE = 20_000_000


@dataclass
class Hit:
    """The value at a rank; of its piece (a cut or the rows between two cuts) the rows and sum up to it."""

    piece: int
    value: float
    same: int
    upto: int
    sum_upto: float


@dataclass
class Selection:
    """Rows (nulls left out), pieces [(number, rows, sum)] in value order, and hits by rank, of one column."""

    n: int
    pieces: list[tuple[int, int, float]] = field(default_factory=list)
    hits: dict[int, Hit] = field(default_factory=dict)

    def value(self, rank: int) -> float:
        return self.hits[rank].value

    def quantile(self, q: float) -> float | None:
        """Linear between the two neighbouring ranks."""
        if not self.n:
            return None
        h = (self.n - 1) * q
        a, b = self.value(math.floor(h)), self.value(math.ceil(h))
        return a + (b - a) * (h - math.floor(h))

    def trimmed_mean(self, k: int) -> float | None:
        """Mean of the values of ranks k to n-1-k."""
        if not self.n:
            return None
        low, high = self.hits[k], self.hits[self.n - 1 - k]
        if low.value == high.value:
            return low.value
        rows = {p: (n, s) for p, n, s in self.pieces}
        before = {p: sum(n for q, n, _ in self.pieces if q < p) for p in (low.piece, high.piece)}
        if low.piece == high.piece:
            between = high.sum_upto - high.value * high.same - low.sum_upto
        else:
            # the rest of the lower piece, whole pieces, the start of the upper piece
            between = (rows[low.piece][1] - low.sum_upto) + sum(s for p, _, s in self.pieces if low.piece < p < high.piece) + (high.sum_upto - high.value * high.same)
        at_low = before[low.piece] + low.upto - k
        below_high = before[high.piece] + high.upto - high.same
        return (between + low.value * at_low + high.value * (self.n - k - below_high)) / (self.n - 2 * k)


def quantile_ranks(n: int, quantiles: Iterable[float]) -> set[int]:
    """Ranks that linear quantiles of n rows need."""
    return {f((n - 1) * q) for q in quantiles for f in (math.floor, math.ceil)} if n else set()


def sketch_places(near: Iterable[float]) -> list[float]:
    """Probabilities just below and above the wanted places."""
    return sorted({min(max(p + d / ACCURACY, 0.0), 1.0) for p in near for d in (-3, 3)})


def select(df: DataFrame, values: dict[str, Column], near: Iterable[float], ranks_of: Callable[[str, int], Iterable[int]],
           known: dict[str, tuple[int, list[float]]] | None = None) -> dict[str, Selection]:
    """Exact values of each column in ``values`` (double) at the 0-based ranks ``ranks_of(name, rows)``.

    ``near`` says about where the ranks lie (shares of the rows), ``known`` may bring rows and
    sketch cuts of a pass that ran already. Nulls are left out, NaN is the largest value.
    """
    names = list(values)
    if not names:
        return {}
    x = {c: values[c].cast("double") + F.lit(0.0) for c in names}
    if known is None:
        probs = sketch_places(near)
        row = df.agg(*[a for i, c in enumerate(names) for a in (F.count(x[c]).alias(f"n{i}"), F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"b{i}"),
                                                                F.percentile_approx(x[c], probs, ACCURACY).alias(f"q{i}"))]).first()
        known = {c: (int(row[f"n{i}"]), [row[f"a{i}"], row[f"b{i}"], *(row[f"q{i}"] or [])]) for i, c in enumerate(names)}
    out = {c: Selection(known[c][0]) for c in names}
    wanted = {c: sorted({int(k) for k in ranks_of(c, known[c][0])}) if known[c][0] else [] for c in names}
    names = [c for c in names if wanted[c]]
    if not names:
        return out
    cuts = {c: sorted({float(v) for v in known[c][1] if v is not None and math.isfinite(v)}) for c in names}
    splits = {c: [-math.inf, *cuts[c], math.inf] if cuts[c] else [-math.inf, 0.0, math.inf] for c in names}
    base = df.select(*[x[c].alias(f"v{i}") for i, c in enumerate(names)])
    base = Bucketizer(splitsArray=[splits[c] for c in names], inputCols=[f"v{i}" for i in range(len(names))], outputCols=[f"b{i}" for i in range(len(names))],
                      handleInvalid="keep").transform(base)

    def piece(i: int, c: str) -> Column:
        """Even: on the cut that the bucket starts with (or NaN), odd: above it."""
        b = F.col(f"b{i}").cast("int")
        start = F.element_at(F.array(*[F.lit(v) for v in splits[c]]), b + 1)
        return b * 2 + F.when((F.col(f"v{i}") == start) | F.isnan(f"v{i}"), 0).otherwise(1)

    cells = F.array(*[F.struct(F.lit(i).alias("at"), piece(i, c).alias("piece"), F.col(f"v{i}").alias("value")) for i, c in enumerate(names)])
    cells = base.select(F.explode(cells).alias("c")).select("c.*").where("value is not null")
    for r in cells.groupBy("at", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).orderBy("at", "piece").collect():
        out[names[r["at"]]].pieces.append((r["piece"], int(r["n"]), r["s"]))

    inside: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, c in enumerate(names):
        sel = out[c]
        ends = np.cumsum([n for _, n, _ in sel.pieces])
        for k in wanted[c]:
            j = int(np.searchsorted(ends, k, side="right"))
            number, n, s = sel.pieces[j]
            if number % 2 == 0:
                value = splits[c][number // 2] if number // 2 < len(splits[c]) - 1 else math.nan
                sel.hits[k] = Hit(number, value, n, n, s)
            else:
                inside.setdefault((i, number), []).append((k, k - int(ends[j] - n)))

    for (i, number), ks in list(inside.items()):
        c = names[i]
        n = next(n for p, n, _ in out[c].pieces if p == number)
        if n > MOST_INSIDE:
            low, high = splits[c][number // 2], splits[c][number // 2 + 1]
            part = df.where((x[c] > F.lit(low)) & ((x[c] < F.lit(high)) if math.isfinite(high) else ~F.isnan(x[c])))
            got = select(part, {c: values[c]}, [k / n for _, k in ks], lambda *_: [k for _, k in ks])[c]
            for k, own in ks:
                hit = got.hits[own]
                earlier = [(m, s) for p, m, s in got.pieces if p < hit.piece]
                out[c].hits[k] = Hit(number, hit.value, hit.same, hit.upto + sum(m for m, _ in earlier), hit.sum_upto + sum(s for _, s in earlier))
            del inside[i, number]
    if inside:
        chosen = None
        for i, number in inside:
            here = (F.col("at") == i) & (F.col("piece") == number)
            chosen = here if chosen is None else chosen | here
        counts = cells.where(chosen).groupBy("at", "piece", "value").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("at", "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ran = counts.withColumns({"upto": F.sum("n").over(upto), "sum_upto": F.sum(F.col("n") * F.col("value")).over(upto)})
        targets = df.sparkSession.createDataFrame([(i, number, k, own) for (i, number), ks in inside.items() for k, own in ks], "at int, piece int, rank long, own long")
        # a few targets a column: a bounded broadcast
        found = ran.join(F.broadcast(targets), ["at", "piece"]).where("own < upto and own >= upto - n")
        for r in found.collect():
            out[names[r["at"]]].hits[int(r["rank"])] = Hit(r["piece"], float(r["value"]), int(r["n"]), int(r["upto"]), float(r["sum_upto"]))
    return out


def quantiles(df: DataFrame, values: dict[str, Column], qs: Iterable[float]) -> dict[str, list[float | None]]:
    """Exact linear quantiles of each column (None without rows)."""
    qs = list(qs)
    got = select(df, values, qs, lambda _, n: quantile_ranks(n, qs))
    return {c: [s.quantile(q) for q in qs] for c, s in got.items()}


# ----------------------------------------------------------------- distinct counts and modes

#: Values that a task holds before it packs them, and values of one part on the other side, about.
HELD, PART = 1 << 21, 1 << 22
_SCALES = (1, 100, 10_000)


def pack_values(v: np.ndarray) -> tuple[bytes, int]:
    """Sorted distinct doubles as compressed differences, and their scale (0: of their bits)."""
    for scale in _SCALES:
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.rint(v * scale)
            if (np.abs(whole) < 2.0**53).all() and (whole / scale == v).all():
                break
    else:
        scale = 0
    ints = whole.astype(np.int64) if scale else v.view(np.int64)
    steps = np.diff(ints, prepend=np.int64(0))
    # equal bytes of all numbers side by side compress best
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True), scale


def unpack_values(b: bytes, scale: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    ints = np.cumsum(np.ascontiguousarray(raw.T).view(np.int64).ravel())
    return ints / scale if scale else ints.view(np.float64)


def _pack_counts(n: np.ndarray) -> bytes:
    return pa.compress(n.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _unpack_counts(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), "<i8")


def _part_of(v: np.ndarray, parts: int) -> np.ndarray:
    """A hash of each value, below ``parts``."""
    with np.errstate(over="ignore"):
        z = v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((z >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _merge_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    n = np.zeros(len(v), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in held]))
    return v, n


def value_stats(df: DataFrame, values: dict[str, Column], rows: dict[str, int]) -> dict[str, tuple[int, int, int, float]]:
    """{column: (distinct values, largest count, values with that count, the smallest of them)}.

    ``rows`` says how many rows each column has; columns are dealt in parts of about PART values.
    """
    names = [c for c in values if rows.get(c)]
    if not names:
        return {}
    parts = [max(1, -(-rows[c] // PART)) for c in names]
    kind = [("column", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("scale", pa.int32()), ("packed", pa.binary()), ("counts", pa.binary())]

    def pack(batches):
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0

        def flush():
            out = []
            for i, own in enumerate(held):
                if own:
                    v, n = np.unique(np.concatenate(own), return_counts=True)
                    part = _part_of(v, parts[i])
                    for p in np.unique(part) if parts[i] > 1 else (0,):
                        at = part == p
                        packed, scale = pack_values(v[at])
                        out.append((i, int(p), int(at.sum()), scale, packed, _pack_counts(n[at])))
                    own.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kind)], [k for k, _ in kind])

        for batch in batches:
            for i in range(len(names)):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                held[i].append(v)
                size += len(v)
            if size >= HELD:
                yield flush()
                size = 0
        if size:
            yield flush()

    def settle(batches):
        at, held, size = None, [], 0

        def stats():
            v, n = _merge_counts(held)
            top = n.max()
            return at[0], len(v), int(top), int((n == top).sum()), float(v[n == top][0])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["column"], r["part"]) != at:
                    if held:
                        out.append(stats())
                    at, held, size = (r["column"], r["part"]), [], 0
                held.append((unpack_values(r["packed"], r["scale"], r["n"]), _unpack_counts(r["counts"], r["n"])))
                size += r["n"]
                if size > 2 * PART:
                    held = [_merge_counts(held)]
                    size = len(held[0][0])
            if out:
                yield _stat_rows(out)
        if held:
            yield _stat_rows([stats()])

    cells = df.select(*[(values[c].cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(names)])
    packed = cells.mapInArrow(pack, "column int, part long, n long, scale int, packed binary, counts binary")
    packed = packed.repartition("column", "part").sortWithinPartitions("column", "part")
    found = packed.mapInArrow(settle, "column int, distinct long, top long, n_top long, first double")
    best = F.max("top").over(Window.partitionBy("column"))  # one row a part
    found = found.withColumn("best", best).groupBy("column").agg(
        F.sum("distinct").alias("distinct"), F.max("top").alias("top"), F.sum(F.when(F.col("top") == F.col("best"), F.col("n_top"))).alias("n_top"),
        F.min(F.when(F.col("top") == F.col("best"), F.col("first"))).alias("first"))
    return {names[r["column"]]: (int(r["distinct"]), int(r["top"]), int(r["n_top"]), float(r["first"])) for r in found.collect()}


def _stat_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["column", "distinct", "top", "n_top", "first"])


# ----------------------------------------------------------------- modes of texts

#: Items that the frequent-items sketch tracks, and candidates that are counted exactly.
TRACKED, CANDIDATES = 10_000, 64


def frequent_modes(df: DataFrame, values: dict[str, Column]) -> tuple[dict[str, tuple[str, int]], list[str]]:
    """({column: (mode, count)}, columns that are not settled); ties go to the smaller value.

    A frequent-items sketch names candidates, a second pass counts them exactly. A value that the
    sketch does not name occurs in at most 2 * 3.5 / TRACKED of the rows (or is rarer than the
    last candidate's estimate); if the best candidate is commoner, the mode is settled.
    """
    names = list(values)
    if not names:
        return {}, []
    x = {c: values[c].cast("string") for c in names}
    row = df.agg(*[a for i, c in enumerate(names) for a in (F.count(x[c]).alias(f"n{i}"), F.call_function("approx_top_k", x[c], F.lit(CANDIDATES), F.lit(TRACKED)).alias(f"k{i}"))]).first()
    named = {c: [(r["item"], int(r["count"])) for r in row[f"k{i}"] or []] for i, c in enumerate(names)}
    asked = [c for c in names if named[c]]
    exact = {}
    if asked:
        cells = F.array(*[F.struct(F.lit(i).alias("at"), x[c].alias("value")) for i, c in enumerate(asked)])
        lists = [F.array(*[F.lit(v) for v, _ in named[c]]) for c in asked]
        cells = df.select(F.explode(F.filter(cells, lambda s: F.array_contains(F.element_at(F.array(*lists), s["at"] + 1), s["value"]))).alias("c")).select("c.*")
        for r in cells.groupBy("at", "value").count().collect():
            exact.setdefault(asked[r["at"]], []).append((-int(r["count"]), r["value"]))
    modes, open_ = {}, []
    for i, c in enumerate(names):
        n = int(row[f"n{i}"])
        if not n:
            continue
        best = min(exact.get(c, [(0, None)]))
        unnamed = max(7 * n / TRACKED, named[c][-1][1] if len(named[c]) >= CANDIDATES else 0)
        # with few values the sketch holds them all, exactly
        if best[1] is not None and -best[0] > unnamed:
            modes[c] = (best[1], -best[0])
        else:
            open_.append(c)
    return modes, open_
