"""Column profiles.

All columns of a kind are profiled together: one wide aggregate for moments and
one long ``(column, value, n)`` value-count table for everything that depends on
the distribution of values.  The number of Spark jobs does not grow with the
number of columns.

Exact order statistics never gather a column in one task: values are cut into
per-column ranges at approximate quantiles, counted per ``(column, range,
value)``, and running counts are taken inside a range plus the range's offset.
Only per-column summaries (bounded by columns × ranges) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from . import ranking, ranks
from .prefix import accuracy, default_buckets

BOOKKEEPING = ("included_in_cohort", "row_id", "cohort_exclusion_reason", "target")
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

# Interpretation bands (upper edges are exclusive).
CV_BANDS = ((0.10, 0.30, 0.50, 1.00),
            ("very_low", "low", "moderate", "high"), "extreme")
SKEW_BANDS = ((-0.1, 0.1000000000000001), ("left_skewed", "symmetric"), "right_skewed")
KURT_BANDS = ((-0.5, 0.5000000000000001), ("platykurtic", "mesokurtic"), "leptokurtic")
CARDINALITY_BANDS = ((2, 6, 21, 51, 201), ("constant", "very_low", "moderate", "high", "very_high"), "extreme")
IMBALANCE_BANDS = ((1.5, 3, 10), ("similar", "mild", "strong"), "extreme")
CAT_ENTROPY_BANDS = ((0.1, 1.5, 3.5, 5), ("flatline", "low_diversity", "sweet_spot", "high_chaos"), "white_noise")
CAT_BALANCE_BANDS = ((0.1, 0.4, 0.7, 0.9), ("total_dominance", "heavy_imbalance", "healthy", "broad"), "near_uniform")
BIN_BALANCE_BANDS = ((0.1, 0.3, 0.7), ("total_dominance", "heavy_imbalance", "moderate_imbalance"), "healthy")
BIN_ENTROPY_BANDS = ((0.05, 0.3, 0.7), ("near_constant", "very_low", "moderate"), "high")


def _band(c, spec):
    edges, labels, last = spec
    return X.band(c, edges, labels, last)


def _is_numeric(t) -> bool:
    return isinstance(t, T.NumericType) and not isinstance(t, T.BooleanType)


def unpivot(df: DataFrame, cols, value_type: str = "string") -> DataFrame:
    """Wide → long ``(column, value)``; one output row per input cell."""
    def cell(c):
        x = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            x = x + F.lit(0.0)  # -0.0 and 0.0 are one value
        return x.cast(value_type)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("_u")).select("_u.column", "_u.value")


def value_counts(df: DataFrame, cols, value_type: str = "string", keep_nulls: bool = False) -> DataFrame:
    """``(column, value, n)`` over the non-null values of every column in ``cols``
    (with ``keep_nulls`` also one NULL-value row per column holding its null count,
    so row totals come from the same pass)."""
    u = unpivot(df, cols, value_type)
    if not keep_nulls:
        u = u.where(F.col("value").isNotNull())
    return u.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _rows_and_levels(df: DataFrame, cols):
    """Value counts of non-null values and per-column row totals from one pass."""
    vc_all = value_counts(df, cols, keep_nulls=True)
    rows = vc_all.groupBy("column").agg(F.sum("n").alias("n_rows"))
    return vc_all.where(F.col("value").isNotNull()), rows


def column_catalog(df: DataFrame, cols=None) -> list[dict]:
    """Per column: dtype, metadata, rows, non-null count and levels as 0, 1, 2 or 3 (three or more).

    Routing only tells one, two and more levels apart, which the smallest value, the
    largest one and the number of other values settle exactly, in two aggregates.
    Returns one small dict per column.
    """
    cols = list(cols or df.columns)
    if not cols:
        return []

    def plain(c):  # types without an order are compared as text
        kind = df.schema[c].dataType
        x = F.col(f"`{c}`")
        return F.to_json(x) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else x

    first = df.agg(F.count(F.lit(1)).alias("__rows"),
                   *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[fn(plain(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, fn in (("lo", F.min), ("hi", F.max))]).first()
    other = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.count_if((plain(c) != F.lit(first[f"lo{i}"])) & (plain(c) != F.lit(first[f"hi{i}"]))).alias(f"o{i}")
        for i, c in enumerate(cols) if first[f"lo{i}"] is not None]).first()
    out = []
    for i, c in enumerate(cols):
        f = df.schema[c]
        lo, hi = first[f"lo{i}"], first[f"hi{i}"]
        levels = 0 if lo is None else (1 if lo == hi or lo != lo else 2) + (1 if other[f"o{i}"] else 0)
        out.append({"column": c, "dtype": f.dataType.simpleString(), "metadata": dict(f.metadata or {}),
                    "n_rows": int(first["__rows"]), "n_nonnull": int(first[f"n{i}"]), "n_unique": levels})
    return out


def dataset_overview(df: DataFrame) -> DataFrame:
    """A3: one row per column with its type, plus the row and column counts."""
    n = df.count()
    rows = [(c, df.schema[c].dataType.simpleString(), n, len(df.columns)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, n_rows long, n_cols int")


# --------------------------------------------------------------------- selection

def numeric_columns(df: DataFrame, catalog=None, exclude=()) -> list[str]:
    """A4: numeric, distinct count ≠ 2, not bookkeeping, not excluded."""
    catalog = catalog or column_catalog(df)
    return [c["column"] for c in catalog
            if _is_numeric(df.schema[c["column"]].dataType) and c["n_unique"] != 2
            and c["metadata"].get("kind") != "categorical"
            and c["column"] not in BOOKKEEPING and c["column"] not in exclude]


def categorical_columns(df: DataFrame, catalog=None, exclude=()) -> list[str]:
    """Categorical kind (string columns or spec'd categoricals), > 2 levels, not a flag."""
    catalog = catalog or column_catalog(df)
    out = []
    for c in catalog:
        name, t, kind = c["column"], df.schema[c["column"]].dataType, c["metadata"].get("kind")
        is_cat = kind == "categorical" or (kind is None and isinstance(t, T.StringType))
        if (is_cat and not isinstance(t, T.BooleanType) and not name.endswith("_missing")
                and name not in BOOKKEEPING and name not in exclude and c["n_unique"] > 2):
            out.append(name)
    return out


def binary_columns(df: DataFrame, catalog=None, exclude=()) -> list[str]:
    """Exactly two observed levels, any type."""
    catalog = catalog or column_catalog(df)
    return [c["column"] for c in catalog
            if c["n_unique"] == 2 and c["column"] not in BOOKKEEPING and c["column"] not in exclude]


# --------------------------------------------------------------------- numeric

def _splits(cuts):
    cuts = sorted({float(v) for v in (cuts or []) if v is not None and not math.isnan(v)})
    return [float("-inf")] + cuts + [float("inf")] if cuts else None


def numeric_value_table(df: DataFrame, cols, buckets: int | None = None, cuts=None) -> DataFrame:
    """``(column, bucket, value, n)`` with ``bucket`` monotone in ``value`` per column."""
    b = buckets or default_buckets(df.sparkSession)
    if cuts is None:
        probs = [i / b for i in range(1, b)] if b > 1 else [0.5]
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, accuracy(b)).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        cuts = {c: row[f"q{i}"] for i, c in enumerate(cols)}
    base = df.select(*[(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(cols)])
    spl = {i: _splits(cuts.get(c)) for i, c in enumerate(cols)}
    with_b = [i for i in spl if spl[i] is not None]
    if with_b:
        bz = Bucketizer(splitsArray=[spl[i] for i in with_b], inputCols=[f"v{i}" for i in with_b],
                        outputCols=[f"b{i}" for i in with_b], handleInvalid="keep")
        base = bz.transform(base)
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               (F.col(f"b{i}").cast("int") if i in with_b else F.lit(0)).alias("bucket"),
                               F.col(f"v{i}").alias("value")) for i, c in enumerate(cols)])
    long = base.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))


def value_table_summary(vt: DataFrame) -> dict:
    """column → (values, distinct, largest count) from a value table (one row per column)."""
    rows = vt.groupBy("column").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("u"),
                                    F.max("n").alias("m")).collect()
    return {r["column"]: (int(r["t"]), int(r["u"]), int(r["m"])) for r in rows}


def order_statistics(vt: DataFrame, ranks: dict) -> dict:
    """Values at 0-based ranks from a (column, bucket, value, n) table.

    ``ranks`` maps column → iterable of ranks; returns {(column, rank): value}.
    Bucket offsets come from a window over the per-column bucket totals (one row
    per bucket), each target rank finds its bucket by a broadcast range join
    (targets are a dozen per column), and running counts are taken only inside
    the buckets that hold a target.
    """
    spark = vt.sparkSession
    targets = [(c, int(k)) for c, ks in ranks.items() for k in set(ks)]
    if not targets:
        return {}
    tdf = spark.createDataFrame(targets, "column string, k long")
    tot = vt.groupBy("column", "bucket").agg(F.sum("n").alias("t"))
    wo = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("off", F.coalesce(F.sum("t").over(wo), F.lit(0)))
    hits = (offs.join(F.broadcast(tdf), "column")
            .where((F.col("off") <= F.col("k")) & (F.col("k") < F.col("off") + F.col("t")))
            .select("column", "bucket", "k", "off"))
    w = (Window.partitionBy("column", "bucket").orderBy("value")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = (vt.join(F.broadcast(hits.select("column", "bucket").distinct()), ["column", "bucket"])
           .withColumn("cum", F.sum("n").over(w)))
    found = cum.join(F.broadcast(hits), ["column", "bucket"]).where(
        (F.col("off") + F.col("cum") - F.col("n") <= F.col("k")) & (F.col("k") < F.col("off") + F.col("cum")))
    return {(r["column"], int(r["k"])): float(r["value"]) for r in found.select("column", "k", "value").collect()}


def _interp(os_, c, n, q):
    h = (n - 1) * q
    lo, hi = math.floor(h), math.ceil(h)
    a, b = os_.get((c, lo)), os_.get((c, hi))
    if a is None or b is None:
        return None
    return a + (b - a) * (h - lo)


def numeric_candidates(df: DataFrame, exclude=()) -> list[str]:
    """A4 / C8 by schema alone: numeric, not a declared categorical, not bookkeeping, not excluded.
    ``numeric_profile(..., skip_two_level=True)`` then applies the distinct ≠ 2
    rule from its own exact distinct counts, with no extra pass."""
    return [f.name for f in df.schema.fields
            if _is_numeric(f.dataType) and (f.metadata or {}).get("kind") != "categorical"
            and f.name not in BOOKKEEPING and f.name not in exclude]


def numeric_profile(df: DataFrame, cols, trim: float = 0.1, skip_two_level: bool = False) -> DataFrame:
    """One row per numeric column.

    Columns: column, n, n_unique, missing_pct, max, min, median, mean, mode,
    n_modes, std_pop, cv, trimmed_mean, iqrange, p_5th, p_95th, skewness,
    kurtosis, cv_band, skew_band, kurtosis_band.  ``skewness``/``kurtosis`` are the
    bias-corrected sample estimators (pandas ``skew``/``kurt``); ``mode`` is the
    smallest of the most frequent values, ``n_modes`` how many tie.
    """
    spark = df.sparkSession
    cols = list(cols)
    schema = ("column string, n long, n_unique long, missing_pct double, max double, min double, median double, "
              "mean double, mode double, n_modes long, std_pop double, cv double, trimmed_mean double, "
              "iqrange double, p_5th double, p_95th double, skewness double, kurtosis double")
    if not cols:
        return spark.createDataFrame([], schema)
    # one pass for moments and bracket cuts, one for exact counts between the cuts, one for the rows
    # inside the brackets, one for the distinct values
    places = [*PERCENTILES, trim, 1.0 - trim]
    probs = ranks.sketch_places(places)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    values = {c: F.col(f"`{c}`").cast("double") for c in cols}
    for i, c in enumerate(cols):
        x = values[c]
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.stddev_pop(x).alias(f"sd{i}"), F.skewness(x).alias(f"sk{i}"),
                 F.kurtosis(x).alias(f"ku{i}"), F.percentile_approx(x, probs, ranks.ACCURACY).alias(f"q{i}")]
    m = df.agg(*aggs).first()
    rows = {c: int(m[f"n{i}"]) for i, c in enumerate(cols)}
    cuts = {c: (rows[c], [m[f"mn{i}"], m[f"mx{i}"], *(m[f"q{i}"] or [])]) for i, c in enumerate(cols)}

    def wanted(c: str, n: int) -> set[int]:
        return ranks.quantile_ranks(n, PERCENTILES) | {int(trim * n), n - 1 - int(trim * n)}

    selected = ranks.select(df, values, places, wanted, cuts)
    stats = ranks.value_stats(df, values, rows)
    rows_total = int(m["__rows"])
    out = []
    for i, c in enumerate(cols):
        n = int(m[f"n{i}"])
        miss = (rows_total - n) * 100.0 / rows_total if rows_total else None
        if n == 0:
            out.append((c, 0, 0, miss) + (None,) * 14)
            continue
        mean, sd = m[f"av{i}"], m[f"sd{i}"]
        g1, g2 = m[f"sk{i}"], m[f"ku{i}"]
        skew = g1 * math.sqrt(n * (n - 1)) / (n - 2) if (g1 is not None and n > 2) else None
        kurt = ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)) if (g2 is not None and n > 3) else None
        pct = {q: selected[c].quantile(q) for q in PERCENTILES}
        tm = selected[c].trimmed_mean(int(trim * n))
        cv = sd / mean if (sd is not None and mean not in (None, 0)) else None
        iqr = pct[0.75] - pct[0.25] if pct[0.75] is not None and pct[0.25] is not None else None
        n_unique, _, n_modes, mode = stats[c]
        if skip_two_level and n_unique == 2:
            continue
        out.append((c, n, n_unique, miss, m[f"mx{i}"], m[f"mn{i}"], pct[0.5], mean,
                    mode, n_modes, sd, cv, tm, iqr, pct[0.05], pct[0.95], skew, kurt))
    prof = spark.createDataFrame(out, schema)
    return prof.withColumns({
        "cv_band": _band(F.col("cv"), CV_BANDS),
        "skew_band": _band(F.col("skewness"), SKEW_BANDS),
        "kurtosis_band": _band(F.col("kurtosis"), KURT_BANDS),
    })


def numeric_modes(df: DataFrame, cols) -> DataFrame:
    """Every most-frequent value of each column, ``(column, value, n)``."""
    vt = (unpivot(df, cols, "double").where(F.col("value").isNotNull())
          .withColumn("value", F.col("value") + F.lit(0.0))
          .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    mx = vt.groupBy("column").agg(F.max("n").alias("max_n"))
    # per-column maxima are one row per column: a bounded broadcast
    return vt.join(F.broadcast(mx), "column").where(F.col("n") == F.col("max_n")).drop("max_n")


def histogram(df: DataFrame, cols, bins: int = 20, discrete_max: int = 20) -> DataFrame:
    """Histogram table per column.

    Columns with at most ``discrete_max`` distinct values get one bar per value;
    others ``bins`` equal-width bins over [min, max] (last bin closed).  Output:
    column, bin, lower, upper, n, share, density.
    """
    spark = df.sparkSession
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.count(x).alias(f"n{i}"),
                 F.approx_count_distinct(x).alias(f"d{i}")]
    st = df.agg(*aggs).first()
    exact_d = {}
    near = [c for i, c in enumerate(cols) if (st[f"d{i}"] or 0) <= discrete_max * 2]
    if near:
        for r in value_counts(df, near, "double").groupBy("column").count().collect():
            exact_d[r["column"]] = int(r["count"])
    parts = []
    for i, c in enumerate(cols):
        mn, mx, n = st[f"mn{i}"], st[f"mx{i}"], st[f"n{i}"]
        x = F.col(f"`{c}`").cast("double") + F.lit(0.0)
        if n == 0:
            continue
        if exact_d.get(c, discrete_max + 1) <= discrete_max:
            e = F.struct(F.lit(c).alias("column"), x.alias("lower"), x.alias("upper"), F.lit(None).cast("double").alias("width"))
        else:
            width = (mx - mn) / bins if mx > mn else 1.0
            k = F.least(F.floor((x - F.lit(mn)) / F.lit(width)), F.lit(bins - 1))
            lower = F.lit(mn) + k * F.lit(width)
            e = F.struct(F.lit(c).alias("column"), lower.alias("lower"), (lower + F.lit(width)).alias("upper"),
                         F.lit(width).alias("width"))
        parts.append(F.when(x.isNotNull(), e))
    if not parts:
        return spark.createDataFrame([], "column string, lower double, upper double, n long, share double, density double")
    long = df.select(F.explode(F.array(*parts)).alias("_h")).where(F.col("_h").isNotNull()).select("_h.*")
    counted = long.groupBy("column", "lower", "upper", "width").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("column"))
    return counted.select(
        "column", "lower", "upper", "n", (F.col("n") / tot).alias("share"),
        F.coalesce(F.col("n") / tot / F.col("width"), F.col("n") / tot).alias("density"))


# --------------------------------------------------------------------- categorical / binary

def _level_stats(vc: DataFrame) -> DataFrame:
    """Per column: total, levels, entropy (bits and nats) from ``(column, value, n)``."""
    n = F.col("n").cast("double")
    g = vc.groupBy("column").agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_levels"),
        F.sum(n * F.log2(n)).alias("_s2"), F.sum(n * F.log(n)).alias("_se"))
    N = F.col("n_total").cast("double")
    return g.select(
        "column", "n_total", "n_levels",
        F.greatest(F.log2(N) - F.col("_s2") / N, F.lit(0.0)).alias("entropy_bin"),
        F.when(F.col("n_levels") > 1, F.greatest(F.log(N) - F.col("_se") / N, F.lit(0.0)) / F.log(F.col("n_levels").cast("double")))
        .otherwise(F.lit(0.0)).alias("balance"),
    )


def _ranked_levels(vc: DataFrame, k: int, rarest: bool = False, rank_col: str = "rank") -> DataFrame:
    order = [F.col("n").asc(), F.col("value").desc()] if rarest else [F.col("n").desc(), F.col("value").asc()]
    return ranking.top_k(vc, "column", order, k, salt_cols="value", rank_col=rank_col)


def categorical_candidates(df: DataFrame, exclude=()) -> list[str]:
    """A9 by schema alone: declared categoricals and plain strings, not flags or
    bookkeeping; the > 2 levels rule is ``categorical_profile(min_levels=3)``."""
    out = []
    for f in df.schema.fields:
        kind = (f.metadata or {}).get("kind")
        if ((kind == "categorical" or (kind is None and isinstance(f.dataType, T.StringType)))
                and not f.name.endswith("_missing") and f.name not in BOOKKEEPING and f.name not in exclude):
            out.append(f.name)
    return out


def categorical_profile(df: DataFrame, cols, levels: dict | None = None, min_levels: int = 1) -> DataFrame:
    """One row per categorical column.

    Levels are observed values (declared-but-unseen levels are not counted);
    ties between equally frequent levels go to the smaller value.  ``levels``
    (column → ordered levels) enables ``median_category``; columns carrying
    ``levels`` metadata use it automatically.
    """
    spark = df.sparkSession
    cols = list(cols)
    levels = dict(levels or {})
    for c in cols:
        meta = df.schema[c].metadata or {}
        if c not in levels and meta.get("ordered") and meta.get("levels"):
            levels[c] = meta["levels"]
    # one value-count table feeds every branch; its shuffle is reused across them
    vc, rows_t = _rows_and_levels(df, cols)
    st = _level_stats(vc).join(rows_t, "column")
    top = _ranked_levels(vc, 2).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("first_mode"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("_n1"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("second_mode"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("_n2"))
    low = _ranked_levels(vc, 1, rarest=True).select("column", F.col("value").alias("rarest"),
                                                    F.col("n").alias("_nr"))
    med = None
    if levels:
        lv = spark.createDataFrame([(c, str(v), i) for c, ls in levels.items() if c in cols
                                    for i, v in enumerate(ls)], "column string, value string, lrank int")
        # declared levels are bounded by the spec, so the window per column is small;
        # unseen levels add 0 and can never be the first to cross one half
        j = vc.join(F.broadcast(lv), ["column", "value"])
        w = Window.partitionBy("column").orderBy("lrank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        j = j.withColumn("_cum", F.sum("n").over(w)).withColumn("_tot", F.sum("n").over(Window.partitionBy("column")))
        med = j.where(F.col("_cum") >= F.col("_tot") * 0.5).groupBy("column").agg(
            F.min_by("value", "lrank").alias("median_category"))
    st = st.where(F.col("n_levels") >= min_levels)
    out = st.join(top, "column", "left").join(low, "column", "left")
    out = out.join(med, "column", "left") if med is not None else out.withColumn("median_category", F.lit(None).cast("string"))
    N = F.col("n_total").cast("double")
    res = out.select(
        "column", F.col("n_total").alias("n"), F.col("n_levels").alias("n_unique"),
        ((F.col("n_rows") - F.col("n_total")) * 100.0 / F.col("n_rows")).alias("missing_pct"),
        "first_mode", "second_mode", "rarest",
        (F.col("_nr") * 100.0 / N).alias("rarest_pct"),
        (F.col("_n1") * 100.0 / N).alias("first_mode_pct"),
        (F.col("_n2") * 100.0 / N).alias("second_mode_pct"),
        (F.col("_n1") / F.col("_n2")).alias("max_class_imbalance"),
        "median_category", "balance", "entropy_bin",
    )
    res = res.withColumns({
        "cardinality_band": _band(F.col("n_unique"), CARDINALITY_BANDS),
        "imbalance_band": _band(F.col("max_class_imbalance"), IMBALANCE_BANDS),
        "entropy_band": _band(F.col("entropy_bin"), CAT_ENTROPY_BANDS),
        "balance_band": _band(F.col("balance"), CAT_BALANCE_BANDS),
    })
    return res


def binary_profile(df: DataFrame, cols) -> DataFrame:
    """One row per two-level column.

    ``cat1`` is the more frequent level (ties → smaller value), ``mode`` is
    ``cat1`` unless p1/p0 ≤ 1.1, then ``equal``; missing_pct is NULL for
    ``_missing`` flag columns.
    """
    cols = list(cols)
    vc, rows_t = _rows_and_levels(df, cols)
    st = _level_stats(vc).join(rows_t, "column")
    top = _ranked_levels(vc, 2).groupBy("column").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("cat1"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("_n1"),
        F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("cat0"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("_n0"))
    out = st.where(F.col("n_levels") == 2).join(top, "column")
    N = F.col("n_total").cast("double")
    p1, p0 = F.col("_n1") / N, F.col("_n0") / N
    ratio = F.col("_n1") / F.col("_n0")
    res = out.select(
        "column", "cat1", "cat0", F.col("n_total").alias("n"),
        F.when(F.col("column").contains("_missing"), F.lit(None).cast("double"))
        .otherwise((F.col("n_rows") - F.col("n_total")) * 100.0 / F.col("n_rows")).alias("missing_pct"),
        p1.alias("p1"), p0.alias("p0"),
        F.when(ratio > 1.1, F.col("cat1")).otherwise(F.lit("equal")).alias("mode"),
        F.when(ratio > 1.1, p1 * 100).otherwise(p0 * 100).alias("mode_pct"),
        (F.least(p0, p1) * 2).alias("balance"), "entropy_bin",
    )
    res = res.withColumns({
        "balance_band": _band(F.col("balance"), BIN_BALANCE_BANDS),
        "entropy_band": _band(F.col("entropy_bin"), BIN_ENTROPY_BANDS),
    })
    return res


def effective_unique(df: DataFrame, cols, min_freq: float = 0.01) -> DataFrame:
    """Number of levels whose share of non-null values is at least ``min_freq``."""
    vc = value_counts(df, cols)
    # per-column totals are one row per column: a bounded broadcast
    g = vc.groupBy("column").agg(F.sum("n").alias("_t"))
    j = vc.join(F.broadcast(g), "column")
    return j.groupBy("column").agg(F.count_if(F.col("n") >= F.col("_t") * F.lit(min_freq)).alias("effective_unique"))


def value_overview(df: DataFrame, cols=None) -> DataFrame:
    """A2 (numbers), D10 (post-derive summary): per column, null count, distinct
    count and, for numeric columns, min / max / mean / sample sd."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs.append(F.count_if(x.isNull()).alias(f"z{i}"))
        if _is_numeric(df.schema[c].dataType):
            d = x.cast("double") + F.lit(0.0)
            aggs += [F.min(d).alias(f"mn{i}"), F.max(d).alias(f"mx{i}"), F.avg(d).alias(f"av{i}"),
                     F.stddev_samp(d).alias(f"sd{i}")]
    m = df.agg(*aggs).first()
    distinct = {r["column"]: int(r["count"]) for r in value_counts(df, cols).groupBy("column").count().collect()}
    out = []
    for i, c in enumerate(cols):
        num = _is_numeric(df.schema[c].dataType)
        out.append((c, df.schema[c].dataType.simpleString(), int(m[f"z{i}"]), distinct.get(c, 0),
                    m[f"mn{i}"] if num else None, m[f"mx{i}"] if num else None,
                    m[f"av{i}"] if num else None, m[f"sd{i}"] if num else None))
    return df.sparkSession.createDataFrame(
        out, "column string, dtype string, n_null long, n_unique long, min double, max double, mean double, std_samp double")


def value_extremes(df: DataFrame, cols, k: int = 5) -> DataFrame:
    """A2 (levels): the ``k`` commonest and ``k`` rarest values per column.

    Output: column, side ('common' | 'rare'), rank, value, n.
    """
    vc = value_counts(df, cols)
    common = _ranked_levels(vc, k).withColumn("side", F.lit("common"))
    rare = _ranked_levels(vc, k, rarest=True).withColumn("side", F.lit("rare"))
    return common.unionByName(rare).select("column", "side", "rank", "value", "n")


def missingness_ranking(df: DataFrame, cols=None, top_n: int = 20) -> DataFrame:
    """Columns with any NULL, by NULL share (percent), the ``top_n`` largest."""
    cols = list(cols or df.columns)
    m = df.agg(F.count(F.lit(1)).alias("__rows"),
               *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    rows = int(m["__rows"])
    data = [(c, int(m[f"z{i}"]), m[f"z{i}"] * 100.0 / rows if rows else 0.0) for i, c in enumerate(cols)]
    data = [d for d in data if d[1] > 0]
    data.sort(key=lambda d: (-d[2], d[0]))
    return df.sparkSession.createDataFrame(data[:top_n], "column string, n_missing long, missing_pct double")
