"""Typing, derivation, missing flags and clean-up.

Each stage is one ``select`` over the input: Catalyst collapses the per-column
expressions into a single projection, so the work is one pass over the data
however many specs there are.  Counts that the reference prints while it
mutates the frame are returned as audit DataFrames computed by one ``agg``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..spec import ColumnSpec, split_specs


def _meta(spec: ColumnSpec, **extra) -> dict:
    m = {"kind": spec.kind, "derived": spec.is_derived}
    if spec.ordered is not None:
        m["levels"] = [str(v) for v in spec.ordered]
        m["ordered"] = True
    m.update(extra)
    return m


def _levels_are_ints(levels) -> bool:
    return all(isinstance(v, int) and not isinstance(v, bool) for v in levels)


def check_required(df: DataFrame, specs, rename_map: dict | None = None) -> None:
    """Every source spec must name a canonical column (and be present)."""
    source, _ = split_specs(specs)
    names = set(rename_map) if rename_map is not None else set(df.columns)
    missing = [s.name for s in source if s.name not in names]
    if missing:
        raise ValueError(f"spec columns not found among canonical columns: {missing}")


def prepared_value(spec: ColumnSpec, c=None):
    """Null tokens → ordered-domain filter → cascading replace, on the raw string."""
    c = F.col(spec.name).cast("string") if c is None else c
    if spec.nulls is not None:
        c = X.null_tokens(c, spec.nulls)
    if spec.ordered is not None:
        c = X.in_domain(c, spec.ordered)
    if spec.replace:
        c = X.cascade_replace(c, spec.replace)
    return c


def typed_value(spec: ColumnSpec, c):
    """Cast a prepared value to the spec's kind."""
    k = spec.kind
    if k == "numeric":
        return X.to_number(c)
    if k == "datetime":
        return X.to_datetime(c, spec.datetime_formats or X.DAYFIRST_FORMATS)
    if k == "timedelta":
        return X.to_interval(c)
    if k == "categorical":
        if spec.ordered is not None and _levels_are_ints(spec.ordered):
            return c.try_cast("int")
        return c
    if k == "text":
        return X.norm_text(c)
    if k == "boolean":
        return F.lower(F.trim(c)).try_cast("boolean")
    raise ValueError(f"no such source kind: {k!r} ({spec.name})")


def apply_schema(df: DataFrame, specs, rename_map: dict | None = None) -> DataFrame:
    """Type every source column in one projection; other columns pass through."""
    check_required(df, specs, rename_map)
    source, _ = split_specs(specs)
    for s in source:  # validate kinds before building anything
        if s.kind not in ("numeric", "datetime", "timedelta", "categorical", "text", "boolean"):
            raise ValueError(f"no such source kind: {s.kind!r} ({s.name})")
    by_name = {s.name: s for s in source}
    out = []
    for c in df.columns:
        s = by_name.get(c)
        if s is None:
            out.append(F.col(c))
        else:
            out.append(typed_value(s, prepared_value(s)).alias(c, metadata=_meta(s)))
    return df.select(*out)


def schema_audit(raw: DataFrame, specs) -> DataFrame:
    """Per source column: nulls before, after null tokens / domain, after cast (one job).

    Result: (column, n_rows, null_raw, null_after_tokens, null_after_cast,
    new_null_tokens, new_null_cast).
    """
    source, _ = split_specs(specs)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, s in enumerate(source):
        raw_c = F.col(s.name).cast("string")
        prep = prepared_value(s)
        typed = typed_value(s, prep)
        aggs += [
            F.count_if(raw_c.isNull()).alias(f"a{i}"),
            F.count_if(prep.isNull()).alias(f"b{i}"),
            F.count_if(typed.isNull()).alias(f"c{i}"),
        ]
    wide = raw.agg(*aggs)
    rows = [
        F.struct(F.lit(s.name).alias("column"), F.col("__n").alias("n_rows"),
                 F.col(f"a{i}").alias("null_raw"), F.col(f"b{i}").alias("null_after_tokens"),
                 F.col(f"c{i}").alias("null_after_cast"))
        for i, s in enumerate(source)
    ]
    return (wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .withColumn("new_null_tokens", F.col("null_after_tokens") - F.col("null_raw"))
            .withColumn("new_null_cast", F.col("null_after_cast") - F.col("null_after_tokens")))


def rejected_values(raw: DataFrame, specs) -> DataFrame:
    """Distinct raw values a cast turned into NULL, with counts (P8/P9 reject lists).

    Distributed (column, raw_value, n) table rather than a driver-side list.
    """
    source, _ = split_specs(specs)
    checked = [s for s in source if s.kind in ("numeric", "datetime", "timedelta", "boolean")]
    if not checked:
        return raw.sparkSession.createDataFrame([], "column string, raw_value string, n long")
    pairs = []
    for s in checked:
        prep = prepared_value(s)
        bad = prep.isNotNull() & typed_value(s, prep).isNull()
        pairs.append(F.struct(F.lit(s.name).alias("column"), F.when(bad, prep).alias("raw_value")))
    return (raw.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
            .where(F.col("raw_value").isNotNull())
            .groupBy("column", "raw_value").agg(F.count(F.lit(1)).alias("n")))


def _check_derived_sources(df: DataFrame, spec: ColumnSpec) -> None:
    """Derivation guards (missing sources, non-datetime sources for durations and calendar parts)."""
    missing = [c for c in spec.derive_from if c not in df.columns]
    if missing:
        raise KeyError(f"{spec.name}: missing source columns {missing}")
    if spec.kind == "timedelta" or (spec.kind == "datetime" and spec.datetime_units):
        for c in spec.derive_from:
            t = df.schema[c].dataType
            if not isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                raise ValueError(f"{spec.name}: source {c} must be a datetime column, got {t.simpleString()}")


def derived_column(df: DataFrame, spec: ColumnSpec, fold_case: bool = False):
    _check_derived_sources(df, spec)
    if spec.kind == "match":
        left, right = spec.derive_from
        e = X.family_agreement(left, right, spec.match_by, fold_case=fold_case)
        meta = _meta(spec, match_by=X.normalise_prefixes(spec.match_by))
    elif spec.kind == "datetime":
        if not spec.datetime_units:
            raise KeyError(f"{spec.name}: datetime derivation needs datetime_units")
        e = X.calendar_part(spec.derive_from[0], spec.datetime_units)
        levels = X.calendar_levels(spec.datetime_units)
        meta = _meta(spec, unit=spec.datetime_units)
        if levels is not None:
            meta["levels"] = [str(v) for v in levels]
            meta["ordered"] = True
    elif spec.kind == "timedelta":
        start, end = spec.derive_from
        e = X.floor_duration(start, end, spec.timedelta_units)
        meta = _meta(spec, unit=spec.timedelta_units)
    else:
        raise ValueError(f"{spec.name}: kind {spec.kind!r} cannot be derived")
    return e.alias(spec.name, metadata=meta)


def apply_derived(df: DataFrame, specs, fold_case: bool = False) -> DataFrame:
    """Add every derived column in declaration order.

    Derived columns may use earlier derived columns, so each is resolved against
    the frame built so far; Catalyst still collapses the projections.
    """
    _, derived = split_specs(specs)
    for s in derived:
        df = df.select(*[c for c in df.columns if c != s.name], derived_column(df, s, fold_case))
    return df


def match_summary(df: DataFrame, specs) -> DataFrame:
    """Per match column, n evaluable and match rate in percent (2 decimals)."""
    _, derived = split_specs(specs)
    matches = [s.name for s in derived if s.kind == "match"]
    if not matches:
        return df.sparkSession.createDataFrame([], "column string, n_evaluable long, match_rate_pct double")
    aggs = []
    for i, m in enumerate(matches):
        aggs += [F.count(m).alias(f"n{i}"), F.count_if(F.col(m)).alias(f"k{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(m).alias("column"), F.col(f"n{i}").alias("n_evaluable"),
                     F.coalesce(F.round(F.try_divide(F.col(f"k{i}") * 100.0, F.col(f"n{i}")), 2),
                                F.lit(0.0)).alias("match_rate_pct"))
            for i, m in enumerate(matches)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def drop_unkept(df: DataFrame, specs) -> DataFrame:
    """Drop every column (source or derived) whose spec says ``keep=False``."""
    return df.drop(*[s.name for s in specs if not s.keep and s.name in df.columns])


def null_counts(df: DataFrame, columns=None) -> dict:
    """Null count per column in one aggregate (a single small row to the driver)."""
    columns = list(columns or df.columns)
    if not columns:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: int(row[f"c{i}"]) for i, c in enumerate(columns)}


def missing_flags(df: DataFrame, specs=(), exclude=()) -> DataFrame:
    """``<c>_missing`` for every non-derived column that has at least one NULL."""
    derived = {s.name for s in specs if s.is_derived}
    skip = derived | set(exclude)
    cols = [c for c in df.columns if c not in skip and not c.endswith("_missing")]
    counts = null_counts(df, cols)
    flags = [F.col(c).isNull().alias(f"{c}_missing", metadata={"kind": "missing_flag", "of": c})
             for c in cols if counts[c] > 0]
    return df.select("*", *flags)


def reorder(df: DataFrame, sequence) -> DataFrame:
    """User-given column order first, the rest after in their current order."""
    seq = [c for c in sequence if c in df.columns]
    return df.select(*seq, *[c for c in df.columns if c not in seq])


def frame_shape(df: DataFrame) -> DataFrame:
    """A1: rows, columns, null cells and null percentage in one aggregate."""
    cols = df.columns
    n_cols = len(cols)
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).alias("null_cells")).select(
        "n_rows",
        F.lit(n_cols).alias("n_cols"),
        F.coalesce("null_cells", F.lit(0)).alias("null_cells"),
        F.coalesce(F.round(F.try_divide(F.col("null_cells") * 100.0, F.col("n_rows") * n_cols), 2),
                   F.lit(0.0)).alias("null_pct"),
    )


def janitor(df: DataFrame, specs, apply_all: bool = True, id_cols=None, order_cols=None,
            include_first: bool = True, drop_dupes: bool = False, rename_map=None):
    """Schema → derived → missing flags → duplicates, or duplicates only.

    Returns ``(frame, duplicates_report)``; ``overview`` tells what is left.
    """
    from . import dedupe

    if apply_all:
        df = apply_schema(df, specs, rename_map)
        df = apply_derived(df, specs)
        df = missing_flags(df, specs)
    report = dedupe.report(df, id_cols, order_cols, include_first=include_first) if id_cols else None
    if drop_dupes and id_cols:
        df = dedupe.drop_later(df, id_cols, order_cols)
    return df, report


def overview(df: DataFrame, id_cols=None) -> DataFrame:
    """P17's last stage, one row: the frame's shape (A1) and, with id columns, its encounter counts (K5)."""
    from . import dedupe

    shape = frame_shape(df)
    if not id_cols:
        return shape
    counts = dedupe.encounter_overview(df, id_cols).withColumnRenamed("n_rows", "_rows")
    return shape.join(F.broadcast(counts), F.col("n_rows") == F.col("_rows")).drop("_rows")  # one row each
