"""Multi-file ingest with drifting headers.

Files are read as all-string CSV.  Files that share a header are read together in
one scan; each header group is mapped to canonical names with one ``select``
(``coalesce`` over the aliases found, NULL when none is present) and the groups
are unioned by name.  Lineage (`_src_file`) and a source order (`_src_order`)
are kept so "first" has a meaning later.
"""

from __future__ import annotations

import re
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import DEFAULT_NULL_TOKENS, null_tokens


def discover(spark: SparkSession, raw_dir: str, pattern: str = "*.csv") -> list[str]:
    """Sorted file paths under ``raw_dir`` matching ``pattern``.

    Listed by Spark's file index (works for any Hadoop file system); the file
    contents are not read because only ``path`` is selected.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .load(raw_dir).select("path").collect())
    return sorted(r["path"] for r in files)


def _reader(spark: SparkSession, sep: str = ","):
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("sep", sep).option("enforceSchema", False))


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Header names of one file, stripped (schema-only read: the first line)."""
    return [c.strip() for c in _reader(spark, sep).csv(path).columns]


def headers(spark: SparkSession, paths, sep: str = ",", threads: int = 16) -> list[list[str]]:
    """Headers of many files; each is a one-line read, so they run concurrently."""
    from concurrent.futures import ThreadPoolExecutor

    paths = list(paths)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(paths)))) as pool:
        return list(pool.map(lambda p: header_of(spark, p, sep), paths))


def header_diff(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Per file, columns missing from / extra to the first file's header."""
    paths = list(paths)
    if not paths:
        raise ValueError("no input files")
    heads = list(zip(paths, headers(spark, paths, sep)))
    base = heads[0][1]
    df = spark.createDataFrame([(i, p, h) for i, (p, h) in enumerate(heads)],
                               "file_index int, file string, header array<string>")
    ref = F.array(*[F.lit(c) for c in base]) if base else F.array().cast("array<string>")
    return df.select("file_index", "file",
                     F.array_except(ref, F.col("header")).alias("missing"),
                     F.array_except(F.col("header"), ref).alias("extra"))


def union_header(spark: SparkSession, paths, sep: str = ",") -> list[str]:
    """Union of all headers in first-seen order."""
    seen = OrderedDict()
    for h in headers(spark, list(paths), sep):
        for c in h:
            seen.setdefault(c, None)
    return list(seen)


def _strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def preview(spark: SparkSession, paths, n: int = 3, sep: str = ",") -> DataFrame:
    """First ``n`` rows of each file aligned to the union header."""
    paths = list(paths)
    if not paths:
        raise ValueError("no input files")
    parts = [_strip_names(_reader(spark, sep).csv(p)).limit(n).withColumn("_src_file", F.lit(p)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _aliases(canonical: str, spec) -> list[str]:
    if spec is None:
        names = []
    elif isinstance(spec, str):
        names = [spec]
    else:
        names = list(spec)
    names = [n.strip() for n in names if n is not None and str(n).strip() != ""]
    return names + ([canonical] if canonical not in names else [])


def harmonize(df: DataFrame, rename_map: dict, keep=()) -> DataFrame:
    """Canonical projection of one header group.

    ``coalesce`` over the aliases present (in map order) becomes the canonical
    column; absent → NULL string; columns not in the map are dropped (unless in
    ``keep``, e.g. lineage columns).
    """
    cols = set(df.columns)
    out = []
    for canonical, spec in rename_map.items():
        present = [a for a in _aliases(canonical, spec) if a in cols]
        if present:
            e = F.coalesce(*[F.col(f"`{a}`").cast("string") for a in present])
        else:
            e = F.lit(None).cast("string")
        out.append(e.alias(canonical))
    out += [F.col(k) for k in keep if k in cols]
    return df.select(*out)


def harmonize_all(frames, rename_map: dict, keep=()) -> DataFrame:
    """Harmonise each frame, then union by name."""
    frames = list(frames)
    if not frames:
        raise ValueError("no input frames")
    parts = [harmonize(f, rename_map, keep) for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _path_key(p: str) -> str:
    return re.sub(r"^file:/+", "/", p)


#: Files whose order is broadcast at most; more are joined by a shuffle.
BROADCAST_FILES = 100_000


def merge(spark: SparkSession, paths, rename_map: dict, sep: str = ",",
          null_values=DEFAULT_NULL_TOKENS) -> DataFrame:
    """S1 + U1 + P1/P2: read all files as strings and return the canonical frame.

    Columns: the canonical names in map order, then ``_src_file`` and ``_src_order``
    (file index in sorted order, start of the block within the file, position within the block).
    """
    paths = list(paths)
    if not paths:
        raise ValueError("no input files")
    groups: OrderedDict = OrderedDict()
    for i, (p, h) in enumerate(zip(paths, headers(spark, paths, sep))):
        groups.setdefault(tuple(h), []).append((i, p))
    # file → index in sorted order, joined on a scheme-less path (one row per file)
    files = spark.createDataFrame([(_path_key(p), i) for i, p in enumerate(paths)], "_fkey string, _fidx int")
    frames = []
    for _, members in groups.items():
        raw = _strip_names(_reader(spark, sep).csv([p for _, p in members]))
        # a block is read by one task from its start, so the running id orders its rows; blocks of
        # a file are read in any order, so their starts order them
        raw = raw.withColumns({"_src_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                               "_pos": F.monotonically_increasing_id()})
        # the metadata path is escaped, the listed one is not
        plain = F.url_decode(F.replace(F.col("_src_file"), F.lit("+"), F.lit("%2B")))
        order = F.broadcast(files) if len(paths) <= BROADCAST_FILES else files
        raw = (raw.withColumn("_fkey", F.regexp_replace(plain, "^file:/+", "/"))
               .join(order, "_fkey", "left")
               .withColumn("_src_order", F.struct(F.coalesce("_fidx", F.raise_error(F.concat(F.lit("file is not in the list: "), "_src_file")).cast("int")).alias("file_index"),
                                                  F.col("_block").alias("block"), F.col("_pos").alias("pos")))
               .drop("_fkey", "_fidx", "_block", "_pos"))
        frames.append(raw)
    out = harmonize_all(frames, rename_map, keep=("_src_file", "_src_order"))
    if null_values:
        out = out.select(*[null_tokens(c, null_values).alias(c) if c in rename_map else F.col(c)
                           for c in out.columns])
    return out
