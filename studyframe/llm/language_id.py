"""Operator 1: language by Bayesian fusion of text, declared language, address suffix and host.

Evidence of a row:
* text: hashed byte trigrams of its letters under one table per language, fitted by grouped
  counts over all rows that declare a language; neighbouring trigrams overlap, so their sum
  is divided by three;
* declared language (markup or metadata): right with a chance of ``DECLARED_RIGHT``;
* address: prior of the host, smoothed towards its suffix (the last label), smoothed towards
  all rows. The counts are sums of the posteriors by text and declaration, from one grouped
  aggregation over all rows, and a row's own share is taken out of its own prior.

``und`` (undetermined) competes as a language of evenly spread trigrams. Rows without any
letters have no language. Such rows are rejected, and all others kept.

Nulls: a null or empty text has no letters (rejected); a null or unknown declaration is no
evidence; a null host or suffix counts as one nameless host. Repeated rows are judged each.
Without any declared language there is nothing to fit: every language is null, rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from studyframe.session import materialize

from .arrowtext import per_slice, slices, text_bytes, tidy

TABLE = 1 << 14
#: Bytes of text handled at once: each takes some 60 bytes while it is scored.
AT_ONCE = 1 << 18
DECLARED_RIGHT = 0.95
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
UND_PRIOR = 1e-3
#: Largest host table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_HOSTS = 200_000

_FOLD = np.full(256, 32, np.uint8)  # letters in lower case, everything else a space
for _c in range(256):
    if 65 <= _c <= 90:
        _FOLD[_c] = _c + 32
    elif 97 <= _c <= 122 or _c >= 128:
        _FOLD[_c] = _c


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram at every byte, whether it counts) of texts laid end to end.

    A trigram counts if its middle is a letter; ends of texts read as spaces.
    """
    folded = _FOLD[data]
    left = np.empty(len(data), np.uint32)
    left[1:], left[:1] = folded[:-1], 32
    right = np.empty(len(data), np.uint32)
    right[:-1], right[-1:] = folded[1:], 32
    ends = offsets[1:][np.diff(offsets) > 0]
    left[offsets[:-1][np.diff(offsets) > 0]] = 32
    right[ends - 1] = 32
    code = (left << 16 | folded.astype(np.uint32) << 8 | right) * np.uint32(2654435761)
    return (code >> np.uint32(32 - 14)).astype(np.int64), folded != 32


def known(declared: Column) -> Column:
    """A declared language as its lower-case main part, or null."""
    code = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def fit_tables(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log chances [TABLE, languages]) from rows with columns text and declared.

    The driver gets TABLE numbers for each language, whatever the size of the corpus.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                languages = part.column(1).to_pylist()
                data, offsets = text_bytes(part.column(0))
                for lang in set(languages):
                    own = np.array([x == lang for x in languages])
                    keep = np.repeat(own, np.diff(offsets))
                    sizes = np.diff(offsets)[own]
                    code, counts = trigrams(data[keep], np.append(0, np.cumsum(sizes)))
                    sums[lang] = sums.get(lang, 0) + np.bincount(code[counts], minlength=TABLE)
        for lang, table in sums.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())],
                                             ["lang", "gram", "n"])

    rows = docs.where(F.col("declared").isNotNull()).select("text", "declared").mapInArrow(tidy(run), "lang string, gram int, n long")
    counts = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counts})
    table = np.zeros((TABLE, len(languages)))
    for r in counts:
        table[r.gram, languages.index(r.lang)] = r.n
    smoothed = table + 0.5
    return languages, np.log(smoothed / smoothed.sum(0))


def _posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score_evidence(docs: DataFrame, languages: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and letters, logs (log chances by language, then und) and first (posterior of these)."""
    n = len(languages)
    lookup = np.concatenate([table, np.full((TABLE, 1), -np.log(TABLE))], 1).astype(np.float32)
    wrong = (1 - DECLARED_RIGHT) / max(1, n - 1)
    names = [f"c{k}" for k in range(len(keep))]
    schema = StructType([StructField(m, docs.schema[c].dataType) for m, c in zip(names, keep)] + [
        StructField("letters", LongType()), StructField("logs", ArrayType(DoubleType())), StructField("first", ArrayType(DoubleType()))])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = text_bytes(batch.column(batch.num_columns - 2))
            code, counts = trigrams(data, offsets)
            sizes = np.diff(offsets)
            full = sizes > 0
            logs = np.zeros((batch.num_rows, n + 1))
            letters = np.zeros(batch.num_rows, np.int64)
            if full.any():
                at = offsets[:-1][full]
                logs[full] = np.add.reduceat(lookup[code] * counts[:, None], at, axis=0, dtype=np.float64) / 3
                letters[full] = np.add.reduceat(counts.astype(np.int64), at)
            logs[:, n] += np.log(UND_PRIOR)
            for k, lang in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if lang in languages:
                    logs[k, :n] += np.log(wrong if n > 1 else 1.0)
                    logs[k, languages.index(lang)] += np.log(DECLARED_RIGHT) - np.log(wrong if n > 1 else 1.0)
                    logs[k, n] += np.log(1 / n)
            first = _posterior(logs)
            first[letters == 0] = 0
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(letters), pa.array(list(logs), pa.list_(pa.float64())), pa.array(list(first[:, :n]), pa.list_(pa.float64()))],
                [*names, "letters", "logs", "first"])
        return work

    chosen = docs.select(*(F.col(c).alias(m) for m, c in zip(names, keep)), F.col("text").alias("_text"), F.col("declared").alias("_declared"))
    out = chosen.mapInArrow(per_slice(make, "_text", AT_ONCE), schema)
    return out.withColumnsRenamed(dict(zip(names, keep)))


def host_table(scored: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """(suffix, host, sums of first posteriors at the host and at its suffix), sums of all rows."""
    hosts = materialize(scored.groupBy("suffix", "host").agg(*(F.sum(F.col("first")[k]).alias(f"s{k}") for k in range(n))), "hosts")
    everything = hosts.agg(*(F.sum(f"s{k}") for k in range(n))).first()  # one row of n numbers
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"s{k}").alias(f"u{k}") for k in range(n)))
    joined = hosts.alias("h").join(suffixes.alias("x"), F.col("h.suffix").eqNullSafe(F.col("x.suffix")))
    return (joined.select(F.col("h.suffix").alias("_suffix"), F.col("host").alias("_host"), F.array(*(F.col(f"s{k}") for k in range(n))).alias("at_host"),
                          F.array(*(F.col(f"u{k}") for k in range(n))).alias("at_suffix")), [x or 0.0 for x in everything])


def _fused(languages: list[str], at_all: list[float]) -> tuple[Column, Column]:
    """(fused logs, struct of language and posterior) from logs, first and the three sums."""
    n = len(languages)
    own = [F.col("first")[k] for k in range(n)]

    def less_own(sums: list[Column]) -> list[Column]:
        return [F.greatest(x - mine, F.lit(0.0)) for x, mine in zip(sums, own)]

    def total(parts: list[Column]) -> Column:
        return sum(parts[1:], parts[0])

    everything = less_own([F.lit(float(x)) for x in at_all])
    whole = total(everything) + F.lit(float(n))
    general = [(x + F.lit(1.0)) / whole for x in everything]
    suffix = less_own([F.col("at_suffix")[k] for k in range(n)])
    wide = [(x + F.lit(SUFFIX_WEIGHT) * g) / (total(suffix) + F.lit(SUFFIX_WEIGHT)) for x, g in zip(suffix, general)]
    host = less_own([F.col("at_host")[k] for k in range(n)])
    prior = [(x + F.lit(HOST_WEIGHT) * g) / (total(host) + F.lit(HOST_WEIGHT)) for x, g in zip(host, wide)]
    logs = F.array(*(F.col("logs")[k] + F.log(p) for k, p in enumerate(prior)), F.col("logs")[n])
    best = F.array_max("fused")
    chance = F.lit(1.0) / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("fused")))
    return logs, F.struct(F.element_at(F.array(*map(F.lit, [*languages, "und"])), F.array_position("fused", best).cast("int")).alias("language"),
                          chance.alias("posterior"))


def identify(docs: DataFrame, keep: str) -> DataFrame:
    """Column ``keep`` (an id, or a struct of all a row has) and language, posterior, kept.

    ``docs`` needs text, declared, host and suffix. The texts are read three times
    (tables, host sums, decision); they are shuffled only beyond ``BROADCAST_HOSTS`` hosts.
    """
    rows = docs.select(F.col(keep).alias("_keep"), "text", known(F.col("declared")).alias("declared"), "host", "suffix")
    languages, table = fit_tables(rows)
    if not languages:
        return rows.select(F.col("_keep").alias(keep), F.lit(None).cast(StringType()).alias("language"), F.lit(0.0).cast(DoubleType()).alias("posterior"),
                           F.lit(False).cast(BooleanType()).alias("kept"))
    hosts, at_all = host_table(score_evidence(rows, languages, table, ["suffix", "host"]), len(languages))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    scored = score_evidence(rows, languages, table, ["_keep", "suffix", "host"])
    joined = scored.join(hosts, F.col("suffix").eqNullSafe(F.col("_suffix")) & F.col("host").eqNullSafe(F.col("_host")), "left")
    logs, choice = _fused(languages, at_all)
    decided = joined.withColumn("fused", logs).withColumn("_choice", choice)
    language = F.when((F.col("letters") > 0) & (F.col("_choice.language") != "und"), F.col("_choice.language"))
    return decided.select(F.col("_keep").alias(keep), language.alias("language"),
                          F.when(F.col("letters") > 0, F.col("_choice.posterior")).otherwise(0.0).alias("posterior"), language.isNotNull().alias("kept"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is found."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", F.col("lang").alias("declared"),
                       F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    return identify(rows, "row").where("kept").select("row.*")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as evidence rows: page_id, text of the markup, declared language, host, suffix."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), r"^(www|m)\.", "")
    return pages.select("page_id", text.alias("text"), F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"),
                        host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as evidence rows: doc_id, text, their lang as declaration and source as host.

    Sources have no address suffix, so they share a nameless one.
    """
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
