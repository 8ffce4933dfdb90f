"""Operator 3: benchmark decontamination by SimHash of item-sized windows.

Texts are compared as bags of five-word shingles (letters and digits, lower case). An item
of fewer than five words is leaked only by a text of just these words: inside longer texts
so short a phrase proves nothing. A window of a document is as many
words as a benchmark item has. A document leaks an item if the bag of some window reaches
a weighted Jaccard similarity (sum of smaller over sum of larger multiplicities) of
``PERCENT`` with the item's.

1. Document shingles that occur in the benchmark are anchors. Bags of windows of one size
   are equally large, so the best window starts at an anchor or ends the document; starts
   after which too few anchors follow are left out. This loses nothing.
2. Each remaining window and each item get a 64-bit SimHash of their shingles, each hashed
   together with its occurrence number, so that equal bits follow the weighted similarity
   also where shingles are repeated.
3. Multi-index blocks: fingerprints at most ``RADIUS`` bits apart agree up to one bit in one
   of ``BLOCKS`` blocks; items are listed under every block value with any one bit turned,
   windows under their own, among windows and items of one size. All pairs within the
   radius are found.
4. Those pairs are verified exactly, shingle by shingle.

Copies of a text are handled once, by digest. Only DataFrame functions are used.

Nulls: a null or wordless text leaks nothing and a null or wordless item is never leaked; a
null id passes through. An item is known by its words, so an item with a null item_id is
leaked like any other (listed as a null before the other ids, and counted), and several
texts under one item_id are compared one by one. Repeated rows get the same result; items
of one text are all listed. Without items nothing is contaminated. Other columns are not carried by
``leaks_by_document`` and all are kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.session import materialize

WORDS, PERCENT = 5, 75
BITS, BLOCKS = 64, 12
#: With one turned bit looked up in each block, 2 * BLOCKS - 1 bits apart are always found.
RADIUS = 2 * BLOCKS - 1
#: Largest tables that are broadcast; larger ones are joined by a shuffle.
BROADCAST_SHINGLES, BROADCAST_TEXTS = 2_000_000, 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, though lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def shingles(ws: Column) -> Column:
    """All shingles of a word array in order, as strings of words."""

    def of(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.array_join(F.slice(w, i, WORDS), " "))
        return F.when(F.size(w) >= WORDS, whole).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return _bound(ws, of)


def shingle_hashes(ws: Column) -> Column:
    """A hash of every shingle, in order; equal shingles have equal ones."""

    def of(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
        return F.when(F.size(w) >= WORDS, whole).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _bound(ws, of)


def numbered(shingles: Column) -> Column:
    """The shingles of a bag with the second and later occurrences told apart by their number.

    The weighted Jaccard similarity of two bags is then that of two sets, in any order.
    """

    def of(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        def runs(at: Column) -> Column:
            def run(p: Column, k: Column) -> Column:
                end = F.coalesce(F.get(at, k + 1), F.size(s))
                more = F.transform(F.sequence(F.lit(2), end - p), lambda n: F.concat(F.get(s, p), F.lit("#"), n.cast("string")))
                return F.when(end - p > 1, F.concat(F.array(F.get(s, p)), more)).otherwise(F.array(F.get(s, p)))
            return F.flatten(F.transform(at, run))
        return _bound(first, runs)

    repeats = F.size(F.array_distinct(shingles)) < F.size(shingles)
    return F.when(repeats, _bound(F.sort_array(shingles), of)).otherwise(shingles)


def _maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a written table if its rows are few enough; else leave the join to the planner."""
    return F.broadcast(df) if df.count() <= most else df


def simhash(rows: DataFrame, by: list[str], shingle: str) -> DataFrame:
    """(by..., fingerprint) from a row per shingle occurrence.

    A sum holds the counts of two bits, 32 places apart, so 32 sums are enough.
    """
    h = F.xxhash64(F.lit("simhash"), shingle)
    sums = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{j}") for j in range(32)]
    counted = rows.groupBy(*by).agg(F.count("*").alias("size"), *sums)
    bits = []
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"s{j}"), 32)
        bits += [F.when(low * 2 > F.col("size"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")),
                 F.when(high * 2 > F.col("size"), F.lit(1 << (j + 32) if j < 31 else -(1 << 63))).otherwise(F.lit(0).cast("long"))]
    fingerprint = bits[0]
    for b in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(b)
    return counted.select(*by, "size", fingerprint.alias("fingerprint"))


def _blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [k * BITS // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block_values(fingerprint: Column, turned: bool) -> Column:
    """Array of (block, value), with every value one bit away too if ``turned``."""
    out = []
    for k, (first, bits) in enumerate(_blocks()):
        value = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1))
        for mask in [0, *(1 << b for b in range(bits))] if turned else [0]:
            out.append(F.struct(F.lit(k).alias("block"), value.bitwiseXOR(F.lit(mask)).alias("value")))
    return F.array(*out)


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of windows and items of one size whose fingerprints are at most RADIUS bits apart.

    ``windows``: key, words, start, fingerprint; ``items``: item_id, words, fingerprint.
    """
    w = windows.select("key", "words", "start", F.col("fingerprint").alias("f"), F.explode(_block_values(F.col("fingerprint"), False)).alias("b"))
    i = items.select("item_id", F.col("words").alias("item_words"), F.col("fingerprint").alias("g"), F.explode(_block_values(F.col("fingerprint"), True)).alias("c"))
    met = w.join(i, (F.col("words") == F.col("item_words")) & (F.col("b.block") == F.col("c.block")) & (F.col("b.value") == F.col("c.value")))
    near = met.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS)
    return near.select("key", "words", "start", "item_id").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """(key, item, similarity, start): the best window for each leaked text (by digest) and item (by digest of its words)."""
    items = benchmark.select(words(F.col(item_text)).alias("ws")).where(F.size("ws") > 0)
    items = materialize(items.select(item_digest(F.col("ws")).alias("item"), F.size("ws").alias("words"), shingles(F.col("ws")).alias("shingles"), shingle_hashes(F.col("ws")).alias("hashes"))
                        .withColumn("size", F.size("shingles")).distinct(), "items")
    known = materialize(items.select("words", "size", "item", F.explode("hashes").alias("hash")).distinct(), "item-hashes")
    asked = _maybe_broadcast(materialize(known.select("hash").distinct(), "known-hashes"), BROADCAST_SHINGLES)

    # 1: anchors, once for each text
    keyed = docs.select(digest(text_col).alias("key"), words(F.col(text_col)).alias("ws"))
    spread = keyed.select("key", F.size("ws").alias("n"), F.posexplode(shingle_hashes(F.col("ws"))).alias("pos", "hash"))
    anchors = materialize(spread.join(asked, "hash", "left_semi").distinct(), "anchors")
    by_item = anchors.join(_maybe_broadcast(known, BROADCAST_SHINGLES), "hash")
    need = F.ceil(F.col("size") * F.lit(PERCENT) / F.lit(100)).cast("int")
    grouped = by_item.groupBy("key", "n", "words", "size", "item").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    grouped = grouped.withColumn("need", need).where(F.size("at") >= F.col("need"))
    end = F.greatest(F.col("n") - F.col("words"), F.lit(0))
    enough = F.filter("at", lambda p, k: (p <= end) & (F.get(F.col("at"), k + F.col("need") - 1) - p < F.col("size")))
    closing = F.when(F.get(F.col("at"), F.size("at") - F.col("need")) >= end, F.array(end)).otherwise(F.array().cast("array<int>"))
    starts = grouped.select("key", "words", F.explode(F.array_union(enough, closing)).alias("start")).distinct()
    starts = materialize(starts, "windows")

    # 2: the words of those windows, from one row for each text
    texts = docs.select(digest(text_col).alias("key"), F.col(text_col).alias("text"))
    wanted = _maybe_broadcast(materialize(starts.select("key").distinct(), "window-texts"), BROADCAST_TEXTS)
    whole = texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    whole = materialize(whole.select("key", words(F.col("text")).alias("ws")), "window-words")
    cut = starts.join(whole, "key").select("key", "words", "start", shingles(F.slice("ws", F.col("start") + 1, F.col("words"))).alias("shingles"))
    cut = materialize(cut, "window-shingles")
    prints = simhash(cut.select("key", "words", "start", F.explode(numbered(F.col("shingles"))).alias("shingle")), ["key", "words", "start"], "shingle")
    item_prints = simhash(items.select("item", "words", F.explode(numbered(F.col("shingles"))).alias("shingle")), ["item", "words"], "shingle")

    # 3 and 4
    pairs = materialize(within_radius(prints, item_prints.withColumnRenamed("item", "item_id")).withColumnRenamed("item_id", "item"), "near-windows")

    def bags(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.select(*by, F.size("shingles").alias("total"), F.explode("shingles").alias("shingle")).groupBy(*by, "total", "shingle").agg(F.count("*").alias("times"))

    ours = bags(cut.join(pairs.select("key", "words", "start").distinct(), ["key", "words", "start"], "left_semi"), ["key", "words", "start"])
    theirs = bags(items, ["item"]).withColumnsRenamed({"total": "item_total", "times": "item_times"})
    common = (pairs.join(ours, ["key", "words", "start"]).join(theirs, ["item", "shingle"])
              .groupBy("key", "item", "start", "total", "item_total").agg(F.sum(F.least("times", "item_times")).alias("common")))
    larger = F.col("total") + F.col("item_total") - F.col("common")
    hits = common.where(F.col("common") * 100 >= larger * PERCENT).select("key", "item", (F.col("common") / larger).alias("similarity"), "start")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")  # the first of the best
    return hits.groupBy("key", "item").agg(best).select("key", "item", "best.similarity", (-F.col("best.back")).alias("start"))


def digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def item_digest(ws: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(ws, " "), 256))


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, contaminated, n_items, item_ids (sorted), similarity (of the best window)."""
    names = benchmark.select("item_id", item_digest(words(F.col("text"))).alias("item")).distinct()
    # in a struct, as a set leaves out bare nulls
    leaks = find_leaks(docs, benchmark, text_col).join(names, "item").groupBy("key").agg(
        F.sort_array(F.collect_set(F.struct("item_id"))).alias("named"), F.max("similarity").alias("similarity"))
    leaks = leaks.select("key", F.col("named.item_id").alias("item_ids"), "similarity")
    leaks = _maybe_broadcast(materialize(leaks, "leaks"), BROADCAST_TEXTS)
    joined = docs.select(F.col(id_col), digest(text_col).alias("key")).join(leaks, "key", "left")
    return joined.select(id_col, F.col("similarity").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                         F.coalesce("item_ids", F.array().cast(leaks.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns whatever their names, that leak no item."""
    own = free_name(docs, "leaked_key")
    leaked = materialize(find_leaks(docs, benchmark, text_col).select(F.col("key").alias(own)).distinct(), "leaked")
    return docs.join(_maybe_broadcast(leaked, BROADCAST_TEXTS), digest(text_col) == F.col(own), "left_anti")
