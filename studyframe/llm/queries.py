"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_dedup, language_id, main_text, ngram_join, packing, prefix_trie, quality, secret_scan, sharding, spelling, token_counts

#: Folder of the public tokenizer files; their place is a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 24


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file's place: STUDYFRAME_TOKENIZERS if set, else that of the installed files."""
    if folder := os.environ.get("STUDYFRAME_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages (a page has the id -1 - page_id): id, table, language, posterior, kept."""
    docs = language_id.identify(language_id.document_evidence(table(spark, sf_dir, "documents")), "doc_id")
    pages = language_id.identify(language_id.page_evidence(table(spark, sf_dir, "pages")), "page_id")
    return docs.select("doc_id", F.lit("documents").alias("origin"), "language", F.round("posterior", 6).alias("posterior"), "kept").unionByName(
        pages.select((F.lit(-1).cast("long") - F.col("page_id")).alias("doc_id"), F.lit("pages").alias("origin"), "language",
                     F.round("posterior", 6).alias("posterior"), "kept"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_counts.over_limit_report(counts, 1024)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.leaks_by_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit_secrets(docs))

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = named(F.filter("findings", lambda s: s["kind"] != "model"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
                        named(F.col("findings")).alias("spans"), count("model"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (part != 1))
    model = quality.fit_quality(quality.labelled_rows(docs, labels))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    # each row is the one event of its own message
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("message"), "turn", "role",
                         F.lit("message").alias("kind"), "text")
    formatted = chat.format_conversations(events, may_regenerate=False)
    read = formatted.withColumns({"turns": chat.read_back(F.col("formatted")), "lost": chat.loss_text(F.col("segments"))})
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of bytes; the statement's ``crc`` row has the byte table ``t``."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


#: The table of CRC-32 by its polynomial.
_CRC_TABLE_SQL = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""


def _chat_sql() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for mark in chat.CONTROL:
            out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
        return out

    extra = len(chat.OPEN + chat.NAMED + chat.CLOSE)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS lost,
    CAST(sum({extra} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM c"""


#: Documents reach every smaller id over links; the smallest one names the component.
_JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL"""

_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.vec_id WHERE r.root < e.y
), c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT c.vec_id, (SELECT count(*) FROM e WHERE e.x = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c"""

#: The best window starts at a shingle of the item or ends the document.
_LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT doc_id, n, u.k AS pos, u.g AS g FROM (SELECT doc_id, len(w) AS n, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: {'k': i - 1, 'g': array_to_string(w[i:i + 4], ' ')})
    WHEN len(w) > 0 THEN [{'k': 0, 'g': array_to_string(w, ' ')}] ELSE [] END) AS u FROM d)
), bs AS (
  SELECT item_id, n, greatest(n - 4, 1) AS m, g, count(*) AS times FROM (SELECT item_id, len(w) AS n, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM b) GROUP BY ALL
), a AS (SELECT doc_id, ds.n, item_id, bs.n AS words, m, times, pos, ds.g FROM ds JOIN bs USING (g)
), q AS (SELECT doc_id, item_id FROM a GROUP BY ALL HAVING count(*) >= max(m) * 0.75
), t AS (SELECT DISTINCT doc_id, item_id, n, words, m, least(pos, greatest(n - words, 0)) AS start FROM a JOIN q USING (doc_id, item_id)
), c AS (
  SELECT t.doc_id, t.item_id, t.start, t.m, greatest(least(t.words, t.n) - 4, 1) AS total, a.g, least(count(*), max(a.times)) AS common
  FROM t JOIN a ON a.doc_id = t.doc_id AND a.item_id = t.item_id AND a.pos >= t.start AND a.pos < t.start + greatest(least(t.words, t.n) - 4, 1) GROUP BY ALL
), s AS (SELECT doc_id, item_id, start, sum(common) AS common, max(total) + max(m) - sum(common) AS larger FROM c GROUP BY ALL
), h AS (SELECT doc_id, item_id, max(CAST(common AS DOUBLE) / CAST(larger AS DOUBLE)) AS similarity FROM s WHERE 100 * common >= 75 * larger GROUP BY ALL
), x AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(similarity) AS similarity FROM h GROUP BY 1)
SELECT d.doc_id, x.doc_id IS NOT NULL AS contaminated, coalesce(x.n_items, 0) AS n_items, coalesce(x.item_ids, '') AS item_ids,
  coalesce(x.similarity, 0.0) AS similarity FROM d LEFT JOIN x USING (doc_id)"""


#: A node is the list of its turns' digests; sums over subtrees join each node with all its prefixes.
_TRIE_SQL = r"""
WITH """ + _CRC_TABLE_SQL + r""", o AS (
  SELECT conv_id, list({'g': g, 'w': w} ORDER BY turn NULLS FIRST, role, g) AS s FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
      CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS w
    FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), h AS (SELECT conv_id, s, conv_id - ((conv_id % 20) + 20) % 20 AS base,
    """ + _crc32_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))") + r""" % 4 AS h FROM o, crc
), c AS (SELECT h.conv_id, coalesce(b.s, [])[1:h.h] || h.s[h.h + 1:] AS s FROM h LEFT JOIN o b ON b.conv_id = h.base
), p AS (SELECT conv_id, len(s) AS size, unnest(range(0, len(s) + 1)) AS depth, list_transform(s, lambda x: x.g) AS k, s FROM c
), n AS (SELECT k[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n,
    any_value(CASE WHEN depth > 0 THEN s[depth].w ELSE 0 END) AS w, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth) AS ends
  FROM p GROUP BY 1, 2
), q AS (SELECT k[1:depth - 1] AS k, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1
), u AS (SELECT k[1:d] AS k, sum(CASE WHEN children IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved
  FROM (SELECT n.k, n, w, children, unnest(range(0, depth + 1)) AS d FROM n LEFT JOIN q USING (k)) GROUP BY 1)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(q.children, 0) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN u USING (k) LEFT JOIN q USING (k) LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.k = n.k[1:n.depth - 1]"""

#: Near words share what is left when one place is taken out (or blanked, for a replaced letter).
_SPELLING_SQL = r"""
WITH RECURSIVE """ + _CRC_TABLE_SQL + r""", r AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL
), c AS (SELECT w, n, """ + _crc32_sql("""flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) - 64 AS BIGINT)] END))""") + r""" AS h FROM r, crc
), v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM c)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), x AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS k FROM v
), d AS MATERIALIZED (SELECT word, n, k, word[1:k] || word[k + 2:] AS rest FROM x
), e AS (
  SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest
), b AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM e JOIN v ON v.word = e.b GROUP BY 1
), f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN b USING (word)
), g(word, last, onward) AS (SELECT word, word, form FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.onward)
SELECT f.word, f.form, g.last AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word AND g.onward IS NULL"""

# name -> (builder, oracle SQL or None)
ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_decontamination": (op3_decontamination, _LEAKS_SQL),
    "op4_ngram_jaccard_join": (op4_ngram_jaccard_join, _JACCARD_SQL),
    "op5_embedding_dedup": (op5_embedding_dedup, _VECTORS_SQL),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_sharding": (op7_sharding, None),
    "op8_quality": (op8_quality, None),
    "op9_chat_format": (op9_chat_format, _chat_sql()),
    "op10_best_fit_packing": (op10_best_fit_packing, None),
    "op11_conversation_trie": (op11_conversation_trie, _TRIE_SQL),
    "op12_spelling_variants": (op12_spelling_variants, _SPELLING_SQL),
    "op13_main_text": (op13_main_text, None),
}
QUERIES = {k: v[0] for k, v in ENTRIES.items()}
ORACLE_SQL = {k: v[1] for k, v in ENTRIES.items() if v[1] is not None}
