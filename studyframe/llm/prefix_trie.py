"""Operator 11: the prefix trie of conversations, by truncation peeling.

Equal conversations are first made one class. The peeling starts at the deepest place where
two classes can still differ: whatever lies beyond the last turn that two classes share is an
unbranched tail, whose nodes follow from sums over the tail. From there each round has the
surviving nodes of the level below and the classes that end at this level, groups them by the
digest of their prefix (that is the discovery of the level's nodes, and their aggregation),
writes the nodes and strips the last turn. The rounds are as many as the longest shared prefix
has turns, whatever the number of conversations.

What travels is a 16-byte digest and a word count a turn, not the texts. The turns of one
conversation (as digests) meet in one task; no group of conversations does: nodes are grouped
with partial aggregation, parents with many children are joined by a broadcast of bounded
size, and the ids that end at a node are hashed as a stream of sorted pieces.

Nulls: a null role or text is empty, a null turn comes before all others; rows without
conversation id belong to no conversation. Equal turns of a conversation are ordered by role
and then by the digest of role and text; repeated rows are repeated turns. Only the four
columns are read. An empty table gives an empty trie: the root without members is no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.session import discard, materialize

#: Words in the sense of the token statistics: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Parents whose children are joined by a broadcast are at most this many.
MOST_HEAVY = 50_000
#: A parent with up to this many children never counts as heavy.
LIGHT_CHILDREN = 1_000
#: Characters of one piece of a sorted id list.
PIECE = 1 << 16


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of digest and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(said.cast("binary"))).alias("digest"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def forked(turns: DataFrame, family: int, most: int) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % family.

    h is the unsigned CRC-32 of the decimal id modulo ``most``. A missing first conversation
    gives no turns, a short one all it has. At most ``family`` conversations read one first
    conversation, so the join has no hot key. (% is never negative here.)
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(family))
    heads = turns.where(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(most - 1, 1)).alias("head"))
    own = turns.select("conv_id", base.alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int").alias("h"), "turns")
    none = F.slice("turns", 1, 0)
    both = own.join(heads, "base", "left").withColumn("head", F.coalesce("head", none))
    return both.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, key, keys, sums): digests of all prefixes, each made from the one before, and words up to each."""
    for batch in batches:
        keys, sums, last = [], [], []
        for turns in batch.column(1).to_pylist():
            now, chain, words = b"", [], [0]
            for t in turns:
                now = hashlib.md5(now + t["digest"], usedforsecurity=False).digest()
                chain.append(now)
                words.append(words[-1] + t["words"])
            keys.append(chain)
            last.append(now)
            sums.append(words)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(k) for k in keys], pa.int64()), pa.array(last, pa.binary()),
             pa.array(keys, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64()))],
            ["conv_id", "depth", "key", "keys", "sums"])


def _pieces(limit: int):
    """Runs of one key in sorted rows as pieces of comma-joined ids: (key, first, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        names, kinds = ["key", "first", "ids"], [pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or size >= limit):
                    out.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield _table(out, names, kinds)
        if ids:
            yield _table([(key, first, ",".join(ids))], names, kinds)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of sorted pieces; one running digest is kept, however many ids a key has."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest is not None and k == key:
                digest.update(b",")
            else:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield _table(out, ["key", "ends_sha256"], [pa.binary(), pa.string()])
    if digest is not None:
        yield _table([(key, digest.hexdigest())], ["key", "ends_sha256"], [pa.binary(), pa.string()])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def ends_digest(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending, comma-joined ids of each key; ``ends`` has key and conv_id.

    The ids are sorted by a range partitioning, so a key with very many of them is cut over
    tasks; its pieces (64 KB of text each) then pass one running digest in order, as SHA-256 asks.
    """
    cut = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = cut.mapInArrow(_pieces(piece), "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def classes_of(turns: DataFrame) -> DataFrame:
    """One row per distinct conversation: conv_id (smallest), n, depth, key, keys, sums, ends_sha256; written."""
    chains = materialize(turns.mapInArrow(_chain, "conv_id long, depth long, key binary, keys array<binary>, sums array<long>"), "trie-chains")
    groups = chains.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    groups = groups.join(ends_digest(chains), "key").drop("key")
    out = materialize(chains.join(groups, "conv_id"), "trie-classes")
    discard(chains)
    return out


def shared_depth(classes: DataFrame) -> int:
    """Turns of the longest prefix that two classes have in common."""
    prefixes = classes.select("conv_id", F.posexplode("keys").alias("at", "key"))
    met = prefixes.groupBy("key").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"), F.max("at").alias("at"))
    at = met.where("low < high").agg(F.max("at")).first()[0]
    return 0 if at is None else at + 1


def _upto(column: str, depth: int):
    """The array cut to what belongs to the first ``depth`` turns (``sums`` starts with a 0)."""
    return F.slice(column, 1, depth + 1 if column == "sums" else max(depth, 1)).alias(column)


def _with_tail(classes: DataFrame, top: int) -> DataFrame:
    """Classes cut to ``top`` turns, with what their tails add to the place of the cut."""
    longer = F.col("depth") > top
    beyond = F.when(longer, F.element_at("sums", -1) - F.element_at("sums", top + 1)).otherwise(0)
    return classes.select(
        "conv_id", "n", F.least("depth", F.lit(top)).alias("depth"), _upto("keys", top), _upto("sums", top), longer.cast("long").alias("children"),
        longer.cast("long").alias("leaves"), ((F.col("n") - 1) * beyond).alias("saved"), F.when(~longer, F.col("ends_sha256")).alias("ends"))


def _tail_nodes(classes: DataFrame, top: int) -> DataFrame:
    """The nodes beyond ``top`` turns: nobody but their class is there, and all but the last have one child."""
    deep = classes.where(F.col("depth") > top).withColumnRenamed("depth", "size")
    # from the words up to the turn before each node
    before = F.posexplode(F.slice("sums", F.lit(top + 1), F.col("size").cast("int") - top))
    deep = deep.select("conv_id", "n", "size", F.element_at("sums", -1).alias("all"), "ends_sha256", before.alias("i", "before"))
    depth = (F.col("i") + (top + 1)).cast("long")
    last = depth == F.col("size")
    return deep.select(
        "conv_id", depth.alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (~last).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("all") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).alias("ends"))


def _peeled(classes: DataFrame, top: int) -> list[DataFrame]:
    """The nodes of depth ``top`` down to 0, one written table a level."""
    ending = materialize(_with_tail(classes, top).sortWithinPartitions("depth"), "trie-ending")
    names = ["conv_id", "n", "keys", "sums", "children", "leaves", "saved", "ends"]
    levels: list[DataFrame] = []
    for depth in range(top, -1, -1):
        here = ending.where(F.col("depth") == depth).select(*names)
        if levels:
            # a surviving node is one child of what is left of it
            here = here.unionByName(levels[-1].select(
                "conv_id", "n", _upto("keys", depth), _upto("sums", depth), F.lit(1).cast("long").alias("children"), "leaves", "saved",
                F.lit(None).cast("string").alias("ends")))
        key = F.element_at("keys", depth) if depth else F.lit(bytearray())
        word = F.element_at("sums", depth + 1) - F.element_at("sums", depth) if depth else F.lit(0).cast("long")
        nodes = here.withColumn("key", key).groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first("keys").alias("keys"), F.first("sums").alias("sums"),
            F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
        levels.append(materialize(nodes.select(
            "key", F.lit(depth).cast("long").alias("depth"), (F.element_at("keys", depth - 1) if depth > 1 else F.lit(bytearray())).alias("parent"),
            "conv_id", "n", "keys", "sums", "children", F.greatest("leaves", F.lit(1)).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * word).alias("saved"), "ends"), "trie-level"))
    discard(ending)
    return levels


def _parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id; parents with many children are few, so their ids are broadcast."""
    total = nodes.count()
    limit = max(LIGHT_CHILDREN, total // MOST_HEAVY)
    # every node is at most one parent's child: at most total / limit <= MOST_HEAVY heavy parents
    ids = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "children")
    found = nodes.where("depth > 0").join(F.broadcast(ids.where(F.col("children") > limit).drop("children")), F.col("parent") == F.col("up"), "left").drop("up")
    light = found.where("parent_conv_id is null").drop("parent_conv_id").join(
        ids.where(F.col("children") <= limit).drop("children"), F.col("parent") == F.col("up")).drop("up")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return found.where("parent_conv_id is not null").unionByName(light).unionByName(root)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv_id, turns as from ``conversation_turns``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    classes = classes_of(turns)
    if not classes.limit(1).count():
        top = 0
    else:
        top = min(shared_depth(classes) + 1, classes.agg(F.max("depth")).first()[0])
    levels = _peeled(classes, top)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = materialize(nodes.drop("keys", "sums"), "trie-nodes")
    for level in levels:
        discard(level)
    upper = _parents(nodes).select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    out = upper.unionByName(_tail_nodes(classes, top))
    return out.withColumn("ends", F.coalesce("ends", F.sha2(F.lit(""), 256))).withColumnRenamed("ends", "ends_sha256")


def conversation_trie(rows: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The trie of the conversations in ``rows`` (conv_id, turn, role, text), rebuilt by ``forked``."""
    turns = materialize(conversation_turns(rows), "trie-turns")
    out = prefix_trie(forked(turns, family, most))
    discard(turns)
    return out
