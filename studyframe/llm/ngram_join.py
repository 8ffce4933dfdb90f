"""Operator 4: Jaccard join of word shingles by a grouped prefix join.

A document is its set of distinct five-word shingles (64-bit hashes). Two sets with a
Jaccard similarity of at least PERCENT share a shingle among the first of both in any
fixed order. The order used: shingles that few documents have come first by hash, shingles
that many have come last, so a passage shared by thousands rarely selects anyone. For the
pair's smaller set a shorter index prefix is enough.

Steps, each a Spark job over the whole table:
1. document counts of all shingles, as sorted hash blocks dealt by hash range; the heaviest ones, at most ``heavy_limit``,
   travel to the tasks and only decide the order, never what is compared;
2. per document: set size, digest of the set, and the id of its group, all documents of
   one size and one prefix;
3. prefix entries (shingle, group) dealt by hash range; groups that meet in a shingle and
   whose sizes allow the similarity are candidate pairs. A shingle with more than
   ``SMALL`` groups gives the chain of its neighbours by size first, and is kept;
4. group pairs are expanded into set pairs. Counts of a set's shingles by hash bucket bound
   what two sets can share and leave out most pairs that do not link; the others are
   verified on the exact sets, block against block, so each set is shipped about once;
5. pairs left over from large shingles and large groups whose ends are still in different
   components are verified in a second round; others are linked already;
6. connected components of the verified links.

Equal texts and equal sets are one node throughout. Nulls: a null text is empty; texts
without words have no set and are linked with nothing; a null id is counted like any other
row but is no component id. Repeated rows stay. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.session import discard, materialize

from .arrowtext import per_slice, slices, text_bytes, tidy
from .graph import components
from .shingles import shingle_sets

PERCENT = 75
SMALL = 32            # groups in a shingle that are paired at once
HEAVY_FROM = 8        # documents that make a shingle heavy at least
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
# Largest tables that are broadcast (set names, pairs); larger ones are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_PAIRS = 300_000, 1_000_000
MOST_MEETINGS = 64    # large shingles of a group that its rows carry along
FINE = 512            # shingles of a set whose signature is a fine one
_FLUSH = 2_000_000    # hashes a task holds before it passes them on


def probe_length(n: int) -> int:
    """Prefix in which a set meets every similar set that is not smaller than itself or not larger."""
    return n - (PERCENT * n + 99) // 100 + 1


def index_length(n: int) -> int:
    """Shorter prefix that is enough for the smaller set of a pair: it shares 2t/(1+t) of its size."""
    return n - (2 * PERCENT * n + 99 + PERCENT) // (100 + PERCENT) + 1


def _digest(*parts: bytes, size: int = 16) -> bytes:
    h = hashlib.blake2b(digest_size=size)
    for p in parts:
        h.update(p)
    return h.digest()


def _codes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Range (upper ``bits``) and 32 more bits of hashes."""
    return (hashes >> np.uint64(32 - bits)).astype(np.int64)


def _by_range(codes: np.ndarray) -> list[tuple[int, slice]]:
    """Stretches of sorted codes by range."""
    ranges = codes >> 32
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    edges = [0, *cuts.tolist(), len(codes)]
    return [(int(ranges[a]), slice(a, b)) for a, b in zip(edges, edges[1:]) if b > a]


# ---- 1: heavy shingles ------------------------------------------------------------

def heavy_shingles(docs: DataFrame, bits: int, heavy_limit: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, document counts) of the shingles that most documents have."""

    def count(batches):
        held, size = [], 0

        def flush():
            codes, n = np.unique(_codes(np.concatenate(held), bits), return_counts=True)
            rows = _by_range(codes)
            many = [np.flatnonzero(n[s] > 1).astype(np.uint32) for _, s in rows]
            return pa.RecordBatch.from_arrays([
                pa.array([r for r, _ in rows], pa.int32()),
                pa.array([(codes[s] & 0xFFFFFFFF).astype(np.uint32).tobytes() for _, s in rows], pa.binary()),
                pa.array([m.tobytes() for m in many], pa.binary()),
                pa.array([n[s][m].astype(np.uint32).tobytes() for (_, s), m in zip(rows, many)], pa.binary())],
                ["range", "codes", "places", "counts"])

        for batch in batches:
            for part in slices(batch, text_col):
                for s in shingle_sets(*text_bytes(part.column(0))):
                    held.append(s)
                    size += len(held[-1])
                if size > _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def heavy(batches):
        now, held = None, []

        def settle():
            codes = np.concatenate([c for c, _ in held]).astype(np.int64)
            codes, at = np.unique(codes, return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            keep = total >= HEAVY_FROM
            return pa.RecordBatch.from_arrays([pa.array(codes[keep] + (now << 32)), pa.array(total[keep])], ["code", "documents"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != now:
                    if held:
                        yield settle()
                    now, held = r["range"], []
                codes = np.frombuffer(r["codes"], np.uint32)
                n = np.ones(len(codes))
                n[np.frombuffer(r["places"], np.uint32)] = np.frombuffer(r["counts"], np.uint32)
                held.append((codes, n))
        if held:
            yield settle()

    blocks = docs.select(text_col).mapInArrow(tidy(count), "range int, codes binary, places binary, counts binary")
    table = materialize(blocks.repartition(1 << bits, "range").sortWithinPartitions("range").mapInArrow(tidy(heavy), "code long, documents long"), "heavy")
    least = HEAVY_FROM
    while table.where(F.col("documents") >= least).count() > heavy_limit:
        least *= 2
    rows = table.where(F.col("documents") >= least).toPandas().sort_values("code")  # at most heavy_limit rows of 16 bytes
    discard(table)
    return rows["code"].to_numpy(np.int64), rows["documents"].to_numpy(np.int64)


class Order:
    """The order of shingles: light ones, then heavy ones by their documents."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bits: int):
        self.codes, self.counts, self.bits = codes, counts, bits

    def prefix(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The probe prefix of each sorted set, in order."""
        together = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        rank = np.zeros(len(together), np.int64)
        if len(self.codes):
            own = _codes(together, self.bits)
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            rank = np.where(self.codes[at] == own, self.counts[at], 0)
        out, a = [], 0
        for s in sets:
            r = rank[a:a + len(s)]
            a += len(s)
            n = probe_length(len(s)) if len(s) else 0
            light = np.flatnonzero(r == 0)
            out.append(s[light[:n]] if len(light) >= n else s[np.argsort(r, kind="stable")[:n]])
        return out


def _group(n: int, prefix: np.ndarray) -> int:
    return int.from_bytes(_digest(n.to_bytes(8, "little"), prefix.tobytes(), size=8), "little", signed=True)


# ---- 3: candidates ------------------------------------------------------------------

def _entries(batches, order: Order, bits: int, text_col: str):
    """Prefix entries in rows by hash range: shingle and index mark, place of the group, groups, sizes."""
    held: dict[tuple[int, int], np.ndarray] = {}
    size = 0

    def flush():
        names = list(held)
        lengths = np.array([len(held[g]) for g in names])
        tokens = np.concatenate([held[g] for g in names])
        owner = np.repeat(np.arange(len(names)), lengths)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        index = place < np.repeat([index_length(n) for _, n in names], lengths)
        code = (tokens >> np.uint64(64 - bits - 31)).astype(np.int64)
        by = np.argsort(code >> 31, kind="stable")
        code, owner, index = code[by], owner[by], index[by]
        edges = np.append(np.flatnonzero(np.diff(code >> 31, prepend=-1)), len(code))
        rows = []
        for a, b in zip(edges, edges[1:]):
            groups, local = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(code[a] >> 31), ((code[a:b] & 0x7FFFFFFF) << 1 | index[a:b]).astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(),
                         np.array([names[g][0] for g in groups], np.int64).tobytes(), np.array([names[g][1] for g in groups], np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))],
                                          ["range", "tokens", "places", "groups", "sizes"])

    for batch in batches:
        for part in slices(batch, text_col):
            sets = [s for s in shingle_sets(*text_bytes(part.column(0))) if len(s)]
            for s, prefix in zip(sets, order.prefix(sets)):
                key = (_group(len(s), prefix), len(s))
                if key not in held:
                    held[key] = prefix
                    size += len(prefix)
            if size > _FLUSH // 2:
                yield flush()
                held, size = {}, 0
    if size:
        yield flush()


def _sizes_allow(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return 100 * small.astype(np.int64) >= PERCENT * large.astype(np.int64)


def _candidates(batches):
    """Pairs of groups (kind 0) and members of large shingles (kind 1) of sorted range rows."""

    def settle(range_, rows):
        tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint32) for r in rows])
        groups = np.concatenate([np.frombuffer(r["groups"], np.int64)[np.frombuffer(r["places"], np.uint32)] for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32)[np.frombuffer(r["places"], np.uint32)] for r in rows])
        index, tokens = (tokens & 1).astype(bool), tokens >> 1
        # only shingles of two entries or more matter
        _, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        keep = n[at] > 1
        tokens, groups, sizes, index = tokens[keep], groups[keep], sizes[keep], index[keep]
        by = np.lexsort((groups, sizes, tokens))
        tokens, groups, sizes, index = tokens[by], groups[by], sizes[by], index[by]
        if len(tokens):
            same = (tokens[1:] == tokens[:-1]) & (groups[1:] == groups[:-1]) & (sizes[1:] == sizes[:-1])
            keep = np.append(True, ~same)
            tokens, groups, sizes, index = tokens[keep], groups[keep], sizes[keep], index[keep]
        _, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        large = n[at] > SMALL if len(n) else np.zeros(0, bool)
        pairs = []
        for step in range(1, min(SMALL, int(n.max()) if len(n) else 0)):
            ok = tokens[step:] == tokens[:-step]
            if step > 1:
                ok &= ~large[step:]
            # the smaller set stands first; it meets by its index prefix (a chain may do without)
            ok &= _sizes_allow(sizes[:-step], sizes[step:]) & (index[:-step] | large[:-step])
            i = np.flatnonzero(ok)
            pairs.append(np.stack([groups[i], groups[i + step]], 1))
        if pairs:
            pairs = np.concatenate(pairs)
            pairs = np.unique(np.stack([pairs.min(1), pairs.max(1)], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                zero = np.zeros(len(pairs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int8)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(zero.astype(np.int32)),
                                                  pa.array(zero.astype(bool))], ["kind", "a", "b", "size", "index"])
        if large.any():
            names = (np.int64(range_) << 31) + tokens[large].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(names), np.int8)), pa.array(names), pa.array(groups[large]), pa.array(sizes[large]),
                                              pa.array(index[large])], ["kind", "a", "b", "size", "index"])

    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["range"] != now:
                if rows:
                    yield from settle(now, rows)
                now, rows = r["range"], []
            rows.append(r)
    if rows:
        yield from settle(now, rows)


def _cross_pairs(batches):
    """Pairs of groups of one large shingle that are in different components and may hold linked sets.

    Rows are sorted by shingle, size, group. A group of one set brings its signature, by which
    most pairs that do not link are left out before they leave the task; groups of several pass.
    A pair that meets in several large shingles leaves at the first: ``probes`` are a group's
    smaller large shingles, ``indexed`` those among them by which it meets larger sets (both null
    where a group has very many; such pairs may leave more than once).
    """

    def settle(rows: pa.Table):
        size, index = rows["size"].to_numpy(), rows["index"].to_numpy(zero_copy_only=False)
        groups = rows["b"].to_numpy()
        low, at = np.unique(np.array(rows["low"].to_pylist(), object), return_inverse=True)
        high = np.unique(np.array(rows["high"].to_pylist(), object), return_inverse=True)
        whole = low[at] == high[0][high[1]]  # all members of the group in one component
        table = SignatureTable(rows["sig"].to_pylist())
        indexed = rows["indexed"].to_pylist()
        probes = [x or [] for x in rows["probes"].to_pylist()]
        lengths = np.array([len(x) for x in probes])
        flat, start = np.array([x for p in probes for x in p], np.int64), np.cumsum(lengths) - lengths
        for i in range(len(groups) - 1):
            if not index[i]:
                continue
            last = int(np.searchsorted(size, 100 * int(size[i]) // PERCENT, side="right"))
            j = np.arange(i + 1, last)
            j = j[(at[j] != at[i]) | ~whole[j] | ~whole[i]]
            if len(j):
                common = table.common(i, j)
                j = j[100 * common >= PERCENT * (int(size[i]) + size[j].astype(np.int64) - common)]
            if len(j) and indexed[i]:
                own = np.repeat(np.arange(len(j)), lengths[j])
                at_flat = np.arange(len(own)) - np.repeat(np.cumsum(lengths[j]) - lengths[j], lengths[j]) + np.repeat(start[j], lengths[j])
                earlier = np.bincount(own, np.isin(flat[at_flat], indexed[i]), len(j)) > 0
                j = j[~earlier]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(groups[i], groups[j])), pa.array(np.maximum(groups[i], groups[j]))], ["a", "b"])

    now, held = None, []
    for batch in batches:
        names = batch.column("a").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(names, prepend=names[:1] - 1)), len(names))
        for x, y in zip(edges, edges[1:]):
            if names[x] != now:
                if held:
                    yield from settle(pa.Table.from_batches(held))
                now, held = names[x], []
            held.append(batch.slice(int(x), int(y - x)))
    if held:
        yield from settle(pa.Table.from_batches(held))


# ---- 4: verification ----------------------------------------------------------------

def _assign(batches):
    """Blocks for sets in a sorted stream (key, n, pick): so many sets or shingles each, named by the first key."""
    block, count, size = None, 0, 0
    for batch in batches:
        blocks = []
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block is None or count >= BLOCK_SETS or size + n > BLOCK_SHINGLES:
                block, count, size = key, 0, 0
            blocks.append(block)
            count += 1
            size += n
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blocks, pa.binary())], ["key", "pick", "block"])


def _gather(batches):
    """Rows (block, key, blob) sorted by block and key become block rows; a repeated key is taken once."""
    block, keys, blobs = None, [], []

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([keys], pa.list_(pa.binary())), pa.array([blobs], pa.list_(pa.binary()))],
                                          ["block", "keys", "sets"])

    for batch in batches:
        for own, key, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if own != block:
                if keys:
                    yield emit()
                block, keys, blobs = own, [], []
            if not keys or key != keys[-1]:
                keys.append(key)
                blobs.append(blob)
    if keys:
        yield emit()


def signature(s: np.ndarray) -> bytes:
    """Counts of a sorted set by hash bucket; empty if a count needs more than a byte.

    Sets of up to FINE shingles get two to four buckets a shingle, so that the bound comes close to
    what two sets really share; larger ones about two shingles a bucket.
    """
    bits = max(6, (2 * len(s)).bit_length() if len(s) <= FINE else (len(s) // 2).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


class SignatureTable:
    """Signatures of the groups of one shingle, by length, for one against many at a time."""

    def __init__(self, signatures: list[bytes]):
        self.own = signatures
        self.length = np.array([len(x) for x in signatures])
        self.place = np.zeros(len(signatures), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for n in np.unique(self.length):
            rows = np.flatnonzero(self.length == n)
            self.place[rows] = np.arange(len(rows))
            if n:
                self.by[int(n)] = np.frombuffer(b"".join(signatures[k] for k in rows), np.uint8).reshape(len(rows), n)

    def common(self, i: int, j: np.ndarray) -> np.ndarray:
        """Shingles that set i can share with the sets j at most; without a signature, all of them."""
        out = np.full(len(j), np.iinfo(np.int32).max, np.int64)
        if not self.length[i]:
            return out
        mine = np.frombuffer(self.own[i], np.uint8)
        for n, table in self.by.items():
            at = np.flatnonzero(self.length[j] == n)
            if len(at):
                few = min(n, len(mine))
                a = mine if len(mine) == few else mine.reshape(few, -1).sum(axis=1, dtype=np.uint16)
                rows = table[self.place[j[at]]]
                b = rows if n == few else rows.reshape(len(at), few, -1).sum(axis=2, dtype=np.uint16)
                out[at] = np.minimum(b, a).sum(axis=1, dtype=np.int64)
        return out


def may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if no sets of n and m shingles with these signatures are similar."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = b.reshape(len(a), -1).sum(axis=1)
    common = int(np.minimum(a, b).sum(dtype=np.int64))
    return 100 * common >= PERCENT * (n + m - common)


def _near_pairs(batches):
    for batch in batches:
        ka, kb, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
        keep = pa.array([may_link(*r) for r in zip(na, sa, nb, sb)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["ka", "kb"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact test of two sorted sets."""
    both = len(x) + len(y)
    if not _sizes_allow(np.array(min(len(x), len(y))), np.array(max(len(x), len(y)))):
        return False
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return 100 * common >= PERCENT * (both - common)


def _verify(batches):
    """Links among the pairs of a meeting of two blocks; pairs linked already by others are skipped."""
    for batch in batches:
        for r in batch.to_pylist():
            sets = dict(zip(r["keys"], r["sets"]))
            if r["keys_b"] is not None:
                sets |= dict(zip(r["keys_b"], r["sets_b"]))
            root: dict[bytes, bytes] = {}

            def find(k):
                while root.setdefault(k, k) != k:
                    root[k] = k = root[root[k]]
                return k

            a, b = [], []
            for p in r["pairs"]:
                x, y = find(p["ka"]), find(p["kb"])
                if x != y and similar(np.frombuffer(sets[p["ka"]], np.uint64), np.frombuffer(sets[p["kb"]], np.uint64)):
                    root[x] = y
                    a.append(p["ka"])
                    b.append(p["kb"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


class Verifier:
    """Checks pairs of set keys on the exact sets, which come from the texts anew."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame, id_col: str, text_col: str):
        self.docs, self.rows, self.nodes, self.id_col, self.text_col = docs, rows, nodes, id_col, text_col

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their signatures do not rule out."""
        named = pairs.select(F.col("ka").alias("name")).unionByName(pairs.select(F.col("kb").alias("name"))).distinct()
        named = materialize(named.join(self.nodes, F.col("name") == F.col("key")).select("name", F.col("first_id").alias("pick")), "paired-sets")
        few = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
        signed = self.rows.join(few, (F.col("key") == F.col("name")) & F.col("id").eqNullSafe(F.col("pick")))
        signed = materialize(signed.groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")

        def side(s: str) -> DataFrame:
            return signed.select(F.col("key").alias(f"k{s}"), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))

        both = pairs.join(side("a"), "ka").join(side("b"), "kb").select("ka", "kb", "na", "nb", "sa", "sb")
        out = materialize(both.mapInArrow(tidy(_near_pairs), "ka binary, kb binary"), "near-pairs")
        discard(named)
        discard(signed)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (ka, kb) that are linked, or that join what others link."""
        id_col, text_col = self.id_col, self.text_col
        kind = self.docs.schema[id_col].dataType.simpleString()
        given = materialize(pairs, "set-pairs")
        pairs = self.near(given)
        roots = components(pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
        # one document of each set that is asked for
        wanted = materialize(roots.join(self.nodes, F.col("node") == F.col("key")).select("key", "root", "n", F.col("first_id").alias("pick")), "wanted-sets")
        asked = wanted.count()

        def make():
            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                sets = shingle_sets(*text_bytes(batch.column(1)))
                blobs = [s.tobytes() for s in sets]
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(b) for b in blobs], pa.binary()), pa.array(blobs, pa.binary())],
                                                  ["id", "own", "blob"])
            return work

        # blocks of sets that are likely to meet, from their names and sizes alone
        parts = max(1, -(-asked // 20_000))
        in_order = wanted.repartitionByRange(parts, "root", "n", "key").sortWithinPartitions("root", "n", "key")
        places = materialize(in_order.select("key", "n", "pick").mapInArrow(tidy(_assign), f"key binary, pick {kind}, block binary"), "set-places")
        small = F.broadcast(places) if asked <= BROADCAST_KEYS else places
        sets = self.docs.select(id_col, text_col).mapInArrow(per_slice(make, text_col), f"id {kind}, own binary, blob binary")
        sets = sets.join(small, (F.col("own") == F.col("key")) & F.col("id").eqNullSafe(F.col("pick"))).select("block", "key", "blob")
        gathered = sets.repartition("block").sortWithinPartitions("block", "key").mapInArrow(tidy(_gather), "block binary, keys array<binary>, sets array<binary>")
        blocks = materialize(gathered, "set-blocks")
        # pairs of one meeting of two blocks; they are few beside the sets and go to the blocks
        placed = (pairs.join(places.select(F.col("key").alias("ka"), F.col("block").alias("ba")), "ka")
                  .join(places.select(F.col("key").alias("kb"), F.col("block").alias("bb")), "kb"))
        meetings = materialize(placed.groupBy("ba", "bb").agg(F.collect_list(F.struct("ka", "kb")).alias("pairs")), "set-meetings")
        few = pairs.count() <= BROADCAST_PAIRS

        def meeting(inside: bool) -> DataFrame:
            chosen = meetings.where("ba = bb" if inside else "ba != bb")
            return blocks.join(F.broadcast(chosen) if few else chosen, F.col("block") == F.col("ba")).drop("block", "ba")

        nothing = F.lit(None).cast("array<binary>")
        alone = meeting(True).select("pairs", "keys", "sets", nothing.alias("keys_b"), nothing.alias("sets_b"))
        asked_for = meetings.where("ba != bb").select(F.col("bb").alias("block")).distinct()
        other = blocks.join(F.broadcast(asked_for) if few else asked_for, "block", "left_semi")
        other = other.select(F.col("block").alias("bb"), F.col("keys").alias("keys_b"), F.col("sets").alias("sets_b"))
        apart = meeting(False).join(other, "bb").select("pairs", "keys", "sets", "keys_b", "sets_b")
        out = materialize(alone.unionByName(apart).mapInArrow(tidy(_verify), "a binary, b binary"), "set-links")
        for t in (given, pairs, wanted, places, blocks, meetings):
            discard(t)
        return out


# ---- all of it ----------------------------------------------------------------------

def jaccard_components(df: DataFrame, heavy_limit: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links reach)."""
    spark = df.sparkSession
    docs = df.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # ranges of about half a million prefix entries; words take some six bytes
    bits = min(24, max(5, (total // 10_000_000).bit_length()))
    codes, counts = heavy_shingles(docs, bits, heavy_limit, text_col)
    shared = spark.sparkContext.broadcast(Order(codes, counts, bits))

    def describe():
        order = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(*text_bytes(batch.column(1)))
            groups = [_group(len(s), p) for s, p in zip(sets, order.prefix(sets))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s.tobytes()) for s in sets], pa.binary()),
                                               pa.array(groups, pa.int64()), pa.array([signature(s) for s in sets], pa.binary())], ["id", "n", "key", "grp", "sig"])

        return work

    rows = materialize(docs.mapInArrow(per_slice(describe, text_col), f"id {kind}, n long, key binary, grp long, sig binary"), "set-rows")
    nodes = materialize(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.min("id").alias("first_id"), F.first("sig").alias("sig")), "set-nodes")
    entries = docs.select(text_col).mapInArrow(tidy(lambda b: _entries(b, shared.value, bits, text_col)), "range int, tokens binary, places binary, groups binary, sizes binary")
    found = entries.repartition(1 << bits, "range").sortWithinPartitions("range").mapInArrow(tidy(_candidates), "kind byte, a long, b long, size int, index boolean")
    found = materialize(found, "candidates")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    large = found.where("kind = 1").select("a", "b", "size", "index")

    members = nodes.select("grp", "key")
    heads = members.groupBy("grp").agg(F.min("key").alias("head"), F.count("*").alias("members"))

    def of(side: str):
        return heads.select(F.col("grp").alias(side), F.col("head").alias(f"k{side}"))

    group_pairs = materialize(pairs, "group-pairs")
    # first round: one member for each group, and every member of a group with its first
    first = group_pairs.join(of("a"), "a").join(of("b"), "b").select("ka", "kb")
    inner = members.join(heads.where("members > 1"), "grp").where("key != head").select(F.col("head").alias("ka"), F.col("key").alias("kb"))
    verifier = Verifier(docs, rows, nodes, id_col, text_col)
    links = verifier.links(first.unionByName(inner))
    roots = materialize(components(links), "set-roots")

    # second round: what is still apart and has not been compared
    state = nodes.join(roots, F.col("key") == F.col("node"), "left").select("grp", "key", F.coalesce("root", "key").alias("root"), "sig")
    spans = state.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.first("sig").alias("sig"))
    spans = spans.withColumn("sig", F.when(F.col("members") == 1, F.col("sig")).otherwise(F.lit(bytearray())))
    mixed = large.join(spans, F.col("b") == F.col("grp")).select("a", "b", "size", "index", "low", "high", "sig")
    apart = mixed.groupBy("a").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l != h").select(F.col("a").alias("shingle"))
    mixed = mixed.join(apart, F.col("a") == F.col("shingle"), "left_semi")
    lists = mixed.groupBy("b", "size").agg(F.collect_list(F.when(F.col("index"), F.col("a"))).alias("i"), F.collect_list("a").alias("p"))
    lists = lists.where(F.size("p").between(2, MOST_MEETINGS)).withColumnsRenamed({"b": "list_of", "size": "list_size"})
    mixed = mixed.join(lists, (F.col("b") == F.col("list_of")) & (F.col("size") == F.col("list_size")), "left")
    mixed = mixed.withColumns({"indexed": F.filter("i", lambda x: x < F.col("a")), "probes": F.filter("p", lambda x: x < F.col("a"))})
    cross = mixed.repartition("a").sortWithinPartitions("a", "size", "b").select("a", "b", "size", "index", "low", "high", "sig", "indexed", "probes").mapInArrow(tidy(_cross_pairs), "a long, b long")
    many = spans.where("members > 1").select("grp")
    unfolded = group_pairs.join(many, F.col("a") == F.col("grp"), "left_semi").unionByName(group_pairs.join(many, F.col("b") == F.col("grp"), "left_semi"))
    inside = spans.where("low != high").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    again = cross.unionByName(unfolded).unionByName(inside).distinct()

    def side(s: str):
        return state.select(F.col("grp").alias(s), F.col("key").alias(f"k{s}"), F.col("root").alias(f"r{s}"))

    second = again.join(side("a"), "a").join(side("b"), "b").where("ra != rb and ka != kb")
    second = second.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    compared = first.unionByName(inner).select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    second = materialize(second.join(compared, ["ka", "kb"], "left_anti"), "second-pairs")
    if second.limit(1).count():
        links = links.unionByName(verifier.links(second))
        roots = materialize(components(links), "set-roots")
    discard(found)

    whole = nodes.join(roots, F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))
    smallest = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_key = whole.join(smallest, "root").select("key", "component_id")
    linked = rows.where("n > 0").join(by_key, "key").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
