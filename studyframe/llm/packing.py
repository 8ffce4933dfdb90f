"""Operator 10: bounded-space online best-fit packing of token sequences.

Documents become ids and a closing id 0. Longer ones than a sequence are cut into
full pieces, with the rest in the first one. Pieces arrive in a hash order; each goes
to the open sequence with the least space that still takes it. At most ``open_bins``
sequences are open; when a new one is needed beyond that, the fullest is closed.
Open sequences are found in a bitset keyed by free space.

Pieces are dealt into parts of about ``part_rows`` by a hash and each part is packed
by itself in one streaming task, so the result depends on the rows alone.

Nulls: a null text is empty and packs as the closing id alone; a null id passes
through. Repeated rows are packed each. Other columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.session import materialize

from .arrowtext import per_slice, text_bytes
from .bpe import FEW_KEPT_BYTES, KEPT_BYTES, IdEncoder, forgetful, shared


def cut_lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of n ids: all full but perhaps the first."""
    first = n % limit
    return ([first] if first else []) + [limit] * (n // limit)


def token_pieces(df: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False, keep_learned: bool = True) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        encoder = shared(IdEncoder, tokenizer_path, KEPT_BYTES if keep_learned else FEW_KEPT_BYTES)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at = encoder.encode(*text_bytes(batch.column(1)))
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for k in range(batch.num_rows):
                own = ids[at[k]:at[k + 1]].tobytes() + b"\0\0\0\0"
                begin = 0
                for p, size in enumerate(cut_lengths(len(own) >> 2, limit)):
                    part = own[begin * 4:(begin + size) * 4]
                    row.append(k)
                    piece.append(p)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
                    begin += size
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names)

        return work

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    mapper = per_slice(make, text_col)
    return df.select(id_col, text_col).mapInArrow(mapper if keep_learned else forgetful(mapper), schema)


class OpenBins:
    """A fixed number of open sequences; ``place`` gives (sequence, offset)."""

    def __init__(self, limit: int, open_bins: int):
        self.limit, self.most = limit, open_bins
        self.free = 0  # bit f: some open sequence has f places free
        self.by_free: list[list[int]] = [[] for _ in range(limit + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        out = bins.pop()
        if not bins:
            self.free ^= 1 << space
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            bin_, space = self.made, self.limit
            self.made += 1
        left = space - length
        if left:
            self.by_free[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.limit - space


def pack_pieces(pieces: DataFrame, limit: int, open_bins: int, part_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a table of pieces (read twice: write it first)."""
    parts = max(1, -(-pieces.count() // part_rows))
    names = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    order = F.xxhash64(F.lit("pack"), id_col, "piece", "ids_crc32")
    dealt = pieces.withColumns({"_order": order, "_part": F.pmod(order, F.lit(parts))})
    dealt = dealt.repartition(parts, "_part").sortWithinPartitions("_part", "_order", id_col, "piece", "ids_crc32")

    def run(batches):
        part, bins = None, None
        for batch in batches:
            own = batch.column(len(names) + 1).to_pylist()
            lengths = batch.column(names.index("length")).to_pylist()
            seq, off = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            for k, (p, n) in enumerate(zip(own, lengths)):
                if p != part:
                    part, bins = p, OpenBins(limit, open_bins)
                b, off[k] = bins.place(n)
                seq[k] = (p << 36) + b
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(seq), pa.array(off)],
                                             [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, fields + ", sequence_id long, offset long")


def best_fit_pack(df: DataFrame, tokenizer_path: str, limit: int = 2048, open_bins: int = 1024, part_rows: int = 200_000,
                  id_col: str = "doc_id", text_col: str = "text", keep_learned: bool = True) -> DataFrame:
    """Pack all rows; one row per piece with its sequence and place there.

    Without ``keep_learned`` each task gives its tokenizer and learned pieces back, so that the
    workers hold none of it in the stages that follow.
    """
    pieces = materialize(token_pieces(df, tokenizer_path, limit, id_col, text_col, keep_learned=keep_learned), "pieces")
    return pack_pieces(pieces, limit, open_bins, part_rows, id_col)
