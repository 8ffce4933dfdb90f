"""Operator 2: exact token counts of every prefix of every text.

For each document the operator stores the step of the token count from each prefix
to the next (one 16-bit number per code point). Their running sum answers how many
tokens any prefix takes and where to cut for any budget, without encoding again.

Nulls: a null text is empty (no steps, 0 tokens); a null id passes through. Repeated
rows give repeated rows. Other input columns are not carried. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import per_slice, text_bytes
from .bpe import PrefixCounter, shared

SCHEMA = "n_bytes long, n_tokens long, prefix_steps binary"


def prefix_token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, prefix_steps (little-endian int16)."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        counter = shared(PrefixCounter, tokenizer_path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = text_bytes(batch.column(1))
            steps, at, tokens = counter.steps(data, offsets)
            bounds = pa.py_buffer((at * 2).astype(np.int32).tobytes())
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(tokens), [None, bounds, pa.py_buffer(steps.tobytes())])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), packed],
                [id_col, "n_bytes", "n_tokens", "prefix_steps"])

        return work

    return df.select(id_col, text_col).mapInArrow(per_slice(make, text_col), f"`{id_col}` {kind}, {SCHEMA}")


def tokens_of_prefix(steps: bytes, code_points: int) -> int:
    """Tokens of the prefix of that many code points (at least 0; longer ones mean the whole text)."""
    return int(np.frombuffer(steps, "<i2", count=min(code_points, len(steps) // 2)).astype(np.int64).sum())


def longest_prefix(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix that takes at most ``budget`` tokens.

    Counts of growing prefixes may fall again, so the last prefix that fits wins.
    """
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, "<i2").astype(np.int64)) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def with_budgets(counts: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Add a column per budget with the code points to keep; other columns stay."""
    names = counts.columns
    if clash := set(budgets) & set(names):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)

    def run(batches):
        for batch in batches:
            steps = batch.column(names.index("prefix_steps")).to_pylist()
            cuts = [pa.array([longest_prefix(s or b"", b) for s in steps], pa.int64()) for b in budgets.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cuts], [*names, *budgets])

    return counts.mapInArrow(run, ", ".join([fields, *(f"`{b}` long" for b in budgets)]))


def over_limit_report(counts: DataFrame, limit: int) -> DataFrame:
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
