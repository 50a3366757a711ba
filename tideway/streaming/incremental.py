"""Incremental sync: batches by high-water mark, and the same merge over a stream of changed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.engine import Engine


def changed_since(df: DataFrame, column: str | None, mark: str | None) -> DataFrame:
    """The rows to sync: those at the mark or later; all without a mark or a date column. Re-reading the boundary is safe, as merges are idempotent."""
    return df if column is None or mark is None else df.where(F.col(column) >= F.lit(mark))


def merge_stream(changes: DataFrame, engine: Engine, table: str, checkpoint: str):
    """Merge each micro-batch of a streaming DataFrame into the target table; of repeated keys the last by date column wins."""
    spec = engine.specs[table]

    def batch(df: DataFrame, _: int) -> None:
        if spec.date_column:
            df = df.groupBy(*spec.key).agg(F.max_by(F.struct(*df.columns), spec.date_column).alias("r")).select("r.*")
        engine.upsert(table, df)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def contiguous_acks(acks: DataFrame):
    """Streaming form of ordered acknowledgement: acks(reader_id, seq, last_key) → the newest key before the first gap, per reader.

    State is the next expected sequence and the acknowledgements beyond it, which a reader's window in flight bounds.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        expected, last, seqs, keys = state.get if state.exists else (0, None, [], [])
        waiting = dict(zip(seqs, keys))
        for f in frames:
            waiting.update({int(s): int(k) for s, k in zip(f["seq"], f["last_key"]) if s >= expected})
        moved = False
        while expected in waiting:
            last, expected, moved = waiting.pop(expected), expected + 1, True
        state.update((expected, last, list(waiting), list(waiting.values())))
        if moved:
            yield pd.DataFrame({"reader_id": [key[0]], "seq": [expected - 1], "last_key": [last]})

    return acks.groupBy("reader_id").applyInPandasWithState(step, "reader_id bigint, seq bigint, last_key bigint", "expected bigint, last bigint, seqs array<bigint>, keys array<bigint>", "append", "NoTimeout")
