"""Best-fit packing with large-item matching.

Texts are encoded and cut into pieces of at most `capacity` ids. Packing needs only how many pieces have each length,
at most `capacity` numbers whatever the corpus: lengths above a third of the capacity are matched first, at most two a
sequence, the longest with the longest that fits; shorter ones then best-fit the remaining gaps, longest first. The plan
says which ranks of a length go where, in runs of equal sequences, and each piece finds its place by its rank among the
pieces of its length. Ranks are counted within hashed shares of a length of about `share_rows` pieces each, so a length
that a third of all pieces have is dealt over many tasks; pieces of full length, most of them in long texts, need no rank.

Nulls: a null text is empty and holds the end id alone; a null doc_id is kept. Repeated rows are packed each for itself.
Texts of any length are cut into as many pieces as they need. Other columns of the documents aren't read, whatever their
names; other columns of pieces stay. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm import common
from tideway.llm.tokens import encoder, groups, vocabulary

CAPACITY, SHARE_ROWS = 2048, 10_000


class Placed(NamedTuple):
    """`per` pieces of a length in each of `count` sequences from `first` on, at `offset`, from rank `rank` on."""

    length: int
    rank: int
    first: int
    count: int
    per: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placed], int]:
    """Placements of all pieces, and the number of sequences."""
    left = {k: n for k, n in counts.items() if n}
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[Placed] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), ascending
    opened = 0

    def place(length: int, first: int, count: int, per: int, offset: int) -> None:
        out.append(Placed(length, used[length], first, count, per, offset))
        used[length] += count * per
        left[length] -= count * per

    def open_(count: int) -> int:
        nonlocal opened
        opened += count
        return opened - count

    def remain(gap: int, first: int, count: int) -> None:
        if gap and count:
            insort(gaps, (gap, first, count))

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed([k for k in large if 2 * k > capacity]):
        while left[a]:
            b = next((k for k in reversed(large) if k <= capacity - a and left[k]), 0)
            n = min(left[a], left[b]) if b else left[a]
            first = open_(n)
            place(a, first, n, 1, 0)
            if b:
                place(b, first, n, 1, a)
            remain(capacity - a - b, first, n)
    halves = [k for k in reversed(large) if 2 * k <= capacity]
    for i, a in enumerate(halves):
        if n := left[a] // 2:
            first = open_(n)
            place(a, first, n, 2, 0)
            remain(capacity - 2 * a, first, n)
        if left[a]:
            b = next((k for k in halves[i + 1 :] if left[k]), 0)
            first = open_(1)
            place(a, first, 1, 1, 0)
            if b:
                place(b, first, 1, 1, a)
            remain(capacity - a - b, first, 1)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, (s,))
            if at == len(gaps):
                n = -(-left[s] // (capacity // s))
                remain(capacity, open_(n), n)
                continue
            gap, first, count = gaps.pop(at)
            per = min(gap // s, left[s])
            n = min(count, left[s] // per)
            place(s, first, n, per, capacity - gap)
            remain(gap - per * s, first, n)
            remain(gap, first + n, count - n)
    return out, opened


#: The column that numbers written pieces.
ROW = "__piece_row"


def _pieces(vocab: str, end: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_of("tokens", encoder.cache_clear)
        enc = encoder(vocab)
        tail = np.array([end], dtype="<u4")
        for batch in batches:
            ids_of, numbers, starts, sizes, crcs, cut = [], [], [], [], [], []
            for i, found in enumerate(x for texts in groups(t.as_py() for t in batch.column(1)) for x in enc.ids_of(texts)):
                ids = np.concatenate([np.frombuffer(found, enc.dtype).astype("<u4"), tail])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    ids_of.append(i)
                    numbers.append(k)
                    starts.append(at)
                    sizes.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        cut.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(ids_of, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(cut, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return run


def pieces(docs: DataFrame, vocab: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return few.mapInArrow(_pieces(vocab, end, capacity, with_ids), schema)


def _placed(placements: list[Placed]):
    table: dict[int, list[Placed]] = {}
    for p in placements:
        table.setdefault(p.length, []).append(p)
    arrays = {k: np.array(v, dtype=np.int64) for k, v in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                p = arrays[int(size)]
                p = p[np.searchsorted(p[:, 1], rank[at], side="right") - 1]
                number = rank[at] - p[:, 1]
                sequence[at] = p[:, 2] + number // p[:, 4]
                offset[at] = p[:, 5] + number % p[:, 4] * size
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def packed(cut: DataFrame, capacity: int = CAPACITY, share_rows: int = SHARE_ROWS) -> DataFrame:
    """The pieces (see pieces()) with sequence_id and offset; columns of these names are replaced. cut should be a written table, as it is read four times.

    A column named ROW that numbers the pieces deals equal ones to different shares, and isn't returned."""
    own = [F.col(f"row.{ROW}")] if ROW in cut.columns else []
    kept = [F.col(f"`{c}`") for c in cut.columns if c not in ("sequence_id", "offset")]
    spark = cut.sparkSession
    # at most capacity rows, whatever the input
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    placements, opened = plan({k: n for k, n in counts.items() if k < capacity}, capacity)
    whole = cut.where(F.col("length") == capacity).select(*kept, (F.monotonically_increasing_id() + opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shares = spark.createDataFrame([(k, -(-n // share_rows)) for k, n in counts.items()], "length long, shares long")
    share = F.pmod(F.xxhash64("row.doc_id", "row.piece", "row.ids_crc32", *own), F.col("shares")).alias("share")
    rows = cut.where(F.col("length") < capacity).select(F.struct(*kept).alias("row"), "length").join(F.broadcast(shares), "length").select("row", "length", share)
    sizes = rows.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    in_length = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = common.checkpointed(sizes.select("length", "share", F.coalesce(F.sum("n").over(in_length), F.lit(0)).alias("before")))
    in_share = Window.partitionBy("length", "share").orderBy("row.doc_id", "row.piece", "row.ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(in_share).cast("long") - 1).join(before, ["length", "share"])
    ranked = ranked.select("row", "length", (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([ranked.schema["row"], *(T.StructField(c, T.LongType()) for c in ("length", "sequence_id", "offset"))])
    placed = ranked.mapInArrow(_placed(placements), schema)
    return placed.select("row.*", "sequence_id", "offset").union(whole).drop(ROW)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, common.table(spark, sf_dir, "documents"), sf_dir)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.bounded(spark)
    cut = pieces(docs, vocabulary("word_bpe_49k.json")).withColumn(ROW, F.monotonically_increasing_id())
    return packed(common.written(cut, "pieces"))
