"""Helpers shared by the training-data operators: shared storage, graph components and small text utilities."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and Python. Texts differ so much in length that a number of rows bounds nothing.
BATCH_BYTES = 8 << 20
_BYTES, _OWN = "spark.sql.execution.arrow.maxBytesPerBatch", [None, None]


def bounded(spark: SparkSession) -> None:
    """Let the session's Arrow batches be of BATCH_BYTES at most (a longer text is a batch of its own); a smaller setting stays."""
    now = spark.conf.get(_BYTES).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def worker_of(operator: str, forget=None) -> None:
    """Called in tasks: a Python worker serves one operator after another, and what the last one kept for its next task (`forget` drops it) goes when another begins."""
    if _OWN[0] != operator:
        if _OWN[1] is not None:
            _OWN[1]()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        _OWN[:] = [operator, forget]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only where that is unset and Spark runs on this machine alone, a temporary folder takes its place."""
    bounded(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideway-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its rows written to the shared checkpoint folder and its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str, file_rows: int = 0) -> DataFrame:
    """df written as Parquet in the shared folder and read back: columns can be pruned, and lost executors cost no recomputation.

    Rows of megabytes need files of at most `file_rows`: Parquet's writer looks at its memory after a hundred rows only,
    and its reader makes batches of thousands of rows, so a task would hold all of a larger file's rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideway/{what}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def spans(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose values (strings or bytes) hold about `size` bytes together; a longer value is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield lo, hi
        lo = hi


def swept(spark: SparkSession) -> None:
    """Let the driver find out which shuffles and checkpoints nothing refers to any more: their files go only then, and a driver with much memory would wait long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete what written() wrote for tables that nothing reads any more: all that came from them must be written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        swept(tables[0].sparkSession)


def joined(big: DataFrame, small: DataFrame, key: str, hot: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """big joined with small, whose keys are unique; big should be a written table, as it is read up to four times.

    Keys that more than `hot` rows of big hold are looked up in a broadcast table of their own, so their rows aren't
    shuffled into one task. By default that is a hundredth of the rows, but 1,000 at least and 200,000 at most, so there are
    at most rows / 200,000 of these keys, or a hundred. Other keys join as Spark sees fit. counts(key, count) saves
    counting if it is known.
    """
    if hot is None:
        hot = min(200_000, max(1000, big.count() // 100))
    counts = big.groupBy(key).count() if counts is None else counts
    often = checkpointed(counts.where(F.col("count") > hot).select(key))
    if often.isEmpty():
        return big.join(small, key)
    few = checkpointed(small.join(often, key, "left_semi"))
    return big.join(F.broadcast(few), key).unionByName(big.join(F.broadcast(often), key, "left_anti").join(small, key))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): one row (node, root) for each node that isn't its component's smallest.

    Alternating large-star and small-star rounds; each joins edges with one minimum per node, so a node with very many
    neighbours is aggregated before the shuffle and its rows can be split by skew handling. Only a count and a checksum
    reach the driver. Empty input gives no rows; loops, repeats and nulls in edges are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    e = checkpointed(e)
    told = lambda x: x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    before = told(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").select("u", "v", "m")
        small = hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hooked.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = told(e)
        del both, low, large, hooked, small
        swept(edges.sparkSession)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
