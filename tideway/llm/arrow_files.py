"""Token ids in Arrow files of fixed-size lists.

Documents are dealt by ranges of doc_id, encoded in their task and written as one Arrow IPC file a task: batches of
`rows` sequences, each a fixed-size list of `seq_len` ids beside a mask of the same shape (false: padding, only at a
file's end). All batches but the last have the same number of sequences, so id i of a file is found by division and read
from a memory map without a copy. A second IPC file holds (doc_id, start, n_tokens) of the file's documents. A task that
runs again writes files of new names; only those that its result names are read.

Nulls: a null text is empty, so it holds the end id alone; rows with a null doc_id come first. Rows of equal doc_id are
ordered by text. A text of any length is encoded whole and runs over as many sequences as it needs. Other columns aren't
read, whatever their names. An empty table gives no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common
from tideway.llm.tokens import encoder, groups, vocabulary

SEQ_LEN, ROWS = 2048, 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, file string, index string, first_doc long, n_docs long, n_tokens long"


def schema_of(width: int, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class _Sequences:
    """Ids as they come, out as batches of sequences."""

    def __init__(self, sink: pa.NativeFile, width: int, seq_len: int, rows: int) -> None:
        self.schema, self.dtype, self.seq_len, self.size = schema_of(width, seq_len), f"<u{width}", seq_len, seq_len * rows
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held = bytearray()
        self.step = self.size * width

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:real] = True
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)], schema=self.schema))

    def add(self, ids: bytes) -> None:
        self.held += ids
        while len(self.held) >= self.step:
            self._batch(np.frombuffer(bytes(self.held[: self.step]), self.dtype), self.size)
            del self.held[: self.step]

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(bytes(self.held), self.dtype)
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.seq_len, self.dtype)]), len(ids))
        self.writer.close()


def _write(base: str, vocab: str, end: int, seq_len: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        common.worker_of("tokens", encoder.cache_clear)
        enc = encoder(vocab)
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        tail = np.array([end], dtype=enc.dtype).tobytes()
        docs = total = 0
        with fs.open_output_stream(f"{root}/{name}.arrow") as a, fs.open_output_stream(f"{root}/{name}.index.arrow") as b:
            out, index = _Sequences(a, enc.width, seq_len, rows), pa.ipc.new_file(b, INDEX)
            for batch in _chain(first, batches):
                sizes = np.empty(batch.num_rows, np.int64)
                i = 0
                for texts in groups(t.as_py() for t in batch.column(1)):
                    for ids in enc.ids_of(texts):
                        out.add(ids + tail)
                        sizes[i] = len(ids) // enc.width + 1
                        i += 1
                starts = total + np.cumsum(sizes) - sizes
                index.write_batch(pa.record_batch([batch.column(0), pa.array(starts), pa.array(sizes)], schema=INDEX))
                docs, total = docs + batch.num_rows, total + int(sizes.sum())
            out.close()
            index.close()
        row = [[part], [f"{base}/{name}.arrow"], [f"{base}/{name}.index.arrow"], [first.column(0)[0].as_py()], [docs], [total]]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "file", "index", "first_doc", "n_docs", "n_tokens"])

    return run


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def write_sequences(docs: DataFrame, base: str, vocab: str, end: int = 0, seq_len: int = SEQ_LEN, rows: int = ROWS) -> list:
    """Encode docs(doc_id, text) in ascending doc_id order into files under the URI base. Returns the manifest: one row a file, in order, with the ids before it (`before`)."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = few.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = sorted(dealt.mapInArrow(_write(base, vocab, end, seq_len, rows), MANIFEST).collect(), key=lambda r: r.part)
    before, out = 0, []
    for r in found:
        out.append(r.asDict() | {"before": before})
        before += r.n_tokens
    return out


class SequenceFile:
    """Random access to one file: sequences by number, and runs of ids."""

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.held: tuple[int, pa.RecordBatch | None] = (-1, None)

    def _batch(self, number: int) -> pa.RecordBatch:
        """A batch of the file; the last one is kept, as a store that isn't mapped reads it anew each time."""
        if self.held[0] != number:
            self.held = (number, self.file.get_batch(number))
        return self.held[1]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence; ids without a copy where the file is mapped."""
        batch, at = self._batch(number // self.rows), number % self.rows * self.seq_len
        ids, mask = (batch.column(i).values.slice(at, self.seq_len) for i in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids [start, start + count) in pieces, none copied where the file is mapped."""
        size = self.seq_len * self.rows
        while count > 0:
            at = start % size
            n = min(count, size - at)
            yield self._batch(start // size).column(0).values.slice(at, n).to_numpy()
            start, count = start + n, count - n

    def close(self) -> None:
        self.source.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = SequenceFile(row["file"])
            fs, path = pyarrow.fs.FileSystem.from_uri(row["index"])
            with fs.open_input_file(path) as source:
                index = pa.ipc.open_file(source)
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, counts = (docs.column(i).to_numpy() for i in (1, 2))
                    crcs = np.zeros(len(starts), np.int64)
                    for i, (s, n) in enumerate(zip(starts.tolist(), counts.tolist())):
                        crc = 0
                        for piece in ids.ids(s, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        crcs[i] = crc
                    yield pa.record_batch([docs.column(0), pa.array(starts + row["before"]), docs.column(2), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            ids.close()


def read_documents(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    files = spark.createDataFrame([(m["file"], m["index"], m["before"]) for m in manifest], "file string, index string, before long")
    return files.repartition(max(1, len(manifest))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{common.shared_dir(spark)}/tideway/sequences-{uuid.uuid4().hex}"
    return read_documents(spark, write_sequences(common.table(spark, sf_dir, "documents"), base, vocabulary("byte_bpe_50k.json")))
