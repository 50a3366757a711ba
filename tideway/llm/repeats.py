"""Removal of repeated 200-byte strings by prefix-free parsing.

A rolling hash of 32 bytes picks triggers: in each 200-byte window of a document the leftmost gram of least hash. The
windows of one trigger follow each other; the text that they cover is the trigger's phrase. Equal windows have their
trigger at the same place, so a window can only recur in another phrase of the same trigger. The steps:

1. Parse: texts are written once, compressed and numbered; one pass over them writes (trigger, phrase digest, document,
   place) for every phrase. Triggers that stand alone in the corpus end here, after a pre-aggregated count.
2. Dictionary: each distinct phrase once, with how often it occurs. A phrase that occurs twice repeats as a whole, so
   thousands of copies cost one entry.
3. Suffix arrays: of each trigger's phrases, what stands before the trigger is sorted backwards (the phrase's suffixes)
   and what follows it forwards (how the parse goes on), with the lengths that neighbours share. A window that begins l
   bytes before the trigger needs l bytes of the one and 200 - l of the other; both orders together put windows in
   corpus order, and equal ones side by side.
4. Marks go back to their documents, which cut the covered bytes and hash the rest.

A trigger with more than `wide` distinct phrases would not fit in one task; its windows are dealt by their digests
instead, which gives the same marks. Phrases, and windows there, are told apart by 128-bit digests, everything else by
the bytes themselves. Places are counted from the text alone, and nothing is dropped.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows repeat each other, so texts of 200 bytes and more
vanish from all of them, as do all copies of any tie. Texts under 200 bytes stay. Texts of any length are parsed in
pieces of CHUNK bytes that overlap by a window, with the same phrases. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

GRAM, WINDOW = 32, 200
SPAN = WINDOW - GRAM + 1
CHUNK = 1 << 18
#: Low bits of a hash that hold its place, so that the least value also tells where it is.
PLACE = 20


def _byte_table() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE = _byte_table()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of each GRAM bytes, by doubling."""
    h, width, power = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), width * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def phrases(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger's place, first window, number of windows, trigger hash) in documents that follow each other in data (bounds: 0, their ends)."""
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = gram_hashes(data)
    low = np.uint64((1 << PLACE) - 1)
    at = (_least(h & ~low | np.arange(len(h), dtype=np.uint64), SPAN) & low).astype(np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(at)]
    whole = np.arange(len(at)) + WINDOW <= end
    new = np.flatnonzero(whole & np.concatenate(([True], (at[1:] != at[:-1]) | ~whole[:-1])))
    n = np.diff(np.append(new, len(at)))
    gone = np.concatenate(([0], np.cumsum(~whole)))
    n -= gone[new + n] - gone[new]  # windows behind a document's last one
    return at[new], new, n, h[at[new]]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


PARSE = "gram long, phrase binary, id long, first int, n int, shift int"


def _row(ids: np.ndarray, base: np.ndarray, big: bytes, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Phrases of big as rows; base is what a place in big lies before the place in its text."""
    place, first, n, h = found
    digest = xxhash.xxh3_128_digest
    shift = place - first
    names = [digest(big[a:b], s) for a, b, s in zip(first.tolist(), (first + n + (WINDOW - 1)).tolist(), shift.tolist())]
    columns = [pa.array(h.view(np.int64)), pa.array(names, pa.binary()), pa.array(ids), *(pa.array(x.astype(np.int32)) for x in (first + base, n, shift))]
    return pa.record_batch(columns, names=["gram", "phrase", "id", "first", "n", "shift"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    held: list[tuple[int, bytes]] = []
    size = 0

    def out() -> pa.RecordBatch:
        big = b"".join(t for _, t in held)
        bounds = np.concatenate(([0], np.cumsum([len(t) for _, t in held])))
        found = phrases(np.frombuffer(big, np.uint8), bounds)
        doc = np.searchsorted(bounds, found[0], side="right") - 1
        return _row(np.array([i for i, _ in held], np.int64)[doc], -bounds[doc], big, found)

    for batch in batches:
        for i, z in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = unzip.decompress(z.as_buffer())
            if len(text) > CHUNK:
                yield from _long(i, text)
            elif len(text) >= WINDOW:
                held.append((i, text))
                size += len(text)
            if size > CHUNK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _long(i: int, text: bytes) -> Iterator[pa.RecordBatch]:
    """The phrases of one text, by pieces: each has the triggers in its CHUNK bytes and sees all of their windows."""
    for at in range(0, len(text), CHUNK):
        low = max(0, at - SPAN)
        part = text[low : at + CHUNK + WINDOW]
        found = phrases(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        own = (found[0] + low >= at) & (found[0] + low < at + CHUNK)
        found = tuple(x[own] for x in found)
        yield _row(np.full(len(found[0]), i), np.int64(low), part, found)


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([c.compress(_bytes(t.as_py())) for t in batch.column(1)], pa.binary())], names=["doc_id", "zipped"])


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen phrases' texts."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            text, chosen = unzip.decompress(batch.column("zipped")[i].as_buffer()), batch.column("chosen")[i].as_py()
            for c in chosen:
                out.append((c["gram"], batch.column("id")[i].as_py(), c["first"], c["n"], c["shift"], c["times"], text[c["first"] : c["first"] + c["n"] + WINDOW - 1]))
                size += c["n"] + WINDOW
            if size > 4 * CHUNK:
                yield _chosen(out)
                out, size = [], 0
        if out:
            yield _chosen(out)


TEXTS = "gram long, id long, first int, n int, shift int, times int, bytes binary"
MARKS = "id long, a int, b int"


def _chosen(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["gram", "id", "first", "n", "shift", "times", "bytes"])


def _order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of byte rows within their groups: the order, and how many bytes each shares with the one before it (-1: another group)."""
    words = np.ascontiguousarray(rows).view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    a, b = rows[order[:-1]], rows[order[1:]]
    other = a != b
    shared = np.where(other.any(axis=1), np.argmax(other, axis=1), rows.shape[1])
    shared[group[order[:-1]] != group[order[1:]]] = -1
    return order, np.concatenate(([-1], shared))


def equal_windows(group: np.ndarray, ids: np.ndarray, first: np.ndarray, n: np.ndarray, shift: np.ndarray, times: np.ndarray, strings: list[bytes]) -> pa.RecordBatch:
    """Marks of the windows of phrases that occur once and are equal to a window of another phrase of their group (trigger)."""
    m = len(strings)
    big = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    at = np.cumsum(sizes) - sizes + shift
    reach = -(-(SPAN - 1) // 8) * 8  # whole words of eight bytes
    behind, ahead = np.arange(reach), np.arange(WINDOW)
    take = lambda places, real: np.where(real, big[np.clip(places, 0, len(big) - 1)], 0).astype(np.uint8)
    before = take(at[:, None] - 1 - behind, behind < shift[:, None])
    after = take(at[:, None] + ahead, ahead < (sizes - shift)[:, None])
    by_suffix, suffix_shares = _order(group, before)
    by_parse, parse_shares = _order(group, after)
    weight = np.minimum(times, 2)
    key, start = [], []
    left, right = np.empty(m, np.int64), np.empty(m, np.int64)
    for l in range(SPAN):  # noqa: E741
        some = np.flatnonzero((l <= shift) & (l > shift - n))
        if len(some) < 2:
            continue
        left[by_suffix] = np.cumsum(suffix_shares < l)
        right[by_parse] = np.cumsum(parse_shares < WINDOW - l)
        _, name = np.unique(left[some] * (m + 1) + right[some], return_inverse=True)
        again = some[(np.bincount(name, weights=weight[some])[name] >= 2) & (times[some] == 1)]
        key.append(ids[again])
        start.append(first[again] + shift[again] - l)
    key, start = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (key, start))
    order = np.lexsort((start, key))
    return _runs(key[order], start[order])


def _runs(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Marks of windows that follow each other as runs [a, b)."""
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] - start[:-1] > 1)))) if len(key) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(key)) - 1 if len(key) else head
    return pa.record_batch([pa.array(key[head]), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + WINDOW).astype(np.int32))], names=["id", "a", "b"])


def _compare(most: int):
    """Phrases come sorted by trigger; whole triggers are compared, about `most` phrases at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(part: pa.Table) -> pa.RecordBatch:
            g, i, f, n, s, t = (part.column(c).to_numpy().astype(np.int64, copy=False) for c in range(6))
            return equal_windows(g, i, f, n, s, t, part.column(6).to_pylist())

        for batch in (b.slice(k, most) for b in batches for k in range(0, b.num_rows, most)):
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                whole = pa.Table.from_batches(held)
                g = whole.column(0).to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield out(whole.slice(0, cut))
                    held, size = whole.slice(cut).to_batches(), len(g) - cut
        if size:
            yield out(pa.Table.from_batches(held))

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of phrases by itself: (window digest, id, start, times)."""
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        ids, first, n, times = (batch.column(c).to_numpy() for c in ("id", "first", "n", "times"))
        names = [xxhash.xxh3_128_digest(x[k : k + WINDOW]) for x, many in zip(batch.column("bytes").to_pylist(), n.tolist()) for k in range(many)]
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(np.repeat(ids, n)), pa.array(start.astype(np.int32)), pa.array(np.repeat(times, n))], names=["window", "id", "start", "times"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text = unzip.decompress(batch.column("zipped")[i].as_buffer())
            marks = batch.column("marks")[i].values
            runs: list[list[int]] = []
            if marks is not None and len(marks):
                a, b = (marks.field(n).to_numpy() for n in ("a", "b"))
                order = np.argsort(a, kind="stable")
                for x, y in zip(a[order].tolist(), b[order].tolist()):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], y)
                    else:
                        runs.append([x, y])
            sha, at = hashlib.sha256(), 0
            for x, y in runs:
                sha.update(text[at:x])
                at = y
            sha.update(text[at:])
            rows.append((batch.column("doc_id")[i].as_py(), len(text), sum(y - x for x, y in runs), len(runs), sha.hexdigest(), [x for r in runs for x in r]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def without_repeats(docs: DataFrame, wide: int = 4000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): a row for each document; spans hold the first and end byte of each removed run in turn."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = common.written(few.mapInArrow(_zip, "doc_id long, zipped binary").withColumn("id", F.monotonically_increasing_id()), "texts")
    parse = common.written(texts.select("id", "zipped").mapInArrow(_parse, PARSE), "parse")
    counts = common.written(parse.groupBy("gram").count().where("count > 1"), "recurring-triggers")
    found = common.written(common.joined(parse, counts.select("gram"), "gram", counts=counts), "recurring-phrases")
    common.release(parse, counts)
    entries = found.groupBy("phrase").agg(F.min("gram").alias("gram"), F.count(F.lit(1)).alias("count"), F.min(F.struct("id", "first", "n", "shift")).alias("at"))
    entries = common.written(entries.withColumn("times", F.least("count", F.lit(2)).cast("int")), "dictionary")
    repeated = entries.where("count > 1")
    twice = common.joined(found.select("phrase", "id", "first", "n"), repeated.select("phrase"), "phrase", counts=repeated)
    marks = twice.select("id", F.col("first").alias("a"), (F.col("first") + F.col("n") + (WINDOW - 1)).alias("b"))
    several = common.written(entries.groupBy("gram").count().where("count > 1").withColumn("phrases", F.col("count")), "compared-triggers")
    chosen = common.joined(entries.select("gram", "at", "times"), several.select("gram", "phrases"), "gram", counts=several)
    chosen = chosen.select("phrases", F.col("at.id").alias("id"), F.struct("gram", "at.first", "at.n", "at.shift", "times").alias("c"))
    chosen = common.written(chosen, "compared-phrases")

    def texts_of(which: str) -> DataFrame:
        per_doc = chosen.where(which).groupBy("id").agg(F.collect_list("c").alias("chosen"))
        return texts.select("id", "zipped").join(per_doc, "id").mapInArrow(_texts_of, TEXTS)

    narrow = texts_of(f"phrases <= {wide}").repartition("gram").sortWithinPartitions("gram")
    marks = marks.union(narrow.mapInArrow(_compare(wide), MARKS))
    if not chosen.where(f"phrases > {wide}").isEmpty():
        windows = common.written(texts_of(f"phrases > {wide}").mapInArrow(_windows, "window binary, id long, start int, times int"), "wide-windows")
        equal = common.written(windows.groupBy("window").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("count")).where("n > 1"), "wide-equal")
        single = common.joined(windows.where("times = 1"), equal.select("window"), "window", counts=equal)
        marks = marks.union(single.select("id", F.col("start").alias("a"), (F.col("start") + WINDOW).alias("b")))
    per_doc = marks.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    return texts.join(per_doc, "id", "left").select("doc_id", "zipped", "marks").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents")).drop("spans")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT r, h, unnest(range(0, greatest(n - {WINDOW - 1}, 0))) AS i FROM d),
k AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * WINDOW})) AS k FROM p),
twice AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {WINDOW}, TRUE) AS opens FROM twice),
numbered AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, min(i) AS a, max(i) + {WINDOW} AS b FROM numbered GROUP BY r, run),
before AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT d.r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS ended, sum(b - a) AS removed, count(*) AS spans FROM d JOIN before ON before.r = d.r GROUP BY d.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(ended, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.r = d.r
"""
