"""Benchmark decontamination with a positional inverted index.

The index is cut by documents: each block of documents holds, for every term, the sorted positions of that term in the
block, so a phrase is looked up where its documents are and no posting list crosses the network. Blocks are written
in the shared folder and can serve any benchmark. A window of benchmark words is looked up from its rarest term in the
block: that term's positions less its place in the window are the candidate starts, and the other terms' lists, rarer
ones first, are intersected after the same shift. Positions leave a gap between documents, so no match crosses them.

A benchmark of at most HELD_BYTES of text is broadcast whole and matched with every block where it lies. A larger one is
dealt: its distinct windows are a table, each window finds its rarest term by the index's own totals, and that term's
blocks are where the window may occur. Windows meet their block in lots of `lot` windows, so no task holds more than a
block and a lot, whatever the benchmark's size, and windows of which a term is nowhere are never sent anywhere.

Nulls: a null text has no words; a document with a null doc_id is reported as such; an item with a null id counts for
hits but isn't listed. Repeated items count once by their id. A text beyond BLOCK_BYTES is a block of its own. Other
columns aren't read, whatever their names. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

WINDOW = 10
#: Bytes that belong to words stay (capital letters as small ones), others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK_BYTES = 4_000_000
#: Text of a benchmark that every task may hold, and windows that meet a block at a time.
HELD_BYTES, LOT = 8_000_000, 100_000
#: Blocks of a file of the index; a task holds one file's at a time.
FILE_BLOCKS = 4
INDEX = "block string, doc_ids array<{id}>, n_words array<bigint>, terms array<string>, counts array<int>, postings array<int>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Block:
    """The index of some documents: bounds[d] is where document d starts; its words follow each other, then a gap of one."""

    def __init__(self, n_words: np.ndarray, terms: list, counts: np.ndarray, postings: np.ndarray) -> None:
        self.n_words, self.terms, self.counts, self.postings = n_words, terms, counts, postings
        self.bounds = np.concatenate([[0], np.cumsum(n_words + 1)])
        self.starts = np.cumsum(counts) - counts

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        seen: dict[bytes, int] = {}
        n_words = np.zeros(len(texts), np.int64)
        ids = []
        for d, text in enumerate(texts):
            words = words_of(text)
            n_words[d] = len(words)
            ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
        bounds = np.concatenate([[0], np.cumsum(n_words + 1)])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        at = np.concatenate([np.arange(b, b + n) for b, n in zip(bounds, n_words)]) if ids else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        return cls(n_words, list(seen), np.bincount(flat, minlength=len(seen)), at[order].astype(np.int32))

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term] : self.starts[term] + self.counts[term]]


def _index(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_of("decontamination")
        for k, (ids, texts) in enumerate(_cut(batches)):
            b = Block.of(texts)
            gaps = np.diff(b.postings, prepend=np.int32(0)).astype(np.int32)  # small within a term's list
            row = [[f"{TaskContext.get().partitionId()}-{k}"], [ids], [b.n_words], [[t.decode("utf-8", "surrogatepass") for t in b.terms]], [b.counts.astype(np.int32)], [gaps]]
            kinds = (pa.string(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds)], names=["block", "doc_ids", "n_words", "terms", "counts", "postings"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of at most BLOCK_BYTES, or of one longer text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            text = t.as_py()
            if texts and size + len(text or "") > BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(text)
            size += len(text or "") + 16
    if texts:
        yield ids, texts


def build_index(docs: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The index of docs(doc_id, text), one row a block; doc_id may be a string instead. Write it before it is matched (written_index), as a block's name holds its task's number."""
    few = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_index(pa.string() if id_type == "string" else pa.int64()), INDEX.format(id=id_type))


def written_index(docs: DataFrame, id_type: str = "bigint") -> DataFrame:
    """build_index() in files of few blocks."""
    return common.written(build_index(docs, id_type), "positions", FILE_BLOCKS)


class Phrases:
    """The distinct windows of some benchmark items (or of labelled windows): rows of term numbers by length, and the items of each window."""

    def __init__(self, items: list[tuple[int | str | None, list[bytes]]], size: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, words in items:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for i in range(max(1, len(row) - size + 1) if row else 0):
                found.setdefault(tuple(row[i : i + size]), set()).add(item)
        by_length: dict[int, list[tuple]] = {}
        for w in found:
            by_length.setdefault(len(w), []).append(w)
        self.windows = {n: np.array(ws, np.int64) for n, ws in by_length.items()}
        self.items = {n: [sorted(x for x in found[w] if x is not None) for w in ws] for n, ws in by_length.items()}

    def local(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each of the vocabulary's terms: its number in the block or -1, and how often it stands there."""
        there = {t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(block.terms)}
        number = np.fromiter((there.get(t, -1) for t in self.vocabulary), np.int64, len(self.vocabulary))
        return number, np.where(number >= 0, block.counts[number] if len(block.counts) else 0, 0)

    def matches(self, block: Block) -> Iterator[tuple[int, list, np.ndarray]]:
        """(length, items, starts in the block) of each window that occurs."""
        number, counts = self.local(block)
        for length, windows in self.windows.items():
            often = counts[windows]
            for w in np.flatnonzero(often.min(axis=1) > 0):
                order = np.argsort(often[w], kind="stable")
                terms = number[windows[w]]
                starts = block.list_of(terms[order[0]]) - order[0]
                for k in order[1:]:
                    if not len(starts):
                        break
                    places = block.list_of(terms[k])
                    wanted = starts + k
                    at = np.searchsorted(places, wanted)
                    at[at == len(places)] = 0
                    starts = starts[places[at] == wanted]
                if len(starts):
                    yield length, self.items[length][w], starts.astype(np.int64)

    def near(self, block: Block, slop: int) -> Iterator[tuple[int, int, int, list]]:
        """(document, first word, last word, items): for each window, the shortest spans of at most its length plus slop words that hold all of its words, in any order."""
        number, counts = self.local(block)
        for length, windows in self.windows.items():
            for w in np.flatnonzero(counts[windows].min(axis=1) > 0):
                terms, need = np.unique(number[windows[w]], return_counts=True)
                rare = block.list_of(terms[np.argmin(block.counts[terms])]).astype(np.int64)
                reach = length + slop
                lists = []
                for t in terms:
                    p = block.list_of(t).astype(np.int64)
                    at = np.clip(np.searchsorted(rare, p), 0, len(rare) - 1)
                    lists.append(p[np.minimum(np.abs(rare[at] - p), np.abs(rare[np.maximum(at - 1, 0)] - p)) < reach])
                places = np.concatenate(lists)
                which = np.repeat(np.arange(len(terms)), [len(x) for x in lists])
                order = np.argsort(places, kind="stable")
                places, which = places[order].tolist(), which[order].tolist()
                have, missing, left = [0] * len(terms), len(terms), 0
                for right, t in enumerate(which):
                    have[t] += 1
                    missing -= have[t] == need[t]
                    while not missing:
                        a, b = places[left], places[right]
                        d = int(np.searchsorted(block.bounds, a, side="right")) - 1
                        tight = have[which[left]] == need[which[left]]
                        if tight and b - a < reach and b < block.bounds[d + 1]:
                            yield d, int(a - block.bounds[d]), int(b - block.bounds[d]), self.items[length][w]
                        missing += tight
                        have[which[left]] -= 1
                        left += 1


def judge(block: Block, phrases: Phrases) -> list[tuple[list[int], list[int], list[int]]]:
    """For each document of the block: the items with occurring windows, and the hit runs of words as firsts and ends."""
    hit = np.zeros(int(block.bounds[-1]) + 1, np.int32)
    items: list[set] = [set() for _ in block.n_words]
    for length, of, starts in phrases.matches(block):
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + length, -1)
        for d in np.unique(np.searchsorted(block.bounds, starts, side="right") - 1):
            items[d].update(of)
    covered = np.cumsum(hit) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0))
    firsts, ends = edges[::2], edges[1::2]
    owner = np.searchsorted(block.bounds, firsts, side="right") - 1
    out = [(sorted(s), [], []) for s in items]
    for d, a, b in zip(owner.tolist(), firsts.tolist(), ends.tolist()):
        out[d][1].append(a - int(block.bounds[d]))
        out[d][2].append(b - int(block.bounds[d]))
    return out


def _block_of(row: dict) -> Block:
    counts = np.asarray(row["counts"], np.int64)
    return Block(np.asarray(row["n_words"], np.int64), row["terms"], counts, np.cumsum(np.asarray(row["postings"], np.int64)))


MATCHES = "block string, at int, doc_id {id}, n_words bigint, items array<{item}>, firsts array<bigint>, ends array<bigint>"


def _stored(batch: pa.RecordBatch | pa.Table, i: int) -> tuple[Block, pa.Array]:
    """Row i of an index as a block, and its documents."""
    cell = lambda n: batch.column(n)[i].values
    row = {n: cell(n).to_numpy(zero_copy_only=False) for n in ("n_words", "counts", "postings")} | {"terms": cell("terms").to_pylist()}
    return _block_of(row), cell("doc_ids")


def _judged(block: Block, name: str, ids: pa.Array, phrases: Phrases, item: pa.DataType) -> pa.RecordBatch:
    found = judge(block, phrases)
    n = len(found)
    columns = [pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), ids, pa.array(block.n_words)]
    columns += [pa.array([f[k] for f in found], pa.list_(pa.int64() if k else item)) for k in range(3)]
    return pa.record_batch(columns, names=["block", "at", "doc_id", "n_words", "items", "firsts", "ends"])


def _near(block: Block, ids: pa.Array, phrases: Phrases, slop: int, item: pa.DataType) -> pa.RecordBatch:
    names = ids.to_pylist()
    rows = [(names[d], i, a, b) for d, a, b, items in phrases.near(block, slop) for i in items]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((ids.type, item, pa.int64(), pa.int64()))], names=["doc_id", "item_id", "first", "last"])


def _small(benchmark: DataFrame, size: int) -> Phrases | None:
    """The windows of a benchmark of at most HELD_BYTES of text, else None."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # short texts count too: an item takes as much as its place in a list
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return Phrases([(r.item_id, words_of(r.text)) for r in items.collect()], size) if total <= HELD_BYTES else None


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                of = [words[i : i + size] for i in range(max(1, len(words) - size + 1) if words else 0)]
                for k in range(0, len(of), 10_000):
                    part = of[k : k + 10_000]
                    yield pa.record_batch([pa.array([item] * len(part), pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["item_id", "terms"])

    return run


def _dealt(index: DataFrame, benchmark: DataFrame, size: int, lot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks with a lot's number, windows with block and lot, (window, item_id) pairs) of a benchmark of any size."""
    few = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    each = few.mapInArrow(_windows(size), "item_id long, terms array<string>").withColumn("window", F.md5(F.array_join("terms", " ")))
    each = common.written(each, "benchmark-windows")
    windows = common.written(each.groupBy("window").agg(F.first("terms").alias("terms")), "distinct-windows")
    terms = index.select("block", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("block", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    totals = terms.groupBy("term").agg(F.sum("n").alias("total"))
    needed = common.written(windows.select("window", F.explode(F.array_distinct("terms")).alias("term")), "window-terms")
    known = common.joined(needed, totals, "term")
    rarest = known.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min_by("term", F.struct("total", "term")).alias("term"))
    able = common.written(windows.join(rarest, "window").where(F.col("n") == F.size(F.array_distinct("terms"))).select("window", "terms", "term"), "possible-windows")
    places = common.written(terms.select("term", "block").join(able.select("term").distinct(), "term", "left_semi"), "term-blocks")
    candidates = common.written(able.join(places, "term").select("block", "window", "terms"), "candidates")
    lots = candidates.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / lot).cast("int").alias("lots"))
    dealt = candidates.join(lots, "block").withColumn("lot", F.pmod(F.xxhash64("window"), F.col("lots")).cast("int")).drop("lots")
    blocks = index.join(lots, "block").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return blocks, dealt, each.select("window", "item_id").distinct()


def _met(act):
    """For each block and lot of windows: what act(block, name, doc_ids, phrases) gives."""

    def run(blocks: pa.Table, windows: pa.Table) -> pa.Table:
        phrases = Phrases([], 1)
        if windows.num_rows:
            of = [(w, [t.encode("utf-8", "surrogatepass") for t in ts]) for w, ts in zip(windows.column("window").to_pylist(), windows.column("terms").to_pylist())]
            phrases = Phrases(of, max(len(ts) for _, ts in of))
        out = []
        for i in range(blocks.num_rows):
            block, ids = _stored(blocks.combine_chunks(), i)
            out.append(act(block, blocks.column("block")[i].as_py(), ids, phrases))
        return pa.Table.from_batches(out)

    return run


def _together(blocks: DataFrame, windows: DataFrame, act, schema: str) -> DataFrame:
    return blocks.groupBy("block", "lot").cogroup(windows.groupBy("block", "lot")).applyInArrow(_met(act), schema)


def matches(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, held: int | None = None, lot: int = LOT) -> DataFrame:
    """(block, at, doc_id, n_words, items, firsts, ends): a row for each document; items as sorted ids, hit words as runs [first, end)."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    small = _small(benchmark, size) if held is None else None
    if small is not None:
        shared = index.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block, ids = _stored(batch, i)
                    yield _judged(block, batch.column("block")[i].as_py(), ids, shared.value, pa.int64())

        return index.mapInArrow(run, MATCHES.format(id=kind, item="bigint"))
    blocks, windows, pairs = _dealt(index, benchmark, size, lot)
    found = _together(blocks, windows, lambda *of: _judged(*of, pa.string()), MATCHES.format(id=kind, item="string"))
    found = common.written(found.where(F.size("firsts") > 0), "matched-windows")
    flat = lambda c: F.flatten(F.collect_list(c))
    runs = found.groupBy("block", "at").agg(flat("firsts").alias("f"), flat("ends").alias("e"))
    joined = F.expr("""aggregate(array_sort(arrays_zip(f, e)), cast(array() as array<struct<f:bigint,e:bigint>>), (s, x) ->
        if(size(s) > 0 and element_at(s, -1).e >= x.f,
           concat(slice(s, 1, size(s) - 1), array(named_struct('f', element_at(s, -1).f, 'e', greatest(element_at(s, -1).e, x.e)))),
           concat(s, array(named_struct('f', x.f, 'e', x.e)))))""")
    hit = common.written(found.select("block", "at", F.explode("items").alias("window")), "window-hits")
    named = hit.join(pairs.where("item_id is not null"), "window").groupBy("block", "at").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = lambda c: F.coalesce(c, F.array().cast("array<bigint>"))
    docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d")).select("block", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    out = docs.join(runs.withColumn("r", joined).select("block", "at", F.col("r.f").alias("firsts"), F.col("r.e").alias("ends")), ["block", "at"], "left").join(named, ["block", "at"], "left")
    return out.select("block", "at", "doc_id", "n_words", none("items").alias("items"), none("firsts").alias("firsts"), none("ends").alias("ends"))


def proximity_matches(index: DataFrame, benchmark: DataFrame, slop: int = 5, size: int = WINDOW, held: int | None = None, lot: int = LOT) -> DataFrame:
    """(doc_id, item_id, first, last): shortest spans of at most size + slop words of a document that hold all words of a window of the item, in any order."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, item_id {{item}}, first bigint, last bigint"
    small = _small(benchmark, size) if held is None else None
    if small is not None:
        shared = index.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _near(*_stored(batch, i), shared.value, slop, pa.int64())

        return index.mapInArrow(run, schema.format(item="bigint")).distinct()
    blocks, windows, pairs = _dealt(index, benchmark, size, lot)
    found = _together(blocks, windows, lambda block, _, ids, phrases: _near(block, ids, phrases, slop, pa.string()), schema.format(item="string"))
    return found.withColumnRenamed("item_id", "window").join(pairs.where("item_id is not null"), "window").select("doc_id", "item_id", "first", "last").distinct()


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written_index(common.table(spark, sf_dir, "documents"))
    found = matches(index, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(zip_with(firsts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)")
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bp AS (SELECT *, unnest(range(0, len(ws) - size + 1)) AS i FROM b),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[i + 1 : i + size], ' ') AS w FROM bp),
dp AS (SELECT r, ws, size, unnest(range(0, greatest(len(ws) - size + 1, 0))) AS i FROM d, (SELECT DISTINCT size FROM windows)),
dw AS (SELECT r, size, i, array_to_string(ws[i + 1 : i + size], ' ') AS w FROM dp),
h AS (SELECT r, i, size, item_id FROM dw JOIN windows USING (size, w)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS at FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN items ON items.r = d.r
"""


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a hit, with their own columns, whatever their names. Rows of one text share its verdict, so the index names documents by their text's digest."""
    index = written_index(docs.select(F.md5("text").alias("doc_id"), "text"), "string")
    hit = matches(index, common.table(spark, sf_dir, "benchmark")).where(F.size("firsts") > 0)
    bad = common.checkpointed(hit.select(F.col("doc_id").alias("digest")).where("digest is not null").distinct())
    common.release(index)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, F.md5("text").alias("digest")).join(bad, "digest", "left_anti").select("row.*")
