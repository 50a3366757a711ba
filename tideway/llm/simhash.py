"""SimHash near-duplicates.

Fingerprints of 64 bits are made in Arrow batches. Equal fingerprints collapse to one node first, so exact copies never
meet in a join. Nodes are then dealt by blocks: with 5 blocks, two fingerprints that differ in at most 3 bits agree on at
least 2 whole blocks, hence on one of the 10 keys made of 2 blocks (25 or 26 bits). Runs of equal keys are compared by
XOR and bit count. A key held by more than `hot` nodes (a cloud of near copies) is dealt again by the 84 keys made of 6
of 9 blocks: there at most 22 bits are free, so a run holds at most 2^22 distinct values whatever the input, and it is
linked by looking up the 1,794 masks of up to 3 free bits once that is cheaper than comparing all. Runs return only
a spanning forest of their links. Nothing is dropped or capped.

Texts of five-word Jaccard similarity 0.8 are often 4 to 11 bits apart, too many for blocks. On request `similar` adds
their links by prefix filtering: it finds candidates that share one of their first shingles, drops by sketches those that can't be, and compares whole sets.

Nulls: a null text has no words and the fingerprint zero, as has an empty one; rows with a null doc_id get a fingerprint
and count for links, but can't name a component unless all of its ids are null. Repeated rows are returned as often as
they come, and rows of one doc_id with other texts are told apart. A text of any length is hashed whole, 32,768 shingles
at a time. Ties don't matter to components, whose name is their smallest id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

BITS, NEAR = 64, 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the word shingles: bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]][:n]
    ends = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 32768):
        counts += np.unpackbits(hashes[at : at + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.worker_of("simhash", _WORDS.clear)
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "key", "fp"])


def row_key() -> Column:
    """A digest of doc_id and text: rows that share it differ in other columns at most."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), F.lit(":")).otherwise(F.concat(F.lit("=") , F.col("text").cast("string")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, key string, fp long: the fingerprint's bits as a signed number), a row for each row of docs."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_prints, "doc_id long, key string, fp long")


def _edges_of(width: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // width for i in range(width + 1)]
    return list(zip(cuts, cuts[1:]))


def block_keys(fps: np.ndarray, blocks: int, keep: int) -> Iterator[np.ndarray]:
    """For each choice of `keep` of the blocks: one key per fingerprint. The choice's number is hashed in, so keys of different choices differ."""
    ranges = _edges_of(blocks)
    for number, chosen in enumerate(combinations(range(blocks), keep)):
        mask = sum(((1 << b) - (1 << a)) for a, b in (ranges[i] for i in chosen))
        yield (fps & np.uint64(mask)), number


def _dealt(blocks: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64, copy=False)
            if len(fps):
                for part in np.array_split(fps, max(1, len(fps) // 20000)):
                    for masked, number in block_keys(part.view(np.uint64), blocks, keep):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int16)), pa.array(masked.view(np.int64)), pa.array(part)], names=["n", "k", "fp"])

    return run


def dealt(nodes: DataFrame, blocks: int, keep: int) -> DataFrame:
    """(n, k, fp): each node under each of its keys; n numbers the choice of blocks, k holds their bits."""
    return nodes.select("fp").mapInArrow(_dealt(blocks, keep), "n short, k long, fp long")


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable over the links a-b, for each of range(size)."""
    label = np.arange(size)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]
    return label


def link_run(fps: np.ndarray) -> np.ndarray:
    """Labels (see forest) of a run of distinct sorted fingerprints that may differ in few places; exact at any length."""
    size = len(fps)
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    masks = [sum(c) for r in range(1, NEAR + 1) for c in combinations(bits, r)] if len(bits) <= 24 else None
    label = np.arange(size)
    if masks is not None and len(masks) < size / 2:
        for mask in masks:
            at = np.searchsorted(fps, other := fps ^ np.uint64(mask))
            at[at == size] = 0
            there = np.flatnonzero(fps[at] == other)
            label = _merge(label, there, at[there])
        return label
    for i in range(0, size, 1024):
        for j in range(i, size, 1024):
            near = np.bitwise_count(fps[i : i + 1024, None] ^ fps[None, j : j + 1024]) <= NEAR
            a, b = np.nonzero(near)
            label = _merge(label, a + i, b + j)
    return label


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    la, lb = label[a], label[b]
    apart = la != lb
    return label if not apart.any() else forest(len(label), la[apart], lb[apart])[label]


def link_sorted(n: np.ndarray, k: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of the runs of equal (n, k) in sorted arrays."""
    out_a, out_b = [], []
    same = (n[1:] == n[:-1]) & (k[1:] == k[:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    ends = np.append(starts[1:], len(n))
    pairs = np.flatnonzero(ends - starts == 2)
    x, y = fps[starts[pairs]], fps[starts[pairs] + 1]
    near = np.bitwise_count(x ^ y) <= NEAR
    out_a.append(x[near])
    out_b.append(y[near])
    for r in np.flatnonzero(ends - starts > 2):
        run = np.sort(fps[starts[r] : ends[r]])
        label = link_run(run)
        rest = np.flatnonzero(label != np.arange(len(run)))
        out_a.append(run[label[rest]])
        out_b.append(run[rest])
    return np.concatenate(out_a), np.concatenate(out_b)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by (n, k, fp); the last run of each waits for the next batch."""

    def out(kept: list[np.ndarray]) -> pa.RecordBatch:
        a, b = link_sorted(*kept)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        n, k, f = (np.asarray(batch.column(i)) for i in range(3))
        last = np.flatnonzero((n != n[-1]) | (k != k[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        f = f.astype(np.int64, copy=False).view(np.uint64)
        if cut or (held and (held[-1][0][-1] != n[0] or held[-1][1][-1] != k[0])):
            held.append([n[:cut], k[:cut], f[:cut]])
            yield out([np.concatenate(x) for x in zip(*held)])
            held = []
        held.append([n[cut:], k[cut:], f[cut:]])
    if held:
        yield out([np.concatenate(x) for x in zip(*held)])


def links(nodes: DataFrame, blocks: int = 5, keep: int = 2, hot: int = 2000, fine_blocks: int = 9, fine_keep: int = 6) -> DataFrame:
    """(a, b): links that span each component of distinct fingerprints nodes(fp) at Hamming distance 3 or less."""
    spark = nodes.sparkSession
    keys = dealt(nodes, blocks, keep)
    full = common.checkpointed(keys.groupBy("n", "k").count().where(F.col("count") > hot).select("n", "k"))
    linked = lambda df: df.repartition("n", "k").sortWithinPartitions("n", "k", F.col("fp")).mapInArrow(_linked, "a long, b long")
    if full.isEmpty():
        return linked(keys)
    again = common.checkpointed(keys.join(full, ["n", "k"], "left_semi").select("fp").distinct())
    return linked(keys.join(full, ["n", "k"], "left_anti").select("n", "k", "fp")).union(linked(dealt(again, fine_blocks, fine_keep)))


def near_duplicates(docs: DataFrame, shingle: int | None = None, least: int = 80, hot: int = 200) -> DataFrame:
    """(doc_id, fp, component_id, key): every row of docs with the smallest doc_id that it reaches over links; key tells rows of other doc_id or text apart.

    Links are fingerprints at 3 bits or less and, if shingle is given, also texts whose sets of word shingles of that length have a Jaccard similarity of least percent or more.
    """
    prints, named = _components(docs, shingle, least, hot)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.checkpointed(common.joined(named, smallest, "root").select("fp", "component_id"))
    return common.joined(prints, named, "fp").select("doc_id", "fp", "component_id", "key")


def _components(docs: DataFrame, shingle: int | None, least: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """prints(doc_id, key, fp), a row for each row of docs, and named(fp, least, root): the component of each distinct fingerprint."""
    prints = common.written(fingerprints(docs), "fingerprints")
    nodes = common.checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = common.components(links(nodes))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    if shingle:
        named = common.checkpointed(named)
        wider = common.components(similar(docs, named.select("fp", "root"), shingle, least, hot)).withColumnRenamed("root", "wider")
        named = named.join(wider, named.root == wider.node, "left").select("fp", "least", F.coalesce("wider", "root").alias("root"))
    return prints, common.checkpointed(named)


class _Hashes(dict):
    """XXH64 by word; clearing it forgets nothing but time."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word, 42)
        return out


_WORDS = _Hashes()


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes, as signed numbers, of the k-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.int64)
    hashes = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    if len(_WORDS) > 50_000:
        _WORDS.clear()
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], k: int, wanted=None) -> Iterator[list[tuple[int, str, np.ndarray | None]]]:
    """(number of the text, text, shingles) of the texts with words, for about a megabyte of texts at a time; equal words have equal numbers. Texts whose number isn't wanted are left out; without k there are no shingles."""
    common.worker_of("simhash", _WORDS.clear)
    out: dict[int, tuple] = {}
    size = 0
    for batch in batches:
        for t in batch.column(0):
            text = t.as_py()
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if words:
                node = xxhash.xxh64_intdigest(b" ".join(words), 42)
                node -= (node >> 63) << 64
                if node not in out and (wanted is None or wanted(node)):
                    out[node] = (node, text, shingles(words, k) if k else None)
                    size += len(text)
                if size > 1 << 20:
                    yield list(out.values())
                    out, size = {}, 0
    if out:
        yield list(out.values())


def _frequent(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for n, _, s in texts if n % 16 == 0] or [np.empty(0, np.int64)]))], names=["k"])

    return run


def frequent(texts: DataFrame, k: int, hot: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in ascending order, their ranks by frequency): those that a sixteenth of the texts shows to be in about `hot` texts or more.

    If they are more than `most`, the most frequent ones of at most that number: 16 bytes each reach the driver and the tasks.
    """
    counts = common.written(texts.mapInArrow(_frequent(k), "k long").groupBy("k").count().where(F.col("count") >= max(2, hot // 16)), "frequent")
    left = most
    for row in counts.groupBy(F.expr("cast(log2(count) as int)").alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).collect():
        left -= row.n
        if left < 0:
            counts = counts.where(F.col("count") >= 2 ** (row.p + 1))
            break
    found = counts.toArrow()
    order, often = (found.column(i).to_numpy() for i in range(2))
    by = np.argsort(order)
    order, rank = order[by], np.empty(len(order), np.int64)
    rank[np.lexsort((order, often[by]))] = np.arange(len(order))
    return order, rank


def prefix(own: np.ndarray, order: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """The first shingles of a text in the order by (rank of frequent ones, hash), and how many of them aren't frequent: texts of `least` percent share one of them."""
    size, rare = len(own) + (-len(own) * least // 100) + 1, len(own)
    if len(order):
        at = np.minimum(np.searchsorted(order, own), len(order) - 1)
        often = order[at] == own
        rare -= int(often.sum())
        own = np.concatenate((own[~often], own[often][np.argsort(rank[at[often]])]))
    return own[:size], min(rare, size)


def _prefixes(k: int, order: np.ndarray, rank: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, k):
            found = [prefix(s, order, rank, least) for _, _, s in texts]
            sizes = [len(x) for x, _ in found]
            node, n, rare = (np.repeat(np.array(x, np.int64), sizes) for x in ([t[0] for t in texts], [len(t[2]) for t in texts], [r for _, r in found]))
            at = np.concatenate([np.arange(x) for x in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([x for x, _ in found]), node, n.astype(np.int32), at.astype(np.int32), at >= rare)], names=["k", "node", "n", "at", "often"])

    return run


KEYS = "k long, node long, n int, at int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole runs of equal first column: batches come sorted by it; the last run of each waits for the next batch."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][0]):
            held.append([c[:cut] for c in cols])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _possible(n: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Whether sets x and y, whose first common shingle may be this one, can be similar enough by their sizes and what stands behind it in both."""
    shared = np.minimum(n[x] - at[x], n[y] - at[y]).astype(np.int64)
    return (np.minimum(n[x], n[y]).astype(np.int64) * 100 >= np.maximum(n[x], n[y]).astype(np.int64) * least) & (shared * (100 + least) >= least * (n[x].astype(np.int64) + n[y]))


def _recurring(least: int):
    """Rows of shingles that several texts begin with, each beside the run's first text: (k, node, n, at, lead, near), near if that pair is possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, node, n, at, *_ in _runs(batches):
            fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (node[1:] != node[:-1])))
            k, node, n, at = (c[fresh] for c in (k, node, n, at))
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(starts, len(k)))
            head = np.repeat(starts, sizes)
            keep = np.flatnonzero(np.repeat(sizes, sizes) > 1)
            head = head[keep]
            near = _possible(n, at, head, keep, least) & (head != keep)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k[keep], node[keep], n[keep], at[keep], node[head], near)], names=["k", "node", "n", "at", "lead", "near"])

    return run


def _near(n: np.ndarray, folded: list[bytes], x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Whether texts x and y can be similar enough by their folded sketches (see sketch()); the longer one of a pair is folded to the shorter one's size."""
    met, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    n, folded = n[met].astype(np.int64), folded[met]
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    x, y = at[: len(x)], at[len(x) :]
    keep, both = np.zeros(len(x), bool), np.minimum(sizes[x], sizes[y])
    for size in np.unique(both):
        bits = np.zeros((len(folded), size // 8), np.uint64)
        for i in np.flatnonzero(sizes >= size):
            bits[i] = np.bitwise_xor.reduce(np.frombuffer(folded[i], np.uint64).reshape(-1, size // 8))
        of = np.flatnonzero(both == size)
        for part in np.array_split(of, len(of) // 50_000 + 1):
            apart = np.bitwise_count(bits[x[part]] ^ bits[y[part]]).sum(axis=1, dtype=np.int64)
            keep[part] = apart * (100 + least) <= (n[x[part]] + n[y[part]]) * (100 - least)
    return keep


def _crossing(least: int):
    """Possible pairs of a run between other groups, without those of the run's first text; rows come as (k, root, node, n, at, lead, f).

    Folded sketches are compared here, so texts of a cloud that are too far apart never become a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, root, node, n, at, lead, folded in _runs(batches):
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            ends = np.append(starts[1:], len(k))
            mixed = np.concatenate(([False], (root[1:] != root[:-1]) & (k[1:] == k[:-1])))
            found, held = [], 0
            for a, b in zip(starts, ends):
                if not mixed[a:b].any():
                    continue
                for i in range(a, b, 512):
                    for j in range(i, b, 512):
                        x, y = np.arange(i, min(b, i + 512)), np.arange(j, min(b, j + 512))
                        x, y = np.nonzero((x[:, None] < y[None]) & (root[x][:, None] != root[y][None]))
                        x, y = x + i, y + j
                        some = _possible(n, at, x, y, least) & (node[x] != lead[x]) & (node[y] != lead[y])
                        x, y = x[some], y[some]
                        some = _near(n, folded, x, y, least)
                        x, y = node[x[some]], node[y[some]]
                        found.append((np.minimum(x, y), np.maximum(x, y)))
                        held += len(x)
                        if held > 200_000:
                            yield _pairs(found)
                            found, held = [], 0
            if held:
                yield _pairs(found)

    return run


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])


#: Bits of the filter that lets only texts of some pair through; others that share a bit are dropped by the join.
SLOTS = 1 << 26


#: Slots of a sketch that goes along with each of a text's rows: enough for 512 shingles, of some use up to 2,300.
FOLDED = 1024


def sketch(own: np.ndarray, most: int | None = None) -> bytes:
    """A bit for each of at least 2 n slots, but no more than `most`: whether an odd number of the shingles fall into it."""
    slots = max(64, 1 << (2 * len(own) - 1).bit_length())
    slots = min(slots, most or slots)
    return np.packbits(np.bincount(own & (slots - 1), minlength=slots) & 1, bitorder="little").tobytes()


def _held(k: int, bits: np.ndarray, whole: bool):
    """(node, fp, n, s, f) of the texts whose bit is set: s is the compressed text or the sketch of its n shingles, f the latter with FOLDED slots at most."""
    wanted = lambda node: int(bits[(node % SLOTS) >> 6]) >> (node & 63) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in _texts(batches, 0 if whole else k, wanted):
            prints = np.array([0 if whole else fingerprint(t) for _, t, _ in few], dtype=np.uint64).view(np.int64)
            held = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) if whole else sketch(own) for _, t, own in few]
            sizes = [0 if whole else len(own) for *_, own in few]
            folded = [b"" if whole else sketch(own, FOLDED) for *_, own in few]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in few], pa.int64()), pa.array(prints), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()), pa.array(folded, pa.binary())], names=["node", "fp", "n", "s", "f"])

    return run


def held(texts: DataFrame, nodes: DataFrame, k: int, whole: bool) -> DataFrame:
    """The rows of _held for nodes(node), each once. The driver makes a filter of fixed size from them; a join drops the others."""
    words = nodes.groupBy(F.expr(f"shiftright(pmod(node, {SLOTS}L), 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(node & 63L as int)))").alias("m")).toArrow()
    bits = np.zeros(SLOTS >> 6, dtype=np.uint64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return texts.mapInArrow(_held(k, bits, whole), "node long, fp long, n long, s binary, f binary").dropDuplicates(["node"])


def _maybe(least: int):
    """Pairs whose sketches differ in no more slots than sets of `least` percent can: each shingle of one side only changes one slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column(4).to_pylist(), batch.column(5), batch.column(6)):
                x, y = (np.frombuffer(c.as_buffer(), np.uint8) for c in (x, y))
                size = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(c.reshape(-1, size)) for c in (x, y))
                keep.append(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (100 + least) <= n * (100 - least))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (shingles(zlib.decompress(c.as_buffer()).lower().split(), k) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(docs: DataFrame, roots: DataFrame, shingle: int = 5, least: int = 80, hot: int = 200, most: int = 1 << 20) -> DataFrame:
    """(a, b): links over the roots(fp, root) of texts whose shingle sets have a Jaccard similarity of least percent or more; they reach whatever all such pairs reach.

    Two such sets share one of the first shingles of each in any common order, and behind the first one that they share
    both hold enough others, so all pairs are found. Frequent shingles (see frequent()) stand last in the order, which
    spares pairs but decides none. Sketches drop pairs that can't be similar enough; the others' whole sets are compared.
    First each text is compared with one text of its run only; then those that are still apart, where sketches of a fixed size
    decide before a pair becomes a row: a cloud of near copies costs a pair for each text and shingle, and pairs that are
    about as similar as `least` asks, not all pairs. Shingles and texts are told apart by 64-bit hashes.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    order, rank = frequent(texts, shingle, hot, most)
    keys = common.written(texts.mapInArrow(_prefixes(shingle, order, rank, least), KEYS + ", often boolean"), "prefixes")
    rare = keys.where("not often").repartition("k").sortWithinPartitions("k", "node").mapInArrow(_recurring(least), KEYS + ", lead long, near boolean")
    # frequent shingles, at most `most`: their first texts are looked up where the rows are
    often = common.written(keys.where("often").drop("often").distinct(), "frequent-prefixes")
    leads = often.groupBy("k").agg(F.min(F.struct("node", "n", "at")).alias("l"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    sizes = f"least(n, l.n) * 100L >= greatest(n, l.n) * {least}L and least(n - at, l.n - l.at) * {100 + least}L >= {least}L * (n + l.n)"
    led = often.join(F.broadcast(leads), "k").select("k", "node", "n", "at", F.col("l.node").alias("lead"), F.expr(f"node <> l.node and {sizes}").alias("near"))
    runs = common.written(rare.union(led), "shared-shingles")
    common.release(keys, often)
    short = common.written(held(texts, runs.select("node"), shingle, False).join(roots, "fp").select("node", "root", "n", "s", "f"), "sketches")
    side = lambda x: short.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select("a", "b", "ra", "rb", F.expr("na + nb").alias("n"), "sa", "sb")
        maybe = common.written(both.mapInArrow(_maybe(least), "a long, b long, ra long, rb long"), "similar-pairs")
        nodes = maybe.select(F.col("a").alias("node")).union(maybe.select("b"))
        whole = common.written(held(texts, nodes, shingle, True).select("node", "s"), "similar-texts")
        sa, sb = (whole.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        found = maybe.join(sa, "a").join(sb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "sa", "sb")
        links_ = common.written(found.mapInArrow(_alike(shingle, least), "a long, b long").distinct(), "similar-links")
        common.release(maybe, whole)
        return links_

    first = checked(runs.where("near").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    met = common.components(first).withColumnRenamed("node", "own")
    named = short.select("node", "root").join(met.withColumnRenamed("root", "met"), F.col("root") == F.col("own"), "left").select("node", F.coalesce("met", "root").alias("root"))
    grouped = common.written(runs.join(named, "node").select("k", "root", "node", "n", "at", "lead"), "grouped-shingles")
    common.release(runs)
    mixed = grouped.groupBy("k").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("k")
    apart = grouped.join(mixed, "k", "left_semi").join(short.select("node", "f"), "node").select("k", "root", "node", "n", "at", "lead", "f")
    apart = apart.repartition("k").sortWithinPartitions("k", "root")
    rest = checked(apart.mapInArrow(_crossing(least), "a long, b long").distinct())
    common.release(short, grouped)
    return first.union(rest)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near copies (op1's links, and five-word shingles at 0.8 or more): of each component one row stays.

    It is the row with the smallest doc_id (null comes last), of equal doc_ids that with the smallest digest of doc_id and
    text, and of rows that share even these any one. Rows are told apart by that digest, so another text under the same
    doc_id is judged for itself. Whole texts are shuffled once, by the join with the kept rows' digests.
    """
    prints, named = _components(docs, 5, 80, 200)
    rows = common.joined(prints, named.select("fp", "root"), "fp")
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("r"))
    kept = kept.select("r.key").distinct()
    twice = common.checkpointed(prints.groupBy("key").count().where("count > 1").select("key").join(kept, "key", "left_semi"))
    once = common.checkpointed(kept.join(twice, "key", "left_anti"))
    keyed = docs.select(row_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    single = keyed.join(once, "key", "left_semi").select("row.*")
    several = keyed.join(twice, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return single.union(several)
