"""Periodic runs of words in whole texts, by maximal pairs.

A run with smallest period q is the maximal pair of its first word and the word q behind it: the two suffixes agree on
L = length - q words, and neither the words before them nor the words after them do. So the runs are the maximal pairs
whose distance is at most L and whose distance and L make up the least length; the least distance of a stretch is its
period. The steps, on many texts at a time:

1. Words become numbers. Texts in which no six words recur hold no run (L is 6 at least) and end here.
2. Suffixes are sorted within their texts by doubling; only those that still share a rank are sorted again. Suffixes that
   follow each other get the length that they share, each from what the suffix before it in the text shares.
3. The LCP-interval tree is walked bottom-up. A node keeps its positions in order, and lists of them by the word on
   their left. The smaller child of a merge looks among the larger one's positions for those at most L away, and steps
   over its own class of left words by galloping, so pairs that can be extended to the left are never formed. What is
   formed is bounded by the exponents of the text's runs, which add up to less than three for each word.

Nulls: a null text has no words; a null doc_id is kept. Repeated rows have equal results. Ties don't occur: a stretch has
one smallest period, and two runs of one start differ in length and period. Texts of up to PIECE bytes are handled
together, a longer text alone; a task holds some 300 bytes for each word of those. Columns other than doc_id and text
aren't read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

LEAST = 12
#: A pair of a run shares so many words at least: its distance is no more, and both make up LEAST.
SHARED = LEAST // 2
PIECE = 1 << 21

Node = tuple[list[int], dict[int, list[int]]]


def _recurring(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether SHARED words that begin at each place recur in its text. Digests may take others for equal, never miss one."""
    n = len(w) - SHARED + 1
    out = np.zeros(len(w), bool)
    if n < 2:
        return out
    mixed = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(SHARED):
        h = (h ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    whole = np.flatnonzero(doc[:n] == doc[SHARED - 1 :])
    h = h[whole]
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        out[whole[twice[at] == h]] = True
    return out


def _ranks(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The rank of each suffix among all, texts one after another; the end of a text sorts behind all of its words."""
    n = len(w)
    order = np.lexsort((w, doc))
    new = np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (w[order][1:] != w[order][:-1])))
    base = np.flatnonzero(new)
    size = np.diff(np.append(base, n))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.repeat(base, size), n
    left = order[np.repeat(size, size) > 1]
    h = 1
    while len(left):
        a, b = rank[left], rank[left + h]
        o = np.lexsort((b, a))
        left, a, b = left[o], a[o], b[o]
        outer = np.concatenate(([True], a[1:] != a[:-1]))
        inner = outer | np.concatenate(([True], b[1:] != b[:-1]))
        place = np.arange(len(left))
        rank[left] = a + np.maximum.accumulate(np.where(inner, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0))
        size = np.diff(np.append(np.flatnonzero(inner), len(left)))
        left = left[np.repeat(size, size) > 1]
        h *= 2
    return rank[:n]


def _shared(w: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray, recur: np.ndarray) -> np.ndarray:
    """The words that each suffix in order shares with the one before it, where these are SHARED or more, else 0."""
    out = np.zeros(len(w), np.int64)
    i = np.flatnonzero(recur & (rank > 0))
    j = order[rank[i] - 1]
    fits = (end[i] == end[j]) & (np.maximum(i, j) + SHARED <= end[i])
    i, j = i[fits], j[fits]
    for k in range(SHARED):
        same = w[i + k] == w[j + k]
        i, j = i[same], j[same]
    words, last, h = w.tolist(), -2, 0
    found = []
    for x, y, most in zip(i.tolist(), j.tolist(), (end[i] - np.maximum(i, j)).tolist()):
        h = max(SHARED, h - 1) if x == last + 1 else SHARED
        while h < most and words[x + h] == words[y + h]:
            h += 1
        found.append(h)
        last = x
    out[rank[i]] = found
    return out


def _beyond(big: list[int], k: int, own: list[int]) -> int:
    """The first place behind k of big whose position isn't in own, where big[k] is: own is part of big, so the two run alike up to there."""
    t, step = bisect_left(own, big[k]), 1
    while k + step < len(big) and t + step < len(own) and big[k + step] == own[t + step]:
        step *= 2
    low, high = step // 2, min(step, len(big) - k, len(own) - t)
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if big[k + mid] == own[t + mid] else (low, mid)
    return k + low + 1


def _merge(a: Node, b: Node, depth: int, left_of: list[int], found: dict[tuple[int, int], int]) -> Node:
    """The node of both; maximal pairs between them that make runs go to found: (start, length) with the least period."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    big, classes = a
    for left, places in b[1].items():
        own = classes.get(left)
        for i in places:
            k, last = bisect_left(big, i - depth), i + depth
            while k < len(big) and (j := big[k]) <= last:
                if own and left_of[j] == left:
                    k = _beyond(big, k, own)
                    continue
                start, period = (i, j - i) if i < j else (j, i - j)
                if period + depth >= LEAST:
                    key = (start, period + depth)
                    if period < found.get(key, period + 1):
                        found[key] = period
                k += 1
    for left, places in b[1].items():
        own = classes.setdefault(left, [])
        for i in places:
            insort(big, i)
            insort(own, i)
    return a


def _pairs(order: list[int], shared: list[int], left_of: list[int]) -> dict[tuple[int, int], int]:
    """Runs of suffixes that follow each other in order and share SHARED words or more with their neighbours."""
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, Node]] = []
    now: Node = ([order[0]], {left_of[order[0]]: [order[0]]})
    for p, l in zip([*order[1:], -1], [*shared[1:], -1]):  # noqa: E741
        while stack and stack[-1][0] >= l:
            depth, below = stack.pop()
            now = _merge(below, now, depth, left_of, found)
            if depth == l:
                break
        if p >= 0:
            stack.append((l, now))
            now = ([p], {left_of[p]: [p]})
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text's words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    number = defaultdict(count().__next__)
    w = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    recur = _recurring(w, doc)
    some = np.zeros(len(texts), bool)
    some[doc[recur]] = True
    if not some.any():
        return out
    take = some[doc]
    w, doc, recur = w[take], doc[take], recur[take]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(first, len(w)))
    begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    rank = _ranks(w, doc)
    order = np.empty(len(w), np.int64)
    order[rank] = np.arange(len(w))
    shared = _shared(w, end, order, rank, recur)
    left_of = np.concatenate(([-1], w[:-1]))
    left_of[first] = -1
    lefts = left_of.tolist()
    # stretches of suffixes that share enough with their neighbours
    inside = np.concatenate(([0], (shared > 0).view(np.int8), [0]))
    opens, closes = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    for a, b in zip(opens.tolist(), closes.tolist()):
        for (start, length), period in _pairs(order[a - 1 : b].tolist(), shared[a - 1 : b].tolist(), lefts).items():
            out[doc[start]].append((start - int(begin[start]), length, period))
    # one stretch may be found from several suffix groups: its least period counts
    for d in np.flatnonzero(some).tolist():
        least: dict[tuple[int, int], int] = {}
        for start, length, period in out[d]:
            least[start, length] = min(period, least.get((start, length), period))
        out[d] = sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds behind its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    start, length, period = np.array(runs, np.int64).T
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in common.spans(batch.column("text"), PIECE):
            part = batch.slice(lo, hi - lo)
            texts = [t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]
            runs = runs_of(texts)
            kept = pa.array([collapsed(t, r) for t, r in zip(texts, runs)], pa.binary()).view(pa.string())
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(RUN)))
            yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), found, kept], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period), collapsed text): a row for each document."""
    few = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(_find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeating(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The query's texts: a tenth of them, by the digest of their doc_id, repeat a part of their words up to their end."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    g = F.floor(h / 10)
    w = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(w, F.lit(1), a), again)).otherwise(F.col(text))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", repeating().alias("text"))
    found = periodic_runs(docs)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out


#: Equal six-word windows of one text, dealt by distance: stretches of them that follow each other are the words that a pair shares.
ORACLE = r"""
WITH RECURSIVE steps AS (SELECT doc_id, text, list_transform(range(0, len(coalesce(doc_id::VARCHAR, ''))), lambda k: ascii(substr(doc_id::VARCHAR, k::INT + 1, 1))) AS b FROM documents),
summed AS (SELECT doc_id, text, coalesce(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(b, lambda x: [x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS c FROM steps),
d AS (SELECT row_number() OVER () AS r, doc_id, xor(c, 4294967295) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0 FROM summed),
e AS (SELECT r, doc_id, h, w0, len(w0) AS n, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM f),
places AS (SELECT r, unnest(range(0, n - 5)) AS i, w FROM t WHERE n > 5),
k AS (SELECT r, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5], w[i + 6]) AS k, w[i + 1:i + 6] AS v FROM places),
often AS (SELECT r, i, k, v FROM k QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.r = y.r AND x.k = y.k AND x.i < y.i AND x.v = y.v),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs),
pair AS (SELECT r, q, min(i) AS s, count(*) + 5 AS l FROM island GROUP BY r, q, g),
run AS (SELECT r, s, l + q AS m, min(q) AS q FROM pair WHERE q <= l AND q + l >= 12 GROUP BY r, s, l + q),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min({'s': s, 'm': m, 'q': q}, {'m': -m, 's': s, 'q': q}) AS best FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM run),
every AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS x FROM t),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM every ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.m::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.m // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
