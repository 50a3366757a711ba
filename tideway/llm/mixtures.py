"""Languages of whole texts as mixtures, by expectation-maximisation over n-gram likelihoods.

Each letter of a text with its two neighbours (0 where that isn't a letter) is a 3-gram; Unicode decides what a letter
is, and capitals count as small letters. Training counts the 3-grams of all labelled texts by language, in 2 ** bits
numbered classes. A text is then taken as a mixture: expectation-maximisation finds the proportions of languages under
which its 3-grams are likeliest. Languages join in the order of these proportions, as long as the likelihood of the text
under the mixture of the chosen ones grows by more than `penalty` times the logarithm of its length for each; the one
with the largest proportion is the prediction.

Counting is one aggregation over all training texts, summed in each task first. The model that tasks get has a proven
size: a number for each language and class, at most MOST of them, so with very many languages there are fewer classes.
It is broadcast; a text's 3-grams are counted and judged in the task that reads it, many texts at a time.

Nulls: a null text, or one without a letter, is `und` with score 0 and no languages; a null lang isn't learned from. A
null doc_id is kept, and written as the empty string where doc_ids are hashed. Ties go to the language that sorts first.
Repeated rows have equal results. Without any labelled text every prediction is `und`. A text's counts are bounded by the
number of classes, so a long text takes memory for its characters, about 40 bytes each. Columns other than doc_id, text
and (in training) lang aren't read, whatever their names; lang is never read when predicting.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

UNKNOWN = "und"
#: Classes of 3-grams (a power of two), and numbers in a model at most.
BITS, MOST = 16, 1 << 24
PIECE = 1 << 20
ROUNDS = 25


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the small form of a letter, 0 for all else."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], np.uint32)


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, class, count) of the 3-grams of texts, in order of text and class."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    small = _letters()[points]
    at = np.flatnonzero(small)
    h = small[at - 1] * np.uint32(0x9E3779B1) ^ small[at] * np.uint32(0x85EBCA77) ^ small[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ends = np.cumsum([len(t) + 1 for t in texts])
    keys = np.searchsorted(ends, at, side="left").astype(np.uint64) << np.uint64(bits) | (h >> np.uint32(32 - bits)).astype(np.uint64)
    keys, n = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), n


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in common.spans(batch.column("text"), PIECE):
            yield batch.slice(lo, hi - lo)


def _count(bits: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, of in sums.items():
                some = np.flatnonzero(of)
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(of[some])], names=["lang", "gram", "n"])
            sums.clear()

        for part in _pieces(batches):
            langs = part.column("lang").to_pylist()
            text, gram, n = grams(part.column("text").to_pylist(), bits)
            numbers = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
            number = np.array([numbers[x] for x in langs], np.int64)[text]
            for lang, k in numbers.items():
                mine = number == k
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits, np.int64)
                sums[lang] += np.bincount(gram[mine], n[mine], 1 << bits).astype(np.int64)
                if len(sums) >= held:
                    yield from out()
        yield from out()

    return run


@dataclass(frozen=True)
class Model:
    """likely[class, language]: the probability of each 3-gram class in each language."""

    langs: list[str]
    bits: int
    likely: np.ndarray


def counted(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, gram, n): how often each 3-gram class stands in all texts of a language."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(_count(bits, 1 << max(0, 20 - bits)), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, smoothing: float = 0.5, bits: int = BITS) -> Model:
    """The model of all rows of docs (lang, text). A language whose texts hold no letter isn't learned."""
    n = docs.where("lang is not null and text is not null").agg(F.count_distinct("lang")).first()[0]
    if n > MOST >> 8:
        raise ValueError(f"{n} languages are more than a model holds ({MOST >> 8})")
    while n << bits > MOST:
        bits -= 1
    # a row a language, of at most 2 ** bits entries
    rows = counted(docs, bits).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("gram", "n"))).alias("c")).select("lang", F.col("c.gram").alias("gram"), F.col("c.n").alias("n")).toArrow()
    langs = rows.column("lang").to_pylist()
    likely = np.full((1 << bits, len(langs)), smoothing)
    for k in range(len(langs)):
        likely[rows.column("gram")[k].values.to_numpy(), k] += rows.column("n")[k].values.to_numpy()
    order = np.argsort(langs)
    likely = (likely / likely.sum(axis=0))[:, order] if langs else likely
    return Model([langs[k] for k in order], bits, likely.astype(np.float32))


def _fit(likely: np.ndarray, n: np.ndarray, starts: np.ndarray, total: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each text after ROUNDS of expectation-maximisation from `shares`; languages with no share stay without."""
    sizes = np.diff(np.append(starts, len(n)))
    for _ in range(ROUNDS):
        part = likely * np.repeat(shares, sizes, axis=0)
        part *= (n / part.sum(axis=1))[:, None]
        shares = np.add.reduceat(part, starts, axis=0) / total[:, None]
    chance = (likely * np.repeat(shares, sizes, axis=0)).sum(axis=1, dtype=np.float64)
    return shares, np.add.reduceat(n * np.log(chance), starts)


def mixtures(text: np.ndarray, gram: np.ndarray, n: np.ndarray, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have 3-grams, their number of 3-grams, proportions of each language after the choice)."""
    known, starts = np.unique(text, return_index=True)
    sizes = np.diff(np.append(starts, len(text)))
    n = n.astype(np.float32)
    total = np.add.reduceat(n, starts)
    likely = model.likely[gram]
    free, most = _fit(likely, n, starts, total, np.full((len(known), len(model.langs)), 1 / len(model.langs), np.float32))
    order = np.argsort(-free, axis=1, kind="stable")
    chosen = np.zeros_like(free)
    chosen[np.arange(len(known)), order[:, 0]] = 1
    best = np.add.reduceat(n * np.log(np.take_along_axis(likely, np.repeat(order[:, :1], sizes, axis=0), axis=1)[:, 0].astype(np.float64)), starts)
    cost = penalty * np.log(total + 1)
    open_ = np.arange(len(known))
    for size in range(2, len(model.langs) + 1):
        # no larger set can be likelier than all languages together
        open_ = open_[most[open_] - best[open_] > cost[open_]]
        if not len(open_):
            break
        rows = np.isin(np.repeat(np.arange(len(known)), sizes), open_)
        begin = np.concatenate(([0], np.cumsum(sizes[open_])[:-1]))
        first = np.zeros((len(open_), len(model.langs)), np.float32)
        np.put_along_axis(first, order[open_, :size], 1 / size, axis=1)
        shares, reached = _fit(likely[rows], n[rows], begin, total[open_], first)
        better = reached - best[open_] > cost[open_]
        open_, shares, reached = open_[better], shares[better], reached[better]
        chosen[open_], best[open_] = shares, reached
    return known, total, chosen


def _predict(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for part in _pieces(batches):
            langs, scores, shares = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows, [[]] * part.num_rows
            found = grams(part.column("text").to_pylist(), own.bits)
            if len(found[0]) and own.langs:
                known, total, chosen = mixtures(*found, own, penalty)
                # one 3-gram of all languages alike stands for what wasn't seen of the text
                expected = (chosen * total[:, None] + 1 / len(own.langs)) / (total[:, None] + 1)
                for k, best, row in zip(known.tolist(), chosen.argmax(axis=1).tolist(), range(len(known))):
                    langs[k], scores[k] = own.langs[best], float(expected[row, best])
                    shares[k] = [(own.langs[l], float(chosen[row, l])) for l in np.flatnonzero(chosen[row]).tolist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "languages"])

    return run


def languages(docs: DataFrame, model: Model, penalty: float = 3.0) -> DataFrame:
    """(doc_id, lang_pred, score, languages): a row for each document.

    languages holds the chosen languages' proportions; score is the expected proportion of lang_pred, lower for short texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return few.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), penalty), f"doc_id {kind}, lang_pred string, score double, languages map<string,double>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return languages(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
