"""Fill-in-middle transformation of whole texts.

A text is cut into units (a run of ASCII letters, or one other character); two cuts between units part it into prefix,
middle and suffix, which are put in another order behind the sentinels <P>, <S> and <M>. Cuts are found among the bytes
of many texts at once, while lengths are told in code points. Between the two stands a sparse exception index: only
multibyte characters are recorded, with their place and the bytes that they have over one. A cut is converted by one
search among them; what lies between is plain arithmetic, and an ASCII text has no entries at all.

Nulls: a null text is empty and stays plain; a null doc_id is written as the empty string where it is hashed. Repeated
rows give equal results, each its own. Texts that contain a sentinel stay plain, so that every output can be undone. A
long text is a batch of its own: beside its bytes a task holds four bytes a unit and eight a multibyte character.
Columns other than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of a batch are handled in pieces of about so many bytes.
PIECE = 1 << 22
_BLOCK = 1 << 20


class Exceptions:
    """Multibyte characters of UTF-8 bytes: their code-point places, and the excess bytes of all before each."""

    def __init__(self, data: np.ndarray) -> None:
        places, extras = [], []
        for at in range(0, len(data), _BLOCK):
            lead = np.flatnonzero(data[at : at + _BLOCK] >= 0xC0)
            b = data[at + lead]
            places.append((at + lead).astype(np.int32))
            extras.append(1 + (b >= 0xE0).astype(np.int32) + (b >= 0xF0))
        extra = np.concatenate([*extras, np.zeros(0, np.int32)])
        self.excess = np.concatenate((np.zeros(1, np.int32), np.cumsum(extra, dtype=np.int32)))
        self.chars = np.concatenate([*places, np.zeros(0, np.int32)]) - self.excess[:-1]

    def byte_of(self, char: np.ndarray) -> np.ndarray:
        """The byte at which each code point begins."""
        return char + self.excess[np.searchsorted(self.chars, char)]

    def char_of(self, byte: np.ndarray) -> np.ndarray:
        """The code point that begins at each byte."""
        return byte - self.excess[np.searchsorted(self.chars + self.excess[:-1], byte)]


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bytes at which units begin, in texts that follow each other in data (bounds: where each begins, and the end)."""
    out = []
    for at in range(0, len(data), _BLOCK):
        b = data[max(0, at - 1) : at + _BLOCK]
        letter = ((b | 0x20) - np.uint8(97)) < 26
        starts = (b & 0xC0) != 0x80
        starts[1:] &= ~(letter[1:] & letter[:-1])
        lo, hi = np.searchsorted(bounds, [at, at + len(b)])
        begins = bounds[lo:hi] - max(0, at - 1)
        starts[begins[begins < len(b)]] = True
        out.append((np.flatnonzero(starts[min(at, 1) :]) + at).astype(np.int32))
    return np.concatenate([*out, np.zeros(0, np.int32)])


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _transform(rate: int, spm: int):
    def piece(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, index = unit_starts(data, bounds), Exceptions(data)
        first = np.searchsorted(starts, bounds)
        n = np.diff(first)
        h1, h2, h3, h4 = (part.column(k).to_numpy() for k in ("h1", "h2", "h3", "h4"))
        ends = np.append(starts, len(data)).astype(np.int64)
        # a unit behind a text's last one begins where the text ends
        a, b = (ends[first[:-1] + f(h1 % (n + 1), h2 % (n + 1))] for f in (np.minimum, np.maximum))
        chars = index.char_of(np.concatenate((bounds[:-1], a, b))).reshape(3, -1)
        plain = np.array([not t or any(s in t for s in (b"<P>", b"<S>", b"<M>")) for t in texts], bool) | (h3 % 100 >= rate)
        form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
        out = []
        for t, f, x, y in zip(texts, form.tolist(), (a - bounds[:-1]).tolist(), (b - bounds[:-1]).tolist()):
            out.append(t if f == "plain" else b"".join((b"<P>", t[:x], b"<S>", t[y:], b"<M>", t[x:y])) if f == "psm" else b"".join((b"<S>", t[y:], b"<P>", t[:x], b"<M>", t[x:y])))
        sizes = [pa.array(np.diff(k, axis=0)[w].astype(np.int64), mask=plain) for k in (chars, np.stack((bounds[:-1], a, b))) for w in (0, 1)]
        columns = [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), *sizes, _strings(out)]
        return pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.spans(batch.column("text"), PIECE):
                yield piece(batch.slice(lo, hi - lo))

    return run


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output): a row for each document.

    `rate` of a hundred texts are transformed, `spm` of a hundred of those with the suffix first; the digest of seed and
    doc_id decides both and the cuts, so a row's result depends on nothing else. Lengths of plain texts are null.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    words = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    few = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(_transform(rate, spm), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of a form came from: its parts end where the next sentinel begins, which no part contains."""
    body = F.substring(F.col(output), F.lit(4), F.length(output))
    one = F.when(F.col(form) == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substring(body, F.length(one) + 4, F.length(output))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(two) + 4, F.length(output))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
  ('0x' || substr(x, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(x, 9, 8))::UBIGINT::BIGINT AS h2,
  ('0x' || substr(x, 17, 8))::UBIGINT::BIGINT AS h3, ('0x' || substr(x, 25, 8))::UBIGINT::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
