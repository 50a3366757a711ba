import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tideway.llm import mixtures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(docs):
    return mixtures.train(docs.where(~mixtures.held_out()))


def plain_grams(text):
    small = [c.lower()[0] if c.isalpha() else "\0" for c in "\n" + text + "\n"]
    return Counter(tuple(small[k - 1 : k + 2]) for k in range(1, len(small) - 1) if small[k] != "\0")


def class_of(gram, bits):
    a, b, c = (ord(x) for x in gram)
    h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    return h >> (32 - bits)


def test_grams_are_those_of_the_plain_version():
    texts = ["", "a", "Äb c1d-É", "日本 x", "!!", "ǅ İ ſ", "ab" * 50, "\n\n"]
    got = [Counter() for _ in texts]
    for t, g, n in zip(*mixtures.grams(texts, 16)):
        got[t][int(g)] += int(n)
    want = [Counter() for _ in texts]
    for t, x in enumerate(texts):
        for g, n in plain_grams(x).items():
            want[t][class_of(g, 16)] += n
    assert got == want


def test_counts_cover_all_training_texts(docs):
    some = docs.where(~mixtures.held_out())
    want = Counter()
    for r in some.collect():
        assert zlib.crc32(str(r.doc_id).encode()) % 3 != 1
        for g, n in plain_grams(r.text).items():
            want[r.lang, class_of(g, 16)] += n
    assert {(r.lang, r.gram): r.n for r in mixtures.counted(some, 16).collect()} == want


def test_held_out_accuracy(spark, docs):
    out = mixtures.op12_language_id(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = out.collect()
    apart = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in apart} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(truth[r.doc_id] == r.lang_pred for r in apart) >= 0.99 * len(apart) and all(0 <= r.score <= 1 for r in rows)


def test_predictions_use_no_label(docs, model):
    few = docs.limit(40)
    one = {r.doc_id: (r.lang_pred, r.score) for r in mixtures.languages(few, model).collect()}
    other = few.selectExpr("doc_id", "text", "'es' as lang", "'x' as score", "1 as languages")
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in mixtures.languages(other, model).collect()}


def test_mixed_texts_have_their_languages(spark, docs, model):
    by = {}
    for r in docs.where("crc32(cast(doc_id as string)) % 3 = 1 and length(text) between 1500 and 3000").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    rows, want = [], {}
    for k, (a, b) in enumerate([("en", "de"), ("fr", "es"), ("de", "fr"), ("en", "es"), ("en", "fr")]):
        x, y = by[a][0], by[b][0]
        rows.append((k, x + " " + y[: len(x) // 2]))
        want[k] = (a, {a, b})
    for k, lang in enumerate(by):
        rows.append((10 + k, by[lang][1]))
        want[10 + k] = (lang, {lang})
    rows.append((20, by["en"][0] + by["de"][0] + by["fr"][0]))
    want[20] = (None, {"en", "de", "fr"})
    found = {r.doc_id: r for r in mixtures.languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, (top, langs) in want.items():
        assert set(found[k].languages) == langs and (top is None or found[k].lang_pred == top), (k, found[k], want[k])
        assert math.isclose(sum(found[k].languages.values()), 1, rel_tol=1e-4)
    assert abs(found[0].languages["en"] - 2 / 3) < 0.1


def test_expectation_maximisation_equals_the_plain_version(docs, model):
    texts = [r.text for r in docs.limit(5).collect()]
    text, gram, n = mixtures.grams(texts, model.bits)
    known, total, _ = mixtures.mixtures(text, gram, n, model, 3.0)
    starts = np.unique(text, return_index=True)[1]
    k = len(model.langs)
    shares, reached = mixtures._fit(model.likely[gram], n.astype(np.float32), starts, total, np.full((5, k), 1 / k, np.float32))
    for d in range(5):
        c, p = n[text == d].astype(float), model.likely[gram[text == d]].astype(float)
        own = [1 / k] * k
        for _ in range(mixtures.ROUNDS):
            new = [0.0] * k
            for m, row in zip(c, p):
                s = sum(a * b for a, b in zip(row, own))
                for l in range(k):
                    new[l] += m * row[l] * own[l] / s
            own = [x / c.sum() for x in new]
        assert np.allclose(own, shares[d], atol=1e-3)
        assert math.isclose(sum(m * math.log(sum(a * b for a, b in zip(row, own))) for m, row in zip(c, p)), reached[d], rel_tol=1e-4)


def test_edges(spark, docs, model):
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "a"), (4, "a"), (None, "und der die"), (5, "x" * 2_000_000), (6, "日本語"), (7, "\x00é")]
    out = mixtures.languages(spark.createDataFrame([(d, t, "q", 1.0) for d, t in rows], "doc_id long, text string, lang string, score double"), model).collect()
    assert len(out) == len(rows)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3} and all(r.score == 0 and not r.languages for r in out if r.lang_pred == "und")
    assert all(0 < r.score <= 1 and r.lang_pred in model.langs for r in out if r.lang_pred != "und")
    assert mixtures.languages(docs.limit(0), model).count() == 0
    untrained = mixtures.train(docs.limit(0))
    assert {r.lang_pred for r in mixtures.languages(docs.limit(5), untrained).collect()} == {"und"}
    odd = mixtures.train(spark.createDataFrame([("a b", None), (None, "xx"), ("12", "nn"), ("ab cd", "aa")], "text string, lang string"))
    assert odd.langs == ["aa"]


def test_very_many_languages_take_fewer_classes(spark, monkeypatch):
    monkeypatch.setattr(mixtures, "MOST", 1 << 16)
    many = spark.range(300).selectExpr("'l' || id as lang", "repeat(chr(cast(97 + id % 26 as int)) || chr(cast(97 + id div 26 as int)) || ' ', 20) as text", "id as doc_id")
    with pytest.raises(ValueError):
        mixtures.train(many)
    some = many.where("doc_id < 200")
    model = mixtures.train(some)
    assert len(model.langs) == 200 and model.likely.size <= 1 << 16
    found = mixtures.languages(some, model).collect()
    assert sum(r.lang_pred == f"l{r.doc_id}" for r in found) > 100
