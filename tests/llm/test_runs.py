import random
import time

import pytest
from tideway.llm import runs


def plain_runs(w):
    """Every period by itself: stretches in which words that far apart are equal."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found[i, j - i + q] = min(q, found.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def made(r):
    w = [bytes([97 + r.randrange(r.randint(1, 4))]) for _ in range(r.randint(0, 70))]
    if w and r.random() < 0.6:
        a, p = r.randrange(len(w)), r.randint(1, 9)
        w = w[:a] + w[a : a + p] * r.randint(2, 8) + w[a:]
    return w


def test_runs_are_those_of_the_plain_version():
    r = random.Random(1)
    for _ in range(800):
        texts = [made(r) for _ in range(r.randint(1, 4))]
        found = runs.runs_of(texts)
        assert found == [plain_runs(w) for w in texts]
        assert [runs.collapsed(w, f) for w, f in zip(texts, found)] == [plain_collapsed(w, f) for w, f in zip(texts, found)]


def test_edges(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t ", "one", "word " * 3000, "a b c " * 2000 + "d", "é x \x0b\x0c" * 40, "x" * 400_000 + " y" * 12, *(b" ".join(made(r)).decode() for _ in range(100))]
    rows = [*enumerate(texts), (4, "z " * 50), (4, "z " * 50), (None, "q " * 30)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, runs string, n_words int")
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        f = plain_runs(w)
        want.append((d, len(w), [tuple(x) for x in f], plain_collapsed(w, f).decode()))
    got = [(x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in runs.periodic_runs(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["one word", "three words", "words of their own on the left", "nested"])
def test_long_texts_take_no_quadratic_time(kind):
    if kind == "nested":
        x, y = b"a", b"ab"
        while len(y) < 60_000:
            x, y = y, y + x
        w = [bytes([c]) for c in y]
    else:
        own = [v for i in range(20_000) for v in (b"u%d" % i, b"a", b"b", b"c", b"d", b"e", b"f")]
        w = {"one word": [b"a"] * 150_000, "three words": [b"a", b"b", b"c"] * 50_000, "words of their own on the left": own}[kind]
    began = time.time()
    found = runs.runs_of([w])[0]
    assert time.time() - began < 30
    if kind != "nested":
        assert found == {"one word": [(0, 150_000, 1)], "three words": [(0, 150_000, 3)]}.get(kind, [])
    else:
        assert sum(n / q for _, n, q in found) < 3 * len(w) and all(w[s : s + n - q] == w[s + q : s + n] for s, n, q in found[::50])
