import hashlib
import random
import re

import numpy as np
from tideway.llm import middles

TEXTS = ["", None, "a", "<P> stays", "ab cd  éü😀 x\n", "word " * 3000, "é" * 5000, "😀a" * 4000, "x" * 3_000_000, "ab\x00c", "<M", "S>", "日本語のテキスト。ascii between 日本" * 50, "Zeile\r\n\tEnde", "ſK"]


def plain_version(doc_id, text, rate=90, spm=20):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, None, t
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), len(pre.encode()), len(mid.encode()), out


def test_edges(spark):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(7, "ab cd"), (7, "ab cd"), (None, "one two"), (None, None)]
    rows += [(100 + i, "".join(r.choices("aZ é😀<PSM>\n", k=r.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, output string, n int")
    found = middles.fill_in_middle(df).withColumn("back", middles.restored())
    assert sorted((tuple(x) for x in found.collect()), key=repr) == sorted(((d, *plain_version(d, t), t or "") for d, t in rows), key=repr)
    every = middles.fill_in_middle(df, rate=100, spm=50)
    assert sorted((tuple(x) for x in every.collect()), key=repr) == sorted(((d, *plain_version(d, t, 100, 50)) for d, t in rows), key=repr)


def test_empty_table(spark):
    out = middles.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "n", "form"]


def test_exceptions_convert_both_ways(monkeypatch):
    monkeypatch.setattr(middles, "_BLOCK", 7)
    r = random.Random(2)
    for _ in range(50):
        t = "".join(r.choices("ab é日😀", k=r.randint(0, 80)))
        data = np.frombuffer(t.encode(), np.uint8)
        index = middles.Exceptions(data)
        chars = np.arange(len(t) + 1)
        byte = np.array([len(t[:k].encode()) for k in chars])
        assert (index.byte_of(chars) == byte).all() and (index.char_of(byte) == chars).all()
        assert len(index.chars) == sum(ord(c) > 127 for c in t)
        want = np.cumsum([0, *(len(u.encode()) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", t))])[:-1]
        assert (middles.unit_starts(data, np.array([0, len(data)])) == (want if t else [])).all()
