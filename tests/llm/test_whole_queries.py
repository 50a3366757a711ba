"""Registered queries without SQL against plain versions over whole tables."""

import math
import random
import re
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tideway.llm import html, licences, secrets

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """A tree by the standard parser; main text is what stands in the article and under nothing that names itself otherwise."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.held, self.marked = [], [], [], []

    def flush(self):
        if line := " ".join("".join(self.held).split()):
            if not any(bad for _, bad, _ in self.open):
                self.marked.append((line, any(mark for *_, mark in self.open)))
        self.held = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in html.BLOCKS:
            self.flush()
        if tag in html.VOID:
            return
        inside = any(mark for *_, mark in self.open)
        words = set(re.split(r"[\s_-]+", (a.get("class", "") + " " + a.get("id", "")).lower()))
        named = tag not in ("html", "body", "main") and (bool(words & html.NAMED) or ("header" in words and not inside) or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "") or a.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"))
        bad = tag in html.BOILERPLATE or tag in html.RAW or (tag == "header" and not inside) or named
        self.open.append((tag, bad, tag == "article" or a.get("role") == "article" or a.get("itemprop") == "articleBody"))

    def handle_endtag(self, tag):
        if tag in html.BLOCKS:
            self.flush()
        places = [i for i, (t, *_) in enumerate(self.open) if t == tag]
        if places:
            del self.open[places[-1] :]

    def handle_data(self, data):
        if not any(t in html.RAW for t, *_ in self.open):
            self.held.append(data)


def test_query_op6(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    out = {r.page_id: r for r in html.op6_html_extraction(spark, SF).collect()}
    assert len(out) == len(pages)
    for p in pages:
        parser = Plain()
        parser.feed(p.html or "")
        parser.close()
        parser.flush()
        best = [x for x, mark in parser.marked if mark] or [x for x, _ in parser.marked]
        assert out[p.page_id].text == "\n".join(best) and out[p.page_id].n_chars == len(out[p.page_id].text) and out[p.page_id].url == p.url


def plain_features(text, start, end):
    """The candidate's features, one plain loop each, in the order of secrets.NAMES."""
    s, before, after = text[start:end], text[max(0, start - 60) : start], text[end : end + 60]
    n, low = len(s), text[start:end].lower()
    of = lambda c: sum(x == c for x in s)
    part = lambda test: sum(map(test, s)) / n
    kinds = ["d" if c.isdigit() else "l" if c.isalpha() else "o" for c in low]
    pairs = {}
    for w in secrets.PARTS:
        for i in range(len(w) - 1):
            pairs[w[i : i + 2]] = pairs.get(w[i : i + 2], 0) + 1
    total = sum(pairs.values()) + 67.6
    steps = [math.log2((pairs[low[i : i + 2]] + 0.1) / total * 676) if low[i : i + 2] in pairs else -2.0 for i in range(len(low) - 1)]
    at = covered = 0
    words = sorted(secrets.PARTS, key=len, reverse=True)
    while at < len(low):
        hit = next((w for w in words if low.startswith(w, at)), None)
        covered += len(hit or "")
        at += len(hit or "x")
    longest = max(len(m[0]) for m in re.finditer(r"(?s)(.)\1*", s))
    near = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z_-]*", before)[-4:]]
    against = any(w in secrets.AGAINST or near[-1].startswith(w) for w in near)
    signs = sum(c in "/\\" for c in s) + 2 * (before[-1:] in ("/", "\\", ".", "@")) + (after[:1] in ("/", "\\", "@"))
    digits, upper, lower = part(str.isdigit), part(str.isupper), part(str.islower)
    return [
        math.log2(n), -sum(of(c) / n * math.log2(of(c) / n) for c in set(s)), digits, upper, lower, float(set(s) <= set("0123456789abcdefABCDEF-")), sum(kinds[i] != kinds[i + 1] for i in range(len(kinds) - 1)) / max(1, n - 1),
        sum(steps) / max(1, n - 1), covered / n, sum(of(c) + (of(c.upper()) if c.upper() != c else 0) for c in "aeiouäöüáéíóúàèêâ") / n, float(longest), len(set(s)) / min(n, 64), float(signs), float(any(s.startswith(p) for p in secrets.PREFIXES)),
        float(any(f in w for w in near for f in secrets.FOR)), float(against) + any(x in low for x in ("example", "placeholder", "your", "dummy", "changeme")), float(before[-1:] in tuple("'\"`")), float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        part(lambda c: not c.isalnum() and c not in "+/_-="), float((digits > 0) + (upper > 0) + (lower > 0) + any(not c.isalnum() for c in s)), float(after[:1] == "@" and before[-1:] == ":" and not before.endswith("mailto:")),
    ]


def plain_score(x, forest):
    total = 0.0
    for feature, cut, left, right, share in zip(*forest):
        node = 0
        while feature[node] >= 0:
            node = left[node] if x[feature[node]] <= cut[node] else right[node]
        total += share[node]
    return total / len(forest.share)


def test_query_op3(spark):
    forest, want = secrets.trained(), set()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in docs:
        text = d.text or ""
        spans = sorted(secrets.candidates(text))
        scored = [(a, b, round(plain_score(plain_features(text, a, b), forest), 6)) for a, b in spans]
        good, kept = [x for x in scored if x[2] >= 0.5], []
        while good:  # overlapping ones grow together
            a, b, s = good.pop(0)
            more = [x for x in good if x[0] < b and a < x[1]]
            if more:
                good = [x for x in good if x not in more]
                good.insert(0, (min(a, *(x[0] for x in more)), max(b, *(x[1] for x in more)), max(s, *(x[2] for x in more))))
            else:
                kept.append((a, b, s))
        for x in sorted((x for x in scored if x[2] < 0.5), key=lambda x: (x[1] - x[0], x)):
            if all(x[1] <= a or b <= x[0] for a, b, _ in kept):
                kept.append(x)
        want |= {(d.doc_id, a, b - a, s, s >= 0.5) for a, b, s in kept}
    got = {(r.doc_id, r.start, r.length, r.score, r.secret) for r in secrets.op3_secret_scans(spark, SF).select("doc_id", "start", "length", "score", "secret").collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(got) == len(want) > 20
    near = {x[:3]: x[3] for x in want}
    assert all(abs(near[x[:3]] - x[3]) < 1e-5 for x in got) and sum(x[4] for x in got) == sum(x[4] for x in want)


def test_very_long_texts_are_scanned_whole(spark):
    r = random.Random(1)
    token = "ghp_" + "".join(r.choices("abcdefXYZ0123456789", k=36))
    text = "some plain words that go on and on " * 60_000 + f"token = '{token}' " + "and on " * 10_000
    found = [x for x in secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() if x.secret]
    assert [text[x.start : x.start + x.length] for x in found] == [token]


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this machine")
def test_long_licences_are_known_by_their_digests(spark):
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    rows = []
    for f, n in names.items():
        t = Path(f"/usr/share/common-licenses/{f}").read_text()
        rows += [(n, t), (n, "Copyright (C) 2020 Somebody\n" + t.replace("license", "licence").replace("favor", "favour").replace("organization", "organisation").replace(" ", "  ").upper()), (None, t.replace("the", "a", 1) + " more")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.licence for r in licences.scan(df, licences.known_table(spark)).collect()}
    assert [found[i] for i in range(len(rows))] == [n for n, _ in rows]
    assert {r.licence for r in licences.scan(df, licences.known_table(spark), ()).collect()} == {None}
    spelled = spark.createDataFrame([("The organisation's licence fulfils its labour in the centre, non-commercial, whilst cancelled",), ("the organization's license fulfills its labor in the center noncommercial while canceled",)], "t string")
    assert len({r[0] for r in spelled.select(licences.canonical(F.col("t"))).collect()}) == 1
