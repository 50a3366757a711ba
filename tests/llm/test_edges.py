"""Names that clash, long texts, hot groups and whole queries against plain versions."""

import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import brute
from tideway.llm import arrow_files, common, decontaminate, html, licences, packing, quality, repeats, secrets, simhash, url_filters

SF = "/root/testdata/sf0.001"
CLASHES = "`a.b` string, _text string, words string, row string, rank int, shares int, _path string, names string, id long, key string, digest string, `at` int"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows whose other columns have names that the operators might use themselves."""
    text = "a password = 'hunter2!x' stands in this text of more than ten plain words, as one can see"
    rows = [(i, t, *["z"] * 4, 1, 2, "p", "n", 3, "k", "d", 4) for i, t in ((1, text), (2, None), (None, "x"), (1, "x"))]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}")


def test_other_columns_stay(spark, odd):
    assert quality.measure(odd).columns == [*odd.columns, *quality.MEASURES] and quality.measure(odd).count() == 4
    assert [r["a.b"] for r in quality.accepted(spark, odd, SF).collect()] == ["z"]
    assert simhash.keep_representatives(spark, odd, SF).columns == odd.columns
    assert decontaminate.uncontaminated(spark, odd, SF).columns == odd.columns and decontaminate.uncontaminated(spark, odd, SF).count() == 4
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and {r.text for r in out.collect()} == {"x", None, "a password = '[SECRET]' stands in this text of more than ten plain words, as one can see"}
    assert packing.pack_documents(spark, odd, SF).count() == 4
    cut = packing.pieces(odd, public_tokenizers.path("word_bpe_49k.json")).selectExpr("*", "1 as rank", "2 as shares", "3 as `a.b`", "4 as sequence_id", "5 as row")
    assert packing.packed(common.written(cut, "t")).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "shares", "a.b", "row", "sequence_id", "offset"]
    assert licences.scan(odd, licences.known_table(spark)).count() == 4 and repeats.without_repeats(odd).count() == 4
    pages = odd.selectExpr("doc_id as page_id", "'http://blog.example.org./x' as url", "timestamp_ntz'2024-06-01' as fetched_at", "*")
    judged = url_filters.judged(pages, url_filters.entries_table(spark))
    assert judged.columns == [*pages.columns, "host", "entries", "n_active", "blocked"]
    assert {(r.host, r.entries, r["a.b"]) for r in judged.collect()} == {("blog.example.org", "legal:blog.example.org", "z")}


def test_query_op1(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r.doc_id: brute.fingerprint(r.text) for r in docs}
    least = brute.classes(prints)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(spark, SF).collect()}
    assert out == {d: (f"{p:016x}", least[d]) for d, p in prints.items()}


def test_query_op4(spark):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want, at = [], 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, arrow_files.op4_token_id_output(spark, SF).collect())) == want


def test_query_op8(spark):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    cut = brute.pieces(docs, lambda t: encode(t, add_special_tokens=False).ids, 2048)
    want = {k: (s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for k, (s, n, ids) in cut.items()}
    out = packing.op8_best_fit_packing(spark, SF).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want and len(out) == len(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    lengths = sorted((n for _, n, _ in cut.values()), reverse=True)
    bins = []  # first fit, longest first
    for n in lengths:
        for i, room in enumerate(bins):
            if n <= room:
                bins[i] -= n
                break
        else:
            bins.append(2048 - n)
    assert -(-sum(lengths) // 2048) <= out.sequence_id.nunique() <= len(bins)


def test_long_texts_repeat(spark):
    r = random.Random(7)
    part = lambda n: "".join(r.choices("abcdefgh é\n", k=n))
    shared, long = part(900), part(700_000)
    docs = [(1, long[:300_000] + shared + long[300_000:]), (2, shared + part(50)), (3, long[261_000:263_000]), (4, "ab" * 200_000), (5, part(300))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, repeats.without_repeats(df).drop("spans").collect())) == sorted(brute.repeats(docs))
    assert all(len(t.encode()) > repeats.CHUNK for _, t in (docs[0], docs[3]))


def test_one_trigger_in_every_document(spark):
    r = random.Random(8)
    line = "a notice of some length that stands in each and every document of this corpus, word for word, and that is followed by something else each time, as it were; "
    docs = [(i, "".join(r.choices("xyz ", k=80)) + line + "".join(r.choices("uvw ", k=80)) + (line * 2 if i % 50 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.repeats(docs))
    for wide in (4000, 50):
        assert sorted(map(tuple, repeats.without_repeats(df, wide).drop("spans").collect())) == want


def test_alignment():
    r = random.Random(9)
    for step in (1, 3, 256):
        for _ in range(60):
            a, b = ([r.randint(0, k) for _ in range(r.randint(0, 40))] for k in (3, 4))
            found = html.common_lines(a, b, step)
            assert len(found) == brute.common_length(a, b) and found == sorted(set(found))
            at = 0
            for x in (a[i] for i in found):
                at = b.index(x, at) + 1
    began = time.time()
    assert len(html.common_lines([1, 2] * 4000, [2, 1, 3] * 4000)) >= 8000 - 1
    assert time.time() - began < 20


def test_deep_pages():
    began = time.time()
    assert html.lines_of("<div><p>" * 30_000 + "x" + "</p></p></div>" * 30_000 + "<p>y</p>") == [("x", 0), ("y", 0)]
    assert html.lines_of("<b>" + "<div>" * 20_000 + "</b>" * 20_000 + "z")[0][0] == "z"
    assert time.time() - began < 20


def test_difference_of_whole_tables(spark):
    """Pages without a marked article: what both neighbours share goes, on every page of the table."""
    body = lambda i: f"<html><body><div>My site</div><div>All pages</div><p>Own words number {i}</p><p>and more of {i * 7}</p><div>Bye</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/a/{i // 3:03}", body(i)) for i in range(300)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert out == {i: f"Own words number {i}\nand more of {i * 7}" for i in range(300)}


def test_difference_of_marked_pages(spark):
    """Differencing holds every page against its nearest: template inside a main element or in articles of its own goes, article text that pages share stays."""
    crumbs, more = "<p>Home</p><p>Blog</p>", "<p>Read on</p><p>Print</p>"
    text = lambda i: f"<h2>Notes</h2><p>Own words number {i}</p><p>Examples</p><p>and more of {i * 7}</p><p>last {i}</p><p>end {i * 3}</p>"
    plain = lambda i: [f"Own words number {i}", "Examples", f"and more of {i * 7}", f"last {i}", f"end {i * 3}"]
    data, want = [], {}

    def page(host, i, body, lines):
        data.append((len(data), f"http://{host}.org/a/{i:03}", f"<body>{body}</body>"))
        want[len(data) - 1] = "\n".join(lines)

    for i in range(40):
        page("main", i, f"<main>{crumbs}{text(i).replace('<h2>Notes</h2>', '')}{more}</main>", plain(i))
        page("cards", i, f"<article><p>Hot offers</p><p>Buy two</p></article><article>{text(i).replace('Examples', f'part {i}').replace('Notes', f'note {i}')}</article><article>Imprint</article>", [f"note {i}", *(x.replace("Examples", f"part {i}") for x in plain(i))])
        # articles stay whole: shared heads, copies, versions that differ in one line
        page("heads", i, f"<article>{text(i)}</article>", ["Notes", *plain(i)])
        page("copies", i, f"<main>{text(1)}</main>", ["Notes", *plain(1)])
        page("versions", i, f"<main>{text(1)}<p>Edit {i}</p></main>", ["Notes", *plain(1), f"Edit {i}"])
        page("open-copies", i, f"<div>{text(1)}</div>", ["Notes", *plain(1)])
    # too few pages to tell
    for i in range(3):
        page("few", i, f"<main>{crumbs}{text(i)}</main>", ["Home", "Blog", "Notes", *plain(i)])
    # an archive of whole articles beside their own pages
    for i in range(1, 6):
        page("archive", i, f"<article>{text(i)}</article>", ["Notes", *plain(i)])
    page("archive", 0, "".join(f"<article>{text(i)}</article>" for i in range(1, 4)), [x for i in range(1, 4) for x in ["Notes", *plain(i)]])
    out = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)).collect()}
    assert out == want


def test_known_licences(spark, tmp_path):
    known = licences.known_table(spark)
    texts = [(n, "Copyright 2021, A. Author\n\n" + t.replace(" ", "  ").upper()) for n, (_, _, t) in enumerate(licences.KNOWN)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licences.scan(df, known).collect()} == {n: k[0] for n, k in enumerate(licences.KNOWN)}
    assert len({k[0] for k in licences.KNOWN}) > 30
    (tmp_path / "Own-1.0.txt").write_text("My own licence: do as you please.\nSecond line.")
    more = known.union(licences.from_folder(spark, str(tmp_path)))
    own = spark.createDataFrame([(1, "MY OWN LICENSE, do as you please second line")], "doc_id long, text string")
    assert licences.scan(own, more).first().licence == "Own-1.0"
    shipped = Path("/usr/share/common-licenses")
    if shipped.exists():
        whole = spark.createDataFrame([(1, (shipped / "GPL-3").read_text(errors="replace")), (2, (shipped / "Apache-2.0").read_text(errors="replace"))], "doc_id long, text string")
        found = {r.doc_id: r.licence for r in licences.scan(whole, licences.from_folder(spark, str(shipped))).collect()}
        assert found[1].startswith("GPL") and found[2] == "Apache-2.0"


def test_entries_of_a_large_platform(spark):
    """Very many entries with paths under one name, and most captures on it."""
    entries = spark.range(3000).selectExpr("'l' as list", "'big.example' as host", "'/u' || id as prefix", "'add' as action", "timestamp_ntz'2024-01-01' as at")
    pages = spark.range(5000).selectExpr("id as page_id", "'http://s' || (id % 7) || '.big.example/u' || (id % 4000) || '/x' as url", "timestamp_ntz'2024-02-01' as fetched_at")
    out = url_filters.judged(pages, entries)
    prefixes = {f"/u{i}" for i in range(3000)}
    want = {i: sum(f"/u{i % 4000}/x".startswith(p) for p in {f"/u{i % 4000}"[:k] for k in range(3, 8)} & prefixes) for i in range(5000)}
    assert {r.page_id: r.n_active for r in out.collect()} == want


def test_skewed_joins(spark):
    big = common.written(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) as k"), "big")
    small = spark.range(3000).selectExpr("id as k", "id * 2 as v")
    for hot in (10, 100_000):
        out = common.joined(big, small, "k", hot)
        assert out.count() == 3000 and out.where("k * 2 <> v").count() == 0 and out.where("k = 7").count() == 1001


def plain_lines(page):
    """Lines of a page by the standard parser, without any choice of what is main text: blocks end lines, raw elements hold none."""
    from html.parser import HTMLParser

    class Lines(HTMLParser):
        CDATA_CONTENT_ELEMENTS = ("script", "style")

        def __init__(self):
            super().__init__()
            self.out, self.held, self.raw = [], [], 0

        def flush(self):
            if line := " ".join("".join(self.held).split()):
                self.out.append(line)
            self.held = []

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style")
            if tag in html.BLOCKS:
                self.flush()

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style")
            if tag in html.BLOCKS:
                self.flush()

        def handle_data(self, data):
            if not self.raw:
                self.held.append(data)

    parser = Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.out


SCRIPTS = ["<!-- hide ", 'var s="<!--";', "a{content:\"<p '\"}", "if (a<b && c>d) x='<div class=\"'", "// it's", "document.write('<p>no</p>')", "", "a\n<b", "</scrip", "<!doctype '", "x = `<a href=\"`"]


def test_scripts_and_styles_hold_no_markup():
    r = random.Random(5)
    for _ in range(400):
        parts, want = [], 0
        for k in range(r.randint(1, 6)):
            tag = r.choice(["script", "style", "SCRIPT"])
            parts.append(r.choice(["", f"<{tag} type='x'>{r.choice(SCRIPTS)}</{tag}{r.choice(['', ' '])}>"]))
            parts.append(r.choice([f"<p>one's <b>word</b> {k}</p>", f"<div>line {k} &amp; more</div>", f"text {k} 5 &lt; 6"]))
        page = "<body>" + "".join(parts) + "</body>"
        assert [x for x, _ in html.lines_of(page)] == plain_lines(page), page
    for body in ("<script><!-- hide </script>", "<style>a{content:\"<p '\"}</style>", "<script>var s='<!--';</script>"):
        page = f"<body>{body}<article><p>Hello <b>world</b></p><p>two's</p></article></body>"
        assert [x for x, _ in html.lines_of(page)] == ["Hello world", "two's"]
    assert html.lines_of("<script>a</script x='1'><p>b</p>") == [("b", 0)]
    assert html.lines_of("<p>a</p><script>var x = '<p>b</p>'") == [("a", 0)]
    began = time.time()
    assert len(html.lines_of("<script><!-- '</script><p>x</p>" * 30_000)) == 30_000
    assert time.time() - began < 20


def test_equal_pieces_are_dealt_to_many_shares(spark):
    rows = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "1L as length", "5L as ids_crc32")
    cut = common.written(rows.withColumn(packing.ROW, F.monotonically_increasing_id()), "equal")
    out = packing.packed(cut, share_rows=1000)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.toPandas()
    assert len(got) == 30_000 and not got.duplicated(["sequence_id", "offset"]).any() and got.sequence_id.nunique() == -(-30_000 // 2048)


def test_entries_without_a_list(spark):
    entries = spark.createDataFrame([(None, "x.org", None, "add", "2024-01-01"), ("l", None, "", "add", "2024-01-01"), ("l", "x.org", "", "add", None)], "list string, host string, prefix string, action string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    pages = spark.createDataFrame([(1, "http://x.org/a", "2024-02-01")], "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp_ntz("fetched_at"))
    assert [r.entries for r in url_filters.judged(pages, entries).collect()] == [":x.org"]
