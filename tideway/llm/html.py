"""Main text of web pages: markup cuts a page into zones, differencing with the nearest pages tells template from text in each.

A page is cut into lines, one for each block. Lines inside menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and hidden elements go. If the page marks its article (article, main or the like), the lines inside
are its text, otherwise all lines left are (the page is open). Every page is then held against its nearest: pages of a
zone are ordered by host, path and page_id, and their lines are aligned by longest common subsequence with those of the
three pages on either side on the host, those with longer common paths first. A page with the very same lines says
nothing about templates and is passed over. What goes depends on what markup has settled:

- open pages: every line that the nearest page has too;
- pages with a main element only: lines before the first and behind the last line of their own, where the nearest four (or
  all three that there are) have them; if that were over half of its lines, these pages are versions of it, and all stay;
- pages with a marked article: articles that the nearest four (or all three) have whole (cards, notices), where another
  article of the page shares no line with any of them. The lines of an article that stays are never cut, as pages of one site
  may well share whole articles.

Neighbours are found by global rank in a range-sorted table, so the pairs don't depend on partitions and a host with
a third of all pages is spread over many tasks; only line hashes go to the block of ranks where a page meets its neighbours.

Nulls: a null or empty html has the empty text; a null url belongs to the host ''. Repeated rows are taken each for
itself. If two pages share a prefix of one length, the closer one comes first, then the one before. Long pages are read
whole; the alignment takes memory for a fraction of len(a) * len(b) bits only. Other columns aren't read, whatever
their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

_MARKUP = re.compile(r"""<!--[\s\S]*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)|</?\Z""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose text never shows, elements that aren't main text, blocks, and elements without an end.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BOILERPLATE = frozenset("nav footer aside form button select dialog svg object head canvas audio video menu".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre br hr header figure figcaption address details summary fieldset legend center option".split()) | BOILERPLATE
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div table tr td th ul ol dl header figure blockquote details fieldset".split()) | BOILERPLATE
#: Words of class, id and role that name something other than main text.
NAMED = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments disqus reply replies respond footer pagination pager widget toolbar toc skip contentinfo complementary".split())
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ARTICLE, MAIN, OPEN = 2, 1, 0
#: Pages on either side that may be near, near pages that must agree about a marked page, and pages of a block that is looked at in one go.
NEAR, WITNESSES, BLOCK = 3, 4, 1024


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(text):
        out.setdefault(k.lower(), entities.unescape(v.strip("\"'")))
    return out


def _is_boilerplate(tag: str, a: dict[str, str], inside: int) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not a or tag in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"):
        return True
    words = set(re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return bool(words & NAMED) or (not inside and "header" in words)


def blocks_of(page: str | None) -> list[tuple[str, int, int]]:
    """(line, zone, box) of each block of the page that isn't boilerplate; zone tells the marked container that it is in, if any, and box numbers the outermost such container."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, and whether text in it drops, its zone and its box, those around it included
    where: dict[str, list[int]] = {}  # the places of open elements in the stack, by name
    boxes: list[int] = []  # those of containers
    drop, zone, box, n_boxes = False, OPEN, 0, 0

    def close(deep: int) -> None:
        nonlocal drop, zone, box
        left = stack[deep - 1][1:] if deep else (False, OPEN, 0)
        if left != (drop, zone, box):
            flush()
        for name, *_ in reversed(stack[deep:]):
            where[name].pop()
            if name in CONTAINERS:
                boxes.pop()
        del stack[deep:]
        drop, zone, box = left

    def flush() -> None:
        if held:
            line = " ".join("".join(held).split())
            if line and not drop:
                out.append((line, zone, box))
            held.clear()

    at, text, raw = 0, page or "", ""
    # each search begins where the last element ended: what scripts and the like hold is never markup
    while m := _MARKUP.search(text, at):
        if m.start() > at and not drop:
            held.append(entities.unescape(text[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                flush()
            deep = where[tag][-1] if where.get(tag) else -1
            if tag in BLOCKS:
                flush()
            if deep >= 0 and (tag in CONTAINERS or not boxes or boxes[-1] <= deep):
                close(deep)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*)?>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if closes := IMPLIED.get(tag):
            while stack and stack[-1][0] in closes:
                close(len(stack) - 1)
        if tag in BLOCKS or m[3].strip():
            a = _attributes(m[3]) if m[3].strip() else {}
            bad = _is_boilerplate(tag, a, zone)
            mark = ARTICLE if tag == "article" or a.get("itemprop") == "articleBody" or a.get("role") == "article" else MAIN if tag == "main" or a.get("role") == "main" else OPEN
            if bad and not drop or mark > zone:
                flush()
            where.setdefault(tag, []).append(len(stack))
            if tag in CONTAINERS:
                boxes.append(len(stack))
            if mark > zone:
                n_boxes += 1
                zone, box = mark, n_boxes
            drop = drop or bad
            stack.append((tag, drop, zone, box))
    if at < len(text) and not drop:
        held.append(entities.unescape(text[at:]))
    flush()
    best = max((z for _, z, _ in out), default=OPEN)
    return [x for x in out if x[1] == best]


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, zone) of each block of blocks_of()."""
    return [(x, z) for x, z, _ in blocks_of(page)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks_of(h.as_py()) for h in batch.column(2)]
        columns = [pa.array([[x for x, *_ in f] for f in found], pa.list_(pa.string())), pa.array([f[0][1] if f else OPEN for f in found], pa.int32()), pa.array([[x for *_, x in f] for f in found], pa.list_(pa.int32()))]
        yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "lines", "zone", "boxes"])


def lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, lines, zone, boxes, row): the lines that markup leaves, the page's zone, the container of each line, and a number of the row once this is written."""
    few = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return few.mapInArrow(_parse, "page_id long, url string, lines array<string>, zone int, boxes array<int>").withColumn("row", F.monotonically_increasing_id())


def _rows(a: list[int], places: dict[int, int], state: int, mask: int) -> list[int]:
    """Bit rows of the alignment of lines a, one behind the other: bit j of a row is 0 where the longest common subsequence grows at line j."""
    out = []
    for x in a:
        hit = state & places.get(x, 0)
        state = ((state + hit) | (state - hit)) & mask
        out.append(state)
    return out


def common_lines(a: list[int], b: list[int], step: int = 256) -> list[int]:
    """The places in a of a longest common subsequence of a and b.

    A row of bits stands for each line of a; every step-th row is kept and the others are made again on the way back, so
    time grows with len(a) * len(b) / 64 and memory with len(b) * (len(a) / step + step) bits, however often lines repeat.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    own, other = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, int] = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    mask = (1 << len(other)) - 1
    kept, state = [mask], mask  # the state before rows 0, step, 2 * step ...
    for i in range(0, len(own), step):
        state = _rows(own[i : i + step], places, state, mask)[-1]
        kept.append(state)
    middle, j = [], len(other)
    for block in range(len(kept) - 2, -1, -1):
        rows = [kept[block], *_rows(own[block * step : (block + 1) * step], places, kept[block], mask)]
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    middle.append(head + block * step + i)
                    j -= 1
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.record_batch([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(n, n + batch.num_rows), pa.int64())], names=[*batch.schema.names, "part", "at"])
        n += batch.num_rows


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def template_lines(zone: int, own: list[int], boxes: list[int], near: list[list[int]]) -> list[int]:
    """The places of lines (hashes `own`) that differencing takes away, given the lines of near pages of the host, nearest first."""
    witnesses = [x for x in near if x != own]
    if zone == OPEN:
        return common_lines(own, witnesses[0]) if witnesses else []
    if len(witnesses) < 3:
        return []
    shared = [set(common_lines(own, x)) for x in witnesses[:WITNESSES]]
    everywhere, somewhere = set.intersection(*shared), set.union(*shared)
    if zone == MAIN:
        rest = [i for i in range(len(own)) if i not in everywhere]
        out = [*range(rest[0]), *range(rest[-1] + 1, len(own))] if rest else []
        return out if 2 * len(out) <= len(own) else []
    if set(boxes) == {boxes[i] for i in somewhere}:
        return []
    kept = {b for i, b in enumerate(boxes) if i not in everywhere}
    return [i for i, b in enumerate(boxes) if b not in kept]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bool]]]:
    """(row, whether each line stays) of pages that lose lines, from pages in order of block and rank."""
    for _, pages in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["block"]):
        window: deque = deque([None] * (2 * NEAR + 1), maxlen=2 * NEAR + 1)
        for r in chain(pages, [None] * NEAR):
            window.append(r)
            page = window[NEAR]
            if page is None or page["rank"] // BLOCK != page["block"]:
                continue
            others = [x for x in window if x and x is not page and (x["zone"], x["host"]) == (page["zone"], page["host"])]
            others.sort(key=lambda x: (-_prefix(x["path"], page["path"]), abs(x["rank"] - page["rank"]), x["rank"]))  # noqa: B023
            gone = set(template_lines(page["zone"], page["hashes"], page["boxes"], [x["hashes"] for x in others]))
            if gone:
                yield page["row"], [i not in gone for i in range(len(page["hashes"]))]


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _kept(batches)
    while some := list(islice(found, 256)):
        yield pa.record_batch([pa.array([r for r, _ in some], pa.int64()), pa.array([k for _, k in some], pa.list_(pa.bool_()))], names=["row", "keep"])


def differenced(found: DataFrame) -> DataFrame:
    """(row, keep): whether each line stays, for pages of written lines() that lose any by differencing with their nearest."""
    address = F.lower(F.coalesce("url", F.lit("")))
    host, path = (F.regexp_extract(address, p, 1) for p in (r"^[a-z][a-z0-9+.-]*://([^/?#]*)", r"^[a-z][a-z0-9+.-]*://[^/?#]*(.*)$"))
    keyed = found.where("size(lines) > 0").select("row", "page_id", "zone", host.alias("host"), path.alias("path"), F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), "boxes")
    order = ["zone", "host", "path", "page_id", F.xxhash64("hashes"), "row"]
    schema = "row long, page_id long, zone int, host string, path string, hashes array<long>, boxes array<int>, part int, at long"
    placed = common.written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, schema), "page-order")
    before, bases = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        bases.append((part, before))
        before += n
    # one row a partition
    ranked = placed.join(F.broadcast(found.sparkSession.createDataFrame(bases, "part int, base long")), "part").withColumn("rank", F.col("base") + F.col("at"))
    # a page goes to its block of ranks, and to the next one if it is near its end
    blocks = F.array_distinct(F.transform(F.array(F.lit(-NEAR), F.lit(NEAR)), lambda d: F.floor((F.col("rank") + d) / BLOCK)))
    sent = ranked.select("row", "rank", "zone", "host", "path", "hashes", "boxes", F.explode(blocks).alias("block"))
    near = sent.repartition("block").sortWithinPartitions("block", "rank")
    out = common.written(near.mapInArrow(_differ, "row long, keep array<boolean>"), "page-drops")
    common.release(placed)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = common.written(lines(pages), "page-lines")
    shorter, own = differenced(found), F.col("lines")
    kept = found
    if not shorter.isEmpty():
        kept = found.join(shorter, "row", "left")
        own = F.filter("lines", lambda x, i: F.coalesce(F.get("keep", i), F.lit(True)))
    return kept.select("page_id", "url", F.array_join(own, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
