"""URL filters as a temporal list join.

Dated list entries (added or removed on a day) become validity intervals. Three equi-joins bring captures and intervals
together: each distinct host meets those of its own name and its parent domains that have entries; a capture of such a
host is cut to the path prefix lengths that occur under that name; and (name, prefix) meets the interval list of exactly
that entry, of which those that hold at the fetch time count: an as-of join. So a capture never scans the other entries of
its host, and captures of hosts without entries are in none of the later joins. Names and entries that very many
captures share are looked up in a broadcast table of such keys alone, whose size is bounded (see common.joined).

Nulls: a null, empty or unparsable url has the host '' and no entries; a null fetch time matches no entry. A dot behind a
host is dropped. An entry that is added twice stays one interval; an entry without a list belongs to the list ''; one without host or time is no entry; a removal without an addition before it does nothing. Of
entries dated at one instant the removal comes first. Repeated captures are returned as often as they come; urls of any
length are read whole; other columns stay as they are, whatever their names, but those with the names of results (host,
entries, n_active, blocked) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideway.llm import common

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: The dated list of the query: (list, host, path prefix, action, time).
ENTRIES = (
    ("spam", "spam-farm.example.org", "", "add", "2024-01-10 00:00:00"),
    ("spam", "spam-farm.example.org", "", "remove", "2024-05-01 00:00:00"),
    ("spam", "spam-farm.example.org", "", "add", "2024-07-15 12:00:00"),
    ("spam", "cheap-pills.example.com", "", "add", "2024-03-01 00:00:00"),
    ("spam", "cheap-pills.example.com", "", "add", "2024-04-01 00:00:00"),
    ("spam", "cheap-pills.example.com", "", "remove", "2024-11-01 00:00:00"),
    ("language", "example.net", "/es/", "add", "2024-02-01 00:00:00"),
    ("language", "example.net", "/es/", "remove", "2024-09-01 00:00:00"),
    ("legal", "blog.example.org", "", "add", "2024-01-01 00:00:00"),
    ("legal", "example.org", "/fr/4", "add", "2024-06-01 00:00:00"),
)
FETCHED = "timestamp '2024-01-01 06:00:00' + make_interval(0, 0, 0, cast(page_id % 366 as int))"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, host, prefix, since, until): validity intervals [since, until) of entries(list, host, prefix, action, at); until is null while an entry holds."""
    one = ["list", "host", "prefix"]
    w = Window.partitionBy(*one).orderBy("at", F.col("action").desc())
    cleaned = entries.where("at is not null and host is not null").select(F.coalesce("list", F.lit("")).alias("list"), F.lower("host").alias("host"), F.coalesce("prefix", F.lit("")).alias("prefix"), "action", "at").distinct()
    changes = cleaned.withColumn("before", F.lag("action").over(w)).where("action <> coalesce(before, 'remove')")
    return changes.withColumn("until", F.lead("at").over(w)).where("action = 'add'").select(*one, F.col("at").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched_at, ...) with host, entries (active ones, 'list:host/prefix' sorted, comma-joined), n_active and blocked."""
    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in captures.columns if c not in ("host", "entries", "n_active", "blocked")]
    host = F.regexp_replace(F.lower(F.regexp_extract(address, HOST, 1)), r"\.$", "")
    rows = captures.select(F.struct(*kept).alias("row"), host.alias("host"), F.regexp_extract(address, PATH, 1).alias("path"), F.col("fetched_at").alias("at"), F.monotonically_increasing_id().alias("id"))
    rows = common.written(rows, "captures")
    # one row an entry: its intervals; one row a name: the lengths of its entries' prefixes
    valid = intervals(entries).groupBy("host", "prefix").agg(F.collect_list(F.struct("list", "since", "until")).alias("of"))
    valid = common.checkpointed(valid.select(F.struct(F.col("host").alias("name"), "prefix").alias("entry"), "of"))
    lengths = valid.groupBy(F.col("entry.name").alias("name")).agg(F.sort_array(F.collect_set(F.length("entry.prefix"))).alias("lengths"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct()
    named = hosts.select("host", F.explode(parents).alias("name")).join(lengths, "name").groupBy("host").agg(F.collect_list(F.struct("name", "lengths")).alias("names"))
    met = common.joined(rows.select("id", "host", "path", "at"), named, "host").select("id", "path", "at", F.explode("names").alias("n"))
    met = met.select("id", "at", "path", "n.name", F.explode("n.lengths").alias("size")).where(F.length("path") >= F.col("size"))
    met = common.written(met.select("id", "at", F.struct("name", F.expr("substring(path, 1, size)").alias("prefix")).alias("entry")), "captured-entries")
    active = F.filter("of", lambda e: (e["since"] <= F.col("at")) & (e["until"].isNull() | (F.col("at") < e["until"])))
    hit = common.joined(met, valid, "entry").select("id", "entry", F.explode(active).alias("e"))
    name = F.concat("e.list", F.lit(":"), "entry.name", "entry.prefix")
    found = hit.groupBy("id").agg(F.array_sort(F.collect_set(name)).alias("names"))
    out = rows.join(found, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return out.select("row.*", "host", F.array_join("names", ",").alias("entries"), F.size("names").cast("long").alias("n_active"), (F.size("names") > 0).alias("blocked"))


def entries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "list string, host string, prefix string, action string, at string").withColumn("at", F.to_timestamp_ntz("at"))


def seen_entries(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the pages: two fifths of their (host, first path segment) pairs are added on a day that a digest gives, half of these removed sixty days later."""
    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(address, HOST, 1)), r"\.$", "")
    pairs = pages.select(host.alias("host"), F.regexp_extract(F.regexp_extract(address, PATH, 1), "^/[^/]*", 0).alias("prefix")).where("host <> ''").distinct()
    dated = pairs.withColumn("h", F.expr("cast(conv(substr(md5(concat(host, prefix)), 1, 4), 16, 10) as int)")).where("h % 5 < 2")
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(h % 366)")
    row = lambda df, action, at: df.select(F.lit("seen").alias("list"), "host", "prefix", F.lit(action).alias("action"), at.alias("at"))
    return row(dated, "add", day).union(row(dated.where("h % 5 = 1"), "remove", day + F.expr("interval 60 days")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(FETCHED).cast("timestamp_ntz").alias("fetched_at"))
    return judged(captures, entries_table(spark).union(seen_entries(pages)))


def _oracle() -> str:
    values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)
    return f"""
WITH pairs AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '\\.$', '') AS host, regexp_extract(regexp_extract(coalesce(url, ''), '{PATH}', 1), '^/[^/]*') AS prefix FROM pages),
dated AS (SELECT host, prefix, ('0x' || substr(md5(host || prefix), 1, 4))::UINTEGER::INT AS h FROM pairs WHERE host <> ''),
e(list, host, prefix, action, moment) AS (SELECT * FROM (VALUES {values}) UNION ALL SELECT 'seen', host, prefix, 'add', TIMESTAMP '2024-01-01' + to_days(h % 366) FROM dated WHERE h % 5 < 2
  UNION ALL SELECT 'seen', host, prefix, 'remove', TIMESTAMP '2024-01-01' + to_days(h % 366 + 60) FROM dated WHERE h % 5 = 1),
c AS (SELECT *, lag(action) OVER (PARTITION BY list, host, prefix ORDER BY moment, action DESC) AS before FROM e),
k AS (SELECT * FROM c WHERE action <> coalesce(before, 'remove')),
v AS (SELECT list, host, prefix, action, moment AS since, lead(moment) OVER (PARTITION BY list, host, prefix ORDER BY moment) AS until FROM k),
i AS (SELECT * FROM v WHERE action = 'add'),
p AS (SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01 06:00:00' + to_days((page_id % 366)::INT) AS fetched_at,
  regexp_replace(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '\\.$', '') AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
m AS (SELECT p.r, string_agg(DISTINCT i.list || ':' || i.host || i.prefix, ',' ORDER BY i.list || ':' || i.host || i.prefix) AS entries,
  count(DISTINCT i.list || ':' || i.host || i.prefix) AS n FROM p JOIN i ON (p.host = i.host OR ends_with(p.host, '.' || i.host))
  AND starts_with(p.path, i.prefix) AND i.since <= p.fetched_at AND (i.until IS NULL OR p.fetched_at < i.until) GROUP BY p.r)
SELECT page_id, url, fetched_at, host, coalesce(entries, '') AS entries, coalesce(n, 0)::BIGINT AS n_active, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN m ON m.r = p.r
"""


ORACLE = _oracle()
