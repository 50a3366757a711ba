"""Disjoint ranges of whole keys, of any number of columns and of any type that sorts.

Keys are compared column by column with nulls first, as Spark sorts them. The first range has no lower bound and the last
no upper one, so rows with null keys, and rows that come while ranges are in use, fall into exactly one of them.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.storage import checkpointed

#: A heavy range has more than so many times the mean.
HEAVY = 2.0


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class KeyRange:
    """Keys in (above, up_to] in the order of whole keys; None leaves a side open. n_rows and top are the rows and the greatest key when it was planned."""

    number: int
    key: tuple[str, ...]
    above: tuple | None = None
    up_to: tuple | None = None
    n_rows: int | None = None
    top: tuple | None = None

    def to_json(self) -> list:
        return [self.number, list(self.key), *[None if v is None else [encoded(x) for x in v] for v in (self.above, self.up_to, self.top)], self.n_rows]

    @staticmethod
    def from_json(text: list) -> KeyRange:
        above, up_to, top = (None if v is None else tuple(decoded(x) for x in v) for v in text[2:5])
        return KeyRange(text[0], tuple(text[1]), above, up_to, text[5], top)

    def where(self) -> Column:
        """The range as a filter; its bounds on the leading column stand by themselves too, where scans and indexes can use them."""
        return F.expr(self.predicate(quoted, literal))

    def predicate(self, quote: Callable[[str], str], write: Callable[[object], str]) -> str:
        """The range in SQL; quote and write give names and values as a database has them."""
        names = [quote(c) for c in self.key]
        parts = []
        if self.above is not None:
            values = [None if v is None else write(v) for v in self.above]
            parts += [f"{names[0]} >= {values[0]}"] if values[0] is not None and len(names) > 1 else []
            parts.append(_beyond(names, values))
        if self.up_to is not None:
            values = [None if v is None else write(v) for v in self.up_to]
            parts += [f"({names[0]} <= {values[0]} OR {names[0]} IS NULL)"] if values[0] is not None and len(names) > 1 else []
            parts.append(_within(names, values))
        return " AND ".join(parts) or "1 = 1"


def _beyond(names: list[str], values: list[str | None]) -> str:
    name, value, rest = names[0], values[0], len(names) > 1
    more = f"{name} IS NOT NULL" if value is None else f"{name} > {value}"
    same = f"{name} IS NULL" if value is None else f"{name} = {value}"
    return f"({more} OR ({same} AND {_beyond(names[1:], values[1:])}))" if rest else f"({more})"


def _within(names: list[str], values: list[str | None]) -> str:
    name, value = names[0], values[0]
    less = None if value is None else f"{name} < {value} OR {name} IS NULL"
    same = f"{name} IS NULL" if value is None else f"{name} = {value}"
    if len(names) == 1:
        return f"({same})" if less is None else f"({less} OR {same})"
    tail = f"({same} AND {_within(names[1:], values[1:])})"
    return tail if less is None else f"({less} OR {tail})"


def literal(value: object) -> str:
    """A value in SQL that Spark and most databases read alike."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def encoded(value: object) -> object:
    """A key value as JSON holds it; decoded() gives it back."""
    for name, (kind, write, _) in _CODES.items():
        if isinstance(value, kind):
            return {name: write(value)}
    return value


def decoded(value: object) -> object:
    if isinstance(value, dict):
        ((name, text),) = value.items()
        return _CODES[name][2](text)
    return value


#: By name: type, how it is written, how it is read; a datetime is a date too, so it stands first.
_CODES = {
    "timestamp": (dt.datetime, dt.datetime.isoformat, dt.datetime.fromisoformat),
    "date": (dt.date, dt.date.isoformat, dt.date.fromisoformat),
    "decimal": (decimal.Decimal, str, decimal.Decimal),
    "bytes": ((bytes, bytearray), lambda v: bytes(v).hex(), bytes.fromhex),
}


def ansi_literal(value: object) -> str:
    """literal() for databases in which a backslash is a character like others and a quote is doubled."""
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else literal(value)


def _cuts(keys: DataFrame, key: list[str], n: int) -> list[tuple[tuple, int]]:
    """(greatest key, rows) of at most n ranges of about equal rows, in order. Whole keys are range-partitioned; a row for each range reaches the driver."""
    own = [F.col(quoted(k)) for k in key]
    dealt = keys.repartitionByRange(n, *[c.asc_nulls_first() for c in own])
    tops = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct(*own)).alias("top"), F.count(F.lit(1)).alias("n"))
    # instants as the session's time zone writes them, which literals are read in
    instants = [isinstance(keys.schema[k].dataType, T.TimestampType) for k in key]
    parts = [F.col("top").getField(k).cast("string" if i else keys.schema[k].dataType) for k, i in zip(key, instants)]
    rows = tops.select("p", "n", *[c.alias(f"k{i}") for i, c in enumerate(parts)]).orderBy("p").collect()
    read = lambda v, instant: dt.datetime.fromisoformat(v) if instant and v is not None else v
    return [(tuple(read(r[f"k{i}"], x) for i, x in enumerate(instants)), r["n"]) for r in rows]


def equal_ranges(df: DataFrame, key: list[str], n: int, rounds: int = 3) -> list[KeyRange]:
    """At most n ranges of about equal rows that together hold every row of df, whatever the keys' types.

    Only the key columns are read. Ranges that turn out to hold more than HEAVY times the mean are cut again, up to
    `rounds` times; what is then still heavy is one key that many rows have. Few ranges come out of few keys.
    """
    keys = df.select(*[F.col(quoted(k)) for k in key])
    cuts = _cuts(keys, key, n)
    for _ in range(rounds if n > 1 else 0):
        mean = sum(c for _, c in cuts) / n
        tops = [t for t, _ in cuts]
        heavy = [i for i, (_, c) in enumerate(cuts) if c > HEAVY * mean]
        finer = {}
        for i in heavy:
            part = keys.where(KeyRange(0, tuple(key), tops[i - 1] if i else None, tops[i]).where())
            finer[i] = _cuts(part, key, -int(-cuts[i][1] // mean))
        if all(len(f) == 1 for f in finer.values()):
            break
        cuts = [c for i, own in enumerate(cuts) for c in finer.get(i, [own])]
    edges = [None, *[t for t, _ in cuts[:-1]], None]
    return [KeyRange(i + 1, tuple(key), a, b, c, t) for i, (a, b, (t, c)) in enumerate(zip(edges, edges[1:], cuts))] or [KeyRange(1, tuple(key), n_rows=0)]


def counted(df: DataFrame, ranges: list[KeyRange]) -> DataFrame:
    """(range, n_rows) by the range of each row; 0 stands for rows of no range, of which there should be none."""
    number = reduce(lambda rest, r: F.when(r.where(), F.lit(r.number)).otherwise(rest), ranges, F.lit(0))
    return df.groupBy(number.cast("long").alias("range")).agg(F.count(F.lit(1)).alias("n_rows"))


def refined(count: Callable[[int, int, int], dict[int, int]], low: int, high: int, n: int, key: str, rounds: int = 16) -> list[KeyRange]:
    """Ranges of an integer key of about equal rows, from histograms that the source counts itself.

    count(low, width, end) gives the rows of each cell i, the keys low + i * width and more, below low + (i + 1) * width and
    below end. Cells of equal width are counted; those with more than a quarter of a range's share are counted again in
    finer ones, and neighbours are put together until a range has its share. Each is within HEAVY times the mean, unless
    a single key is heavier.
    """

    def cells(at: int, end: int, n: int) -> list[tuple[int, int, int]]:
        width = max(1, -(-(end - at) // n))
        return [(at + i * width, min(at + (i + 1) * width, end), c) for i, c in sorted(count(at, width, end).items())]

    low, high = int(low), int(high)
    found = cells(low, high + 1, 8 * n)
    share = sum(c for *_, c in found) / n
    for _ in range(rounds):
        heavy = [x for x in found if x[2] > share / 4 and x[1] - x[0] > 1]
        if not heavy:
            break
        found = sorted([x for x in found if x not in heavy] + [y for at, end, _c in heavy for y in cells(at, end, 16)])
    out, held = [], 0
    for i, (_, end, c) in enumerate(found):
        held += c
        if i + 1 == len(found) or held + found[i + 1][2] > share:
            out.append((end - 1, held))
            held = 0
    edges = [None, *[(top,) for top, _ in out[:-1]], None]
    return [KeyRange(i + 1, (key,), a, b, c, (t,)) for i, (a, b, (t, c)) in enumerate(zip(edges, edges[1:], out))] or [KeyRange(1, (key,), n_rows=0)]


def frame_counts(df: DataFrame, key: str) -> Callable[[int, int, int], dict[int, int]]:
    """count() of refined() for a DataFrame: each call is one aggregate over the key column. Keys are integers of any type, decimals without a fraction among them; their differences may go beyond a long."""
    k = quoted(key)

    def count(low: int, width: int, end: int) -> dict[int, int]:
        rows = df.where(f"{k} >= {low} and {k} < {end}")
        return {r[0]: r[1] for r in rows.groupBy(F.expr(f"(cast({k} as decimal(38,0)) - {low}) div cast({width} as decimal(38,0))")).count().collect()}

    return count


def stored_cuts(df: DataFrame, key: list[str], n: int) -> list[KeyRange]:
    """equal_ranges() of a source that should be read once: its keys are written to the shared folder first."""
    return equal_ranges(checkpointed(df.select(*[F.col(quoted(k)) for k in key])), key, n)
