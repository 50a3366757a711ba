"""Name filters, column choice, error classes: the analysis around a run."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.catalog import DATE_TYPES

#: Patterns of tables that are usually left out, matched with the name in small letters.
EXCLUDED = (
    "^temp_",
    "_temp$",
    "^tmp_",
    "_tmp$",
    "^log_",
    "_log$",
    "_logs$",
    "^audit_",
    "_audit$",
    "^archive_",
    "_archive$",
    "_archived$",
    "^backup_",
    "_backup$",
    "_bak$",
    "^staging_",
    "_staging$",
    "^test_",
    "_test$",
    "^__",
    "_history$",
    "^sysdiagrams$",
    "^aspnet_",
    "^elmah",
)
#: Patterns of column names that tell when a row changed, best first, matched without case.
DATE_PATTERNS = (
    "^updated_?at$",
    "^modified_?(at|date|time)?$",
    "^last_?modified",
    "^changed_?(at|date)?$",
    "update",
    "modif",
    "^created_?at$",
    "^creation_?date$",
    "create",
)
#: Exit codes.
EXIT_CODES = {
    "success": 0,
    "config": 1,
    "connection": 2,
    "transfer": 3,
    "validation": 4,
    "cancelled": 5,
    "state": 6,
    "io": 7,
}
#: Fixed values: (class, parts of a message in small letters), the first class that fits; transfer otherwise.
EXIT_RULES = (
    ("io", ("no such file", "file not found", "permission denied", "is a directory", "not a directory")),
    ("validation", ("row count", "mismatch", "primary key", "no pk", "upsert requires", "validation failed")),
    ("config", ("yaml:", "json:", "unmarshal", "invalid configuration", "missing required", "invalid value", "parsing config")),
    ("connection", ("connection", "connect", "dial", "refused", "timeout", "unreachable", "no such host", "network", "pool", "ping", "login failed", "authentication")),
    ("transfer", ("transfer", "copy", "bulk", "insert", "schema extraction", "create table", "drop table", "truncate")),
    ("cancelled", ("cancel", "interrupt", "context canceled", "context deadline")),
    ("state", ("state", "checkpoint", "resume", "run not found", "already completed", "config changed")),
)
#: Messages with one of these aren't settings errors, whatever else they hold.
NOT_CONFIG = ("connection", "connect", "dial")
#: Classes that a later run may get over.
RECOVERABLE = ("connection", "cancelled", "io")
#: Parts of messages, in small letters, that are worth another attempt.
RETRYABLE = (
    "connection reset",
    "connection refused",
    "connection timed out",
    "deadlock",
    "lock timeout",
    "too many connections",
    "server is shutting down",
    "broken pipe",
    "unexpected eof",
    "i/o timeout",
    "context deadline exceeded",
    "retry",
)
#: Words that no query of a read-only session may hold, and how it must begin.
FORBIDDEN = ("DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "RENAME", "REPLACE")
READING = ("SELECT", "SHOW", "EXEC", "DESCRIBE", "EXPLAIN")


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return _any([text.contains(p) for p in parts])


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored expression: * and ? stop at '/', [^...] negates."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            out += glob[i : end + 1]
            i = end
        else:
            out += c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c
        i += 1
    return f"^{out}$"


def _matches(name: Column, globs: list[str]) -> Column:
    return _any([F.lower(name).rlike(glob_pattern(g.lower())) for g in globs])


def selected(tables: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Tables that an include glob matches (all if there is none) and no exclude glob does."""
    name = F.col("table_name")
    return tables.where((_matches(name, include) if include else F.lit(True)) & ~_matches(name, exclude))


def exclusion_candidate(name: Column) -> Column:
    return _any([F.lower(name).rlike(p) for p in EXCLUDED])


def date_columns(columns: DataFrame) -> DataFrame:
    return columns.where(F.lower("type_name").isin(*DATE_TYPES))


def date_column(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_name, date_column): the first candidate that the table has with a date type."""
    found = date_columns(columns).join(candidates, F.lower("column_name") == F.lower("candidate"))
    return found.groupBy("table_name").agg(F.min_by("column_name", "pos").alias("date_column"))


def ranked_date_columns(columns: DataFrame) -> DataFrame:
    """Date columns by the first pattern that their name fits (score from 0; no pattern: one more than their number), ties by ordinal."""
    score = F.lit(len(DATE_PATTERNS) + 1)
    for i, p in reversed(list(enumerate(DATE_PATTERNS))):
        score = F.when(F.lower("column_name").rlike(p), F.lit(i)).otherwise(score)
    rows = date_columns(columns).select("table_name", "column_name", "ordinal", score.alias("score"))
    return rows.select("table_name", "column_name", "score", F.row_number().over(Window.partitionBy("table_name").orderBy("score", "ordinal")).cast("bigint").alias("place"))


def suggested_columns(ranked: DataFrame) -> DataFrame:
    """(column_name, score): each date column name once, by its best place in any table; the first seen wins."""
    return ranked.groupBy("column_name").agg(F.min("score").alias("score")).orderBy("score", "column_name")


def exit_class(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit("transfer")
    for name, parts in reversed(EXIT_RULES):
        fits = _holds(low, parts)
        out = F.when(fits & ~_holds(low, NOT_CONFIG) if name == "config" else fits, F.lit(name)).otherwise(out)
    return F.when(message.isNull(), F.lit("success")).otherwise(out)


def exit_code(message: Column) -> Column:
    """The exit code of a message; null is success."""
    kind = exit_class(message)
    out = F.lit(EXIT_CODES["transfer"])
    for name, code in EXIT_CODES.items():
        out = F.when(kind == name, F.lit(code)).otherwise(out)
    return out


def recoverable(message: Column) -> Column:
    return exit_class(message).isin(*RECOVERABLE)


def retryable(message: Column) -> Column:
    return F.coalesce(_holds(F.lower(message), RETRYABLE), F.lit(False))


def retryable_text(message: str) -> bool:
    """The same for one message on the driver."""
    low = message.lower()
    return any(p in low for p in RETRYABLE)


def read_only(sql: Column) -> Column:
    """A reading word first, and no forbidden one anywhere."""
    text = F.upper(F.trim(sql))
    return ~_holds(text, FORBIDDEN) & _any([text.startswith(p) for p in READING])


def capped(rows: DataFrame, order: list[str], most: int = 15) -> tuple[DataFrame, bool]:
    """The first `most` rows in order, and whether there are more: one row beyond is read to tell."""
    few = rows.orderBy(*order).limit(most + 1)
    return few.limit(most), few.count() > most


def key_columns(rows: DataFrame) -> DataFrame:
    """(index_name, cols): the columns of each key in key order."""
    return rows.groupBy("index_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))), lambda x: x["column_name"]), ",").alias("cols"))
