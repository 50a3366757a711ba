"""Scalar functions on values in flight, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What databases call types whose values are normalised.
BINARY_TYPES = ("binary", "varbinary", "image")
GUID_TYPES = ("uniqueidentifier",)
BIT_TYPES = ("bit",)
TIME_TYPES = ("datetime", "datetime2", "smalldatetime", "datetimeoffset")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def empty_to_null(binary: Column) -> Column:
    """Empty binary values read as null."""
    return F.when(F.length(binary) > 0, binary)


def hex_text(binary: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(binary)))


def guid_text(binary: Column) -> Column:
    """Sixteen bytes in mixed-endian order as text; other lengths as plain hex."""
    h = F.lower(F.hex(binary))
    take = lambda *at: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in at])
    text = F.concat_ws("-", take(3, 2, 1, 0), take(5, 4), take(7, 6), take(8, 9), take(10, 11, 12, 13, 14, 15))
    return F.when(F.length(binary) == 16, text).otherwise(h)


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def bit_to_bool(number: Column) -> Column:
    return number != 0


def bool_to_int(flag: Column) -> Column:
    return flag.cast("int")


def sane_timestamp(ts: Column) -> Column:
    """Timestamps before year 1 read as null."""
    return F.when(F.year(ts) >= 1, ts)


def normal_value(value: Column, source_type: str, kind: T.DataType) -> Column:
    """A value as targets want it, by the type that its source calls it: empty binaries and impossible times are null, identifiers are text, bits are flags."""
    name = source_type.lower().split("(")[0].strip()
    if name in BINARY_TYPES and isinstance(kind, T.BinaryType):
        return empty_to_null(value)
    if name in GUID_TYPES and isinstance(kind, T.BinaryType):
        return guid_text(value)
    if name in BIT_TYPES and isinstance(kind, (T.IntegralType, T.DecimalType)):
        return bit_to_bool(value)
    if name in TIME_TYPES and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return sane_timestamp(value)
    return value


def normalized(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with normal_value() for each column whose source type is given; all are native expressions beside the scan."""
    return df.select(*[normal_value(F.col(f"`{f.name}`"), kinds[f.name], f.dataType).alias(f.name) if f.name in kinds else F.col(f"`{f.name}`") for f in df.schema])


def split_list(text: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones; null for an empty text."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.length(text) > 0, items)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def cut_bytes(text: Column, n: int) -> Column:
    """The first n bytes of a text and '...' if it is longer. A character that the cut would break is left out, as a string can't hold half of one."""
    head = F.encode(F.substring(text, 1, n), "UTF-8")
    # a character has four bytes at most, so one of the four longest heads is whole
    heads = [F.substring(head, 1, n - i).cast("string") for i in range(4)]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads])
    return F.when(F.octet_length(text) > n, F.concat(whole, F.lit("..."))).otherwise(text)


def redacted(text: Column, most: int = 100) -> Column:
    """Sample values for logs: cut to `most` bytes, then addresses with a local part, SSN shapes and telephone numbers are masked in this order."""
    s = cut_bytes(text, most)
    s = F.when(s.contains(".") & s.rlike("^[^@]+@"), F.concat(F.lit("[EMAIL]"), F.regexp_replace(s, r"^[^@]+@", "@"))).otherwise(s)
    s = F.when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("[SSN]")).otherwise(s)
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return F.when((digits >= 10) & (digits <= 15) & (F.octet_length(s) - digits <= 4), F.lit("[PHONE]")).otherwise(s)


#: What keys begin with in error bodies.
KEY_MARKS = ("sk-", "api-", "key-", "secret-", "token-")


def redacted_body(body: Column, most: int = 200) -> Column:
    """An error body for logs: cut to `most` bytes, and every key mark with the 40 characters behind it masked, one kind of mark after the other."""
    out = cut_bytes(body, most)
    for mark in KEY_MARKS:
        out = F.regexp_replace(out, f"(?is){mark}.{{0,40}}", "[REDACTED]")
    return out


def key_number(key: Column) -> Column:
    """A saved key as a whole number; null if it isn't one."""
    text = key.cast("string")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def compared_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for keys of one type; keys that can't be compared, nulls among them, count as equal."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def humanized(n: Column) -> Column:
    """Counts as 1.5K, 2.0M, 3.1B."""
    return F.when(n >= 1_000_000_000, F.format_string("%.1fB", F.bround(n / 1e9, 1))).when(n >= 1_000_000, F.format_string("%.1fM", F.bround(n / 1e6, 1))).when(n >= 1000, F.format_string("%.1fK", F.bround(n / 1e3, 1))).otherwise(n.cast("string"))


def grouped_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def duration_text(seconds: Column) -> Column:
    """Rounded seconds as 1h 2m 3s, 2m 3s or 3s."""
    n = F.floor(seconds + 0.5).cast("bigint")
    whole = lambda x, by: F.floor(x / by).cast("bigint")
    h, m, s = whole(n, 3600), whole(n % 3600, 60), n % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def size_text(n: Column) -> Column:
    """Bytes as 1.5 GB, 2.0 MB, 3.1 KB or 12 bytes."""
    unit = lambda k: F.format_string("%.1f", F.bround(n / k, 1))
    return F.when(n >= 1 << 30, F.concat(unit(1 << 30), F.lit(" GB"))).when(n >= 1 << 20, F.concat(unit(1 << 20), F.lit(" MB"))).when(n >= 1 << 10, F.concat(unit(1 << 10), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def estimated_memory(workers: Column, buffers: Column, chunk: Column, row_bytes: Column) -> Column:
    """Bytes in flight: each worker holds a read and a write queue of buffers; 500 bytes a row where the size isn't known."""
    return (workers * buffers * 2 * chunk * F.when(row_bytes > 0, row_bytes).otherwise(F.lit(500))).cast("bigint")


def short_hash(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


#: Characters whose capital is several characters (ß: SS), and the one character that takes their place: their title case, a capital ß, or themselves.
_WIDE = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1]
_ONE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDE]


def capitalized(text: Column) -> Column:
    """The text with its first character as a capital; a character stays one, so ß becomes ẞ."""
    first = F.substring(text, 1, 1)
    capital = F.when(first.isin(_WIDE), F.translate(first, "".join(_WIDE), "".join(_ONE))).otherwise(F.upper(first))
    return F.concat(capital, F.substring(text, 2, 1 << 30))


def task_key(table: Column, part: Column) -> Column:
    """transfer:schema.table, with :pN for a split."""
    return F.concat(F.lit("transfer:"), table, F.coalesce(F.concat(F.lit(":p"), part.cast("string")), F.lit("")))


def adjustments_text(pairs: Column) -> Column:
    """A map of settings as JSON; null as an empty one."""
    return F.coalesce(F.to_json(pairs), F.lit("{}"))


def adjustments(text: Column) -> Column:
    """JSON of settings as a map; text that isn't such JSON as an empty one."""
    return F.coalesce(F.from_json(text, "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))


#: Column names that databases reserve, and those that Oracle reserves beside them.
RESERVED = (
    "date", "time", "timestamp", "year", "month", "day",
    "user", "order", "group", "table", "index", "key",
    "type", "name", "value", "size", "number", "level",
    "comment", "desc", "asc", "limit", "offset",
    "select", "insert", "update", "delete", "from", "where",
    "and", "or", "not", "null", "true", "false",
    "primary", "foreign", "references", "constraint",
    "create", "alter", "drop", "truncate",
    "row", "rows", "column", "schema", "database",
    "function", "procedure", "trigger", "view",
)
RESERVED_ORACLE = ("uid", "sysdate", "rownum", "rowid", "access", "file", "long", "raw", "session", "start")


def is_reserved(name: Column, connector: str = "") -> Column:
    return F.lower(name).isin(*RESERVED, *(RESERVED_ORACLE if connector == "oracle" else ()))


def ddl_type(ddl: Column, name: Column) -> Column:
    """The type that a CREATE TABLE text gives a column, without NULL, NOT NULL and DEFAULT; null if it isn't found."""
    at = F.call_function("regexp_extract", ddl, F.concat(F.lit(r'(?i)(?:^|[\s,("\[`])\Q'), name, F.lit(r'\E["\]`]?[ \t]+([^,\n()]*(?:\([^)]*\))?)')), F.lit(1))
    return F.nullif(F.trim(F.regexp_replace(at, r"(?i)\s+(NOT\s+NULL|NULL|DEFAULT)\b.*$", "")), F.lit(""))


def task_table(task_key: Column) -> Column:
    """transfer:schema.table[:pN] → schema.table"""
    return F.regexp_extract(task_key, r"^transfer:(.*?)(?::p[0-9]+)?$", 1)


def task_part(task_key: Column) -> Column:
    return F.nullif(F.regexp_extract(task_key, ":p([0-9]+)$", 1), F.lit("")).cast("bigint")


def encrypted(plain: Column, key: Column, profile: Column) -> Column:
    """A sealed profile: AES-GCM, bound to its name."""
    return F.base64(F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), profile))


def decrypted(sealed: Column, key: Column, profile: Column) -> Column:
    return F.aes_decrypt(F.unbase64(sealed), key, F.lit("GCM"), F.lit("DEFAULT"), profile).cast("string")
