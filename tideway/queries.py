"""Registered queries: each applies operators to whole tables, beside SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway import catalog, storage
from tideway.engine import Engine
from tideway.functions import values as V
from tideway.operators import analyze, merge, metrics, state, validate
from tideway.plans import ranges, splits
from tideway.sources import dialects, keyed, scan, tables
from tideway.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


def query(sql: str) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


class Rows:
    """Literal rows for both engines: settings, and cases beside rows of tables."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows
        self.names = [c.strip().split()[0] for c in schema.split(",")]

    def df(self, spark: SparkSession, d: str = "") -> DataFrame:
        plain = self.schema.replace("timestamp_ntz", "string")
        out = spark.createDataFrame(self.rows, plain)
        for c in self.schema.split(","):
            name, kind = c.strip().split()
            if kind == "timestamp_ntz":
                out = out.withColumn(name, F.col(name).cast("timestamp_ntz"))
        return out

    def sql(self) -> str:
        kinds = [c.strip().split()[1] for c in self.schema.split(",")]
        names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}

        def cell(v: object, kind: str) -> str:
            text = "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
            return f"CAST({text} AS {names[kind]})"

        rows = ", ".join("(" + ", ".join(cell(v, k) for v, k in zip(r, kinds)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS t({', '.join(self.names)}))"


class Derived:
    """Rows that one SELECT, which both engines read alike, makes of the given tables; their names stand in braces."""

    def __init__(self, select: str) -> None:
        self.select, self.tables = select, sorted(set(re.findall(r"{(\w+)}", select)))

    def df(self, spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(self.select, **{t: table(spark, d, t) for t in self.tables})

    def sql(self) -> str:
        return "(" + self.select.format(**{t: t for t in self.tables}) + ")"


def _word(words: str, at: str, sep: str = ",") -> str:
    """SQL for one of some words, by a number."""
    return f"split_part('{words}', '{sep}', CAST(({at}) % {len(words.split(sep))} + 1 AS INT))"


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 5000 AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderkey LIMIT 1000")
def keyset_page(spark, d):
    return scan.keyset_page(table(spark, d, "orders"), "o_orderkey", ORDER_COLUMNS, 100, 5000, 1000, scan.since("o_orderdate", "1997-01-01"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 7000 ORDER BY o_orderkey LIMIT 500")
def keyset_page_unbounded(spark, d):
    return scan.keyset_page(table(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_totalprice"], 7000, None, 500)


@query("SELECT * FROM orders")
def full_table_scan(spark, d):
    return scan.read(spark, d, catalog.TableSpec("orders", ("o_orderkey",)))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1000 AND rn <= 1500")
def rownum_page(spark, d):
    return scan.row_number_page(table(spark, d, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey"], 1000, 1500)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn > 50 AND rn <= 150")
def rownum_page_composite(spark, d):
    return scan.row_number_page(table(spark, d, "conversations"), ["conv_id", "turn"], ["conv_id", "turn", "role"], 50, 150)


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-15') WHERE rn > 100 AND rn <= 300")
def rownum_page_filtered(spark, d):
    return scan.row_number_page(table(spark, d, "events"), ["event_id"], ["event_id", "user_id", "ts"], 100, 300, scan.since("ts", "2024-01-15"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def rownum_scaled(spark, d):
    return scan.numbered(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).withColumn("rn", F.col("rn").cast("bigint"))


_NTILE = "SELECT 'orders' AS t, split, min(k) AS min_key, max(k) AS max_key, count(*) AS n_rows FROM (SELECT o_orderkey AS k, ntile(8) OVER (ORDER BY o_orderkey) AS split FROM orders) GROUP BY split UNION ALL SELECT 'customer', split, min(k), max(k), count(*) FROM (SELECT c_custkey AS k, ntile(7) OVER (ORDER BY c_custkey) AS split FROM customer) GROUP BY split"


@query(_NTILE)
def ntile_splits(spark, d):
    parts = [splits.equi_depth_numbered(table(spark, d, t), k, n).withColumn("t", F.lit(t)) for t, k, n in (("orders", "o_orderkey", 8), ("customer", "c_custkey", 7))]
    return parts[0].unionByName(parts[1])


@query("WITH e AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part), s AS (SELECT *, (hi - lo + 1) // 6 AS step, unnest(range(1, 7)) AS split FROM e) SELECT split, lo + (split - 1) * step AS min_key, CASE WHEN split = 6 THEN hi ELSE lo + split * step - 1 END AS max_key FROM s")
def minmax_splits(spark, d):
    return splits.equi_width(table(spark, d, "part"), "p_partkey", 6)


@query("WITH e AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), s AS (SELECT *, (hi - lo + 1) // 4 AS step, unnest(range(0, 4)) AS i FROM e) SELECT i + 1 AS reader_id, lo - 1 + i * step AS above, CASE WHEN i = 3 THEN hi ELSE lo - 1 + (i + 1) * step END AS up_to FROM s")
def reader_ranges(spark, d):
    lo, hi = table(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return spark.createDataFrame([(s.number, s.above, s.up_to) for s in splits.reader_ranges(lo, hi, 4)], "reader_id bigint, above bigint, up_to bigint")


@query("WITH n AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS rn, count(*) OVER () AS total FROM conversations) SELECT least((rn - 1) // 100, 4) + 1 AS split, min(rn) AS first_row, max(rn) AS last_row, count(*) AS n_rows FROM n GROUP BY 1")
def rownum_splits(spark, d):
    rows = scan.numbered(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    return rows.groupBy(splits.row_number_splits(F.col("rn"), 100, 5).cast("bigint").alias("split")).agg(F.min("rn").cast("bigint").alias("first_row"), F.max("rn").cast("bigint").alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


@query("WITH e AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), s AS (SELECT *, (hi - lo + 1) // 5 AS step, unnest(range(0, 5)) AS i FROM e), r AS (SELECT i + 1 AS split, lo - 1 + i * step AS a, CASE WHEN i = 4 THEN hi ELSE lo - 1 + (i + 1) * step END AS b FROM s) SELECT split, count(*) AS n_rows FROM r JOIN orders ON o_orderkey > a AND o_orderkey <= b GROUP BY split")
def split_coverage(spark, d):
    orders = table(spark, d, "orders")
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return splits.covering(orders, "o_orderkey", splits.reader_ranges(lo, hi, 5))


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)
_KEYS = Rows("table_name string, n_key int, keyset boolean", [("customer", 1, True), ("lineitem", 0, False), ("nation", 1, True), ("orders", 1, True), ("part", 1, True), ("region", 1, True), ("supplier", 1, True)])


@query(f"SELECT c.table_name, n_rows, CASE WHEN n_rows <= 5000 OR n_key = 0 THEN 'full_table' WHEN keyset THEN 'keyset' ELSE 'row_number' END AS method, CASE WHEN n_rows <= 5000 OR n_key = 0 THEN 1 ELSE least(n_rows // 2000 + 1, 8) END AS partitions FROM ({_COUNTS}) c JOIN {_KEYS.sql()} k ON c.table_name = k.table_name")
def split_strategy(spark, d):
    keys = {t: (n, keyset) for t, n, keyset in _KEYS.rows}
    rows = []
    for t, n in validate.counts({t: table(spark, d, t) for t in TABLES}).collect():
        method = splits.strategy(n, keys[t][1], keys[t][0] > 0, 5000)
        rows.append((t, n, method, 1 if method == "full_table" else splits.split_count(n, 2000, 8)))
    return spark.createDataFrame(rows, "table_name string, n_rows bigint, method string, partitions bigint")


@query('SELECT c_custkey, c_name, c_nationkey AS "nation_key_", c_acctbal AS "col_2nd_balance", c_mktsegment AS "märkt" FROM customer')
def project_rename(spark, d):
    odd = table(spark, d, "customer").toDF("C_CustKey", "C_NAME", "Nation Key!", "2nd Balance", "Märkt")
    return catalog.renamed(odd)


_NAMES = Derived("SELECT 't' || p_size AS table_name, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' ' || p_type WHEN 1 THEN p_partkey || p_name WHEN 2 THEN 'ok_' || p_partkey WHEN 3 THEN '' ELSE 'Straße-' || p_size || '.É$' END AS column_name FROM {part}")


@query(f"SELECT * FROM (SELECT table_name, column_name AS old_name, CASE WHEN regexp_matches(c, '^\\p{{Nd}}') OR c = '' THEN 'col_' || c ELSE c END AS new_name FROM (SELECT *, regexp_replace(lower(column_name), '[^\\p{{L}}\\p{{Nd}}_]', '_', 'g') AS c FROM {_NAMES.sql()})) WHERE old_name <> new_name")
def identifier_changes(spark, d):
    return catalog.identifier_changes(_NAMES.df(spark, d))


_CLEAN = lambda c: f"CASE WHEN regexp_matches(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{Nd}}_]', '_', 'g'), '^\\p{{Nd}}') OR {c} = '' THEN 'col_' ELSE '' END || regexp_replace(lower({c}), '[^\\p{{L}}\\p{{Nd}}_]', '_', 'g')"
_MORE_NAMES = Derived("SELECT CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment || c_nationkey WHEN 1 THEN 'plain' || c_nationkey ELSE c_nationkey || 'x y' END AS table_name, CASE WHEN c_nationkey % 2 = 0 THEN 'c' || c_custkey ELSE c_name END AS column_name FROM {customer}")


@query(f"SELECT count(*) FILTER (own) AS table_changes, sum(n)::BIGINT AS column_changes, count(*) FILTER (own OR n > 0) AS tables_with_changes, count(*) FILTER (NOT own AND n = 0) AS tables_unchanged FROM (SELECT table_name, {_CLEAN('table_name')} <> table_name AS own, count(*) FILTER ({_CLEAN('column_name')} <> column_name) AS n FROM {_MORE_NAMES.sql()} GROUP BY table_name)")
def identifier_totals(spark, d):
    return catalog.change_totals(_MORE_NAMES.df(spark, d))


@query(f"SELECT column_name, regexp_matches(column_name, '^[A-Za-z_][A-Za-z0-9_ $#]{{0,127}}$') AS valid FROM {_NAMES.sql()}")
def identifier_valid(spark, d):
    return _NAMES.df(spark, d).select("column_name", catalog.valid_identifier(F.col("column_name")).alias("valid"))


_KEY_TYPES = Derived(f"SELECT 'c' || p_partkey AS name, {_word('INT,bigint,NUMBER,uuid,int4,decimal,varchar,mediumint,numeric,SmallSerial,number', 'p_partkey')} AS type_name, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS scale, p_size % 3 AS n_key FROM {{part}}")


@query(f"SELECT name, n_key = 1 AND (lower(type_name) IN ('int','bigint','smallint','tinyint','integer','serial','bigserial','smallserial','int4','int8','int2') OR (lower(type_name) = 'number' AND coalesce(scale, 0) = 0)) AS eligible FROM {_KEY_TYPES.sql()}")
def keyset_eligible(spark, d):
    return _KEY_TYPES.df(spark, d).select("name", catalog.keyset_eligible(F.col("type_name"), F.col("scale"), F.col("n_key")).alias("eligible"))


@query("SELECT event_id, ts FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts FROM events) WHERE ts >= TIMESTAMP '2024-01-20'")
def incremental_rows(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return rows.where(scan.since("ts", "2024-01-20"))


_TABLE_NAMES = Derived(f"SELECT DISTINCT {_word('temp_,tmp_,,audit_,old_,log_,test_,__,elmah,', 'c_custkey')} || {_word('users,Orders,orders,badges,posts,log2,sales/eu,user', 'c_nationkey')} || {_word('_archive,_bak,,_logs,_history,s,_archived', 'c_custkey + c_nationkey')} AS table_name FROM {{customer}}")


@query(f"SELECT table_name FROM {_TABLE_NAMES.sql()} WHERE (regexp_matches(lower(table_name), '^user[^/]*$') OR regexp_matches(lower(table_name), '^[^/]*orders[^/]*$') OR regexp_matches(lower(table_name), '^log[0-9]$')) AND NOT regexp_matches(lower(table_name), '^[^/]*_archive$')")
def table_glob_filter(spark, d):
    return analyze.selected(_TABLE_NAMES.df(spark, d), ["user*", "*orders*", "log[0-9]"], ["*_archive"])


_EXCLUDED = " OR ".join(f"regexp_matches(lower(table_name), '{p}')" for p in "^temp_ _temp$ ^tmp_ _tmp$ ^log_ _log$ _logs$ ^audit_ _audit$ ^archive_ _archive$ _archived$ ^backup_ _backup$ _bak$ ^staging_ _staging$ ^test_ _test$ ^__ _history$ ^sysdiagrams$ ^aspnet_ ^elmah".split())


@query(f"SELECT table_name, ({_EXCLUDED}) AS candidate FROM {_TABLE_NAMES.sql()}")
def exclude_candidates(spark, d):
    return _TABLE_NAMES.df(spark, d).select("table_name", analyze.exclusion_candidate(F.col("table_name")).alias("candidate"))


_SCHEMA = Derived(f"SELECT 't' || (p_partkey % 200) AS table_name, {_word('id,CreatedAt,LastModified,updated_at,birth,modified,ts,CreationDate,record_created,changed_at,last_update,UpdatedAt', 'p_size')} AS column_name, {_word('int,datetime,datetime2,timestamp,date,varchar,timestamptz', 'p_partkey')} AS type_name, CAST(floor(p_partkey / 200.0) AS INT) AS ordinal FROM {{part}}")
_CANDIDATES = Rows("pos int, candidate string", [(1, "modified"), (2, "updated_at"), (3, "createdat"), (4, "ts")])
_DATES = "('date','datetime','datetime2','smalldatetime','datetimeoffset','timestamp','timestamptz','timestamp_ntz','timestamp without time zone','timestamp with time zone')"


@query(f"SELECT table_name, arg_min(column_name, pos) AS date_column FROM {_SCHEMA.sql()} s JOIN {_CANDIDATES.sql()} c ON lower(s.column_name) = lower(c.candidate) WHERE lower(type_name) IN {_DATES} GROUP BY table_name")
def date_column_pick(spark, d):
    return analyze.date_column(_SCHEMA.df(spark, d), _CANDIDATES.df(spark, d))


_SCORES = " ".join(f"WHEN regexp_matches(lower(column_name), '{p}') THEN {i}" for i, p in enumerate(("^updated_?at$", "^modified_?(at|date|time)?$", "^last_?modified", "^changed_?(at|date)?$", "update", "modif", "^created_?at$", "^creation_?date$", "create")))


@query(f"SELECT table_name, column_name, CASE {_SCORES} ELSE 10 END AS score, row_number() OVER (PARTITION BY table_name ORDER BY CASE {_SCORES} ELSE 10 END, ordinal) AS place FROM {_SCHEMA.sql()} WHERE lower(type_name) IN {_DATES}")
def date_column_rank(spark, d):
    return analyze.ranked_date_columns(_SCHEMA.df(spark, d))


@query(f"SELECT column_name, min(score) AS score FROM (SELECT column_name, CASE {_SCORES} ELSE 10 END AS score FROM {_SCHEMA.sql()} WHERE lower(type_name) IN {_DATES}) GROUP BY column_name")
def suggested_date_columns(spark, d):
    return analyze.suggested_columns(analyze.ranked_date_columns(_SCHEMA.df(spark, d)))


_MESSAGE_TEXTS = (
    "open state.db: permission denied|validation failed: 3 tables|invalid configuration: no source|dial tcp: connection refused|deadlock victim"
    "|context canceled|checkpoint is corrupt|something else|read: i/o timeout|bulk insert failed|row count differs in t|yaml: line 3|yaml: cannot connect"
    "|json: bad value|no pk on t|ping failed|connection pool exhausted|authentication failed for user|login failed for user sa|truncate t failed"
    "|run not found|interrupted by user|too many connections|unexpected EOF|server is shutting down|please retry|broken pipe|connection reset by peer"
    "|lock timeout exceeded|context deadline exceeded|temporarily unavailable|no such file or directory|config changed since last run"
    "|upsert requires a primary key|schema extraction failed|invalid value for chunk_size|connection timed out"
)
_MESSAGES = Derived(f"SELECT doc_id AS id, CASE WHEN doc_id % 41 > 0 THEN {_word(_MESSAGE_TEXTS, 'doc_id', '|')} || ' ' || substr(text, 1, 80) END AS message FROM {{documents}}")
_ANY = lambda column, parts: "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts.split("|")) + ")"
_MESSAGE = "lower(message)"
_CODES = f"""CASE WHEN message IS NULL THEN 0
WHEN {_ANY(_MESSAGE, 'no such file|file not found|permission denied|is a directory|not a directory')} THEN 7
WHEN {_ANY(_MESSAGE, 'row count|mismatch|primary key|no pk|upsert requires|validation failed')} THEN 4
WHEN {_ANY(_MESSAGE, 'yaml:|json:|unmarshal|invalid configuration|missing required|invalid value|parsing config')} AND NOT {_ANY(_MESSAGE, 'connection|connect|dial')} THEN 1
WHEN {_ANY(_MESSAGE, 'connection|connect|dial|refused|timeout|unreachable|no such host|network|pool|ping|login failed|authentication')} THEN 2
WHEN {_ANY(_MESSAGE, 'transfer|copy|bulk|insert|schema extraction|create table|drop table|truncate')} THEN 3
WHEN {_ANY(_MESSAGE, 'cancel|interrupt|context canceled|context deadline')} THEN 5
WHEN {_ANY(_MESSAGE, 'state|checkpoint|resume|run not found|already completed|config changed')} THEN 6 ELSE 3 END"""


@query(f"SELECT id, {_CODES} AS code, {_CODES} IN (2, 5, 7) AS recoverable FROM {_MESSAGES.sql()}")
def exit_code(spark, d):
    return _MESSAGES.df(spark, d).select("id", analyze.exit_code(F.col("message")).alias("code"), analyze.recoverable(F.col("message")).alias("recoverable"))


@query(f"SELECT id, coalesce({_ANY(_MESSAGE, 'connection reset|connection refused|connection timed out|deadlock|lock timeout|too many connections|server is shutting down|broken pipe|unexpected eof|i/o timeout|context deadline exceeded|retry')}, FALSE) AS retryable FROM {_MESSAGES.sql()}")
def retryable_error(spark, d):
    return _MESSAGES.df(spark, d).select("id", analyze.retryable(F.col("message")).alias("retryable"))


_SQLS = Derived(f"SELECT doc_id AS id, {_word('SELECT 1|delete from t|select updated_at from t|WITH x AS (SELECT 1) SELECT * FROM x|EXEC p| show variables |select replace(a, b, c) from t|merge into t|explain select 1|EXECUTE sp_rename a, b|describe t|', 'doc_id', '|')} || ' ' || substr(text, 1, 60) AS q FROM {{documents}}")


@query(f"SELECT id, NOT {_ANY('upper(q)', 'DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE|CREATE|GRANT|REVOKE|RENAME|REPLACE')} AND regexp_matches(upper(trim(q)), '^(SELECT|SHOW|EXEC|DESCRIBE|EXPLAIN)') AS allowed FROM {_SQLS.sql()}")
def read_only_guard(spark, d):
    return _SQLS.df(spark, d).select("id", analyze.read_only(F.col("q")).alias("allowed"))


_TARGET = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 2"
_SOURCE = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 1"
_MERGED = f"""SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN a IN ('insert', 'update') THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
CASE WHEN a IN ('insert', 'update') THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus, CASE WHEN a IN ('insert', 'update') THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice, a AS _action
FROM (SELECT t, s, CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'target_only' WHEN t.o_custkey IS DISTINCT FROM s.o_custkey OR t.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR t.o_totalprice IS DISTINCT FROM s.o_totalprice THEN 'update' ELSE 'unchanged' END AS a
FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.o_orderkey = s.o_orderkey)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.where("o_orderkey % 3 <> 2"), orders.where("o_orderkey % 4 <> 1").withColumn("o_totalprice", changed)


@query(_MERGED)
def upsert_merge(spark, d):
    return merge.merge(*_sides(spark, d), ["o_orderkey"])


@query(f"SELECT _action, count(*) AS n FROM ({_MERGED}) GROUP BY _action")
def upsert_actions(spark, d):
    return merge.merge(*_sides(spark, d), ["o_orderkey"]).groupBy("_action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal, CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'target_only' ELSE 'update' END AS _action FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 2) t FULL JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 1) s ON t.c_custkey = s.c_custkey")
def upsert_blind(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return merge.merge(rows.where("c_custkey % 3 <> 2"), rows.where("c_custkey % 4 <> 1"), ["c_custkey"], detect=False)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 <> 0")
def upsert_key_only(spark, d):
    keys = table(spark, d, "nation").select("n_nationkey")
    return merge.insert_only(keys.where("n_nationkey % 2 = 0"), keys.where("n_nationkey % 3 = 0"), ["n_nationkey"])


@query("SELECT p_partkey, CASE WHEN t.b IS DISTINCT FROM s.b OR t.z IS DISTINCT FROM s.z THEN 'update' ELSE 'unchanged' END AS _action FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS b, p_size AS z FROM part) t JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS b, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS z FROM part) s USING (p_partkey)")
def merge_nullsafe(spark, d):
    part = table(spark, d, "part")
    null = lambda c, n: F.when(F.col("p_partkey") % n != 0, F.col(c))
    t = part.select("p_partkey", null("p_brand", 7).alias("b"), F.col("p_size").alias("z"))
    s = part.select("p_partkey", null("p_brand", 5).alias("b"), null("p_size", 11).alias("z"))
    return merge.merge(t, s, ["p_partkey"]).select("p_partkey", "_action")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_orderkey BETWEEN 1000 AND 1999 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999")
def split_cleanup(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    part = rows.where("o_orderkey between 1000 and 1999").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return merge.replace_range(rows, part, "o_orderkey", 1000, 1999)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey > 3000 AND o_orderkey <= 8000)")
def resume_cleanup(spark, d):
    return merge.before_resume(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3000, 8000)


@query("SELECT coalesce(s.t, x.t) AS table_name, s.n AS source_rows, x.n AS target_rows, CASE WHEN x.n IS NULL THEN 'missing_target' WHEN s.n IS NULL THEN 'missing_source' WHEN s.n = x.n THEN 'ok' ELSE 'mismatch' END AS status FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part) s FULL JOIN (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 100 <> 7 UNION ALL SELECT 'region', count(*) FROM region) x ON s.t = x.t")
def row_count_diff(spark, d):
    source = {t: table(spark, d, t) for t in ("nation", "orders", "part")}
    return validate.count_diff(source, {"nation": source["nation"], "orders": source["orders"].where("o_orderkey % 100 <> 7"), "region": table(spark, d, "region")})


_SAMPLE = "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws(',', '', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100"


@query(f"SELECT o_orderkey FROM ({_SAMPLE}) WHERE o_orderkey % 5 = 0")
def sample_keys_missing(spark, d):
    orders = table(spark, d, "orders")
    return validate.sampled_keys(orders, orders.where("o_orderkey % 5 <> 0"), ["o_orderkey"])


@query(f"SELECT o_orderkey FROM ({_SAMPLE}) WHERE o_orderkey % 5 <> 0")
def sample_keys_present(spark, d):
    orders = table(spark, d, "orders")
    return validate.sampled_keys(orders, orders.where("o_orderkey % 5 <> 0"), ["o_orderkey"], present=True)


@query("SELECT 'orders' AS child, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 9 <> 4) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def fk_orphans(spark, d):
    a = validate.orphans(table(spark, d, "orders"), ["o_custkey"], table(spark, d, "customer").where("c_custkey % 9 <> 4"), ["c_custkey"])
    b = validate.orphans(table(spark, d, "lineitem"), ["l_orderkey"], table(spark, d, "orders"), ["o_orderkey"])
    return validate.counts({"orders": a, "lineitem": b}, "n").withColumnRenamed("table_name", "child")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return validate.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE NOT l_discount <= 0.05")
def check_violations(spark, d):
    return validate.broken(table(spark, d, "lineitem"), "l_discount <= 0.05").select("l_orderkey", "l_linenumber", "l_discount")


@query(f"SELECT o_orderkey, CASE WHEN _action = 'insert' THEN 'missing' WHEN _action = 'target_only' THEN 'extra' ELSE 'changed' END AS status FROM ({_MERGED}) WHERE _action <> 'unchanged'")
def checksum_diff(spark, d):
    target, source = _sides(spark, d)
    return validate.checksum_diff(source, target, ["o_orderkey"])


@query(f"SELECT o_orderkey, CASE WHEN _action = 'insert' THEN 'missing' WHEN _action = 'target_only' THEN 'extra' ELSE 'changed' END AS status FROM ({_MERGED}) WHERE _action <> 'unchanged'")
def tree_diff_many(spark, d):
    """Tables that differ everywhere: the tree stops at once and all rows are compared."""
    target, source = _sides(spark, d)
    return validate.tree_diff(source, target, ["o_orderkey"], 1000)


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'changed' AS status FROM lineitem WHERE l_partkey % 5000 = 7 AND l_tax IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'missing' FROM lineitem WHERE l_partkey % 5000 = 9")
def tree_diff(spark, d):
    """Tables that differ in few rows, which alone are compared one by one."""
    rows = table(spark, d, "lineitem")
    other = rows.where("l_partkey % 5000 <> 9").withColumn("l_tax", F.when(F.col("l_partkey") % 5000 != 7, F.col("l_tax")))
    return validate.tree_diff(rows, other, ["l_orderkey", "l_linenumber", "l_partkey"], 1000)


_RUNS = Derived(f"SELECT 'r' || o_orderkey AS run_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate + INTERVAL '1' HOUR END AS completed_at, {_word('success,running,partial,failed', 'o_orderkey')} AS status, 's' || (o_custkey % 500) AS source_schema, 'public' AS target_schema FROM {{orders}}")
_TASKS = Derived(f"SELECT event_id AS task_id, 'r' || user_id AS run_id, 'transfer:' || event_type || '.t' || (user_id % 20) || CASE WHEN event_id % 3 > 0 THEN ':p' || (event_id % 3) ELSE '' END AS task_key, CASE WHEN user_id % 20 > 12 THEN 'success' ELSE {_word('success,failed,running,pending', 'CASE WHEN user_id % 20 > 8 THEN 0 WHEN user_id % 20 > 5 THEN event_id % 2 * 2 ELSE event_id END')} END AS status, CASE WHEN event_id % 4 = 1 THEN 'timeout' END AS error FROM {{events}}")
_PROGRESS = Derived("SELECT event_id AS task_id, user_id AS last_key, event_id % 700 AS rows_done, event_id % 700 + CASE WHEN user_id % 20 > 15 THEN 0 ELSE event_id % 3 * 10 END AS rows_total FROM {events} WHERE event_id % 4 <> 3")
_JOINED = f"(SELECT t.task_id, run_id, task_key, status, coalesce(rows_done, 0) AS rows_done, coalesce(rows_total, 0) AS rows_total FROM {_TASKS.sql()} t LEFT JOIN {_PROGRESS.sql()} p ON t.task_id = p.task_id)"
_ROLLUP = f"(SELECT regexp_extract(task_key, '^transfer:(.*?)(?::p[0-9]+)?$', 1) AS table_name, sum(rows_done)::BIGINT AS rows_done, sum(rows_total)::BIGINT AS rows_total, count(*) AS n_tasks, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'success' END AS status FROM {_JOINED} GROUP BY 1)"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return state.task_progress(_TASKS.df(spark, d), _PROGRESS.df(spark, d))


@query(f"SELECT * FROM {_JOINED}")
def task_progress(spark, d):
    return _joined(spark, d)


@query(f"SELECT run_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM {_TASKS.sql()} GROUP BY run_id")
def run_stats(spark, d):
    return state.run_stats(_TASKS.df(spark, d))


@query(f"SELECT * FROM {_ROLLUP}")
def table_rollup(spark, d):
    return state.table_rollup(_joined(spark, d))


@query(f"SELECT run_id, sum(rows_done)::BIGINT AS rows_done, sum(rows_total)::BIGINT AS rows_total, CASE WHEN sum(rows_total) > 0 THEN round(100.0 * sum(rows_done)::DOUBLE / sum(rows_total)::DOUBLE, 4) ELSE 0.0 END::DOUBLE AS percent FROM {_JOINED} GROUP BY run_id")
def run_progress(spark, d):
    return state.run_progress(_joined(spark, d))


@query(f"SELECT run_id, source_schema FROM {_RUNS.sql()} WHERE status = 'running' ORDER BY started_at DESC, run_id DESC LIMIT 1")
def latest_run(spark, d):
    return state.latest_running(_RUNS.df(spark, d)).select("run_id", "source_schema")


@query(f"SELECT run_id FROM {_RUNS.sql()} a WHERE status = 'running' AND EXISTS (SELECT 1 FROM {_RUNS.sql()} b WHERE b.status = 'success' AND b.source_schema = a.source_schema AND b.target_schema = a.target_schema AND b.started_at > a.started_at)")
def superseded_runs(spark, d):
    return state.superseded(_RUNS.df(spark, d)).select("run_id")


@query(f"SELECT run_id FROM {_RUNS.sql()} WHERE status IN ('success', 'failed') AND completed_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def expired_runs(spark, d):
    return state.expired(_RUNS.df(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"), 30).select("run_id")


@query(f"SELECT task_id FROM {_TASKS.sql()} WHERE run_id NOT IN (SELECT run_id FROM {_RUNS.sql()} WHERE status IN ('success', 'failed', 'running') AND started_at < TIMESTAMP '1995-02-01')")
def retained_tasks(spark, d):
    return state.without(_TASKS.df(spark, d), _RUNS.df(spark, d).where("status in ('success', 'failed', 'running') and started_at < timestamp_ntz'1995-02-01'")).select("task_id")


_TARGET_ROWS = Derived("SELECT event_type || '.t' || (user_id % 20) AS table_name, CAST(sum(CASE WHEN event_id % 4 <> 3 THEN event_id % 700 ELSE 0 END) + CASE user_id % 20 % 4 WHEN 0 THEN 0 WHEN 1 THEN -5 ELSE 5 END AS BIGINT) AS n_rows FROM {events} WHERE user_id % 20 <> 7 GROUP BY event_type, user_id % 20")


@query(f"SELECT r.table_name, CASE WHEN n_rows IS NULL THEN 'create' WHEN status = 'success' AND n_rows = rows_total THEN 'skip' WHEN n_rows < rows_done THEN 'restart' ELSE 'continue' END AS action FROM {_ROLLUP} r LEFT JOIN {_TARGET_ROWS.sql()} t ON r.table_name = t.table_name")
def resume_plan(spark, d):
    return state.resume_plan(_joined(spark, d), _TARGET_ROWS.df(spark, d))


_ACKS = Derived("SELECT CAST(event_id % 100 AS INT) AS reader_id, CAST(floor(event_id / 100.0) AS BIGINT) AS seq, event_id AS last_key FROM {events} WHERE event_id % 977 <> 500")
_RANGES = Derived("SELECT CAST(event_id % 100 AS INT) AS reader_id, min(event_id) - 1 AS above, max(event_id) AS up_to FROM {events} GROUP BY event_id % 100")
_CONTIGUOUS = f"(SELECT reader_id, max(seq) AS seq, arg_max(last_key, seq) AS last_key FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY seq) - 1 AS n FROM (SELECT DISTINCT * FROM {_ACKS.sql()})) WHERE seq = n GROUP BY reader_id)"


@query(f"SELECT * FROM {_CONTIGUOUS}")
def contiguous_acks(spark, d):
    return state.contiguous(_ACKS.df(spark, d))


@query(f"SELECT coalesce(arg_min(last, reader_id) FILTER (last < up_to), max(up_to)) AS checkpoint FROM (SELECT r.*, coalesce(last_key, above) AS last FROM {_RANGES.sql()} r LEFT JOIN {_CONTIGUOUS} c ON r.reader_id = c.reader_id)")
def safe_checkpoint(spark, d):
    return state.safe_checkpoint(_ACKS.df(spark, d), _RANGES.df(spark, d))


_SYNC_TABLES = Derived("SELECT c_name AS table_name, CASE WHEN c_nationkey % 3 > 0 THEN 'ts' END AS date_column FROM {customer}")
_MARKS = Derived("SELECT c_name AS table_name, max(o_orderdate) AS mark FROM {customer} JOIN {orders} ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0 GROUP BY c_name")


@query(f"SELECT t.table_name, CASE WHEN date_column IS NULL THEN 'no_date_column' WHEN mark IS NULL THEN 'first_sync' ELSE 'incremental' END AS mode FROM {_SYNC_TABLES.sql()} t LEFT JOIN {_MARKS.sql()} m ON t.table_name = m.table_name")
def sync_classes(spark, d):
    return state.sync_plan(_SYNC_TABLES.df(spark, d), _MARKS.df(spark, d))


_FAILS = Derived("SELECT event_type || (user_id % 50) AS table_name, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN 'e' || event_id END AS error FROM {events}")


@query(f"SELECT table_name, arg_min(error, seq) AS error FROM {_FAILS.sql()} WHERE error IS NOT NULL GROUP BY table_name")
def first_failures(spark, d):
    return state.first_failures(_FAILS.df(spark, d))


_HOURLY = "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS throughput, (sum(user_id) % 100)::DOUBLE AS cpu, (sum(event_id) % 100)::DOUBLE AS memory FROM events GROUP BY 1"
_TREND = f"""SELECT *, (n >= 3 AND decline > 0.2) AS decreasing, coalesce(memory > m1 * 1.05 AND m1 > m2 * 1.05, FALSE) AS memory_rising, cpu > 90 AS cpu_high, memory > 85 AS memory_high, n < 3 AS insufficient,
max(CASE WHEN n = 3 THEN a3 END) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS baseline FROM (SELECT *, CASE WHEN x1 > 0 THEN (throughput - x1) / x1 * 100 ELSE 0 END AS change_pct, CASE WHEN x2 > 0 AND throughput > 0 THEN greatest((x2 - throughput) / x2, 0) ELSE 0 END AS decline
FROM (SELECT *, lag(throughput, 1) OVER w AS x1, lag(throughput, 2) OVER w AS x2, lag(memory, 1) OVER w AS m1, lag(memory, 2) OVER w AS m2, row_number() OVER w AS n, avg(throughput) OVER (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a3 FROM ({_HOURLY}) WINDOW w AS (ORDER BY ts)))"""


def _trend(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    hourly = table(spark, d, "events").groupBy(hour).agg(F.count(F.lit(1)).cast("double").alias("throughput"), (F.sum("user_id") % 100).cast("double").alias("cpu"), (F.sum("event_id") % 100).cast("double").alias("memory"))
    return metrics.with_trend(hourly)


@query(f"SELECT ts, round(change_pct, 6) AS change_pct, round(decline, 6)::DOUBLE AS decline, decreasing FROM ({_TREND})")
def throughput_trend(spark, d):
    return _trend(spark, d).select("ts", F.round("change_pct", 6).alias("change_pct"), F.round("decline", 6).alias("decline"), "decreasing")


@query(f"SELECT ts, insufficient, memory_rising, cpu_high, memory_high FROM ({_TREND})")
def metric_flags(spark, d):
    return _trend(spark, d).select("ts", "insufficient", "memory_rising", "cpu_high", "memory_high")


@query(f"SELECT ts, CASE WHEN insufficient OR coalesce(baseline > 0 AND abs(throughput - baseline) <= 0.1 * baseline, FALSE) THEN 'continue' WHEN memory_high THEN 'reduce_chunk' WHEN cpu_high THEN 'scale_down' WHEN decreasing THEN 'scale_up' ELSE 'continue' END AS decision, CASE WHEN insufficient OR coalesce(baseline > 0 AND abs(throughput - baseline) <= 0.1 * baseline, FALSE) THEN 'continue' ELSE 'continue' END AS at_limits FROM ({_TREND})")
def tuning_decision(spark, d):
    return _trend(spark, d).select("ts", metrics.decision().alias("decision"), metrics.decision(chunk=5000, workers=1, cores=1).alias("at_limits"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3")
def last_samples(spark, d):
    return metrics.last_samples(table(spark, d, "events").select("event_type", "event_id", "value"), 3, "event_id", ["event_type"])


_SIZED = {"nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name", "benchmark": "item_id text", "documents": "doc_id text lang source n_chars", "pages": "page_id url html", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}
_BYTES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, coalesce(sum({' + '.join(f'coalesce(strlen({c}::VARCHAR), 0)' for c in cs.split())})::BIGINT // nullif(count(*), 0), 0) AS avg_bytes FROM {t}" for t, cs in _SIZED.items())


@query(_BYTES)
def table_sizes(spark, d):
    """All tables whose columns are texts and whole numbers, which both engines write alike."""
    return metrics.table_sizes({t: table(spark, d, t) for t in _SIZED})


_TIMINGS = "SELECT l_linenumber AS part, l_tax AS query_s, l_discount AS scan_s, l_quantity / 100 AS write_s, l_partkey AS rows FROM lineitem"


@query(f"SELECT part, sum(rows)::BIGINT AS rows, round(sum(query_s) / nullif(sum(query_s) + sum(scan_s) + sum(write_s), 0) * 100, 4) AS query_pct, round(sum(scan_s) / nullif(sum(query_s) + sum(scan_s) + sum(write_s), 0) * 100, 4) AS scan_pct, round(sum(write_s) / nullif(sum(query_s) + sum(scan_s) + sum(write_s), 0) * 100, 4) AS write_pct, round(sum(rows)::DOUBLE / nullif(sum(query_s) + sum(scan_s) + sum(write_s), 0), 2) AS rows_per_second FROM ({_TIMINGS}) GROUP BY part")
def timing_profile(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("part"), F.col("l_tax").alias("query_s"), F.col("l_discount").alias("scan_s"), (F.col("l_quantity") / 100).alias("write_s"), F.col("l_partkey").alias("rows"))
    return metrics.timing_profile(rows, ["part"]).withColumn("rows_per_second", F.round("rows_per_second", 2))


@query(f"SELECT count(*) FILTER (status = 'success') AS tables_complete, count(*) AS tables_total, count(*) FILTER (running) AS tables_running, sum(done)::BIGINT AS rows_transferred, sum(total)::BIGINT AS rows_total, round(sum(done) * 100.0 / sum(total), 4)::DOUBLE AS progress_pct, (sum(done)::BIGINT // 10)::BIGINT AS rows_per_second, string_agg(CASE WHEN running THEN table_name END, ',' ORDER BY table_name) AS current_tables, count(*) FILTER (failed) AS error_count FROM (SELECT regexp_extract(task_key, '^transfer:(.*?)(?::p[0-9]+)?$', 1) AS table_name, sum(rows_done) AS done, sum(rows_total) AS total, bool_or(status = 'running') AS running, bool_or(status = 'failed') AS failed, CASE WHEN bool_and(status = 'success') THEN 'success' END AS status FROM {_JOINED} GROUP BY 1)")
def progress_update(spark, d):
    return metrics.progress_update(_joined(spark, d).select(V.task_table(F.col("task_key")).alias("table_name"), "status", "rows_done", "rows_total"), 10.0)


_STATS = Derived("SELECT p_brand || p_size AS table_name, count(*) AS n_rows, CASE WHEN min(p_partkey) % 9 = 0 THEN 0 ELSE max(p_partkey) END AS avg_bytes FROM {part} GROUP BY p_brand, p_size")


@query(f"SELECT round(sum(n_rows * avg_bytes)::DOUBLE / sum(n_rows)::DOUBLE, 4) AS weighted, max(avg_bytes) AS largest, arg_max(table_name, avg_bytes) AS largest_table FROM {_STATS.sql()} WHERE avg_bytes > 0")
def row_size_stats(spark, d):
    return metrics.row_size_stats(_STATS.df(spark, d))


@query(f"SELECT * FROM {_STATS.sql()} ORDER BY n_rows DESC, table_name LIMIT 5")
def largest_tables(spark, d):
    return metrics.largest(_STATS.df(spark, d))


@query(f"SELECT least(coalesce(floor(avg(avg_bytes)), 500), 2000)::BIGINT AS row_bytes FROM (SELECT * FROM {_STATS.sql()} ORDER BY n_rows DESC, table_name LIMIT 5) WHERE n_rows > 0 AND avg_bytes > 0")
def avg_row_size(spark, d):
    return metrics.average_row_size(_STATS.df(spark, d))


_ACTIONS = Derived("SELECT event_type || (user_id % 5) AS action, CAST(event_id % 100 AS DOUBLE) AS before, CAST(event_id % 100 + user_id % 5 * 4 AS DOUBLE) AS after FROM {events}")


@query(f"SELECT action, count(*) AS n, round(avg((after - before) / before * 100), 4) AS mean_effect FROM {_ACTIONS.sql()} WHERE before > 0 GROUP BY action HAVING round(avg((after - before) / before * 100), 4) > 10 ORDER BY mean_effect DESC, action LIMIT 3")
def action_effects(spark, d):
    return metrics.action_effects(_ACTIONS.df(spark, d))


@query("SELECT 'orders' AS table_name, coalesce(max(o_orderkey), 0) + 1 AS next_value FROM orders UNION ALL SELECT 'part', coalesce(max(p_partkey), 0) + 1 FROM part")
def sequence_next(spark, d):
    parts = [table(spark, d, t).agg((F.coalesce(F.max(k), F.lit(0)) + 1).cast("bigint").alias("next_value")).select(F.lit(t).alias("table_name"), "next_value") for t, k in (("orders", "o_orderkey"), ("part", "p_partkey"))]
    return parts[0].union(parts[1])


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY value LIMIT 5")
def distinct_sample(spark, d):
    return scan.distinct_sample(table(spark, d, "customer"), "c_mktsegment")


@query("WITH h AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5) SELECT 'c_name' AS column_name, string_agg(c_name, ',' ORDER BY c_custkey) AS samples FROM h UNION ALL SELECT 'c_nationkey', string_agg(CAST(c_nationkey AS VARCHAR), ',' ORDER BY c_custkey) FROM h")
def row_sample(spark, d):
    return scan.row_sample(table(spark, d, "customer"), ["c_custkey"], ["c_name", "c_nationkey"])


_KEYCOLS = Derived("SELECT p_brand AS index_name, p_partkey AS pos, p_type AS column_name FROM {part}")


@query(f"SELECT index_name, string_agg(column_name, ',' ORDER BY pos) AS cols FROM {_KEYCOLS.sql()} GROUP BY index_name")
def key_columns_agg(spark, d):
    return analyze.key_columns(_KEYCOLS.df(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN substr(md5(o_orderpriority), 1, (o_orderkey % 5 * 2)::INT) END AS raw, o_orderkey % 3 <> 0 AS flag, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS ts FROM orders")
def normalize_values(spark, d):
    raw = F.unhex(F.expr("substr(md5(o_orderpriority), 1, cast(o_orderkey % 5 * 2 as int))"))
    ts = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(V.empty_to_null(raw))).alias("raw"), V.bit_to_bool(F.col("o_orderkey") % 3).alias("flag"), V.sane_timestamp(ts).alias("ts"))


@query("SELECT c_custkey, CASE WHEN length(hex) = 32 THEN substr(hex, 7, 2) || substr(hex, 5, 2) || substr(hex, 3, 2) || substr(hex, 1, 2) || '-' || substr(hex, 11, 2) || substr(hex, 9, 2) || '-' || substr(hex, 15, 2) || substr(hex, 13, 2) || '-' || substr(hex, 17, 4) || '-' || substr(hex, 21, 12) ELSE hex END AS guid FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN substr(md5(c_name), 1, 30) ELSE md5(c_name) END AS hex FROM customer)")
def guid_text(spark, d):
    hex_ = F.when(F.col("c_custkey") % 4 == 0, F.substring(F.md5("c_name"), 1, 30)).otherwise(F.md5("c_name"))
    return table(spark, d, "customer").select("c_custkey", V.guid_text(F.unhex(hex_)).alias("guid"))


@query("SELECT o_orderkey, '\\x' || lower(hex(o_orderpriority)) AS hex_text FROM orders")
def hex_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.hex_text(F.col("o_orderpriority").cast("binary")).alias("hex_text"))


_NUMBER_TEXT = "CASE o_orderkey % 8 WHEN 0 THEN o_orderkey || '.' WHEN 1 THEN '+.' || o_orderkey WHEN 2 THEN o_orderkey || 'e' WHEN 3 THEN '-' || o_orderkey || '.25E-3' WHEN 4 THEN o_orderpriority WHEN 5 THEN '1.2.' || o_orderkey WHEN 6 THEN ' ' || o_orderkey END"


@query(f"SELECT o_orderkey, regexp_full_match({_NUMBER_TEXT}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS is_number FROM orders")
def ascii_numeric(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.is_number(F.expr(_NUMBER_TEXT)).alias("is_number"))


@query("SELECT o_orderkey, (o_totalprice > 100000)::INTEGER AS flag FROM orders")
def bool_int(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.bool_to_int(F.col("o_totalprice") > 100000).alias("flag"))


_TEXTS = Rows("id int, text string", [(1, "a, b ,,c"), (2, ""), (3, None), (4, " , "), (5, "jane.doe@example.com"), (6, "123-45-6789"), (7, "+1 555 123 4567"), (8, "x" * 120), (9, "hello"), (10, "(555) 123-4567"), (11, "12345678901234567890"), (12, "@x.org"), (13, "@.1234567890"), (14, "é" * 60), (15, "a@b"), (16, "a@b@c.d"), (17, "x" * 99 + "é"), (18, "５５５1234567890")])


@query("SELECT doc_id, len(items) AS n_items, md5(array_to_string(items, '|')) AS digest FROM (SELECT doc_id, list_filter([trim(x) for x in string_split(text, ',')], lambda x: x <> '') AS items FROM documents)")
def csv_split(spark, d):
    items = V.split_list(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(items).cast("bigint").alias("n_items"), F.md5(F.array_join(items, "|")).alias("digest"))


_CUT = lambda t, n: f"CASE WHEN strlen({t}) > {n} THEN substr({t}, 1, len(list_filter(range(1, {n} + 1), lambda k: k <= length({t}) AND strlen(substr({t}, 1, k)) <= {n}))) || '...' ELSE {t} END"
_REDACTED = lambda source, key: f"""SELECT {key}, CASE WHEN dg BETWEEN 10 AND 15 AND strlen(b) - dg <= 4 THEN '[PHONE]' ELSE b END AS redacted FROM (SELECT *, length(regexp_replace(b, '[^0-9]', '', 'g')) AS dg FROM
(SELECT {key}, CASE WHEN regexp_matches(a, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') THEN '[SSN]' ELSE a END AS b FROM (SELECT {key}, CASE WHEN contains(s, '.') AND regexp_matches(s, '^[^@]+@') THEN '[EMAIL]' || regexp_replace(s, '^[^@]+@', '@') ELSE s END AS a FROM
(SELECT {key}, {_CUT('text', 100)} AS s FROM {source}))))"""  # noqa: E731


@query(f"{_REDACTED('documents', 'doc_id')} UNION ALL {_REDACTED('(SELECT id::BIGINT AS doc_id, text FROM ' + _TEXTS.sql() + ')', 'doc_id')}")
def redact_text(spark, d):
    out = lambda df, key: df.select(F.col(key).cast("bigint").alias("doc_id"), V.redacted(F.col("text")).alias("redacted"))
    return out(table(spark, d, "documents"), "doc_id").union(out(_TEXTS.df(spark, d), "id"))


_N = "(o_orderkey % 900 + 10) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 100000 ELSE 100000000 END"


@query(f"SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1e9) WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS human FROM (SELECT o_orderkey, {_N} AS n FROM orders)")
def humanize(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.humanized(F.expr(_N)).alias("human"))


@query("SELECT o_orderkey, format('{:,}', o_orderkey * 12345) AS digits FROM orders")
def group_digits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.grouped_digits(F.col("o_orderkey") * 12345).alias("digits"))


@query("SELECT o_orderkey, CASE WHEN n // 3600 > 0 THEN (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' WHEN n // 60 > 0 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS duration, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE b || ' bytes' END AS size FROM (SELECT o_orderkey, floor(o_orderkey * 0.75 + 0.5)::BIGINT AS n, o_orderkey * o_orderkey * (o_orderkey % 7) AS b FROM orders)")
def durations_and_sizes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", V.duration_text(k * 0.75).alias("duration"), V.size_text(k * k * (k % 7)).alias("size"))


@query("SELECT o_orderkey, (4 * 3 * 2 * (o_custkey % 1000) * CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 * 100 ELSE 500 END)::BIGINT AS bytes FROM orders")
def memory_estimate(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", V.estimated_memory(F.lit(4), F.lit(3), F.col("o_custkey") % 1000, k % 3 * 100).alias("bytes"))


_BODY = "CASE doc_id % 3 WHEN 0 THEN 'error: Api-' || text WHEN 1 THEN text ELSE 'sk-abc token-' || md5(text) || ' and SECRET-x ' || text END"
_MASKED = _CUT("body", 200)
for _mark in ("sk-", "api-", "key-", "secret-", "token-"):
    _MASKED = f"regexp_replace({_MASKED}, '(?is){_mark}.{{0,40}}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, {_MASKED} AS redacted FROM (SELECT doc_id, {_BODY} AS body FROM documents)")
def redact_body(spark, d):
    return table(spark, d, "documents").select("doc_id", V.redacted_body(F.expr(_BODY)).alias("redacted"))


_KEY_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'x' || o_orderkey WHEN 1 THEN '-' || o_orderkey WHEN 2 THEN '99999999999999999999' WHEN 3 THEN o_orderkey || '.5' ELSE '' || o_orderkey END"


@query(f"SELECT o_orderkey, CASE WHEN regexp_full_match({_KEY_TEXT}, '[+-]?[0-9]+') THEN TRY_CAST({_KEY_TEXT} AS BIGINT) END AS key_number, CASE WHEN o_orderkey < o_custkey THEN -1 WHEN o_orderkey > o_custkey THEN 1 ELSE 0 END AS compared FROM orders")
def key_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.key_number(F.expr(_KEY_TEXT)).alias("key_number"), V.compared_keys(F.col("o_orderkey"), F.col("o_custkey")).alias("compared"))


@query("""SELECT c_custkey, '[' || replace(n, ']', ']]') || ']' AS mssql, '"' || replace(n, '"', '""') || '"' AS postgres, '`' || replace(n, '`', '``') || '`' AS mysql,
CASE WHEN c_custkey % 2 = 0 THEN 'SEGMENT_' || c_custkey ELSE '"' || upper(replace(n, '"', '""')) || '"' END AS oracle FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'segment_' || c_custkey ELSE c_name || ' ]"`' END AS n FROM customer)""")
def quoted_names(spark, d):
    name = F.expr("""CASE WHEN c_custkey % 2 = 0 THEN 'segment_' || c_custkey ELSE c_name || ' ]"`' END""")
    return table(spark, d, "customer").select("c_custkey", *[dialects.quoted(name, c).alias(c) for c in ("mssql", "postgres", "mysql", "oracle")])


_CATALOG_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
_AS_TEXT = {"postgres": ('"{0}"', 'ST_AsText("{0}") AS "{0}"', '"geo"."{0}"'), "mssql": ("[{0}]", "[{0}].STAsText() AS [{0}]", "[geo].[{0}] WITH (NOLOCK)"), "mysql": ("`{0}`", "ST_AsText(`{0}`) AS `{0}`", "`geo`.`{0}`")}
_SPATIAL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS connector, '{t}' AS table_name, 'SELECT ' || string_agg(CASE WHEN column_type = 'VARCHAR' THEN replace('{text}', '{{0}}', column_name) ELSE replace('{plain}', '{{0}}', column_name) END, ', ') || ' FROM {place.format(t)}' AS sql FROM (DESCRIBE {t})"
    for c, (plain, text, place) in _AS_TEXT.items()
    for t in _CATALOG_TABLES
)


@query(_SPATIAL_SQL)
def spatial_projection(spark, d):
    """The queries that would read every table of the folder, were its texts geometries."""
    kinds = {t: [(c, "geometry" if k == "string" else k) for c, k in table(spark, d, t).dtypes] for t in tables.list_folder(spark, d)}
    rows = [(c, t, dialects.dialect(c).read_query("geo", t, columns, "other")) for c in _AS_TEXT for t, columns in kinds.items()]
    return spark.createDataFrame(rows, "connector string, table_name string, sql string")


_WORDS = Derived(f"SELECT p_partkey, {_word('Order,id,User,title,rowid,SESSION,desc,description,view,start', 'p_partkey')} || CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS name FROM {{part}}")


@query(f"SELECT p_partkey, name, lower(name) IN ('order', 'user', 'desc', 'view') AS reserved, lower(name) IN ('order', 'user', 'desc', 'view', 'rowid', 'session', 'start') AS reserved_oracle FROM {_WORDS.sql()}")
def reserved_words(spark, d):
    return _WORDS.df(spark, d).select("p_partkey", "name", V.is_reserved(F.col("name")).alias("reserved"), V.is_reserved(F.col("name"), "oracle").alias("reserved_oracle"))


_DDL = """'CREATE TABLE t (id BIGINT NOT NULL, c' || p_size || ' VARCHAR(' || p_partkey || ') NULL DEFAULT 2, "big one" DECIMAL(' || (p_size + 2) || ', 2), d DATE DEFAULT now())'"""
_ASKED = "CASE p_partkey % 5 WHEN 0 THEN 'id' WHEN 1 THEN 'c' || p_size WHEN 2 THEN 'big one' WHEN 3 THEN 'd' ELSE 'none' END"


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'VARCHAR(' || p_partkey || ')' WHEN 2 THEN 'DECIMAL(' || (p_size + 2) || ', 2)' WHEN 3 THEN 'DATE' END AS kind FROM part")
def ddl_types(spark, d):
    return table(spark, d, "part").select("p_partkey", V.ddl_type(F.expr(_DDL), F.expr(_ASKED)).alias("kind"))


_ALL_TABLES = _CATALOG_TABLES


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _ALL_TABLES))
def table_list(spark, d):
    return tables.footer_counts({t: table(spark, d, t) for t in tables.list_folder(spark, d)})


_CONSTRAINTS = Derived("SELECT 'pk_' || p_brand AS constraint_name, p_brand AS table_name, 'PRIMARY KEY' AS constraint_type FROM {part} GROUP BY p_brand UNION ALL SELECT 'uq_' || p_brand, p_brand, 'UNIQUE' FROM {part} GROUP BY p_brand")
_KEY_USAGE = Derived("SELECT CASE WHEN p_size < 6 THEN 'pk_' ELSE 'uq_' END || p_brand AS constraint_name, p_brand AS table_name, 'c' || p_size AS column_name, 10 - p_size AS pos FROM {part} WHERE p_size < 9 GROUP BY p_brand, p_size")
_COLUMN_ROWS = Derived("SELECT p_brand AS table_name, 'c' || p_size AS column_name, CASE WHEN p_size % 2 = 0 THEN 'bigint' ELSE 'string' END AS type_name, p_size AS ordinal FROM {part} GROUP BY p_brand, p_size")
_PRIMARY = f"(SELECT c.table_name, k.column_name, k.pos FROM {_CONSTRAINTS.sql()} c JOIN {_KEY_USAGE.sql()} k ON c.constraint_name = k.constraint_name AND c.table_name = k.table_name WHERE constraint_type = 'PRIMARY KEY')"


@query(f"SELECT table_name, string_agg(column_name, ',' ORDER BY pos) AS cols FROM {_PRIMARY} GROUP BY table_name")
def primary_keys(spark, d):
    return tables.primary_keys(_CONSTRAINTS.df(spark, d), _KEY_USAGE.df(spark, d))


@query(f"SELECT c.*, p.pos AS key_pos FROM {_COLUMN_ROWS.sql()} c LEFT JOIN {_PRIMARY} p ON c.table_name = p.table_name AND c.column_name = p.column_name")
def described_columns(spark, d):
    return tables.described(_COLUMN_ROWS.df(spark, d), _CONSTRAINTS.df(spark, d), _KEY_USAGE.df(spark, d))


def _engine(spark: SparkSession, source: str, specs: list, **more) -> Engine:
    """An engine with a new target and state in the shared folder."""
    base = f"{storage.shared_dir(spark)}/tideway/run-{uuid.uuid4().hex}"
    return Engine(spark, source, f"{base}/target", f"{base}/state.json", specs, **more)


@query("SELECT * FROM orders")
def engine_reload(spark, d):
    """A reload in four key splits, read back from the target."""
    e = _engine(spark, d, [catalog.TableSpec("orders", ("o_orderkey",))], threshold=1000, chunk=100, most=4)
    assert e.run()["status"] == "success"
    return e.current("orders")


@query("SELECT * FROM lineitem")
def engine_reload_whole(spark, d):
    e = _engine(spark, d, [catalog.TableSpec("lineitem")])
    assert e.run()["status"] == "success"
    return e.current("lineitem")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 50 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 100 = 1")
def engine_upsert(spark, d):
    """A reload of the table, then an upsert of changed and new rows that rewrites only the buckets they fall into."""
    spec = catalog.TableSpec("customer", ("c_custkey",))
    e = _engine(spark, d, [spec], bucket_rows=1500)
    assert e.run()["status"] == "success"
    rows = table(spark, d, "customer")
    changed = rows.where("c_custkey % 50 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    e.upsert("customer", changed.unionByName(rows.where("c_custkey % 100 = 1").withColumn("c_custkey", F.col("c_custkey") + 1000000000)))
    return e.current("customer")


@query("SELECT 'customer' AS table_name, count(*) AS n_rows, FALSE AS exclude, '' AS date_columns FROM customer UNION ALL SELECT 'events', count(*), FALSE, 'ts' FROM events UNION ALL SELECT 'orders', count(*), FALSE, 'o_orderdate' FROM orders")
def analyze_tables(spark, d):
    e = _engine(spark, d, [catalog.TableSpec(t) for t in ("orders", "events", "customer")])
    return e.analyze().select("table_name", "n_rows", "exclude", "date_columns")


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short, substr(sha256(text), 1, 16) AS config_hash, upper(substr(text, 1, 1)) || substr(text, 2) AS capitalized FROM documents")
def truncate_and_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", V.truncated(t, 50).alias("short"), V.short_hash(t).alias("config_hash"), V.capitalized(t).alias("capitalized"))


@query(f"SELECT task_id, regexp_extract(task_key, '^transfer:(.*?)(?::p[0-9]+)?$', 1) AS table_name, CAST(nullif(regexp_extract(task_key, ':p([0-9]+)$', 1), '') AS BIGINT) AS part, task_key AS rebuilt FROM {_TASKS.sql()}")
def task_key_parse(spark, d):
    return _TASKS.df(spark, d).select("task_id", V.task_table(F.col("task_key")).alias("table_name"), V.task_part(F.col("task_key")).alias("part"), V.task_key(V.task_table(F.col("task_key")), V.task_part(F.col("task_key"))).alias("rebuilt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' END AS again FROM events")
def adjustments_json(spark, d):
    parsed = V.adjustments(F.col("props"))
    own = V.adjustments(F.when(F.col("event_id") % 3 != 0, F.col("props")).otherwise(F.lit("not json")))
    return table(spark, d, "events").select("event_id", F.try_element_at(parsed, F.lit("k")).alias("k"), V.adjustments_text(own).alias("again"))


_TYPE = "CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'INTEGER' THEN 'int' WHEN column_type = 'FLOAT[]' THEN 'array<float>' WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(column_type) END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, {_TYPE} AS type_name, (row_number() OVER ())::INTEGER AS ordinal FROM (DESCRIBE {t})" for t in _ALL_TABLES))
def catalog_columns(spark, d):
    return catalog.catalog(spark, {t: table(spark, d, t) for t in _ALL_TABLES}).select("table_name", "column_name", "type_name", "ordinal")


_UPDATES = Derived("SELECT event_id AS task_id, 9 * user_id AS last_key, event_id AS rows_done, event_id + 7 AS rows_total FROM {events} WHERE event_id % 9 = 2")


@query(f"SELECT * FROM {_PROGRESS.sql()} WHERE task_id % 9 <> 2 AND task_id % 11 <> 4 UNION ALL SELECT * FROM {_UPDATES.sql()} WHERE task_id % 11 <> 4")
def progress_saved_and_cleared(spark, d):
    saved = state.saved_progress(_PROGRESS.df(spark, d), _UPDATES.df(spark, d))
    return state.cleared_progress(saved, table(spark, d, "events").where("event_id % 11 = 4").select(F.col("event_id").alias("task_id")))


_NEW_TASKS = Derived("SELECT event_id + 1000000000 AS task_id, 'r' || CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 - event_id END AS run_id, 'transfer:' || event_type || '.t' || (user_id % 20) AS task_key, 'pending' AS status, CAST(NULL AS STRING) AS error FROM {events} WHERE event_id % 7 = 0")


@query(f"SELECT * FROM {_TASKS.sql()} UNION ALL SELECT n.* FROM {_NEW_TASKS.sql()} n ANTI JOIN {_TASKS.sql()} t ON n.run_id = t.run_id AND n.task_key = t.task_key")
def tasks_created(spark, d):
    return state.created_tasks(_TASKS.df(spark, d), _NEW_TASKS.df(spark, d))


@query(f"SELECT r.run_id, started_at, completed_at, r.status, count(t.task_id) AS total, count(*) FILTER (t.status = 'pending') AS pending, count(*) FILTER (t.status = 'running') AS running, count(*) FILTER (t.status = 'success') AS success, count(*) FILTER (t.status = 'failed') AS failed FROM {_RUNS.sql()} r LEFT JOIN {_TASKS.sql()} t ON r.run_id = t.run_id GROUP BY ALL")
def run_history(spark, d):
    return state.history(_RUNS.df(spark, d), _TASKS.df(spark, d))


@query("SELECT c_custkey, c_name AS opened, TRUE AS sealed FROM customer")
def sealed_profiles(spark, d):
    key, profile = F.lit(b"0123456789abcdef"), F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", V.encrypted(F.col("c_name"), key, profile).alias("s"))
    return rows.select("c_custkey", V.decrypted(F.col("s"), key, profile).alias("opened"), (F.col("s") != F.col("c_name")).alias("sealed"))


@query("SELECT o_orderkey, (SELECT count(*) > 15 FROM orders) AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15)")
def capped_rows(spark, d):
    few, more = analyze.capped(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return few.withColumn("truncated", F.lit(more))


@query("SELECT t AS table_name, n AS n_rows, CASE WHEN n <= 2000 THEN 'full_table' WHEN t = 'conversations' THEN 'row_number' WHEN t = 'lineitem' THEN 'full_table' ELSE 'keyset' END AS method, CASE WHEN n <= 2000 OR t = 'lineitem' THEN 1 ELSE least(n // 1000 + 1, 6) END AS partitions FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'lineitem', count(*) FROM lineitem)")
def dry_run_plan(spark, d):
    specs = [catalog.TableSpec("orders", ("o_orderkey",)), catalog.TableSpec("conversations", ("conv_id", "turn")), catalog.TableSpec("nation", ("n_nationkey",)), catalog.TableSpec("lineitem")]
    rows = _engine(spark, d, specs).dry_run(2000, 1000, 6)
    return spark.createDataFrame([(r["table"], r["rows"], r["method"], r["partitions"]) for r in rows], "table_name string, n_rows bigint, method string, partitions bigint")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def keyset_reader(spark, d):
    """The whole table through the keyed source, a task for each range of row groups."""
    keyed.register(spark)
    return spark.read.format(keyed.NAME).options(path=f"{d}/orders.parquet", key="o_orderkey", splits="16").load().select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_orderkey <= 3000000 AND l_returnflag = 'R'")
def keyed_source_filtered(spark, d):
    """Comparisons with numbers reach the source, the other one stays."""
    keyed.register(spark)
    rows = spark.read.format(keyed.NAME).options(path=f"{d}/lineitem.parquet", key="l_orderkey").load()
    return rows.where("l_quantity > 45 and l_orderkey <= 3000000 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, user_id, event_type FROM events")
def keyed_stream(spark, d):
    """All rows of a growing table as a stream behind its last key, written by one batch and read back."""
    keyed.register(spark)
    base = f"{storage.shared_dir(spark)}/tideway/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.format(keyed.NAME).options(path=f"{d}/events.parquet", key="event_id").load()
    rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows").select("event_id", "user_id", "event_type")


@query("SELECT conv_id, turn FROM conversations")
def row_number_reader(spark, d):
    """A table with a key of two columns, read in ranges that together hold each row once."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return functools.reduce(DataFrame.union, [rows.where(r.where()) for r in ranges.equal_ranges(rows, ["conv_id", "turn"], 6)])


@query("SELECT 'conversations' AS table_name, count(*) AS n_rows, 0::BIGINT AS unplaced, TRUE AS balanced FROM conversations UNION ALL SELECT 'lineitem', count(*), 0, TRUE FROM lineitem")
def composite_ranges(spark, d):
    """Ranges of keys of several columns: no row is outside them, and none holds over twice the mean."""
    return _placed(spark, d, [("conversations", ["conv_id", "turn"]), ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])], lambda df, key: ranges.equal_ranges(df, key, 12))


@query("SELECT 'events' AS table_name, count(*) AS n_rows, 0::BIGINT AS unplaced, TRUE AS balanced FROM events")
def skewed_ranges(spark, d):
    """An integer key whose values crowd at one end, cut by histograms: equal widths would put nearly all rows into one split."""
    one = F.col("event_id").cast("decimal(19,0)")
    spread = one * one * one  # beyond a long from two million events on
    return _placed(spark, d, [("events", ["k"])], lambda df, key: ranges.refined(ranges.frame_counts(df, "k"), *df.agg(F.min("k"), F.max("k")).first(), 12, "k"), {"k": spread})


def _placed(spark: SparkSession, d: str, keys: list, plan: Callable, more: dict | None = None) -> DataFrame:
    out = []
    for t, key in keys:
        rows = table(spark, d, t).withColumns(more or {}).select(*key)
        found = plan(rows, key)
        sizes = ranges.counted(rows, found)
        inside = F.col("range") > 0
        one = sizes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(~inside, F.col("n_rows"))), F.lit(0)).alias("unplaced"), F.coalesce(F.max(F.col("n_rows")) <= ranges.HEAVY * F.sum("n_rows") / 12, F.lit(True)).alias("balanced"))
        out.append(one.select(F.lit(t).alias("table_name"), "n_rows", "unplaced", "balanced"))
    return functools.reduce(DataFrame.union, out)


@query("SELECT * FROM conversations")
def engine_reload_composite(spark, d):
    """A table with a key of two columns, reloaded in splits of two steps each."""
    e = _engine(spark, d, [catalog.TableSpec("conversations", ("conv_id", "turn"))], threshold=100, chunk=50, most=3, steps=2)
    out = e.run()
    assert out["status"] == "success" and not out["warnings"]
    return e.current("conversations")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def engine_growing(spark, d):
    """A table that grows twenty times by upserts; its buckets split on the way."""
    base = f"{storage.shared_dir(spark)}/tideway/grow-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    n = max(1, orders.count() // 20)
    orders.where("o_orderkey % 20 = 0").write.parquet(f"{base}/orders.parquet")
    e = _engine(spark, base, [catalog.TableSpec("orders", ("o_orderkey",))], bucket_rows=n)
    assert e.run()["status"] == "success"
    for part in ("o_orderkey % 20 in (1, 2, 3)", "o_orderkey % 20 between 3 and 10", "o_orderkey % 20 > 9"):
        e.upsert("orders", orders.where(part))
    version = e.folder.version("orders")
    assert version["buckets"] > 10 and max(version["rows"].values()) < 4 * n + 100
    return e.current("orders")


@query("SELECT * FROM orders")
def engine_idle_sync(spark, d):
    """A loaded table and a sync after it that finds no row changed since: nothing is written."""
    base = f"{storage.shared_dir(spark)}/tideway/run-{uuid.uuid4().hex}"
    specs = [catalog.TableSpec("orders", ("o_orderkey",), "o_orderdate")]
    e, sync = (Engine(spark, d, f"{base}/target", f"{base}/state.json", specs, mode) for mode in ("reload", "upsert"))
    assert e.run()["status"] == "success"
    sync.state = e.state
    assert sync.run()["status"] == "success" and sync.folder.version("orders")["number"] == 1
    return sync.current("orders")


@query("SELECT event_id, user_id, value FROM events")
def engine_stream(spark, d):
    """A table that is loaded in part and then merged from a stream of its rows, those that it has included."""
    keyed.register(spark)
    base = f"{storage.shared_dir(spark)}/tideway/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").where("event_id % 3 = 0").select("event_id", "user_id", F.lit(0.0).alias("value")).write.parquet(f"{base}/events.parquet")
    e = _engine(spark, base, [catalog.TableSpec("events", ("event_id",))], bucket_rows=50_000)
    assert e.run()["status"] == "success"
    changes = spark.readStream.format(keyed.NAME).options(path=f"{d}/events.parquet", key="event_id").load().select("event_id", "user_id", "value")
    incremental.merge_stream(changes, e, "events", f"{base}/checkpoint").awaitTermination()
    return e.current("events")
