"""Databases through Spark's JDBC source and sink."""

from __future__ import annotations

import contextlib
import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.catalog import DATE_TYPES, TableSpec
from tideway.plans.ranges import KeyRange, ansi_literal, literal, refined, stored_cuts
from tideway.plans.splits import Split
from tideway.sources.dialects import ROW_STATISTICS, SPATIAL, Dialect

#: What a JDBC URL calls a connector.
_BY_URL = {"postgresql": "postgres", "sqlserver": "mssql", "mysql": "mysql", "mariadb": "mysql", "oracle": "oracle"}


def dialect_of(options: dict) -> Dialect:
    kind = options["url"].split(":")[1]
    return Dialect(_BY_URL.get(kind, kind))


def read_table(spark: SparkSession, table: str, options: dict, key: str | None = None, splits: list[Split] | None = None, ranges: list[KeyRange] = ()) -> DataFrame:
    """A table, or one partition for each split or range of its key; filters and columns are pushed to the database."""
    url = options["url"]
    rest = {k: v for k, v in options.items() if k != "url"}
    if key and splits:
        own = dialect_of(options)
        return spark.read.jdbc(url, table, predicates=[own.predicate(key, s) for s in splits], properties=rest)
    if ranges:
        own = dialect_of(options)
        write = literal if own.name == "mysql" else ansi_literal
        return spark.read.jdbc(url, table, predicates=[r.predicate(own.quote, write) for r in ranges], properties=rest)
    return spark.read.jdbc(url, table, properties=rest)


def key_ranges(spark: SparkSession, table: str, options: dict, key: list[str], n: int) -> list[KeyRange]:
    """At most n ranges of about equal rows, planned by the database: histograms of an integer key, else every so many rows in key order.

    Texts are cut in the database's own order, which its collation gives. Where it can't number rows, Spark reads the keys.
    """
    own, df = dialect_of(options), read_table(spark, table, options)
    names = [own.quote(k) for k in key]
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        low, high = query_rows(spark, options, f"SELECT MIN({names[0]}) AS lo, MAX({names[0]}) AS hi FROM {table}")[0]
        if low is None:
            return [KeyRange(1, tuple(key), n_rows=0)]
        cell = {"mysql": "({k} - {low}) DIV {width}", "oracle": "FLOOR(({k} - {low}) / {width})"}.get(own.name, "({k} - {low}) / {width}")

        def count(low: int, width: int, end: int) -> dict[int, int]:
            at = cell.format(k=names[0], low=low, width=width)
            return {int(r[0]): int(r[1]) for r in query_rows(spark, options, f"SELECT c, COUNT(*) AS n FROM (SELECT {at} AS c FROM {table} WHERE {names[0]} >= {low} AND {names[0]} < {end}) q GROUP BY c")}

        return refined(count, low, high, n, key[0])
    if own.name == "derby":
        return stored_cuts(df, key, n)
    rows = int(scalar(spark, options, f"SELECT COUNT(*) AS n FROM {table}"))
    size = max(1, -(-rows // n))
    cols = ", ".join(names)
    rest = "MOD(rn, {0})".format(size) if own.name != "mssql" else f"rn % {size}"
    tops = query_rows(spark, options, f"SELECT {cols} FROM (SELECT {cols}, ROW_NUMBER() OVER (ORDER BY {cols}) AS rn FROM {table}) q WHERE {rest} = 0 AND rn < {rows} ORDER BY {cols}")
    edges = [None, *map(tuple, tops), None]
    return [KeyRange(i + 1, tuple(key), a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def write_table(df: DataFrame, table: str, options: dict, mode: str = "append", batch: int = 10_000) -> None:
    rest = {k: v for k, v in options.items() if k != "url"} | {"batchsize": str(batch)}
    df.write.jdbc(options["url"], table, mode=mode, properties=rest)


@contextlib.contextmanager
def connection(spark: SparkSession, options: dict):
    """A connection of the driver's own, closed at the end."""
    jvm = spark.sparkContext._jvm
    if options.get("driver"):
        jvm.java.lang.Class.forName(options["driver"])
    own = jvm.java.util.Properties()
    for k, v in options.items():
        if k not in ("url", "driver", "dbtable"):
            own.setProperty(k, str(v))
    con = jvm.java.sql.DriverManager.getConnection(options["url"], own)
    try:
        yield con
    finally:
        con.close()


def execute(spark: SparkSession, options: dict, *statements: str) -> list[int]:
    """Run statements in one transaction of the database; rows that each changed."""
    with connection(spark, options) as con:
        try:
            con.setAutoCommit(False)
            statement = con.createStatement()
            done = [statement.executeUpdate(s) for s in statements]
            con.commit()
            return done
        except Exception:
            con.rollback()
            raise


def run(spark: SparkSession, options: dict, statement: str) -> None:
    """Run one statement that may or may not give rows."""
    with connection(spark, options) as con:
        con.createStatement().execute(statement)


def table_exists(spark: SparkSession, options: dict, table: str) -> bool:
    """Whether the database answers a query for the table; other errors than its absence come up with the query that follows."""
    rest = {k: v for k, v in options.items() if k != "url"}
    try:
        spark.read.jdbc(options["url"], f"(SELECT * FROM {table} WHERE 1 = 0) tideway_q", properties=rest)
    except Exception:
        return False
    return True


def ping(spark: SparkSession, options: dict) -> None:
    """Open a connection and close it."""
    execute(spark, options)


def scalar(spark: SparkSession, options: dict, query: str):
    """The single value of a query that the database runs."""
    return query_rows(spark, options, query)[0][0]


def query_rows(spark: SparkSession, options: dict, query: str) -> list:
    """The few rows of a query that the database runs."""
    own = {k: v for k, v in options.items() if k != "dbtable"}
    return spark.read.format("jdbc").options(**own).option("query", query).load().collect()


def stage(df: DataFrame, table: str, options: dict, tries: int = 2) -> int:
    """Fill a staging table anew, with the types that tables here have; returns its rows. Spark writes each partition in a transaction, and a task that is lost after
    it may come twice, so the table is counted against the rows that finished tasks wrote and filled again if they differ."""
    columns = ", ".join(f"{dialect_of(options).quote(f.name)} {dialect_of(options).type_of(f.dataType)}" for f in df.schema)
    for _ in range(tries):
        seen = Observation()
        execute(df.sparkSession, options, *([f"DROP TABLE {table}"] if table_exists(df.sparkSession, options, table) else []), f"CREATE TABLE {table} ({columns})")
        write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), table, options)
        n = scalar(df.sparkSession, options, f"SELECT COUNT(*) AS n FROM {table}")
        if n == seen.get["n"]:
            return n
    raise RuntimeError(f"staging table {table} has {n} rows where {seen.get['n']} were written")


def estimated_count(spark: SparkSession, options: dict, schema: str, table: str) -> int | None:
    """The rows of a table by the statistics that its database keeps; None where it keeps none, or none yet."""
    query = ROW_STATISTICS.get(dialect_of(options).name)
    if query is None:
        return None
    n = scalar(spark, options, query.format(schema=ansi_literal(schema), table=ansi_literal(table)))
    return int(n) if n is not None and n > 0 else None


def tiered_count(spark: SparkSession, options: dict, schema: str, table: str) -> int:
    """The database's own estimate if it has one, else the exact count."""
    found = estimated_count(spark, options, schema, table)
    return found if found is not None else int(scalar(spark, options, f"SELECT COUNT(*) AS n FROM {dialect_of(options).table(schema, table)}"))


def live_catalog(spark: SparkSession, options: dict, schema: str) -> dict[str, list[tuple]]:
    """tables (name), columns (table, column, type, ordinal, nullable), keys (table, column, place) and references
    (table, constraint, place, column, other table, other column) of a schema, as any JDBC driver tells them."""

    def told(ask, *names: str) -> list[tuple]:
        found, out = ask(), []
        try:
            while found.next():
                out.append(tuple(found.getString(n) for n in names))
        finally:
            found.close()
        return out

    with connection(spark, options) as con:
        meta, any_ = con.getMetaData(), None
        kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        # a catalog is what MySQL calls a schema
        catalog = schema if dialect_of(options).name == "mysql" else any_
        schema = any_ if dialect_of(options).name == "mysql" else schema or any_
        names = [r[0] for r in told(lambda: meta.getTables(catalog, schema, "%", kinds), "TABLE_NAME")]
        columns = [(t, c, k, int(n), x != "NO") for t, c, k, n, x in told(lambda: meta.getColumns(catalog, schema, "%", "%"), "TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "ORDINAL_POSITION", "IS_NULLABLE") if t in set(names)]
        keys = [(t, c, int(n)) for name in names for t, c, n in told(lambda name=name: meta.getPrimaryKeys(catalog, schema, name), "TABLE_NAME", "COLUMN_NAME", "KEY_SEQ")]
        references = [(t, x, int(n), c, o, k) for name in names for t, x, n, c, o, k in told(lambda name=name: meta.getImportedKeys(catalog, schema, name), "FKTABLE_NAME", "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")]
    return {"tables": sorted(names), "columns": columns, "keys": keys, "references": references}


def specs_of(spark: SparkSession, options: dict, schema: str, dates: list[str] = (), target_schema: str = "") -> list[TableSpec]:
    """What the engine needs to know of each table of a schema: its key, source types, foreign keys, and the first of `dates` that it has as a date column."""
    found, own = live_catalog(spark, options, schema), dialect_of(options)
    out = []
    for t in found["tables"]:
        columns = {c: k.lower() for x, c, k, *_ in found["columns"] if x == t}
        low = {c.lower(): c for c, k in columns.items() if k in DATE_TYPES}
        key = tuple(c for _, c, _n in sorted((r for r in found["keys"] if r[0] == t), key=lambda r: r[2]))
        foreign: dict[str, list] = {}
        for x, name, n, c, other, k in found["references"]:
            if x == t:
                foreign.setdefault(name, []).append((n, c, other, k))
        links = tuple((tuple(c for _, c, _o, _k in sorted(of)), of[0][2], tuple(k for *_, k in sorted(of))) for of in foreign.values())
        spatial = tuple(c for c, k in columns.items() if k in SPATIAL.get(own.name, ((), ""))[0])
        date = next((low[d.lower()] for d in dates if d.lower() in low), None)
        out.append(TableSpec(t, key, date, spatial, links, format="jdbc", options=options | {"dbtable": own.table(schema, t)}, schema=schema, target_schema=target_schema, kinds=columns))
    return out


def staging_name(table: str, writer: str = "0", most: int = 60) -> str:
    """The staging table of one writer; a hash stands for the end of a name that would be too long."""
    name = f"stg_{table}_{writer}"
    return name if len(name) <= most else f"{name[: most - 17]}_{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def upsert_table(df: DataFrame, schema: str, table: str, key: list[str], options: dict, writer: str = "0") -> int:
    """Merge rows into a database table: executors fill a staging table, then one statement of the database merges it. Returns the rows that it changed."""
    own, spark = dialect_of(options), df.sparkSession
    staging = own.table(schema, staging_name(table, writer))
    write_table(df, staging, options, "overwrite")
    try:
        return execute(spark, options, own.upsert(schema, table, staging, df.columns, key))[0]
    finally:
        execute(spark, options, f"DROP TABLE {staging}")
