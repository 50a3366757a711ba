"""Tables, columns and keys; connector registry; type and identifier rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Connector name, aliases, JDBC URL pattern, default port, default schema.
CONNECTORS = {
    "postgres": (("pg", "postgresql"), "jdbc:postgresql://{host}:{port}/{database}", 5432, "public"),
    "mssql": (("sqlserver", "sql-server"), "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "dbo"),
    "mysql": (("mariadb", "maria"), "jdbc:mysql://{host}:{port}/{database}", 3306, ""),
    "oracle": (("ora", "oracledb"), "jdbc:oracle:thin:@//{host}:{port}/{database}", 1521, ""),
}
#: Types of a key that pages can follow; Oracle's number counts if it has no scale.
INTEGER_TYPES = (
    "int",
    "bigint",
    "smallint",
    "tinyint",
    "integer",
    "serial",
    "bigserial",
    "smallserial",
    "int4",
    "int8",
    "int2",
)
#: Types of date columns.
DATE_TYPES = ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "timestamp", "timestamptz", "timestamp_ntz", "timestamp without time zone", "timestamp with time zone")


@dataclass(frozen=True)
class TableSpec:
    """A table to move: its data are a DataFrame, its keys are declared here as files have none. kinds are source types of columns whose values are normalised, identity a column that the target numbers itself."""

    name: str
    key: tuple[str, ...] = ()
    date_column: str | None = None
    spatial: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    checks: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    schema: str = ""
    target_schema: str = ""
    kinds: dict = field(default_factory=dict)
    srid: int = 4326
    identity: str = ""

    @property
    def mark(self) -> str:
        """What a sync mark belongs to: source schema, table and target schema."""
        return "|".join((self.schema, self.name, self.target_schema))


def canonical(name: str) -> str:
    """The connector's own name; names and aliases are matched without case."""
    low = name.strip().lower()
    for own, (aliases, *_) in connectors().items():
        if low == own or low in aliases:
            return own
    raise ValueError(f"unknown connector {name!r}; available: {', '.join(available())}")


#: How a connector's own words for its connection security are called by its JDBC driver.
MYSQL_SSL = {"disable": "DISABLED", "disabled": "DISABLED", "false": "DISABLED", "require": "REQUIRED", "required": "REQUIRED", "true": "REQUIRED", "verify-ca": "VERIFY_CA", "verify_ca": "VERIFY_CA", "verify-full": "VERIFY_IDENTITY", "verify_full": "VERIFY_IDENTITY", "verify-identity": "VERIFY_IDENTITY", "verify_identity": "VERIFY_IDENTITY"}


def jdbc_options(connector: str, host: str, database: str, user: str, password: str, port: int | None = None, options: dict | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source; credentials stay out of the URL. options are the connector's own: sslmode, encrypt,
    trustServerCertificate, packetSize, ssl_mode, charset, collation, loc, service_name, tns_connect."""
    name, more = canonical(connector), options or {}
    _, url, default, _ = connectors()[name]
    out = {"url": url.format(host=host, port=port or default, database=more.get("service_name") or database), "user": user, "password": password}
    if name == "postgres":
        out["sslmode"] = more.get("sslmode") or "prefer"
    elif name == "mssql":
        out |= {k: str(more[k]).lower() for k in ("encrypt", "trustServerCertificate", "packetSize") if k in more}
    elif name == "mysql":
        out["sslMode"] = MYSQL_SSL.get(str(more.get("ssl_mode", "")).lower(), "PREFERRED")
        out["characterEncoding"] = {"utf8mb4": "UTF-8", "utf8": "UTF-8"}.get(more.get("charset", "utf8mb4"), more.get("charset"))
        out["connectionTimeZone"] = more.get("loc") or "UTC"
        out |= {"connectionCollation": more["collation"]} if more.get("collation") else {}
    elif name == "oracle":
        out |= {"oracle.jdbc.defaultRowPrefetch": "5000", "fetchsize": "5000"}
        if more.get("tns_connect"):
            out["url"] = f"jdbc:oracle:thin:@{more['tns_connect']}"
    return out


def columns_of(df: DataFrame, table: str) -> list[tuple]:
    """(table, column, type, ordinal, nullable) in ordinal order."""
    return [(table, f.name, f.dataType.simpleString(), i + 1, f.nullable) for i, f in enumerate(df.schema.fields)]


COLUMNS = "table_name string, column_name string, type_name string, ordinal int, nullable boolean"


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns of all tables as rows."""
    return spark.createDataFrame([r for name in sorted(tables) for r in columns_of(tables[name], name)], COLUMNS)


def sanitized(name: Column) -> Column:
    """Target naming: small letters, '_' for all but letters, digits and '_', 'col_' before a leading digit or nothing."""
    clean = F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}_]", "_")
    return F.when(clean.rlike(r"^\p{Nd}") | (clean == ""), F.concat(F.lit("col_"), clean)).otherwise(clean)


def sanitize_name(name: str) -> str:
    clean = "".join(c if c.isalpha() or c.isdecimal() or c == "_" else "_" for c in name.lower())
    return "col_" + clean if not clean or clean[0].isdecimal() else clean


def renamed(df: DataFrame) -> DataFrame:
    """df with target names; two columns that get one name are an error."""
    names = [sanitize_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns collide after renaming: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def valid_identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_ $#]{0,127}$")


def identifier_changes(columns: DataFrame) -> DataFrame:
    """Renamed columns of catalog rows: (table_name, old_name, new_name)."""
    return columns.select("table_name", F.col("column_name").alias("old_name"), sanitized(F.col("column_name")).alias("new_name")).where("old_name <> new_name")


def change_totals(columns: DataFrame) -> DataFrame:
    """One row of totals over catalog rows: tables and columns that get another name, tables with and without any change."""
    new = lambda c: sanitized(F.col(c)) != F.col(c)
    tables = columns.groupBy("table_name").agg(F.count_if(new("column_name")).alias("n")).withColumn("own", new("table_name"))
    touched = F.col("own") | (F.col("n") > 0)
    return tables.agg(F.count_if("own").alias("table_changes"), F.coalesce(F.sum("n"), F.lit(0)).alias("column_changes"), F.count_if(touched).alias("tables_with_changes"), F.count_if(~touched).alias("tables_unchanged"))


#: Connectors that users add, by name, beside the fixed ones.
_ADDED: dict[str, tuple] = {}


def register(name: str, aliases: tuple[str, ...], url: str, port: int, schema: str = "") -> None:
    """Add a connector; a name or alias that is taken, whatever its case, is an error."""
    low, known = name.strip().lower(), {n for own, (more, *_) in connectors().items() for n in (own, *more)}
    if taken := known & {low, *(a.lower() for a in aliases)}:
        raise ValueError(f"connector names are taken: {', '.join(sorted(taken))}")
    _ADDED[low] = (tuple(a.lower() for a in aliases), url, port, schema)


def connectors() -> dict[str, tuple]:
    return CONNECTORS | _ADDED


def available() -> list[str]:
    return sorted(connectors())


def keyset_eligible(type_name: Column, scale: Column, n_key: Column) -> Column:
    """One key column of an integer type; a number of scale 0 counts."""
    low = F.lower(type_name)
    return (n_key == 1) & (low.isin(*INTEGER_TYPES) | ((low == "number") & (F.coalesce(scale, F.lit(0)) == 0)))


#: Source type to Spark type; decimals take precision and scale.
SPARK_TYPES = {
    "bit": T.BooleanType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "tinyint": T.ShortType(), "smallint": T.ShortType(), "int2": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(),
    "int4": T.IntegerType(), "mediumint": T.IntegerType(), "serial": T.IntegerType(), "bigint": T.LongType(), "int8": T.LongType(), "bigserial": T.LongType(), "float": T.DoubleType(), "double precision": T.DoubleType(),
    "double": T.DoubleType(), "float8": T.DoubleType(), "real": T.FloatType(), "float4": T.FloatType(), "money": T.DecimalType(19, 4), "smallmoney": T.DecimalType(10, 4), "date": T.DateType(), "time": T.StringType(),
    "datetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "datetimeoffset": T.TimestampType(), "timestamptz": T.TimestampType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "image": T.BinaryType(), "bytea": T.BinaryType(), "blob": T.BinaryType(), "raw": T.BinaryType(),
}


def spark_type(source: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type of a source type. Decimals beyond 38 digits stay text, and so does every other type not listed."""
    low = source.strip().lower()
    if low in ("decimal", "numeric", "number"):
        p, s = precision or 38, scale or 0
        return T.StringType() if p > 38 else T.LongType() if s == 0 and p <= 18 else T.DecimalType(p, s)
    return SPARK_TYPES.get(low, T.StringType())
