"""What databases want in SQL that goes to them: quoting, read hints, spatial columns, catalog queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.catalog import canonical
from tideway.plans.splits import Split

#: Oracle's reserved words that commonly stand as names.
ORACLE_WORDS = frozenset(
    """
    ACCESS ADD ALL ALTER AND
    ANY AS ASC AUDIT BETWEEN
    BY CHAR CHECK CLUSTER COLUMN
    COMMENT COMPRESS CONNECT CREATE CURRENT
    DATE DECIMAL DEFAULT DELETE DESC
    DISTINCT DROP ELSE EXCLUSIVE EXISTS
    FILE FLOAT FOR FROM GRANT
    GROUP HAVING IDENTIFIED IMMEDIATE IN
    INCREMENT INDEX INITIAL INSERT INTEGER
    INTERSECT INTO IS LEVEL LIKE
    LOCK LONG MAXEXTENTS MINUS MLSLABEL
    MODE MODIFY NOAUDIT NOCOMPRESS NOT
    NOWAIT NULL NUMBER OF OFFLINE
    ON ONLINE OPTION OR ORDER
    PCTFREE PRIOR PUBLIC RAW RENAME
    RESOURCE REVOKE ROW ROWID ROWNUM
    ROWS SELECT SESSION SET SHARE
    SIZE SMALLINT START SUCCESSFUL SYNONYM
    SYSDATE TABLE THEN TO TRIGGER
    UID UNION UNIQUE UPDATE USER
    VALIDATE VALUES VARCHAR VARCHAR2 VIEW
    WHENEVER WHERE WITH
    NAME TYPE VALUE KEY TIME
    TIMESTAMP YEAR MONTH DAY HOUR
    MINUTE SECOND ZONE DATA RESULT
    """.split()
)
#: Spatial types, and how each database gives their text.
SPATIAL = {
    "postgres": (("geography", "geometry"), "ST_AsText({0}) AS {0}"),
    "mssql": (("geography", "geometry"), "{0}.STAsText() AS {0}"),
    "mysql": (("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection"), "ST_AsText({0}) AS {0}"),
    "oracle": (("sdo_geometry",), "SDO_UTIL.TO_WKTGEOMETRY({0}) AS {0}"),
}
#: How each database reads a spatial value from its text.
SPATIAL_SINK = {
    "postgres": "ST_GeomFromText({0}, {srid})",
    "mssql": "{kind}::STGeomFromText({0}, {srid})",
    "mysql": "ST_GeomFromText({0}, {srid})",
    "oracle": "SDO_GEOMETRY({0}, {srid})",
}
SPATIAL_TYPES = {"postgres": "GEOMETRY", "mssql": "GEOMETRY", "mysql": "GEOMETRY", "oracle": "SDO_GEOMETRY"}
#: How each database sets what a generated key goes on with.
IDENTITY = {
    "postgres": "SELECT setval(pg_get_serial_sequence({text}, {name}), {value}, false)",
    "mssql": "DBCC CHECKIDENT ({text}, RESEED, {last})",
    "mysql": "ALTER TABLE {table} AUTO_INCREMENT = {value}",
    "oracle": "ALTER TABLE {table} MODIFY ({column} GENERATED BY DEFAULT AS IDENTITY (START WITH {value}))",
    "ansi": "ALTER TABLE {table} ALTER COLUMN {column} RESTART WITH {value}",
}
#: The row count that each database keeps for a table, by quoted literals of schema and name.
ROW_STATISTICS = {
    "postgres": "SELECT CAST(c.reltuples AS BIGINT) AS n FROM pg_class c JOIN pg_namespace s ON s.oid = c.relnamespace WHERE s.nspname = {schema} AND c.relname = {table}",
    "mssql": "SELECT SUM(p.rows) AS n FROM sys.partitions p JOIN sys.tables t ON t.object_id = p.object_id JOIN sys.schemas s ON s.schema_id = t.schema_id WHERE p.index_id < 2 AND s.name = {schema} AND t.name = {table}",
    "mysql": "SELECT table_rows AS n FROM information_schema.tables WHERE table_schema = {schema} AND table_name = {table}",
    "oracle": "SELECT num_rows AS n FROM all_tables WHERE owner = {schema} AND table_name = {table}",
}
#: Each database's type for a Spark type; decimals keep their precision and scale.
TYPES = {
    "postgres": {"boolean": "BOOLEAN", "byte": "SMALLINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION", "string": "TEXT", "binary": "BYTEA", "date": "DATE", "timestamp": "TIMESTAMPTZ", "timestamp_ntz": "TIMESTAMP"},
    "mssql": {"boolean": "BIT", "byte": "SMALLINT", "short": "SMALLINT", "integer": "INT", "long": "BIGINT", "float": "REAL", "double": "FLOAT", "string": "NVARCHAR(MAX)", "binary": "VARBINARY(MAX)", "date": "DATE", "timestamp": "DATETIMEOFFSET", "timestamp_ntz": "DATETIME2"},
    "mysql": {"boolean": "TINYINT(1)", "byte": "TINYINT", "short": "SMALLINT", "integer": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "LONGTEXT", "binary": "LONGBLOB", "date": "DATE", "timestamp": "TIMESTAMP(6)", "timestamp_ntz": "DATETIME(6)"},
    "oracle": {"boolean": "NUMBER(1)", "byte": "NUMBER(3)", "short": "NUMBER(5)", "integer": "NUMBER(10)", "long": "NUMBER(19)", "float": "BINARY_FLOAT", "double": "BINARY_DOUBLE", "string": "CLOB", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"},
    "ansi": {"boolean": "BOOLEAN", "byte": "SMALLINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE", "string": "VARCHAR(4000)", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"},
}
QUOTES = {"postgres": ('"', '"'), "mssql": ("[", "]"), "mysql": ("`", "`"), "oracle": ('"', '"'), "spark": ("`", "`")}


@dataclass(frozen=True)
class Dialect:
    """name: a connector, or spark for SQL that Spark reads."""

    name: str

    def quote(self, name: str) -> str:
        """The closing quote is doubled. Oracle takes capitals, and quotes only where it must."""
        opening, closing = QUOTES.get(self.name, ('"', '"'))
        if self.name == "oracle":
            name = name.upper()
            if re.fullmatch(r"[A-Z_][A-Z0-9_]*", name) and name not in ORACLE_WORDS:
                return name
        return opening + name.replace(closing, closing * 2) + closing

    def from_text(self, value: str, kind: str = "geometry", srid: int = 4326) -> str:
        """The spatial value that a text stands for; the text itself where a database has no such type."""
        return SPATIAL_SINK[self.name].format(value, kind=kind, srid=srid) if self.name in SPATIAL_SINK else value

    def table(self, schema: str, name: str) -> str:
        return f"{self.quote(schema)}.{self.quote(name)}" if schema or self.name in ("postgres", "mssql") else self.quote(name)

    def hint(self, strict: bool = False) -> str:
        """The hint of a dirty read, where there is one and consistency isn't asked for."""
        return " WITH (NOLOCK)" if self.name == "mssql" and not strict else ""

    def projection(self, columns: list[tuple[str, str]], target: str) -> str:
        """The select list of (column, type) pairs; spatial columns are sent as text to another engine, under their own names."""
        kinds, as_text = SPATIAL.get(self.name, ((), "{0}"))
        other = target != self.name
        return ", ".join(as_text.format(self.quote(c)) if other and t.lower() in kinds else self.quote(c) for c, t in columns)

    def read_query(self, schema: str, name: str, columns: list[tuple[str, str]], target: str, strict: bool = False) -> str:
        """The query that Spark's JDBC source sends; key ranges and filters come as its predicates."""
        return f"SELECT {self.projection(columns, target)} FROM {self.table(schema, name)}{self.hint(strict)}"

    def predicate(self, key: str, split: Split) -> str:
        own = self.quote(key)
        parts = ([f"{own} > {split.above}"] if split.above is not None else []) + ([f"{own} <= {split.up_to}"] if split.up_to is not None else [])
        return " AND ".join(parts) or "1 = 1"

    def type_of(self, kind: T.DataType) -> str:
        """The database's type for a Spark type."""
        if isinstance(kind, T.DecimalType):
            return f"{'NUMBER' if self.name == 'oracle' else 'DECIMAL'}({kind.precision}, {kind.scale})"
        return TYPES.get(self.name, TYPES["ansi"])[kind.typeName()]

    def create_table(self, schema: str, name: str, columns: T.StructType, key: list[str] = (), spatial: list[str] = ()) -> str:
        """A CREATE TABLE statement with its primary key; key columns of text get a length, as keys need one, and spatial ones their type."""
        short = {"mysql": "VARCHAR(255)", "mssql": "NVARCHAR(450)", "oracle": "VARCHAR2(255)"}.get(self.name, "VARCHAR(255)")
        rows = [f"{self.quote(f.name)} {SPATIAL_TYPES[self.name] if f.name in spatial and self.name in SPATIAL_TYPES else short if f.name in key and isinstance(f.dataType, T.StringType) else self.type_of(f.dataType)}{' NOT NULL' if f.name in key or not f.nullable else ''}" for f in columns]
        rows += [f"PRIMARY KEY ({', '.join(map(self.quote, key))})"] if key else []
        return f"CREATE TABLE {self.table(schema, name)} ({', '.join(rows)})"

    def create_index(self, schema: str, name: str, index: str, columns: list[str], unique: bool = False) -> str:
        return f"CREATE {'UNIQUE ' * unique}INDEX {self.quote(index)} ON {self.table(schema, name)} ({', '.join(map(self.quote, columns))})"

    def add_foreign_key(self, schema: str, name: str, constraint: str, columns: list[str], parent: str, key: list[str]) -> str:
        return f"ALTER TABLE {self.table(schema, name)} ADD CONSTRAINT {self.quote(constraint)} FOREIGN KEY ({', '.join(map(self.quote, columns))}) REFERENCES {self.table(schema, parent)} ({', '.join(map(self.quote, key))})"

    def add_check(self, schema: str, name: str, constraint: str, check: str) -> str:
        return f"ALTER TABLE {self.table(schema, name)} ADD CONSTRAINT {self.quote(constraint)} CHECK ({check})"

    def drop_table(self, schema: str, name: str) -> str:
        return f"DROP TABLE {'' if self.name in ('oracle', 'derby') else 'IF EXISTS '}{self.table(schema, name)}"

    def restart_identity(self, schema: str, name: str, column: str, value: int) -> str:
        """The statement after which a generated key goes on with a value."""
        table = self.table(schema, name)
        return IDENTITY.get(self.name, IDENTITY["ansi"]).format(table=table, text="'" + table.replace("'", "''") + "'", column=self.quote(column), name="'" + column.replace("'", "''") + "'", value=int(value), last=int(value) - 1)

    def truncate(self, schema: str, name: str) -> str:
        return f"TRUNCATE TABLE {self.table(schema, name)}"

    def upsert(self, schema: str, name: str, staging: str, columns: list[str], key: list[str], spatial: list[str] = (), srid: int = 4326) -> str:
        """One statement that merges a staging table into its target; rows of equal keys change only where a column differs.
        Spatial columns come from the texts that the staging table holds, and aren't compared."""
        if spatial and self.name in SPATIAL_SINK:
            chosen = ", ".join(f"{self.from_text(self.quote(c), srid=srid)} AS {self.quote(c)}" if c in spatial else self.quote(c) for c in columns)
            staging = f"(SELECT {chosen} FROM {staging})" + (" x" if self.name in ("postgres", "mysql") else "")
        q, rest = self.quote, [c for c in columns if c not in key]
        compared = [c for c in rest if c not in spatial]
        target, cols = self.table(schema, name), ", ".join(map(q, columns))
        if self.name in ("postgres", "mysql"):
            head = f"INSERT INTO {target} ({cols}) SELECT {cols} FROM {staging}"
            if self.name == "mysql":
                changes = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest) or f"{q(key[0])} = {target}.{q(key[0])}"
                return f"{head} ON DUPLICATE KEY UPDATE {changes}"
            on = f"{head} ON CONFLICT ({', '.join(map(q, key))}) DO "
            if not rest:
                return on + "NOTHING"
            if not compared:
                return on + "NOTHING"
            before, after = (", ".join(f"{x}.{q(c)}" for c in compared) for x in (target, "EXCLUDED"))
            return on + f"UPDATE SET {', '.join(f'{q(c)} = EXCLUDED.{q(c)}' for c in rest)} WHERE ({before}) IS DISTINCT FROM ({after})"
        match = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in key)
        differs = " OR ".join(f"t.{q(c)} <> s.{q(c)} OR (t.{q(c)} IS NULL AND s.{q(c)} IS NOT NULL) OR (t.{q(c)} IS NOT NULL AND s.{q(c)} IS NULL)" for c in compared)
        sets = ", ".join(f"{q(c)} = s.{q(c)}" for c in rest)
        values = ", ".join(f"s.{q(c)}" for c in columns)
        if self.name == "oracle":
            update = f" WHEN MATCHED THEN UPDATE SET {sets} WHERE {differs}" if compared else ""
            return f"MERGE INTO {target} t USING {staging} s ON ({match}){update} WHEN NOT MATCHED THEN INSERT ({cols}) VALUES ({values})"
        update = f" WHEN MATCHED AND ({differs}) THEN UPDATE SET {sets}" if compared else ""
        end = ";" if self.name == "mssql" else ""
        return f"MERGE INTO {target} AS t USING {staging} AS s ON {match}{update} WHEN NOT MATCHED THEN INSERT ({cols}) VALUES ({values}){end}"


def dialect(connector: str) -> Dialect:
    return Dialect(connector if connector == "spark" else canonical(connector))


def quoted(name: Column, connector: str) -> Column:
    """Dialect.quote for a column of names."""
    opening, closing = QUOTES[connector]
    name = F.upper(name) if connector == "oracle" else name
    out = F.concat(F.lit(opening), F.replace(name, F.lit(closing), F.lit(closing * 2)), F.lit(closing))
    plain = name.rlike("^[A-Z_][A-Z0-9_]*$") & ~name.isin(*sorted(ORACLE_WORDS))
    return F.when(plain, name).otherwise(out) if connector == "oracle" else out


#: Catalog queries in information_schema terms, for Spark's JDBC `query` option; {schema} is a quoted literal.
TABLES_QUERY = "SELECT table_name FROM information_schema.tables WHERE table_schema = {schema} AND table_type = 'BASE TABLE'"
COLUMNS_QUERY = "SELECT table_name, column_name, data_type AS type_name, ordinal_position AS ordinal, is_nullable FROM information_schema.columns WHERE table_schema = {schema}"
CONSTRAINTS_QUERY = "SELECT constraint_name, table_name, constraint_type FROM information_schema.table_constraints WHERE table_schema = {schema}"
KEY_COLUMNS_QUERY = "SELECT constraint_name, table_name, column_name, ordinal_position AS pos FROM information_schema.key_column_usage WHERE table_schema = {schema}"
#: The same for Oracle, which has views of its own.
ORACLE_QUERIES = {
    TABLES_QUERY: "SELECT table_name FROM all_tables WHERE owner = {schema}",
    COLUMNS_QUERY: "SELECT table_name, column_name, data_type AS type_name, column_id AS ordinal, nullable AS is_nullable FROM all_tab_columns WHERE owner = {schema}",
    CONSTRAINTS_QUERY: "SELECT constraint_name, table_name, DECODE(constraint_type, 'P', 'PRIMARY KEY', 'U', 'UNIQUE', 'R', 'FOREIGN KEY', 'CHECK') AS constraint_type FROM all_constraints WHERE owner = {schema}",
    KEY_COLUMNS_QUERY: "SELECT constraint_name, table_name, column_name, position AS pos FROM all_cons_columns WHERE owner = {schema}",
}


def catalog_query(query: str, connector: str, schema: str) -> str:
    text = ORACLE_QUERIES[query] if canonical(connector) == "oracle" else query
    return text.format(schema="'" + schema.replace("'", "''") + "'")
