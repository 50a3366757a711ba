"""Settings of a run: JSON or simple YAML with templates for secrets, checked before anything is read."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession

from tideway.catalog import canonical, connectors, jdbc_options
from tideway.engine import Engine
from tideway.sources import jdbc

_FILE = re.compile(r"^\$\{file:([^}]+)\}$")
_ENV = re.compile(r"^\$\{(?:env:)?([A-Za-z_][A-Za-z0-9_]*)\}$")


def expanded(value: str) -> str:
    """${file:path} is a file's trimmed text, ${env:NAME} and ${NAME} an environment variable (empty if unset); other text is itself."""
    if m := _FILE.match(value):
        return Path(m[1]).expanduser().read_text().strip()
    if m := _ENV.match(value):
        return os.environ.get(m[1], "")
    return value


def _walk(value: object) -> object:
    if isinstance(value, dict):
        return {k: _walk(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v) for v in value]
    return expanded(value) if isinstance(value, str) else value


@dataclass
class Endpoint:
    type: str = ""
    host: str = ""
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    schema: str = ""
    options: dict = field(default_factory=dict)


@dataclass
class Migration:
    chunk_size: int = 100_000
    max_partitions: int = 8
    workers: int = 4
    large_table_threshold: int = 5_000_000
    include_tables: list = field(default_factory=list)
    exclude_tables: list = field(default_factory=list)
    target_mode: str = "drop_recreate"
    strict_consistency: bool = False
    sample_validation: bool = False
    sample_size: int = 100
    checkpoint_frequency: int = 10
    max_retries: int = 3
    date_updated_columns: list = field(default_factory=list)
    read_ahead_buffers: int = 4


@dataclass
class Config:
    source: Endpoint
    target: Endpoint
    migration: Migration
    profile: dict = field(default_factory=dict)


def _made(kind: type, values: dict):
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in known})


def _endpoint(values: dict, default: str, what: str) -> Endpoint:
    e = _made(Endpoint, values)
    for name in ("host", "database"):
        if not getattr(e, name):
            raise ValueError(f"{what}.{name} is required")
    e.type = canonical(e.type or default)
    _, _, port, schema = connectors()[e.type]
    e.port, e.schema = int(e.port or port), e.schema or schema
    return e


def load(text: str) -> Config:
    """Settings from JSON, or from YAML where a parser for it is installed."""
    try:
        raw = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("settings aren't JSON, and no YAML parser is installed") from e
        raw = yaml.safe_load(text)
    raw = _walk(raw or {})
    out = Config(_endpoint(raw.get("source", {}), "mssql", "source"), _endpoint(raw.get("target", {}), "postgres", "target"), _made(Migration, raw.get("migration", {})), raw.get("profile", {}))
    a, b = out.source, out.target
    if (a.type, a.host.lower(), a.port, a.database) == (b.type, b.host.lower(), b.port, b.database):
        raise ValueError(f"source and target cannot be the same database ({a.host}:{a.port}/{a.database})")
    if out.migration.target_mode not in ("drop_recreate", "upsert"):
        raise ValueError("migration.target_mode must be 'drop_recreate' or 'upsert'")
    return out


def engine(spark: SparkSession, settings: Config, state: str) -> Engine:
    """The engine of a run between two databases: tables, keys and links come from the source's catalog, all else from the settings."""
    a, b, m = settings.source, settings.target, settings.migration
    source, target = (jdbc_options(e.type, e.host, e.database, e.user, e.password, e.port, e.options) for e in (a, b))
    specs = jdbc.specs_of(spark, {k: v for k, v in source.items() if v}, a.schema, m.date_updated_columns, b.schema)
    out = Engine(
        spark, source["url"], {k: v for k, v in target.items() if v}, state, specs, "upsert" if m.target_mode == "upsert" else "reload", workers=m.workers, retries=m.max_retries, threshold=m.large_table_threshold,
        chunk=m.chunk_size, most=m.max_partitions, cadence=m.checkpoint_frequency, sample=m.sample_size if m.sample_validation else 0,
    )
    chosen = out.selected(m.include_tables, m.exclude_tables)
    out.specs = {t: out.specs[t] for t in chosen}
    return out


def yaml_text(values: dict, indent: int = 0) -> str:
    """Settings as YAML: nested mappings, lists of scalars, and scalars as JSON writes them."""
    out, pad = [], " " * indent
    for k, v in values.items():
        if isinstance(v, dict):
            out += [f"{pad}{k}:", yaml_text(v, indent + 2)] if v else [f"{pad}{k}: {{}}"]
        elif isinstance(v, (list, tuple)):
            out += [f"{pad}{k}:", *(f"{pad}  - {json.dumps(x)}" for x in v)] if v else [f"{pad}{k}: []"]
        else:
            out.append(f"{pad}{k}: {json.dumps(v)}")
    return "\n".join(out)
