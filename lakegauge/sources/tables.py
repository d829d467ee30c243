"""Reading and writing tables by path, format and options."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

# File extension -> format; database URL schemes -> JDBC subprotocol.
EXTENSIONS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".orc": "orc"}
DATABASES = {
    "postgresql": "postgresql",
    "postgres": "postgresql",
    "mysql": "mysql",
    "sqlite": "sqlite",
    "mssql": "sqlserver",
    "oracle": "oracle",
    "snowflake": "snowflake",
    "bigquery": "bigquery",
    "redshift": "redshift",
}
SEPARATORS = {".tsv": "\t"}


@dataclass(frozen=True)
class Source:
    """Where a table comes from; ``options`` go to the reader as they are."""

    source: str
    format: str | None = None
    sql: str | None = None
    params: Mapping = field(default_factory=dict)
    options: Mapping = field(default_factory=dict)
    schema: str | None = None

    @classmethod
    def from_dict(cls, data: Mapping) -> "Source":
        known = {k: data[k] for k in ("source", "format", "sql", "params", "options", "schema") if data.get(k) is not None}
        if "source" not in known:
            raise ValueError("a source needs a path or URL")
        return cls(**known)


def extension(path: str) -> str:
    name = urlparse(path).path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def is_database(source: str) -> bool:
    return urlparse(source).scheme.split("+")[0] in DATABASES


def infer_format(source: str, given: str | None = None) -> str:
    """The given format, else by the extension of the URL path, else Parquet."""
    if given:
        return {"tsv": "csv", "txt": "csv", "jsonl": "json"}.get(given.lower(), given.lower())
    if is_database(source):
        return "jdbc"
    return EXTENSIONS.get(extension(source), "parquet")


def file_options(path: str, kind: str, options: Mapping) -> dict:
    """Defaults per format below the caller's options."""
    out: dict = {}
    if kind == "csv":
        out = {"header": "true", "sep": SEPARATORS.get(extension(path), ","), "encoding": "UTF-8"}
        if "schema" not in options:
            out["inferSchema"] = "true"
    out.update({k: v for k, v in options.items() if k != "schema"})
    return out


def bind(sql: str, params: Mapping) -> str:
    """Put parameters into ``:name`` places as SQL literals; only numbers, strings, booleans and NULL."""
    import re

    def literal(match) -> str:
        value = params[match.group(1)]
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, float)):
            return repr(value)
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        raise TypeError(f"cannot bind {type(value).__name__}")

    return re.sub(r"(?<!:):([A-Za-z_]\w*)", literal, sql)


def jdbc_options(src: Source) -> dict:
    """Options of the JDBC reader. ``partitionColumn`` with bounds makes the read parallel.

    A query cannot be combined with ``partitionColumn``, so it becomes a derived table then.
    """
    if not src.sql:
        raise ValueError("a database source needs a query")
    url = urlparse(src.source)
    base = url.scheme.split("+")[0]
    place = url.hostname or ""
    if url.port:
        place += f":{url.port}"
    out = {"url": f"jdbc:{DATABASES[base]}://{place}{url.path}"}
    if url.username:
        out["user"] = url.username
    if url.password:
        out["password"] = url.password
    query = bind(src.sql, src.params)
    if "partitionColumn" in src.options:
        out["dbtable"] = f"({query}) AS source_query"
    else:
        out["query"] = query
    out.update(src.options)
    return out


def read(spark: SparkSession, src: Source | Mapping | str) -> DataFrame:
    """Read a file, folder, object-store path or database query."""
    if isinstance(src, str):
        src = Source(src)
    elif isinstance(src, Mapping):
        src = Source.from_dict(src)
    kind = infer_format(src.source, src.format)
    reader: DataFrameReader = spark.read.format(kind)
    if kind == "jdbc":
        return reader.options(**jdbc_options(src)).load()
    options = file_options(src.source, kind, {**src.options, **({"schema": src.schema} if src.schema else {})})
    if src.schema:
        reader = reader.schema(src.schema)
    return reader.options(**options).load(src.source)


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    """Write in the given format or the one of the extension."""
    kind = infer_format(path, format)
    writer = df.write.format(kind).mode(mode)
    if kind == "csv":
        writer = writer.options(header="true", sep=SEPARATORS.get(extension(path), ","), escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**options).save(path)


def read_in_splits(spark: SparkSession, path: str, split_bytes: int, **options) -> DataFrame:
    """Read with smaller input splits: the chunked read of a large file, chunks side by side.

    The split size is a setting of a session of its own, which shares the context; the caller's session stays as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(min(split_bytes, 1 << 22)))
    return read(own, Source(path, options=options))
