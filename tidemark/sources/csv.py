"""Delimited text: packages with a header, tab-separated copies, and a registry of readers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError
from tidemark.functions.datatypes import Format, parse, write

#: Notations that a flexible timestamp column may have; the first that fits counts.
PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd")


@dataclass(frozen=True)
class CsvPackage:
    """How a file with a header becomes a package.

    timestamp: a column, or `current_timestamp` for the time of loading.
    columns: trend -> Format of its text. Files may be compressed.
    """

    timestamp: str = "timestamp"
    identifier: str = "entity"
    delimiter: str = ","
    granularity: str = "15m"
    entity_type: str = "node"
    columns: dict[str, Format] = field(default_factory=dict)

    def read(self, spark: SparkSession, path: str | list[str], now: Column | None = None, strict: bool = True) -> DataFrame:
        """Rows of entity, timestamp and typed trends. Strict: a text that is no value fails the query; else it is null."""
        raw = spark.read.option("header", True).option("sep", self.delimiter).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
        needed = {self.identifier, *self.columns} | ({self.timestamp} - {"current_timestamp"})
        missing = needed - set(raw.columns)
        if missing:
            raise ConfigurationError(f"no such columns: {sorted(missing)}")
        if self.timestamp == "current_timestamp":
            at = now if now is not None else F.current_timestamp()
        else:
            text = F.col(f"`{self.timestamp}`")
            at = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in PATTERNS))
            if strict:
                at = F.coalesce(at, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("Error parsing timestamp '"), text, F.lit("'"))).cast("timestamp")))
        return raw.select(F.col(f"`{self.identifier}`").alias("entity"), at.alias("timestamp"), *(parse(F.coalesce(F.col(f"`{c}`"), F.lit("")), f, strict).alias(c) for c, f in self.columns.items()))

    def definition(self, names: list[str], store: str) -> dict:
        """A trend store definition for what the files hold."""
        return {"data_source": store, "entity_type": self.entity_type, "granularity": self.granularity, "parts": [{"name": f"{store}_{self.entity_type}_{self.granularity}", "trends": [{"name": n, "data_type": self.columns[n].type if n in self.columns else "text"} for n in names]}]}


#: Readers by name: (session, path, options) -> package.
READERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {}


def register(name: str, reader: Callable[[SparkSession, str, dict], DataFrame]) -> None:
    """Make a reader known; a name is taken once."""
    if name in READERS:
        raise ConfigurationError(f"reader {name} is known already")
    READERS[name] = reader


def discover(group: str = "tidemark.readers") -> list[str]:
    """Make the readers known that installed packages offer under an entry point; returns their names. Names taken already stay."""
    found = []
    for point in entry_points(group=group):
        if point.name not in READERS:
            register(point.name, point.load())
            found.append(point.name)
    return found


def load(spark: SparkSession, name: str, path: str, options: dict | None = None) -> DataFrame:
    """A package read by a registered reader, or by one that an installed package offers."""
    if name not in READERS:
        discover()
    if name not in READERS:
        raise ConfigurationError(f"no such reader: {name}")
    return READERS[name](spark, path, options or {})


register("csv", lambda spark, path, options: CsvPackage(**options).read(spark, path))


def copy_to(df: DataFrame, path: str, formats: dict[str, Format] | None = None) -> None:
    """Write rows as lines of tab-separated texts, null as \\N, backslash, tab and line ends escaped."""
    formats = formats or {}
    kinds = {"bigint": "bigint", "int": "integer", "smallint": "smallint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "timestamp_ntz": "timestamp", "timestamp": "timestamp with time zone"}

    def line(c: str, kind: str) -> Column:
        form = formats.get(c) or Format(kinds.get(kind, "text"), pattern="yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = write(F.col(f"`{c}`"), form)
        if kind != "string":
            return text
        escaped = F.col(f"`{c}`")
        for sign, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            escaped = F.replace(escaped, F.lit(sign), F.lit(code))
        return F.coalesce(escaped, F.lit(form.null))

    df.select(F.concat_ws("\t", *(line(c, k) for c, k in df.dtypes)).alias("value")).write.text(path)


def copy_from(spark: SparkSession, path: str, columns: dict[str, str], formats: dict[str, Format] | None = None) -> DataFrame:
    """Read such lines; columns: name -> type name."""
    formats = formats or {}
    cells = F.split("value", "\t", -1)

    def cell(i: int, name: str, kind: str) -> Column:
        raw = cells[i]
        form = formats.get(name) or Format(kind, pattern="yyyy-MM-dd HH:mm:ss.SSSSSS")
        if kind != "text":
            return parse(raw, form).alias(name)
        marked = F.replace(raw, F.lit("\\\\"), F.lit("\u0000"))
        for code, sign in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\u0000", "\\")):
            marked = F.replace(marked, F.lit(code), F.lit(sign))
        return F.when(raw != form.null, marked).alias(name)

    return spark.read.text(path).select(*(cell(i, n, k) for i, (n, k) in enumerate(columns.items())))


def package_json(df: DataFrame, keys: tuple[str, ...] = ("entity_id", "timestamp")) -> DataFrame:
    """Each row as JSON text with its keys and values."""
    values = [c for c in df.columns if c not in keys]
    return df.select(F.to_json(F.struct(*keys, F.struct(*values).alias("values")), {"ignoreNullFields": "false"}).alias("value"))


def package_from_json(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of such texts; schema: that of the values."""
    parsed = F.from_json(column, f"entity_id bigint, timestamp timestamp, values struct<{schema}>")
    return texts.select(parsed.alias("__p")).select("__p.entity_id", "__p.timestamp", "__p.values.*")


def pretend(df: DataFrame) -> None:
    """Read and parse everything, store nothing."""
    df.write.format("noop").mode("overwrite").save()
