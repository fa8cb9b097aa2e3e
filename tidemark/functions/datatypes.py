"""Types of trends and attributes: parsing, writing, inference and promotion as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError

#: Types by name with their Spark types.
SPARK_TYPES = {
    "boolean": "boolean",
    "smallint": "smallint",
    "integer": "int",
    "bigint": "bigint",
    "real": "float",
    "double precision": "double",
    "numeric": "decimal(38,9)",
    "timestamp": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "text": "string",
}
#: Types that inference tries, narrowest first; each also is the order in which columns widen.
WIDENING = ["smallint", "integer", "bigint", "real", "double precision", "numeric", "timestamp", "text"]
_RANK = {name: i for i, name in enumerate(WIDENING)}
INTEGERS, FLOATS = ("smallint", "integer", "bigint"), ("real", "double precision")


def spark_type(name: str) -> str:
    """The Spark type of a type name; `T[]` is an array."""
    base = name.removesuffix("[]")
    if base not in SPARK_TYPES:
        raise ConfigurationError(f"no such data type: {name}")
    return f"array<{SPARK_TYPES[base]}>" if name.endswith("[]") else SPARK_TYPES[base]


@dataclass(frozen=True)
class Format:
    """How values of one type are written in text."""

    type: str
    null: str = "\\N"
    true: tuple[str, ...] = ("true",)
    false: tuple[str, ...] = ("false",)
    pattern: str = "yyyy-MM-dd'T'HH:mm:ss"
    zone: str = "UTC"
    separator: str = ","
    prefix: str = ""
    postfix: str = ""
    scale: int = 9
    item: Format | None = field(default=None)


#: Strptime directives and the letters of Spark's patterns.
_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%z": "xx"}


def pattern(strptime: str) -> str:
    """A Spark time pattern from one of strptime directives."""
    out, i, literal = "", 0, ""

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if any(c.isalpha() for c in literal) else literal

    while i < len(strptime):
        directive = strptime[i : i + 2]
        if directive in _DIRECTIVES:
            out, literal, i = out + flush() + _DIRECTIVES[directive], "", i + 2
        else:
            literal, i = literal + strptime[i], i + 1
    return out + flush()


def parse(c: Column, form: Format, strict: bool = True) -> Column:
    """The value that a text holds.

    The null literal is null; for integers so is an empty text. Strict: any
    other text that is no value of the type, or out of its range, fails the
    query with the text in the message; else it becomes null.
    """
    kind = form.type
    if kind.endswith("[]"):
        item = form.item or replace(form, type=kind[:-2], item=None)
        inner = F.regexp_replace(c, r"^[\[{]|[\]}]$", "")
        return F.when(c.isNotNull(), F.transform(F.split(inner, f"\\Q{form.separator}\\E", -1), lambda x: parse(x, item, strict)))
    bad = F.raise_error(F.concat(F.lit("Error parsing value '"), c, F.lit(f"' as {kind}"))) if strict else F.lit(None)
    null = c == form.null
    if kind == "text":
        return F.when(~null, F.regexp_replace(F.regexp_replace(c, "^" + _literal(form.prefix), ""), _literal(form.postfix) + "$", "") if form.prefix or form.postfix else c)
    if kind == "boolean":
        return F.when(null, F.lit(None).cast("boolean")).when(c.isin(*form.true), True).when(c.isin(*form.false), False).when(c.isNotNull(), bad.cast("boolean"))
    if kind == "timestamp":
        value = F.try_to_timestamp(c, F.lit(form.pattern)).cast("timestamp_ntz")
    elif kind == "timestamp with time zone":
        value = F.to_utc_timestamp(F.try_to_timestamp(c, F.lit(form.pattern)), form.zone)
    elif kind == "numeric":
        value = c.try_cast(f"decimal(38,{form.scale})")
    else:
        value = c.try_cast(spark_type(kind))
        if kind in INTEGERS:
            null = null | (c == "")
            value = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), value)
    target = f"decimal(38,{form.scale})" if kind == "numeric" else spark_type(kind)
    return F.when(null, F.lit(None).cast(target)).when(value.isNotNull(), value).when(c.isNotNull(), bad.cast(target))


def _literal(text: str) -> str:
    return f"\\Q{text}\\E" if text else ""


def write(c: Column, form: Format) -> Column:
    """The text of a value; null becomes the null literal."""
    kind = form.type
    if kind.endswith("[]"):
        item = form.item or replace(form, type=kind[:-2], item=None)
        text = F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: write(x, item)), form.separator), F.lit("}"))
    elif kind == "boolean":
        text = F.when(c, form.true[0]).otherwise(form.false[0])
    elif kind == "timestamp":
        text = F.date_format(c, form.pattern)
    elif kind == "timestamp with time zone":
        text = F.date_format(F.from_utc_timestamp(c, form.zone), form.pattern)
    elif kind == "text":
        text = F.concat(F.lit(form.prefix), c, F.lit(form.postfix))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), form.null).otherwise(text)


def rank(c: Column) -> Column:
    """The place in WIDENING of the narrowest type that holds a text; null and empty fit the narrowest."""
    return (
        F.when(c.isNull() | (c == ""), 0)
        .when(c.rlike("^-?[1-9][0-9]*$") & c.try_cast("smallint").isNotNull(), 0)
        .when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.when(c.try_cast("int").isNotNull(), 1).when(c.try_cast("bigint").isNotNull(), 2).otherwise(3))
        .when(c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), 3)
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}$") & F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), 6)
        .otherwise(7)
    )


def infer(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the narrowest type that holds all texts of each column. One pass, one partial aggregation; without rows all are smallint."""
    names = F.array(*map(F.lit, WIDENING))
    return df.agg(*(F.element_at(names, F.coalesce(F.max(rank(F.col(f"`{c}`"))), F.lit(0)) + 1).alias(c) for c in columns))


def widest(*types: str) -> str:
    """The type that holds all of the given ones."""
    return max(types, key=lambda t: _RANK[t])


def widens(old: str, new: str) -> bool:
    """Whether a column may change from one type to the other without loss."""
    return _RANK[new] >= _RANK[old]


def promoted(function: str, kind: str) -> str:
    """Type of an aggregate of a column; functions other than sum and avg keep it, count gives bigint."""
    name = function.lower()
    if name == "count":
        return "bigint"
    if name == "sum":
        return {"smallint": "bigint", "integer": "bigint", "bigint": "numeric"}.get(kind, kind)
    if name == "avg":
        return "double precision" if kind in FLOATS else "numeric"
    return kind


def aggregate(function: str, column: str, kind: str) -> Column:
    """An aggregate whose result has the promoted type and does not overflow on the way."""
    name, c = function.lower(), F.col(f"`{column}`")
    if name not in AGGREGATES:
        raise ConfigurationError(f"no such aggregate: {function}")
    if name in ("sum", "avg") and kind in INTEGERS and promoted(name, kind) == "numeric":
        c = c.cast("decimal(38,0)" if name == "sum" else "decimal(20,0)")
    result = AGGREGATES[name](c)
    target = promoted(name, kind)
    if target == "numeric":
        return result.cast("decimal(38,0)") if name == "sum" and kind in INTEGERS else result
    return result.cast(spark_type(target))


AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev, "variance": F.variance, "bool_and": F.bool_and, "bool_or": F.bool_or, "any_value": F.any_value, "median": F.median}
