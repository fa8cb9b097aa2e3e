"""Names: distinguished names, names of parts and relations, quoting, sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError


def explode_dn(dn: Column) -> Column:
    """`Type=name,Type=name` as an array of structs (type, name)."""
    kinds = F.regexp_extract_all(dn, F.lit(r"([^,]+)=([^,]+)"), 1)
    names = F.regexp_extract_all(dn, F.lit(r"([^,]+)=([^,]+)"), 2)
    return F.transform(F.arrays_zip(kinds.alias("type"), names.alias("name")), lambda x: F.struct(x["type"].alias("type"), x["name"].alias("name")))


def implode_dn(parts: Column) -> Column:
    """The text of an array of structs (type, name)."""
    return F.array_join(F.transform(parts, lambda x: F.concat(x["type"], F.lit("="), x["name"])), ",")


def split_dn(dn: Column) -> Column:
    """Components of a distinguished name, split at commas that no backslash escapes."""
    return F.split(dn, r"(?<!\\),", -1)


def escape_commas(text: Column) -> Column:
    """A component with its commas escaped."""
    return F.replace(text, F.lit(","), F.lit("\\,"))


def dn_entity_type(dn: Column) -> Column:
    """The type of the last component; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(dn, F.lit(r"([^,]+)=([^,]+)"), 1), F.lit(-1))


def substring_from(text: Column, pattern: str) -> Column:
    """The first group of a match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def message(separator: str, *lines: Column) -> Column:
    """Lines joined by a separator, null ones left out."""
    return F.concat_ws(separator, *lines)


def quoted(name: str) -> str:
    """A name as Spark SQL takes it: bare if plain, else within backticks."""
    return name if re.fullmatch(r"[a-z][a-z_0-9]*", name) and name not in ("end", "timestamp") else "`" + name.replace("`", "``") + "`"


def aggregate_part_name(part: str, granularity: str, entity_type: str | None = None, source_type: str | None = None) -> str:
    """The name of a part that holds an aggregate of another.

    The granularity at the end is replaced, or added; for an aggregate over
    entities the source type in the name gives way to the target type, or the
    target type is put in front.
    """
    name = re.sub(r"_(\d+(?:s|m|h|d|w|month))$", "", part)
    if entity_type:
        swapped = re.sub(rf"(^|_){re.escape(source_type)}(?=_|$)", rf"\g<1>{entity_type}", name) if source_type else name
        name = swapped if swapped != name else f"{entity_type}_{name}"
    return f"{name}_{granularity}"


def relation_name(source: str, target: str) -> str:
    """The name of the relation between two entity types."""
    return f"{source}->{target}"


def parse_size(text: str) -> int:
    """Bytes of a size such as 10MB; K, M, G and T are powers of 1024."""
    found = re.fullmatch(r"\s*(\d+)\s*([KMGT]?)B?\s*", text.upper())
    if not found:
        raise ConfigurationError(f"no size: {text!r}")
    return int(found[1]) << 10 * " KMGT".index(found[2] or " ")
