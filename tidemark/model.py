"""Definitions of stores, relations, derived parts and triggers, read from and written to plain dictionaries."""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass, field

from tidemark.errors import ConfigurationError


def _read(kind, value):
    if value is None or kind is typing.Any:
        return value
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return _read(next(k for k in inner if k is not type(None)), value)
    if origin is list:
        return [_read(inner[0], v) for v in value]
    if dataclasses.is_dataclass(kind):
        return kind.from_dict(value)
    return value


class Definition:
    """Reading and writing; unknown keys and missing ones are errors that name the definition."""

    @classmethod
    def from_dict(cls, data: dict):
        if not isinstance(data, dict):
            raise ConfigurationError(f"{cls.__name__}: not a mapping")
        hints = typing.get_type_hints(cls)
        known = {f.name: f for f in dataclasses.fields(cls)}
        lacking = [n for n, f in known.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and n not in data]
        if lacking:
            raise ConfigurationError(f"{cls.__name__}: missing {', '.join(lacking)}")
        if strange := set(data) - set(known):
            raise ConfigurationError(f"{cls.__name__}: unknown {', '.join(sorted(strange))}")
        return cls(**{n: _read(hints[n], v) for n, v in data.items()})

    def to_dict(self) -> dict:
        return {k: v for k, v in dataclasses.asdict(self).items() if v not in (None, [], {})}


@dataclass
class Trend(Definition):
    name: str
    data_type: str
    description: str = ""
    time_aggregation: str = "SUM"
    entity_aggregation: str = "SUM"
    extra_data: dict = field(default_factory=dict)


@dataclass
class GeneratedTrend(Definition):
    name: str
    data_type: str
    expression: str
    description: str = ""
    extra_data: dict = field(default_factory=dict)


@dataclass
class Part(Definition):
    name: str
    trends: list[Trend]
    generated_trends: list[GeneratedTrend] = field(default_factory=list)


@dataclass
class TrendStore(Definition):
    data_source: str
    entity_type: str
    granularity: str
    partition_size: str
    parts: list[Part]
    title: str | None = None
    retention_period: str | None = None

    def key(self) -> tuple[str, str, str]:
        return self.data_source.lower(), self.entity_type.lower(), self.granularity

    def parts_by_trend(self) -> dict[str, str]:
        """The part of each trend."""
        return {t.name: p.name for p in self.parts for t in p.trends}


@dataclass
class Attribute(Definition):
    name: str
    data_type: str
    unit: str | None = None
    description: str = ""
    extra_data: dict = field(default_factory=dict)


@dataclass
class AttributeStore(Definition):
    data_source: str
    entity_type: str
    attributes: list[Attribute]

    def name(self) -> str:
        return f"{self.data_source}_{self.entity_type}"


@dataclass
class NotificationStore(Definition):
    data_source: str
    attributes: list[Attribute]


@dataclass
class Relation(Definition):
    name: str
    source_entity_type: str
    target_entity_type: str
    query: str
    cardinality: str = "one-to-one"


@dataclass
class Source(Definition):
    trend_store_part: str
    mapping_function: str = "trend.mapping_id"


@dataclass
class ViewMaterialization(Definition):
    target_trend_store_part: str
    sources: list[Source]
    view: str | None = None
    function: dict | None = None
    enabled: bool = True
    processing_delay: str = "30m"
    stability_delay: str = "5m"
    reprocessing_period: str = "3 days"
    fingerprint_function: str | None = None
    description: dict | None = None


@dataclass
class Field(Definition):
    name: str
    data_type: str
    value: typing.Any = None


@dataclass
class TriggerDefinition(Definition):
    name: str
    kpi_data: list[Field]
    kpi_function: str
    thresholds: list[Field]
    condition: str
    weight: str
    notification: str
    granularity: str
    data: str = "'{}'"
    tags: list[str] = field(default_factory=list)
    fingerprint: str | None = None
    notification_store: str | None = None
    trend_store_links: list[dict] = field(default_factory=list)
    mapping_functions: list[dict] = field(default_factory=list)
    description: str = ""
