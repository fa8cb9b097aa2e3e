"""An instance put into a warehouse: stores, entities, relations, what is derived, and triggers."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError, DuplicateDefinition
from tidemark.functions.granularity import parse
from tidemark.model import ViewMaterialization
from tidemark.operators import aggregate, relations
from tidemark.plans.instance import Instance, adapted, view_name
from tidemark.streaming.incremental import Materialization
from tidemark.warehouse import Warehouse


def initialize(house: Warehouse, instance: Instance, tell: Callable[[str], None] = lambda _: None) -> list[str]:
    """Make all that an instance defines, in the order in which later definitions need earlier ones. Returns the steps taken.

    What is there already stays as it is. Statements of the custom folders run
    before, between and after, as their names say.
    """
    instance.load()
    c, done = instance.catalog, []

    def step(name: str, make: Callable[[], object]) -> None:
        tell(name)
        make()
        done.append(name)

    def define(kind: str) -> Callable[[], object]:
        def every() -> None:
            for key, d in getattr(c, kind).items():
                try:
                    house.change(lambda held, key=key, d=d: held.create_trend_store(d) if kind == "trend_stores" else held.create_attribute_store(d) if kind == "attribute_stores" else held.define(kind, key, d))
                except DuplicateDefinition:
                    tell(f"{kind}: {key} is there already")

        return every

    def virtual() -> None:
        own = virtual_entities(instance)
        house.change(lambda held: held.virtual.update(own))

    scripts = lambda folder: lambda: instance.run_scripts(house.spark, f"custom/{folder}")
    step("pre-init", scripts("pre-init"))
    step("attribute stores", define("attribute_stores"))
    step("trend stores", define("trend_stores"))
    step("notification stores", define("notification_stores"))
    step("virtual entities", virtual)
    step("relations", define("relations"))
    step("pre-materialization-init", scripts("pre-materialization-init"))
    step("materializations", define("materializations"))
    step("triggers", define("triggers"))
    step("post-init", scripts("post-init"))
    return done


def virtual_entities(instance: Instance) -> dict[str, str]:
    """The query of each virtual entity type, by the name of its file."""
    folder = instance.root / "virtual-entity"
    out = {}
    if instance.given is not None:
        return dict(instance.given.get("virtual-entity", {}))
    for path in sorted(folder.glob("**/*.sql")) if folder.exists() else []:
        text = adapted(path.read_text(encoding="utf-8"))
        out[path.stem] = re.sub(r"^\s*create\s+(?:or\s+replace\s+)?view\s+\S+\s+as\s+", "", text, flags=re.I | re.S)
    return out


def register(house: Warehouse) -> None:
    """Make the warehouse's tables known to SQL: parts with their generated trends, entities, relations and attributes."""
    c = house.catalog
    for s in c.trend_stores.values():
        for p in s.parts:
            generated(house, p.name, house.part(p.name).read()).createOrReplaceTempView(f"`{view_name('trend', p.name)}`")
    for kind in {*c.entity_types.values(), *c.virtual}:
        house.entities(kind).createOrReplaceTempView(f"`{view_name('entity', kind)}`")
    for name in c.attribute_stores:
        house.attribute_table(name).current().createOrReplaceTempView(f"`{view_name('attribute', name)}`")
        house.attribute_table(name).history().createOrReplaceTempView(f"`{view_name('attribute_history', name)}`")
    for name in c.relations:
        house.relation(name).createOrReplaceTempView(f"`{view_name('relation', name)}`")


def generated(house: Warehouse, part: str, df: DataFrame) -> DataFrame:
    """Rows of a part with its generated trends."""
    from tidemark.functions.datatypes import spark_type

    own = house.catalog.part(part)[1].generated_trends
    return df.withColumns({t.name: F.expr(adapted(t.expression)).cast(spark_type(t.data_type)) for t in own}) if own else df


def derive(house: Warehouse) -> None:
    """Fill virtual entities and relations anew."""
    for kind, query in house.catalog.virtual.items():
        register(house)
        house.add_entities(kind, house.spark.sql(query).toDF("name"))
    register(house)
    for name, relation in house.catalog.relations.items():
        house.fill_relation(name, house.spark.sql(adapted(relation.query)))


def _span(text: str) -> timedelta:
    return timedelta(seconds=parse(text).seconds)


def materialization(house: Warehouse, definition: ViewMaterialization) -> Materialization:
    """A definition as what the monitor runs: its view over the due rows of its sources, or an aggregate."""
    target, _ = house.catalog.part(definition.target_trend_store_part)
    sources = tuple(s.trend_store_part for s in definition.sources)
    function = definition.function or {}

    def view(parts: dict[str, DataFrame]) -> DataFrame:
        for name, rows in parts.items():
            generated(house, name, rows).createOrReplaceTempView(f"`{view_name('trend', name)}`")
        return house.spark.sql(adapted(definition.view))

    def over_time(parts: dict[str, DataFrame]) -> DataFrame:
        return aggregate.time_aggregate(parts[function["source"]], _measures(house, function["source"]), target.granularity)

    def over_entities(parts: dict[str, DataFrame]) -> DataFrame:
        return aggregate.entity_aggregate(parts[function["source"]], house.relation(function["relation"]), _measures(house, function["source"]))

    make = view if definition.view else {"time": over_time, "entity": over_entities}.get(function.get("kind"))
    if make is None:
        raise ConfigurationError(f"{definition.target_trend_store_part}: neither view nor function")
    delays = [_span(x) for x in (definition.processing_delay, definition.stability_delay, definition.reprocessing_period)]
    return Materialization(definition.target_trend_store_part, sources, parse(target.granularity), make, *delays, enabled=definition.enabled, by_part=True)


def _measures(house: Warehouse, part: str) -> list[aggregate.Measure]:
    return [aggregate.Measure(t.name, t.data_type, t.time_aggregation, t.entity_aggregation) for t in house.catalog.part(part)[1].trends]


def materializations(house: Warehouse, names: list[str] | None = None) -> list[Materialization]:
    """Those named, or all, each after those whose parts it reads."""
    held = house.catalog.materializations
    if missing := sorted(set(names or []) - set(held)):
        raise ConfigurationError(f"no materialization {', '.join(missing)}")
    order: list[str] = []

    def visit(name: str) -> None:
        if name in held and name not in order:
            for s in held[name].sources:
                visit(s.trend_store_part)
            order.append(name)

    for name in sorted(held):
        visit(name)
    return [materialization(house, held[n]) for n in order if not names or n in names]


def materialize(house: Warehouse, names: list[str] | None = None, now: datetime | None = None, reset: bool = False, newest_first: bool = True, most: int = 0) -> dict[str, int]:
    """Make what is due, of each after what it reads: what one run made is taken in before the next level."""
    register(house)
    out: dict[str, int] = {}
    for m in materializations(house, names):
        out |= house.materialize([m], now, reset, newest_first, most)
    return out


def create_notifications(house: Warehouse, name: str, indicators: DataFrame | None = None, at: datetime | None = None) -> int:
    """Run a trigger; without indicators given, over the rows of its linked part."""
    instance = Instance(".")
    instance.catalog = house.catalog
    definition = house.catalog.triggers.get(name)
    if definition is None:
        raise ConfigurationError(f"no trigger {name}")
    if indicators is None:
        if definition.kpi_function.strip().lower().startswith("select"):
            register(house)
            indicators = house.spark.sql(adapted(definition.kpi_function))
        else:
            part = definition.trend_store_links[0]["part_name"]
            indicators = generated(house, part, house.part(part).read())
    return house.create_notifications(instance.trigger(name), indicators, at)


def refresh_relation(house: Warehouse, name: str) -> int:
    """Fill one relation anew; returns how many pairs it has."""
    if name not in house.catalog.relations:
        raise ConfigurationError(f"no relation {name}")
    register(house)
    house.fill_relation(name, house.spark.sql(adapted(house.catalog.relations[name].query)))
    return house.relation(name).count()


def cardinality(house: Warehouse, name: str) -> DataFrame:
    """Ids that break what a relation says of its cardinality."""
    return relations.violations(house.relation(name), house.catalog.relations[name].cardinality)
