"""Command line: python -m tidemark.cli FAMILY [COMMAND] ..."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict
from datetime import datetime

import yaml

from tidemark.catalog import Catalog, check
from tidemark.errors import TidemarkError
from tidemark.functions.datatypes import Format
from tidemark.functions.tables import plain, rst
from tidemark.model import Attribute, AttributeStore, NotificationStore, Relation, TrendStore, TriggerDefinition, ViewMaterialization
from tidemark.plans.instance import Instance, load_file
from tidemark.sources.csv import CsvPackage
from tidemark.warehouse import Warehouse


def _spark():
    from pyspark.sql import SparkSession

    from tidemark.session import prepare

    return prepare(SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def _house(args) -> Warehouse:
    return Warehouse(_spark(), args.root)


def _read(path: str) -> dict:
    from pathlib import Path

    return load_file(Path(path))


def _form(path: str) -> CsvPackage:
    with open(path, encoding="utf-8") as file:
        options = yaml.safe_load(file)
    columns = {c["name"]: Format(c["data_type"], **c.get("parser_config", {"null": ""})) for c in options.pop("columns", [])}
    return CsvPackage(**options, columns=columns)


def _table(args, header: list[str], rows) -> None:
    print((rst if getattr(args, "rst", False) else plain)(header, rows))


# loading and initialization


def initialize(args) -> None:
    from tidemark.plans import setup

    house = _house(args)
    setup.initialize(house, Instance(args.instance), print)
    setup.derive(house)


def quick_start(args) -> None:
    from tidemark.plans.instance import skeleton

    print("\n".join(skeleton(args.instance)))


def load_data(args) -> None:
    spark = _spark()
    form = _form(args.parser_config)
    if args.pretend:
        from tidemark.sources.csv import pretend

        return pretend(form.read(spark, args.files))
    house = Warehouse(spark, args.root, Instance(args.instance).load() if args.instance else None)
    done = house.load_many({f: form for f in args.files}, args.data_source)
    print(plain(["file", "stored"], [(f, json.dumps(getattr(s, "rows", s))) for f, s in done.items()]))


def sample_data(args) -> None:
    from tidemark.plans.instance import sample_readings

    rows = sample_readings(_spark(), args.sources, args.start, args.granularity, args.intervals)
    if args.out:
        rows.write.option("header", True).csv(args.out)
    else:
        done = Warehouse(rows.sparkSession, args.root).store(rows.withColumnRenamed("node", "entity"), args.data_source, args.entity_type, args.granularity)
        print(json.dumps(done.rows))


def check_config(args) -> None:
    with open(args.file, encoding="utf-8") as file:
        wrong = check(TrendStore.from_dict(yaml.safe_load(file)))
    print("\n".join(wrong) or "fine")
    if wrong:
        sys.exit(1)


def deduce(args) -> None:
    form = _form(args.parser_config)
    print(yaml.safe_dump(form.definition(list(form.columns), args.data_source), sort_keys=False))


def listing(args) -> None:
    catalog: Catalog = Instance(args.instance).load()
    rows = [(s.data_source, s.entity_type, s.granularity, p.name, len(p.trends)) for s in catalog.trend_stores.values() for p in s.parts]
    _table(args, ["data source", "entity type", "granularity", "part", "trends"], rows)


def report(args) -> None:
    spark = _spark()
    house = Warehouse(spark, args.root, Instance(args.instance).load() if args.instance else None)
    parts = {p.name: house.part(p.name).read() for s in house.catalog.trend_stores.values() for p in s.parts}
    _table(args, ["part", "rows", "entities", "latest"], house.catalog.report(parts, spark).collect())  # one row for each part


def plan(args) -> None:
    instance = Instance(args.instance)
    instance.load()
    print(plain(["source", "target", "over", "granularity", "relation", "kept as"], [(s.source, s.target, s.kind, s.granularity, s.relation, instance.aggregate_view(s) if s.kind == "entity" else "") for s in instance.aggregations()]))


def generate(args) -> None:
    instance = Instance(args.instance)
    instance.load()
    print("\n".join(instance.write_aggregations()))


# definitions


def _create(kind: str, model):
    def run(args) -> None:
        d = model.from_dict(_read(args.file))
        makers = {"trend_stores": lambda c: c.create_trend_store(d), "attribute_stores": lambda c: c.create_attribute_store(d)}
        _house(args).change(makers.get(kind, lambda c: c.define(kind, Catalog.key(kind, d), d)))
        print(f"created {Catalog.key(kind, d)}")

    return run


def _drop(kind: str):
    return lambda args: _house(args).change(lambda c: c.drop(kind, args.name))


def _names(kind: str):
    return lambda args: _table(args, ["name"], [[" ".join(k) if isinstance(k, tuple) else k] for k in sorted(getattr(_house(args).catalog, kind))])


def _show(kind: str):
    def run(args) -> None:
        held = getattr(_house(args).catalog, kind)
        own = held.get(args.name) or next((d for k, d in held.items() if " ".join(k) == args.name), None)
        if own is None:
            raise TidemarkError(f"{kind}: no {args.name}")
        print(yaml.safe_dump(own.to_dict(), sort_keys=False))

    return run


def _trends(method: str):
    def run(args) -> None:
        d = TrendStore.from_dict(_read(args.file))
        options = {"change": "any" if args.force else "upward"} if method == "change_trends" else {}
        done = _house(args).change(lambda c: getattr(c, method)(d, **options))
        print(json.dumps({k: asdict(v) for k, v in done.items()} if isinstance(done, dict) else done))

    return run


def _delete_store(args) -> None:
    _house(args).change(lambda c: c.delete_trend_store(c.trend_store(args.data_source, args.entity_type, args.granularity)))


def add_attribute(args) -> None:
    _house(args).change(lambda c: c.add_attributes(args.store, [Attribute(args.name, args.data_type, description=args.description)]))


def remove_attribute(args) -> None:
    _house(args).change(lambda c: c.remove_attribute(args.store, args.name))


def alias(args) -> None:
    print(_house(args).change(lambda c: c.alias_type(args.name)))


# what runs


def partitions(args) -> None:
    house = _house(args)
    _table(args, ["part", "partition", "packages"], [(p.name, i, len(e)) for s in house.catalog.trend_stores.values() for p in s.parts for i, e in sorted(house.part(p.name).snapshot().entries.items())])


def remove_old(args) -> None:
    now = datetime.fromisoformat(args.now) if args.now else datetime.now()
    print(json.dumps(_house(args).remove_old(now, args.pretend)))


def materialize(args) -> None:
    from tidemark.plans import setup

    print(json.dumps(setup.materialize(_house(args), args.names or None, reset=args.reset, newest_first=args.newest_first, most=args.max_num)))


def live_monitor(args) -> None:
    from tidemark.plans import setup

    house, turn = _house(args), 0
    while not args.rounds or turn < args.rounds:
        print(json.dumps(setup.materialize(house, most=args.batch_size)))
        turn += 1
        if not args.rounds or turn < args.rounds:
            time.sleep(args.poll_timeout)


def process_log(args) -> None:
    house = _house(args)
    house.state().take(house.log_path(), args.reset)


def refresh_current(args) -> None:
    print(json.dumps(_house(args).refresh_current()))


def fill_relations(args) -> None:
    from tidemark.plans import setup

    house = _house(args)
    for name in args.names or sorted(house.catalog.relations):
        print(f"{name}: {setup.refresh_relation(house, name)}")


def fill_virtual(args) -> None:
    from tidemark.plans import setup

    setup.derive(_house(args))


def enable(on: bool):
    return lambda args: _house(args).change(lambda c: c.enable(args.name, on))


def update(kind: str, field: str):
    return lambda args: _house(args).change(lambda c: c.update(kind, args.name, **{field: args.value}))


def update_materialization(args) -> None:
    d = ViewMaterialization.from_dict(_read(args.file))
    _house(args).change(lambda c: c.define("materializations", d.target_trend_store_part, d, replace=True))


def notify(args) -> None:
    from tidemark.plans import setup

    house = _house(args)
    at = datetime.fromisoformat(args.timestamp) if args.timestamp else None
    for name in [args.trigger] if args.trigger else sorted(house.catalog.triggers):
        print(f"{name}: {setup.create_notifications(house, name, at=at)}")


ROOT, FILE, NAME, RST = ("root", {}), ("file", {}), ("name", {}), ("--rst", {"action": "store_true"})
INSTANCE, FLAG = ("instance", {}), {"action": "store_true"}
VALUE = ("value", {})
#: Commands by family ("" for those without), each with what runs it and its arguments.
COMMANDS = {
    "": {
        "quick-start": (quick_start, [INSTANCE]),
        "initialize": (initialize, [INSTANCE, ROOT]),
        "load-data": (load_data, [INSTANCE, ROOT, ("parser_config", {}), ("data_source", {}), ("files", {"nargs": "+"}), ("--pretend", FLAG)]),
        "sample-data": (sample_data, [ROOT, ("--sources", {"type": int, "default": 10}), ("--start", {"default": "2024-01-01 00:00:00"}), ("--granularity", {"default": "15m"}), ("--intervals", {"type": int, "default": 96}), ("--data-source", {"default": "sample"}), ("--entity-type", {"default": "node"}), ("--out", {})]),
        "check-config": (check_config, [FILE]),
        "list": (listing, [INSTANCE, RST]),
        "report": (report, [INSTANCE, ROOT, RST]),
        "aggregation-plan": (plan, [INSTANCE]),
        "live-monitor": (live_monitor, [ROOT, ("--poll-timeout", {"type": float, "default": 2.0}), ("--batch-size", {"type": int, "default": 50}), ("--rounds", {"type": int, "default": 0})]),
    },
    "trend-store": {
        "create": (_create("trend_stores", TrendStore), [ROOT, FILE]),
        "delete": (_delete_store, [ROOT, ("data_source", {}), ("entity_type", {}), ("granularity", {})]),
        "add-trends": (_trends("add_trends"), [ROOT, FILE]),
        "add-parts": (_trends("add_parts"), [ROOT, FILE]),
        "remove-trends": (_trends("remove_trends"), [ROOT, FILE]),
        "change-trends": (_trends("change_trends"), [ROOT, FILE, ("--force", FLAG)]),
        "deduce": (deduce, [("parser_config", {}), ("data_source", {})]),
        "show": (_show("trend_stores"), [ROOT, NAME]),
        "list": (_names("trend_stores"), [ROOT, RST]),
        "process-modified-log": (process_log, [ROOT, ("--reset", FLAG)]),
        "materialize": (materialize, [ROOT, ("names", {"nargs": "*"}), ("--reset", FLAG), ("--max-num", {"type": int, "default": 0}), ("--newest-first", FLAG)]),
    },
    "partition": {"list": (partitions, [ROOT, RST]), "remove-old": (remove_old, [ROOT, ("--now", {}), ("--pretend", FLAG)])},
    "attribute-store": {
        "create": (_create("attribute_stores", AttributeStore), [ROOT, FILE]),
        "delete": (_drop("attribute_stores"), [ROOT, NAME]),
        "add-attribute": (add_attribute, [ROOT, ("store", {}), NAME, ("data_type", {}), ("--description", {"default": ""})]),
        "remove-attribute": (remove_attribute, [ROOT, ("store", {}), NAME]),
        "show": (_show("attribute_stores"), [ROOT, NAME]),
        "list": (_names("attribute_stores"), [ROOT, RST]),
        "materialize-current": (refresh_current, [ROOT]),
    },
    "notification-store": {"create": (_create("notification_stores", NotificationStore), [ROOT, FILE]), "delete": (_drop("notification_stores"), [ROOT, NAME]), "list": (_names("notification_stores"), [ROOT, RST])},
    "relation": {"create": (_create("relations", Relation), [ROOT, FILE]), "remove": (_drop("relations"), [ROOT, NAME]), "materialize": (fill_relations, [ROOT, ("names", {"nargs": "*"})]), "list": (_names("relations"), [ROOT, RST])},
    "virtual-entity": {"materialize": (fill_virtual, [ROOT])},
    "trend-materialization": {
        "create": (_create("materializations", ViewMaterialization), [ROOT, FILE]),
        "update": (update_materialization, [ROOT, FILE]),
        "drop": (_drop("materializations"), [ROOT, NAME]),
        "list": (_names("materializations"), [ROOT, RST]),
    },
    "trigger": {
        "create": (_create("triggers", TriggerDefinition), [ROOT, FILE]),
        "delete": (_drop("triggers"), [ROOT, NAME]),
        "enable": (enable(True), [ROOT, NAME]),
        "disable": (enable(False), [ROOT, NAME]),
        "list": (_names("triggers"), [ROOT, RST]),
        "update-weight": (update("triggers", "weight"), [ROOT, NAME, VALUE]),
        "update-kpi-function": (update("triggers", "kpi_function"), [ROOT, NAME, VALUE]),
        "update-data-function": (update("triggers", "data"), [ROOT, NAME, VALUE]),
        "create-notifications": (notify, [ROOT, ("--trigger", {}), ("--timestamp", {})]),
    },
    "data-source": {"list": (_names("data_sources"), [ROOT, RST])},
    "entity-type": {"list": (_names("entity_types"), [ROOT, RST])},
    "alias": {"create": (alias, [ROOT, NAME]), "list": (_names("aliases"), [ROOT, RST]), "delete": (_drop("aliases"), [ROOT, NAME])},
    "aggregation": {"plan": (plan, [INSTANCE]), "generate": (generate, [INSTANCE])},
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    top = parser.add_subparsers(required=True)
    for family, commands in COMMANDS.items():
        under = top.add_parser(family).add_subparsers(required=True) if family else top
        for name, (run, options) in commands.items():
            command = under.add_parser(name)
            for option, settings in options:
                command.add_argument(option, **settings)
            command.set_defaults(run=run)
    args = parser.parse_args(argv)
    try:
        args.run(args)
    except TidemarkError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
