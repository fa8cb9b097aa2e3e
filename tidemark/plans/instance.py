"""An instance: a folder of definitions that becomes a catalogue and views over the stored parts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.errors import ConfigurationError
from tidemark.functions.datatypes import promoted, spark_type
from tidemark.functions.granularity import PARTITION_SIZES, parse
from tidemark.model import AttributeStore, NotificationStore, Relation, TrendStore, TriggerDefinition, ViewMaterialization
from tidemark.operators import aggregate, relations, triggers

#: Folders of an instance with what they define, in the order in which they are read.
FOLDERS = {
    "attribute": AttributeStore,
    "trend": TrendStore,
    "notification": NotificationStore,
    "relation": Relation,
    "materialization": ViewMaterialization,
    "trigger": TriggerDefinition,
}


def load_file(path: Path) -> dict:
    """A definition from a YAML or JSON file."""
    if path.suffix in (".yaml", ".yml"):
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    if path.suffix == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    raise ConfigurationError(f"{path}: neither YAML nor JSON")


def adapted(sql: str) -> str:
    """SQL that names tables by schema ("trend"."x", entity."y") and uses regular substrings, as Spark takes it."""
    out = re.sub(r"\b(trend|entity|attribute|attribute_history|relation)\.\"([^\"]+)\"", lambda m: f"`{view_name(m[1], m[2])}`", sql)
    out = re.sub(r"\bsubstring\(\s*([^()]+?)\s+from\s+('(?:[^']|'')*')\s*\)", r"nullif(regexp_extract(\1, \2, 1), '')", out, flags=re.I)
    out = re.sub(r'"([^"]+)"', r"`\1`", out)
    return out.rstrip().rstrip(";")


def view_name(schema: str, name: str) -> str:
    """The temporary view that stands for a table of a schema."""
    return name if schema == "trend" else f"{schema}_{name}"


class Instance:
    """The definitions of a folder and the tables they speak of."""

    def __init__(self, root: str | Path | None = None, given: dict[str, list] | None = None):
        """root: the folder; or given: the same by folder, definitions as dictionaries and statements as texts."""
        self.root = Path(root or ".")
        self.given = given
        self.catalog = Catalog()
        self.hints: dict[str, str] = {}

    def definitions(self, kind: str) -> list:
        """All definitions of a folder, by file name."""
        if self.given is not None:
            return [FOLDERS[kind].from_dict(d) for d in self.given.get(kind, [])]
        folder = self.root / kind
        files = sorted(p for p in folder.glob("**/*") if p.suffix in (".yaml", ".yml", ".json")) if folder.exists() else []
        out = []
        for path in files:
            try:
                out.append(FOLDERS[kind].from_dict(load_file(path)))
            except ConfigurationError as error:
                raise ConfigurationError(f"{path}: {error}") from error
        return out

    def scripts(self, folder: str) -> list[str]:
        """Statements of a folder's SQL files, by file name."""
        path = self.root / folder
        if self.given is not None:
            return [x.strip() for t in self.given.get(folder, []) for x in adapted(t).split(";") if x.strip()]
        texts = [p.read_text(encoding="utf-8") for p in sorted(path.glob("**/*.sql"))] if path.exists() else []
        return [s.strip() for t in texts for s in adapted(t).split(";") if s.strip()]

    def load(self) -> Catalog:
        """Read every definition into the catalogue."""
        c = self.catalog
        for d in self.definitions("attribute"):
            c.create_attribute_store(d)
        for d in self.definitions("trend"):
            c.create_trend_store(d)
        for d in self.definitions("notification"):
            c.define("notification_stores", d.data_source, d)
        for d in self.definitions("relation"):
            c.define("relations", d.name, d)
        for d in self.definitions("materialization"):
            c.define("materializations", d.target_trend_store_part, d)
        for d in self.definitions("trigger"):
            c.define("triggers", d.name, d)
        for path in sorted((self.root / "aggregation").glob("*hints*.yaml")) if self.given is None and (self.root / "aggregation").exists() else []:
            self.hints |= load_file(path) or {}
        return c

    def register(self, spark: SparkSession, tables: dict[tuple[str, str], DataFrame]) -> None:
        """Make tables known to the instance's SQL: (schema, name) -> rows."""
        for (schema, name), df in tables.items():
            df.createOrReplaceTempView(f"`{view_name(schema, name)}`")

    def run_scripts(self, spark: SparkSession, folder: str) -> None:
        for statement in self.scripts(folder):
            spark.sql(statement)

    def virtual_entities(self, spark: SparkSession, entities: DataFrame) -> DataFrame:
        """The entities with those added that the folder's queries give."""
        for query in self.scripts("virtual-entity"):
            body = re.sub(r"^\s*create\s+(?:or\s+replace\s+)?view\s+\S+\s+as\s+", "", query, flags=re.I | re.S)
            entities = relations.virtual_entities(entities, spark.sql(body).toDF("name"))
        return entities

    def relation(self, spark: SparkSession, name: str) -> DataFrame:
        """A relation, filled anew from its query."""
        return relations.refresh(spark.sql(adapted(self.catalog.relations[name].query)))

    def materialized(self, spark: SparkSession, target: str) -> DataFrame:
        """The rows of a derived part, from its view."""
        definition = self.catalog.materializations[target]
        if not definition.view:
            raise ConfigurationError(f"{target} has no view")
        return spark.sql(adapted(definition.view))

    def trigger(self, name: str) -> triggers.Trigger:
        """A trigger with its thresholds and expressions."""
        d = self.catalog.triggers[name]
        return triggers.Trigger(name, tuple(f.name for f in d.kpi_data), {f.name: f.value for f in d.thresholds}, expression(d.condition), expression(d.weight), expression(d.notification), expression(d.data))

    def aggregations(self) -> list[aggregate.Step]:
        """The steps that derive the standard aggregates of all raw stores."""
        steps = []
        for store in self.catalog.trend_stores.values():
            if "raw" not in (store.title or "").lower():
                continue
            own = {r.name: r.target_entity_type for r in self.catalog.relations.values() if r.source_entity_type.strip() == store.entity_type}
            for part in store.parts:
                steps += aggregate.cascade(part.name, store.granularity, store.entity_type, own)
        return steps

    def measures(self, part: str) -> list[aggregate.Measure]:
        """The trends of a part with their aggregates."""
        return [aggregate.Measure(t.name, t.data_type, t.time_aggregation, t.entity_aggregation) for t in self.catalog.part(part)[1].trends]

    def aggregate_view(self, step: aggregate.Step) -> str:
        """Whether a step's result is a view (made when read) or stored; views by default, hints decide."""
        return self.hints.get(step.relation or "", "VIEW")

    def generated(self, part: str, df: DataFrame) -> DataFrame:
        """The rows of a part with its generated trends."""
        own = self.catalog.part(part)[1].generated_trends
        return df.withColumns({t.name: F.expr(adapted(t.expression)).cast(spark_type(t.data_type)) for t in own}) if own else df

    def aggregate_definitions(self, step: aggregate.Step) -> tuple[dict, dict]:
        """The trend store and the materialization that a step stands for, as definitions; generated trends go on with their expressions."""
        base = self._base(step.source)
        own, part = self.catalog.part(base)
        relation = self.catalog.relations.get(step.relation or "")
        entity_type = relation.target_entity_type if relation else own.entity_type
        trends = [{"name": "samples", "data_type": "bigint"}]
        for t in part.trends:
            kind = t.time_aggregation if step.kind == "time" else t.entity_aggregation
            trends.append({"name": t.name, "data_type": promoted(kind, t.data_type), "time_aggregation": t.time_aggregation, "entity_aggregation": t.entity_aggregation})
        generated = [{"name": t.name, "data_type": t.data_type, "expression": t.expression} for t in part.generated_trends]
        store = {"title": f"Aggregate of {step.source}", "data_source": own.data_source, "entity_type": entity_type, "granularity": step.granularity, "partition_size": PARTITION_SIZES[step.granularity], "parts": [{"name": step.target, "trends": trends} | ({"generated_trends": generated} if generated else {})]}
        made = {"target_trend_store_part": step.target, "enabled": True, "sources": [{"trend_store_part": step.source, "mapping_function": f"mapping_{step.granularity}"}], "function": {"kind": step.kind, "source": step.source, "granularity": step.granularity} | ({"relation": step.relation} if step.relation else {})}
        return store, made

    def write_aggregations(self) -> list[str]:
        """Write the definitions of all standard aggregates into the instance's folders; returns the files. A store that several parts share gets all of them."""
        stores: dict[tuple, dict] = {}
        files = []
        for step in self.aggregations():
            own, made = self.aggregate_definitions(step)
            key = (own["data_source"], own["entity_type"], own["granularity"])
            if key in stores:
                stores[key]["parts"] += own["parts"]
            else:
                stores[key] = own
            files.append(self._write("materialization", step.target, made))
        for key, own in stores.items():
            files.append(self._write("trend", "aggregate_" + "_".join(key), own))
        return files

    def _write(self, folder: str, name: str, definition: dict) -> str:
        path = self.root / folder / f"{name}.yaml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump(definition, sort_keys=False), encoding="utf-8")
        return str(path)

    def _base(self, part: str) -> str:
        """The raw part that a part is derived from."""
        for step in self.aggregations():
            if step.target == part:
                return self._base(step.source)
        return part

    def run(self, spark: SparkSession, parts: dict[str, DataFrame], steps: list[aggregate.Step] | None = None) -> dict[str, DataFrame]:
        """All aggregates of the given parts, lazily."""
        made = dict(parts)
        for step in steps if steps is not None else self.aggregations():
            if step.source not in made:
                continue
            base = next((p for p in parts if step.source.startswith(re.sub(r"_\d+\w+$", "", p))), step.source)
            measures = self.measures(base) if base in parts else [aggregate.Measure(c) for c in made[step.source].columns if c not in ("entity_id", "timestamp", "samples", "created", "job_id")]
            own = made[step.source]
            out = aggregate.time_aggregate(own, measures, step.granularity) if step.kind == "time" else aggregate.entity_aggregate(own, self.relation(spark, step.relation), measures)
            made[step.target] = self.generated(base, out) if base in parts else out
        return made


def expression(text: str) -> str:
    """An expression over indicators, written as a SELECT over $1, as a Spark SQL expression."""
    out = re.sub(r"^\s*select\s+", "", text.strip().rstrip(";"), flags=re.I)
    out = out.replace("$1.", "")
    out = re.sub(r"::(json|jsonb|text)\b", "", out)
    out = re.sub(r"array_to_string\(\s*array\[(.*?)\]\s*,\s*(E?'(?:[^']|'')*')\s*\)", lambda m: f"concat_ws({m[2].removeprefix('E')}, {m[1]})", out, flags=re.I | re.S)
    return re.sub(r"\bformat\(", "format_string(", out, flags=re.I)


def sample_readings(spark: SparkSession, sources: int, start: str, granularity: str, intervals: int, seed: int = 1) -> DataFrame:
    """Made-up measurements of a number of sources over intervals after a start."""
    step = parse(granularity)
    at = F.lit(start).cast("timestamp") + F.make_dt_interval(secs=(F.col("k") * step.seconds).cast("decimal(18,6)"))
    grid = spark.range(sources).withColumnRenamed("id", "source").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(intervals))))
    noise = lambda n: (F.pmod(F.xxhash64("source", "k", F.lit(seed + n)), F.lit(1000)) / 1000).cast("double")
    return grid.select(F.format_string("node-%07d", "source").alias("node"), at.alias("timestamp"), F.round(10 + 5 * noise(0), 2).alias("outside_temp"), F.round(20 + 2 * noise(1), 2).alias("inside_temp"), F.round(30 * noise(2), 3).alias("power_kwh"))


def skeleton(root: str | Path) -> list[str]:
    """An empty instance: its folders, and a first trend store to change. Returns what was made; what is there stays."""
    made = []
    for folder in (*FOLDERS, "virtual-entity", "aggregation", "custom/pre-init", "custom/pre-materialization-init", "custom/post-init"):
        path = Path(root, folder)
        if not path.exists():
            path.mkdir(parents=True)
            made.append(str(path))
    first = Path(root, "trend", "first.yaml")
    if not first.exists():
        store = {"title": "Raw first measurements", "data_source": "first", "entity_type": "thing", "granularity": "15m", "partition_size": PARTITION_SIZES["15m"], "parts": [{"name": "first_thing_15m", "trends": [{"name": "measured", "data_type": "numeric"}]}]}
        first.write_text(yaml.safe_dump(store, sort_keys=False), encoding="utf-8")
        made.append(str(first))
    return made


#: Ways to make a package known by a plugin's name: (session, options) -> rows.
GENERATORS: dict[str, Callable[..., DataFrame]] = {"readings": sample_readings}
