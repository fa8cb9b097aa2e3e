import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.catalog import Catalog, check
from tidemark.errors import ConfigurationError, DuplicateDefinition, NoSuchTrend, NoSuchTrendStore
from tidemark.functions.datatypes import Format
from tidemark.model import Attribute, AttributeStore, Part, Trend, TrendStore
from tidemark.plans import setup
from tidemark.plans.instance import Instance, adapted, expression, sample_readings
from tidemark.sources import csv
from tidemark.warehouse import Warehouse

STORE = """
title: Raw buoy measurements
data_source: buoynet
entity_type: mooring
granularity: 30m
partition_size: 2d
retention_period: 10d
parts:
  - name: buoynet_mooring_sea_30m
    trends:
      - {name: wave_height, data_type: numeric, time_aggregation: MAX, entity_aggregation: MAX}
      - {name: swells, data_type: integer}
    generated_trends:
      - {name: steep, data_type: numeric, expression: wave_height * 10}
"""
DERIVED = """
data_source: buoynet-derived
entity_type: mooring
granularity: 30m
partition_size: 2d
parts:
  - name: derived_mooring_energy_30m
    trends: [{name: energy, data_type: numeric}]
"""
HOURLY = """
data_source: buoynet
entity_type: mooring
granularity: 1h
partition_size: 4d
parts:
  - name: buoynet_mooring_sea_1h
    trends:
      - {name: samples, data_type: bigint}
      - {name: wave_height, data_type: numeric, time_aggregation: MAX}
      - {name: swells, data_type: bigint}
"""
BAYS = """
name: mooring->bay
source_entity_type: mooring
target_entity_type: bay
cardinality: many-to-one
query: SELECT m.id, b.id FROM entity."bay" b, entity."mooring" m WHERE startswith(m.name, concat(b.name, '/'))
"""
ENERGY = """
target_trend_store_part: derived_mooring_energy_30m
sources: [{trend_store_part: buoynet_mooring_sea_30m}]
view: SELECT entity_id, timestamp, wave_height * wave_height * swells AS energy FROM trend."buoynet_mooring_sea_30m" WHERE steep > 1
"""
BY_HOUR = """
target_trend_store_part: buoynet_mooring_sea_1h
sources: [{trend_store_part: buoynet_mooring_sea_30m}]
function: {kind: time, source: buoynet_mooring_sea_30m}
processing_delay: 1h
"""
ROUGH = """
name: rough sea
kpi_data: [{name: wave_height, data_type: numeric}]
kpi_function: SELECT entity_id, timestamp, wave_height FROM trend."buoynet_mooring_sea_30m"
thresholds: [{name: safe, data_type: numeric, value: 2.5}]
condition: wave_height >= safe
weight: SELECT CASE WHEN $1.wave_height > 4 THEN 90 WHEN $1.wave_height > 3 THEN 50 ELSE 10 END
notification: SELECT array_to_string(ARRAY[format('waves of %s m', $1.wave_height), 'keep off'], ' - ')
data: "format('[%s]', $1.wave_height)"
granularity: 30m
notification_store: warnings
"""
WARNINGS = """
data_source: warnings
attributes:
  - {name: rule_id, data_type: integer}
  - {name: details, data_type: text}
  - {name: data, data_type: json}
  - {name: weight, data_type: integer}
  - {name: created, data_type: timestamp with time zone}
"""
SITE = """
data_source: survey
entity_type: mooring
attributes: [{name: depth, data_type: integer}, {name: anchor, data_type: text}]
"""
FILES = {"trend": [STORE, DERIVED, HOURLY], "relation": [BAYS], "materialization": [ENERGY, BY_HOUR], "trigger": [ROUGH], "notification": [WARNINGS], "attribute": [SITE]}


@pytest.fixture
def root(tmp_path):
    for folder, texts in FILES.items():
        (tmp_path / "i" / folder).mkdir(parents=True)
        for k, text in enumerate(texts):
            (tmp_path / "i" / folder / f"d{k}.yaml").write_text(text)
    (tmp_path / "i" / "virtual-entity").mkdir()
    (tmp_path / "i" / "virtual-entity" / "bay.sql").write_text("CREATE VIEW bays AS SELECT DISTINCT split(name, '/')[0] AS name FROM entity.\"mooring\";")
    (tmp_path / "i" / "aggregation").mkdir()
    (tmp_path / "i" / "aggregation" / "hints.yaml").write_text("mooring->bay: VIEW_MATERIALIZATION")
    return tmp_path


FORM = csv.CsvPackage(identifier="mooring", granularity="30m", entity_type="mooring", columns={"wave_height": Format("numeric", null=""), "swells": Format("integer", null=""), "crew": Format("text", null="")})
LINES = """mooring,timestamp,wave_height,swells,crew
skerry/1,2023-12-17T10:30:00Z,1.5,4,a
skerry/1,2023-12-17 11:00:00,,2,b
fjord/7,2023-12-17T11:30:00+01:00,3.25,1,c
fjord/7,2023-12-17T11:00:00Z,4.5,2,c
"""


def test_instance_from_files_to_notifications(spark, root):
    path = root / "sea.csv.gz"
    with gzip.open(path, "wt") as file:
        file.write(LINES)
    instance = Instance(root / "i")
    house = Warehouse(spark, str(root / "w"))
    said = []
    steps = setup.initialize(house, instance, said.append)
    assert steps == ["pre-init", "attribute stores", "trend stores", "notification stores", "virtual entities", "relations", "pre-materialization-init", "materializations", "triggers", "post-init"]
    setup.initialize(house, Instance(root / "i"), said.append)  # once more: all is there
    assert sum("is there already" in x for x in said) == 9
    done = house.load(str(path), FORM, "buoynet")
    assert done.rows == {"buoynet_mooring_sea_30m": 4} and house.load(str(path), FORM, "BUOYNET").job == 2
    assert house.jobs().where("finished is not null").count() == 2
    part = house.part("buoynet_mooring_sea_30m").read()
    assert part.count() == 4 and {r.job_id for r in part.collect()} == {2}
    assert sorted((r.id, r.name) for r in house.entities("mooring").collect()) == [(1, "fjord/7"), (2, "skerry/1")]
    setup.derive(house)
    setup.derive(house)
    assert sorted(r.name for r in house.entities("bay").collect()) == ["fjord", "skerry"]
    assert house.relation("mooring->bay").count() == 2 and setup.cardinality(house, "mooring->bay").count() == 0
    # another session finds the same catalogue
    again = Warehouse(spark, str(root / "w"))
    late = datetime(2024, 1, 1)
    assert setup.materialize(again, now=late) == {"buoynet_mooring_sea_1h": 0, "derived_mooring_energy_30m": 0}  # stored just now: not yet at rest
    soon = datetime(2100, 1, 1)
    again.change(lambda c: [c.update("materializations", m, reprocessing_period="100000d") for m in list(c.materializations)])
    assert setup.materialize(again, now=soon) == {"buoynet_mooring_sea_1h": 1, "derived_mooring_energy_30m": 2}
    energy = again.part("derived_mooring_energy_30m").read()
    assert sorted(float(r.energy) for r in energy.collect()) == [9.0, 10.5625, 40.5]
    hourly = again.part("buoynet_mooring_sea_1h").read()
    assert sorted((r.entity_id, float(r.wave_height), r.samples) for r in hourly.collect()) == [(1, 4.5, 2), (2, 1.5, 2)]
    assert setup.materialize(again, now=soon) == {"buoynet_mooring_sea_1h": 0, "derived_mooring_energy_30m": 0}
    assert setup.materialize(again, ["derived_mooring_energy_30m"], now=soon, reset=True, most=1) == {"derived_mooring_energy_30m": 1}
    assert setup.create_notifications(again, "rough sea") == 2 and setup.create_notifications(again, "rough sea", at=datetime(2023, 12, 17, 11)) == 1
    notes = again.notifications("warnings").orderBy("id").collect()
    assert [(r.id, r.weight, r.details) for r in notes] == [(1, 50, "waves of 3.250000000 m - keep off"), (2, 90, "waves of 4.500000000 m - keep off"), (3, 90, "waves of 4.500000000 m - keep off")]
    again.change(lambda c: c.enable("rough sea", False))
    assert setup.create_notifications(again, "rough sea") == 0
    assert again.remove_old(datetime(2024, 6, 1), pretend=True) == {"buoynet_mooring_sea_30m": [9854]} and again.remove_old(datetime(2023, 12, 18)) == {"buoynet_mooring_sea_30m": []}
    again.clear("buoynet_mooring_sea_30m", datetime(2023, 12, 17, 11))
    assert again.part("buoynet_mooring_sea_30m").read().count() == 2
    with pytest.raises(NoSuchTrendStore):
        house.load(str(path), FORM, "elsewhere")
    assert "no trend store" in house.load_many({str(path): FORM}, "elsewhere")[str(path)]


def test_a_failing_materialization_does_not_stop_others(spark, root):
    house = Warehouse(spark, str(root / "w"))
    setup.initialize(house, Instance(root / "i"))
    house.change(lambda c: [c.update("materializations", m, reprocessing_period="100000d") for m in list(c.materializations)])
    house.change(lambda c: c.update("materializations", "buoynet_mooring_sea_1h", function=None, view="SELECT nothing FROM trend.\"buoynet_mooring_sea_30m\""))
    house.store(spark.createDataFrame([("skerry/1", datetime(2023, 12, 17, 10), 2.0)], "entity string, timestamp timestamp, wave_height double"), "buoynet", "mooring", "30m")
    assert setup.materialize(house, now=datetime(2100, 1, 1)) == {"buoynet_mooring_sea_1h": -1, "derived_mooring_energy_30m": 1}


def test_attributes_on_disk(spark, root):
    house = Warehouse(spark, str(root / "w"))
    setup.initialize(house, Instance(root / "i"))
    days = [datetime(2023, 1, d) for d in (1, 2, 3)]
    make = lambda *r: spark.createDataFrame(list(r), "entity string, timestamp timestamp, depth int, anchor string, colour string")
    house.store_attributes("survey_mooring", make(("a", days[0], 10, "x", "red"), ("b", days[0], 7, "y", "red"), ("a", days[1], 10, "x", "red"), (None, days[0], 1, "z", "red")))
    table = house.attribute_table("survey_mooring")
    assert table.history().count() == 3 and table.current().count() == 0
    assert list(house.refresh_current()) == ["survey_mooring"] and house.refresh_current() == {}
    assert sorted((r.depth, r.anchor) for r in table.current().collect()) == [(7, "y"), (10, "x")]
    table.compact()
    assert table.history().count() == 2
    before = table.history().where("depth = 7").first().modified
    house.store_attributes("survey_mooring", make(("b", days[0], 8, "y", "red"), ("b", days[2], 9, None, "red")))
    assert [(r.depth, r.modified > before) for r in table.history().where("depth between 7 and 9").orderBy("timestamp").collect()] == [(8, True), (9, True)]
    assert len(table.stale()) == 1 and len(house.refresh_current()["survey_mooring"]) == 1
    assert sorted((r.depth, r.anchor or "") for r in table.current().collect()) == [(9, ""), (10, "x")]
    assert table.with_end().where("end is null").count() == 2
    assert table.store(make().drop("entity", "depth", "anchor").withColumn("entity_id", F.lit(1).cast("bigint"))) == []
    house.change(lambda c: c.add_attributes("survey_mooring", [Attribute("depth", "bigint"), Attribute("colour", "text")]))
    house.store_attributes("survey_mooring", make(("a", days[2], 3, "x", "blue")))
    wide = house.attribute_table("survey_mooring").history()
    assert dict(wide.dtypes)["depth"] == "bigint" and [r.colour for r in wide.orderBy("timestamp", "colour").collect()][-1] == "blue"


def test_texts_get_types(spark, root):
    house = Warehouse(spark, str(root / "w"))
    setup.initialize(house, Instance(root / "i"))
    texts = spark.createDataFrame([("a", datetime(2023, 1, 1), "12", "0.5", "x"), ("b", datetime(2023, 1, 1), "70000", "", "y")], "entity string, timestamp timestamp, depth string, slope string, anchor string")
    assert house.store_texts("survey_mooring", texts) == {"depth": "integer", "slope": "real", "anchor": "text"}
    wider = texts.select("entity", "timestamp", F.concat("depth", F.lit("000000")).alias("depth"))
    assert house.store_texts("survey_mooring", wider) == {"depth": "bigint"}
    got = house.attribute_table("survey_mooring").history()
    assert sorted((r.depth, r.slope, r.anchor) for r in got.collect()) == [(12000000, 0.5, "x"), (70000000000, None, "y")]


def test_readers_of_installed_packages(spark, monkeypatch):
    class Point:
        name = "ready-made"

        def load(self):
            return lambda session, path, options: session.range(3)

    monkeypatch.setattr(csv, "entry_points", lambda group: [Point()])
    assert csv.load(spark, "ready-made", "x").count() == 3 and csv.discover() == []
    csv.READERS.pop("ready-made")


def test_progress(spark, tmp_path):
    from tidemark.streaming.progress import Progress

    seen = Progress().follow(spark)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen.wait("ended").error is None and seen.wait("batch").rows == 5
    seen.leave(spark)


def test_aggregates_of_an_instance(spark, root):
    instance = Instance(root / "i")
    catalog = instance.load()
    assert Catalog.from_text(catalog.to_text()).to_text() == catalog.to_text()
    nodes = spark.createDataFrame([(1, "fjord/7"), (2, "skerry/1")], "id bigint, name string")
    part = spark.createDataFrame([(1, datetime(2023, 12, 17, 10, 30), 3.25, 1), (1, datetime(2023, 12, 17, 11), 4.5, 2), (2, datetime(2023, 12, 17, 11), 1.0, 5)], "entity_id bigint, timestamp timestamp, wave_height double, swells int")
    bays = spark.createDataFrame([(1, "fjord"), (2, "skerry")], "id bigint, name string")
    instance.register(spark, {("entity", "mooring"): nodes, ("entity", "bay"): bays, ("trend", "buoynet_mooring_sea_30m"): part})
    assert instance.relation(spark, "mooring->bay").count() == 2
    made = instance.run(spark, {"buoynet_mooring_sea_30m": part})
    hour = made["buoynet_mooring_sea_1h"].where("entity_id = 1").first()
    assert (hour.wave_height, hour.swells, hour.samples, float(hour.steep)) == (4.5, 3, 2, 45)
    assert made["buoynet_bay_sea_1d"].count() == 2
    assert instance.aggregate_view(next(s for s in instance.aggregations() if s.kind == "entity")) == "VIEW_MATERIALIZATION"
    files = instance.write_aggregations()
    assert len(files) > 6
    (root / "i" / "trend" / "d2.yaml").unlink()  # the hourly store is written now
    (root / "i" / "materialization" / "d1.yaml").unlink()
    written = Instance(root / "i").load()
    assert written.trend("buoynet_mooring_sea_1d", "swells").data_type == "bigint" and written.part("buoynet_bay_sea_1h")[0].entity_type == "bay"
    assert written.part("buoynet_mooring_sea_1h")[1].generated_trends[0].name == "steep"
    report = catalog.report({"p": part}, spark).first()
    assert (report.rows, report.entities) == (3, 2)


def test_strict_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity,timestamp,x\na,2023-01-01 00:00:00,1\na,yesterday,2\n")
    form = csv.CsvPackage(columns={"x": Format("integer", null="")})
    with pytest.raises(Exception, match="Error parsing timestamp 'yesterday'"):
        form.read(spark, str(tmp_path / "a.csv")).collect()
    assert form.read(spark, str(tmp_path / "a.csv"), strict=False).where("timestamp is null").count() == 1
    with pytest.raises(ConfigurationError, match="no such columns"):
        csv.CsvPackage(identifier="cell").read(spark, str(tmp_path / "a.csv"))
    now = csv.CsvPackage(timestamp="current_timestamp").read(spark, str(tmp_path / "a.csv"), now=F.lit(datetime(2020, 1, 1)).cast("timestamp"))
    assert {r.timestamp for r in now.collect()} == {datetime(2020, 1, 1)}
    with pytest.raises(ConfigurationError):
        csv.load(spark, "xml", "x")


def test_copies_escape(spark, tmp_path):
    rows = [(1, "a\tb\\c\nd\re", 1.5), (2, None, None), (3, "\\N", 0.1), (4, "", 2.0)]
    df = spark.createDataFrame(rows, "k bigint, t string, x double")
    csv.copy_to(df, str(tmp_path / "c"))
    back = csv.copy_from(spark, str(tmp_path / "c"), {"k": "bigint", "t": "text", "x": "double precision"})
    assert sorted(map(tuple, back.collect())) == rows
    texts = csv.package_json(df.withColumnRenamed("k", "entity_id").withColumn("timestamp", F.lit(datetime(2020, 1, 1)).cast("timestamp")))
    assert sorted(r.t or "" for r in csv.package_from_json(texts, "t string, x double").collect()) == sorted(r[1] or "" for r in rows)


def test_catalog():
    c = Catalog()
    store = TrendStore("hub", "node", "15m", "1d", [Part("p", [Trend("x", "integer")])])
    c.create_trend_store(store)
    with pytest.raises(DuplicateDefinition):
        c.create_trend_store(store)
    wider = TrendStore("HUB", "Node", "15m", "1d", [Part("p", [Trend("x", "real"), Trend("y", "text")]), Part("q", [Trend("z", "text")])])
    assert c.add_parts(wider) == ["q"]
    changes = c.change_trends(wider)["p"]
    assert (changes.added, changes.removed, changes.changed) == (["y"], [], {"x": ("integer", "real")})
    assert c.change_trends(store)["p"].removed == ["y"] and c.trend("p", "x").data_type == "real"
    assert c.change_trends(store, change="any")["p"].changed == {"x": ("real", "integer")}
    with pytest.raises(NoSuchTrend):
        c.trend("p", "y")
    c.delete_trend_store(store)
    with pytest.raises(NoSuchTrendStore):
        c.trend_store("hub", "node", "15m")
    assert len(check(TrendStore("a", "b", "15x", "1d", [Part("p", [Trend("x", "nope")]), Part("p", [])]))) == 3
    c.create_attribute_store(AttributeStore("s", "node", [Attribute("a", "integer")]))
    assert c.add_attributes("s_node", [Attribute("a", "bigint"), Attribute("b", "text")]).added == ["b"]
    c.remove_attribute("s_node", "b")
    job = c.start_job({"x": 1})
    c.end_job(job)
    assert c.jobs[0]["finished"] is not None and c.data_source("Hub") == c.data_source("hub")


def test_definitions_tell_what_is_wrong():
    with pytest.raises(ConfigurationError, match="missing entity_type"):
        TrendStore.from_dict({"data_source": "a", "granularity": "15m", "partition_size": "1d", "parts": []})
    with pytest.raises(ConfigurationError, match="unknown colour"):
        Trend.from_dict({"name": "x", "data_type": "text", "colour": 1})
    assert TrendStore.from_dict({"data_source": "a", "entity_type": "b", "granularity": "15m", "partition_size": "1d", "parts": [{"name": "p", "trends": []}]}).to_dict()["parts"] == [{"name": "p", "trends": [], "generated_trends": []}]


def test_sql_texts():
    assert adapted("SELECT \"a\" FROM trend.\"x y\";") == "SELECT `a` FROM `x y`"
    assert expression("SELECT $1.a::text") == "a"


def test_sample_readings(spark):
    df = sample_readings(spark, 3, "2020-01-01 00:00:00", "15m", 4)
    assert df.count() == 12 and df.agg(F.max("timestamp")).first()[0] == datetime(2020, 1, 1, 1)


def test_command_line(spark, root, capsys):
    i, w = str(root / "i"), str(root / "w")
    said = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    assert "buoynet_mooring_sea_30m" in said("list", i)[1]
    assert "buoynet_bay_sea_1h" in said("aggregation-plan", i)[1]
    assert said("check-config", str(root / "i" / "trend" / "d0.yaml"))[0] == 0
    assert "trend stores" in said("initialize", i, w)[1]
    assert "derived_mooring_energy_30m" in said("trend-materialization", "list", w)[1]
    assert said("trigger", "update-weight", w, "rough sea", "SELECT 7")[0] == 0 and "SELECT 7" not in said("trigger", "list", w)[1]
    assert said("trigger", "disable", w, "rough sea")[0] == 0 and said("trigger", "create-notifications", w)[1] == "rough sea: 0\n"
    assert said("attribute-store", "add-attribute", w, "survey_mooring", "owner", "text")[0] == 0 and "owner" in said("attribute-store", "show", w, "survey_mooring")[1]
    assert said("sample-data", w, "--data-source", "buoynet", "--entity-type", "mooring", "--granularity", "30m", "--sources", "2", "--intervals", "3")[0] == 0
    assert said("relation", "materialize", w)[1] == "mooring->bay: 0\n" and said("virtual-entity", "materialize", w)[0] == 0
    assert "samples" not in said("trend-store", "materialize", w)[1] and said("live-monitor", w, "--rounds", "1")[0] == 0
    assert said("partition", "list", w)[0] == 0 and said("attribute-store", "materialize-current", w)[1] == "{}\n"
    assert said("notification-store", "delete", w, "nothing")[0] == 1
    assert said("trend-store", "delete", w, "buoynet", "mooring", "1h")[0] == 0 and "1h" not in said("trend-store", "list", w)[1]
    assert said("aggregation", "generate", i)[0] == 0
    assert "first.yaml" in said("quick-start", str(root / "new"))[1] and "first_thing_15m" in said("list", str(root / "new"))[1]
    (root / "i" / "trend" / "y.json").write_text('{"data_source": 1}')
    assert cli.main(["list", i]) == 1
