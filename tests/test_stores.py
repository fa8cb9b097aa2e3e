from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.granularity import parse
from tidemark.operators import aggregate, attributes, package, relations, store, triggers
from tidemark.streaming import incremental

T = datetime(2013, 4, 25, 9, 45)
PART = "entity_id bigint, timestamp timestamp, created timestamp, job_id bigint, a smallint, b smallint, c smallint"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_upsert(spark):
    empty = spark.createDataFrame([], PART)
    schema = "entity_id bigint, timestamp timestamp, a smallint, b smallint, c smallint"
    first = store.upsert(empty, spark.createDataFrame([(1234, T, 1, 2, 3), (2345, T, 4, 5, 6), (None, T, 0, 0, 0)], schema), job=1, now=F.lit(T))
    second = store.upsert(first, spark.createDataFrame([(2345, T, 4, 5, 7)], schema), job=2, now=F.lit(datetime(2020, 1, 1)))
    assert rows(second, "entity_id", "job_id", "created", "c") == [(1234, 1, T, 3), (2345, 2, T, 7)]
    third = store.upsert(second, spark.createDataFrame([(2345, T, None)], "entity_id bigint, timestamp timestamp, b smallint"), job=3)
    assert rows(third.where("entity_id = 2345"), "a", "b", "c") == [(4, None, 7)]
    again = store.upsert(third, spark.createDataFrame([(2345, T, None)], "entity_id bigint, timestamp timestamp, b smallint"), job=3)
    assert rows(again, *again.columns) == rows(third, *third.columns)


def test_last_of_a_batch_wins(spark):
    new = spark.createDataFrame([(1, T, 5, 1), (1, T, 9, 3), (1, T, 7, 2)], "entity_id bigint, timestamp timestamp, a smallint, seq int")
    out = store.upsert(spark.createDataFrame([], PART), new, order=[F.col("seq")])
    assert rows(out, "a") == [(9,)]


def test_table_on_disk(spark, tmp_path):
    schema = "entity_id bigint, timestamp timestamp, created timestamp, job_id bigint, a smallint"
    table = store.TrendTable(spark, str(tmp_path / "t"), schema, parse("1d"))
    assert table.read().count() == 0 and table.store(spark.createDataFrame([], schema)) == []
    make = lambda *r: spark.createDataFrame(list(r), "entity_id bigint, timestamp timestamp, a smallint, z int")
    days = table.store(make((1, T, 1, 0), (2, T.replace(day=26), 2, 0)), job=1)
    before = table.manifest()
    assert table.store(make((1, T, 3, 0)), job=2) == days[:1]
    assert table.manifest()[days[1]] == before[days[1]]
    assert rows(table.read(), "entity_id", "a", "job_id") == [(1, 3, 2), (2, 2, 1)]
    assert rows(table.read(days[1:]), "entity_id") == [(2,)]
    assert table.drop_before(days[1]) == days[:1] and table.read().count() == 1
    assert len(table.vacuum()) == 1 and table.vacuum() == [] and table.read().count() == 1


def test_writers_side_by_side(spark, tmp_path):
    """Four writers of one package into one part: none fails, each row is there once."""
    schema = "entity_id bigint, timestamp timestamp, created timestamp, job_id bigint, c1 smallint"
    new = spark.createDataFrame([(i, T, i) for i in range(100)], "entity_id bigint, timestamp timestamp, c1 smallint")
    tables = [store.TrendTable(spark, str(tmp_path / "one"), schema, parse("1d")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda t: t.store(new), tables))
    assert [t.read().count() for t in tables] == [100] * 4 and tables[0].snapshot().version == 4
    tables[0].compact()
    assert rows(tables[1].read(), "entity_id", "c1") == [(i, i) for i in range(100)] and len(tables[0].manifest()[partition(T)]) == 1


def test_writers_of_several_partitions(spark, tmp_path):
    """Writers into one part, each into its own day, while days are folded: none is lost."""
    schema = "entity_id bigint, timestamp timestamp, created timestamp, job_id bigint, c1 smallint"
    table = lambda: store.TrendTable(spark, str(tmp_path / "one"), schema, parse("1d"))

    def work(day):
        at = T.replace(day=day)
        for k in (1, 2):
            table().store(spark.createDataFrame([(i, at, k) for i in range(25)], "entity_id bigint, timestamp timestamp, c1 smallint"), job=k)
        table().compact([partition(at)])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, (10, 11, 12, 13)))
    assert rows(table().read(), "c1", "job_id") == [(2, 2)] * 100 and table().snapshot().version == 12


def test_partial_columns_and_nulls(spark, tmp_path):
    """A column keeps what was stored last by a package that has it, a null too; created is that of the first."""
    schema = "entity_id bigint, timestamp timestamp, created timestamp, job_id bigint, a int, b string"
    table = store.TrendTable(spark, str(tmp_path / "t"), schema, parse("1d"))
    at = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp")
    table.store(spark.createDataFrame([(1, T, 5, "x"), (2, T, 6, "y")], "entity_id bigint, timestamp timestamp, a int, b string"), job=1, now=at(1))
    table.store(spark.createDataFrame([(1, T, None)], "entity_id bigint, timestamp timestamp, a int"), job=2, now=at(2))
    table.store(spark.createDataFrame([(1, T, "z")], "entity_id bigint, timestamp timestamp, b string"), job=3, now=at(3))
    for _ in range(2):
        assert rows(table.read(), "entity_id", "a", "b", "job_id", "created") == [(1, None, "z", 3, datetime(2024, 1, 1)), (2, 6, "y", 1, datetime(2024, 1, 1))]
        table.compact()
    table.remove([partition(T)], F.col("entity_id") == 1)
    assert rows(table.read(), "entity_id") == [(2,)]


def partition(at):
    return int((at - datetime(1970, 1, 1)).total_seconds() // 86400)


def test_modified_log_folds(spark):
    log = spark.createDataFrame([("p", T, datetime(2020, 1, d)) for d in (1, 3, 2)], "part string, timestamp timestamp, modified timestamp")
    half = store.fold_modified(log.limit(1))
    assert rows(store.fold_modified(log, half), "last") == [(datetime(2020, 1, 3),)]


def test_packages(spark):
    p = spark.createDataFrame([(i, T, 10 * i + 1, 10 * i + 2, 10 * i + 3) for i in range(1, 5)], "entity_id bigint, timestamp timestamp, x int, y int, z int")
    kept = package.filter_trends(p, lambda c: c != "y")
    assert rows(kept, "x", "z")[3] == (41, 43) and package.filter_trends(p, lambda c: False).columns == ["entity_id", "timestamp"]
    parts = package.split(p, {"x": "blue", "z": "blue", "y": None}.get)
    assert list(parts) == ["blue"] and package.trends(parts["blue"]) == ["x", "z"]
    assert package.known_trends(p, ["x", "w"]).columns == ["entity_id", "timestamp", "x"]


def test_merge_tells_absent_from_null(spark):
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    two = spark.createDataFrame([(1, None), (3, "c")], "k int, x string").withColumn("z", F.lit(9))
    out = package.merge([one, two], ["k"])
    assert out.columns == ["k", "x", "y", "z"]
    assert {tuple(r) for r in out.collect()} == {(1, None, 1, 9), (2, "b", 2, None), (3, "c", None, 9)}


def test_history(spark):
    h = spark.createDataFrame([(1, datetime(2020, 1, d), v) for d, v in ((1, "A"), (2, "A"), (3, "B"), (4, "A"), (5, None), (6, None))] + [(2, datetime(2020, 1, 1), None)], "entity_id bigint, timestamp timestamp, v string")
    compacted = attributes.compact(h)
    assert [r.v for r in compacted.where("entity_id = 1").orderBy("timestamp").collect()] == ["A", "B", "A", None]
    assert rows(attributes.compact(compacted), "timestamp") == rows(compacted, "timestamp")
    assert compacted.where("entity_id = 2").count() == 1
    assert rows(attributes.current(h).where("entity_id = 1"), "timestamp") == [(datetime(2020, 1, 6),)]
    assert [r.end for r in attributes.with_end(compacted).where("entity_id = 1").orderBy("timestamp").collect()][-1] is None
    staged = spark.createDataFrame([(1, datetime(2020, 1, 1), "Z")], "entity_id bigint, timestamp timestamp, v string")
    held = attributes.transfer(h.withColumn("modified", F.lit(datetime(2020, 2, 1))), staged, F.lit(datetime(2021, 1, 1)))
    assert rows(held.where("v = 'Z'"), "modified") == [(datetime(2021, 1, 1),)] and held.count() == 7
    assert attributes.transfer(h.withColumn("modified", F.lit(datetime(2020, 2, 1))), staged.limit(0)).count() == 7
    assert attributes.widen(h, {"n": ("smallint", "integer"), "v": ("text", "integer")}).dtypes[2:] == [("v", "string"), ("n", "int")]


def test_entities_get_stable_ids(spark):
    known = spark.createDataFrame([(5, "b", T, 1)], "id bigint, name string, created timestamp, entity_type_id int")
    names = spark.createDataFrame([("d",), ("a",), ("b",), (None,), ("c",), ("a",)], "name string")
    out = relations.get_or_create(known, names.repartition(4))
    assert rows(out, "id", "name") == [(5, "b"), (6, "a"), (7, "c"), (8, "d")]
    assert rows(relations.get_or_create(out, names), "id", "name") == rows(out, "id", "name")


def test_relations(spark):
    r = relations.refresh(spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 3)], "a int, b int"))
    assert rows(r, "source_id", "target_id") == [(1, 2), (1, 3)]
    assert rows(relations.violations(r, "many-to-one"), "side", "id") == [("source_id", 1)]
    assert relations.violations(r, "one-to-many").count() == 0


def test_aggregates(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, 1, 10), 2.0), (1, datetime(2020, 1, 1, 9, 15), 4.0), (1, datetime(2020, 1, 1, 10, 15), 8.0), (2, None, 1.0)], "entity_id bigint, timestamp timestamp, v double")
    hour = aggregate.time_aggregate(df, [aggregate.Measure("v", time="avg")], "1h")
    assert rows(hour, "timestamp", "samples", "v") == [(datetime(2020, 1, 1, 10), 2, 3.0), (datetime(2020, 1, 1, 11), 1, 8.0)]
    assert rows(aggregate.time_aggregate(hour, [aggregate.Measure("v")], "1d"), "samples", "v") == [(3, 11.0)]
    chunk = aggregate.time_aggregate_chunk(df, [aggregate.Measure("v", time="avg")], "1h", datetime(2020, 1, 1, 10))
    assert rows(chunk, "samples", "v") == [(2, 3.0)]
    edges = spark.createDataFrame([(1, 100), (1, 101)], "source_id bigint, target_id bigint")
    assert rows(aggregate.entity_aggregate(df, edges, [aggregate.Measure("v")]).where("timestamp = '2020-01-01 10:00:00'"), "entity_id", "samples", "v") == [(100, 1, 2.0), (101, 1, 2.0)]


def test_big_sums_do_not_overflow(spark):
    df = spark.createDataFrame([(1, T, 9223372036854775807)] * 3, "entity_id bigint, timestamp timestamp, v bigint")
    assert aggregate.time_aggregate(df, [aggregate.Measure("v", "bigint")], "1d").first().v == 3 * 9223372036854775807


def test_cascade_makes_sources_first():
    steps = aggregate.cascade("hub_node_main_15m", "15m", "node", {"node->v-site": "v-site"})
    made = {"hub_node_main_15m"}
    for s in steps:
        assert s.source in made
        made.add(s.target)
    assert {"hub_node_main_1month", "hub_v-site_main_1w"} <= made
    assert aggregate.standard_sources({"a": "Raw counters", "b": "derived"}) == ["a"]


def test_triggers(spark):
    df = spark.createDataFrame([(1, T, 0.04), (2, T, 1.5), (3, T, 3.0), (4, T, None)], "entity_id bigint, timestamp timestamp, power_kwh double")
    rule = triggers.Trigger("t", ("power_kwh",), {"max_power": 0.05}, "power_kwh > max_power", triggers.weights(("power_kwh > 1", 500), ("power_kwh > 2", 800), otherwise=300), "format_string('%s > %s', power_kwh, max_power)")
    out = rule.notifications(df)
    assert rows(out, "entity_id", "weight", "details") == [(2, 500, "1.5 > 0.05"), (3, 500, "3.0 > 0.05")]
    with pytest.raises(Exception, match="lacks indicators"):
        rule.notifications(df.drop("power_kwh"))
    held = spark.createDataFrame([(7, 1, T, None)], "id bigint, entity_id bigint, timestamp timestamp, data string")
    added = triggers.append(held, df.select("entity_id", "timestamp", F.create_map(F.lit("a"), F.lit(1)).alias("data")))
    assert added.count() == 5 and added.agg(F.min("id")).first()[0] == 7 and added.where("data = '{\"a\":1}'").count() == 4
    assert rows(triggers.notification_sets(out, ["weight"]), "weight", "notifications") == [(500, 2)]


def test_due(spark):
    rows_ = [("a", datetime(2020, 1, 1), datetime(2020, 1, 1, 1), "x", None), ("b", datetime(2020, 1, 1), datetime(2020, 1, 1, 1), "x", "x"), ("c", datetime(2020, 1, 1), None, None, "x"), ("d", datetime(2020, 1, 3), datetime(2020, 1, 1), "x", None), ("e", datetime(2020, 1, 1), datetime(2020, 1, 2), "x", "y"), ("f", datetime(2020, 1, 1), None, "z", "y")]
    state = spark.createDataFrame(rows_, "target string, timestamp timestamp, max_modified timestamp, fingerprint string, processed string")
    now, delay = F.lit(datetime(2020, 1, 2)), F.expr("INTERVAL 30 MINUTES")
    assert [r.target for r in incremental.due(state, now, delay).collect()] == ["a", "f"]
    assert [r.target for r in incremental.due(state, now, delay, reset=True).collect()] == ["a", "b", "c", "f"]
    assert [r.target for r in incremental.due(state, now, delay, most=1).collect()] == ["a"]


def test_monitor_equals_full_computation(spark, tmp_path):
    source = spark.createDataFrame([(i % 5, datetime(2020, 1, 1, i % 20, 7 * i % 60), float(i)) for i in range(300)], "entity_id bigint, timestamp timestamp, v double")
    measures = [aggregate.Measure("v")]
    held = {}

    def write(m, made, targets):
        old = held.get(m.name)
        made = made.select("entity_id", "timestamp", "samples", "v")
        new = made if old is None else incremental.rematerialize(old, made, targets)
        held[m.name] = spark.createDataFrame(new.collect(), "entity_id bigint, timestamp timestamp, samples bigint, v double")

    log, job = str(tmp_path / "log"), incremental.Materialization("h", ("p",), parse("1h"), lambda r: aggregate.time_aggregate(r, measures, "1h"))
    monitor = incremental.LiveMonitor(spark, log, str(tmp_path / "check"), [job], lambda _: source, write)
    entries = store.modified_log(source, "p", F.lit(datetime(2020, 1, 2)))
    for part in (entries.where("hour(timestamp) < 10"), entries.where("hour(timestamp) >= 8")):
        part.write.mode("append").parquet(log)
        monitor.start().awaitTermination()
    full = aggregate.time_aggregate(source, measures, "1h")
    assert rows(held["h"], "entity_id", "timestamp", "samples", "v") == rows(full, "entity_id", "timestamp", "samples", "v")


def test_own_mapping_and_fingerprint(spark, tmp_path):
    """A source stamp may count for several target stamps; a fingerprint of one's own decides what is due."""
    source = spark.createDataFrame([(1, datetime(2020, 1, 1, h), float(h)) for h in (1, 2, 3)], "entity_id bigint, timestamp timestamp, v double")
    both = lambda at: F.array(at, at + F.expr("INTERVAL 1 HOUR"))
    made = {}

    def make(rows):
        return rows.groupBy("entity_id", F.col("target_timestamp").alias("timestamp")).agg(F.sum("v").alias("v"))

    def fingerprint(modified):
        return modified.groupBy("timestamp").agg(F.max("last").alias("max_modified"), F.lit("same").alias("fingerprint"))

    moving = incremental.Materialization("moving", ("p",), parse("1h"), make, mapping=both)
    fixed = incremental.Materialization("fixed", ("p",), parse("1h"), lambda rows: rows, fingerprint=fingerprint)
    state = incremental.State(spark, str(tmp_path / "s"))
    state.add(store.modified_log(source, "p", F.lit(datetime(2020, 1, 2))))
    write = lambda m, rows_, *_: made.__setitem__(m.name, rows(rows_, "timestamp", "v"))
    run = lambda: state.run([moving, fixed], lambda *_: source, write, datetime(2021, 1, 1))
    assert run() == {"moving": 4, "fixed": 3}
    assert [v for _, v in made["moving"]] == [1.0, 3.0, 5.0, 3.0] and len(made["fixed"]) == 3
    state.add(store.modified_log(source.where("v = 2"), "p", F.lit(datetime(2020, 1, 3))))
    assert run() == {"moving": 2, "fixed": 0}
