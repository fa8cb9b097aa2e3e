"""Queries of what is stored: files in, tables on disk, attributes, notifications, derived parts, a whole instance.

Each writes to a folder of its own in the shared checkpoint folder and returns
what it reads back.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions.datatypes import Format
from tidemark.functions.granularity import bucket_end, parse
from tidemark.operators import rejects, store
from tidemark.plans import setup
from tidemark.plans.instance import Instance
from tidemark.session import shared_folder
from tidemark.sources import csv
from tidemark.sources.tables import table
from tidemark.streaming.late_stream import LateAggregates
from tidemark.warehouse import Warehouse

NTZ = "timestamp_ntz"
QUERIES, SQL = {}, {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _naive(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast(NTZ).alias(c) if k.startswith("timestamp") else F.col(c).cast("double").alias(c) if k.startswith("decimal") else F.col(c) for c, k in kinds.items()))


# files


def _order_files(spark: SparkSession, d: str, price) -> str:
    path = shared_folder(spark, "csv")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), price.alias("price"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("{"), "o_custkey", F.lit(",\\N}")).alias("list"))
    rows.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    return path


_ORDER_FORM = {"price": Format("double precision", null="-"), "label": Format("text", null="5-LOW"), "list": Format("bigint[]")}


@query("SELECT CAST(o_orderkey AS VARCHAR) AS entity, o_orderdate AS timestamp, nullif(o_totalprice, 0) AS price, nullif(o_orderpriority, '5-LOW') AS label, list_value(o_custkey, NULL) AS list FROM orders")
def csv_package_strict(spark, d):
    """Compressed files with a header and another separator, every text a value of its type."""
    path = _order_files(spark, d, F.col("o_totalprice").cast("string"))
    return _naive(csv.load(spark, "csv", path, {"timestamp": "at", "identifier": "node", "delimiter": ";", "columns": _ORDER_FORM}))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS entity, o_orderdate AS timestamp, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_totalprice END AS price, nullif(o_orderpriority, '5-LOW') AS label, list_value(o_custkey, NULL) AS list FROM orders")
def csv_package_lenient(spark, d):
    """Texts that are no value of their type become null, as null literals do."""
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("-")).otherwise(F.col("o_totalprice").cast("string"))
    form = csv.CsvPackage("at", "node", ";", columns=_ORDER_FORM)
    return _naive(form.read(spark, _order_files(spark, d, price), strict=False))


@query("SELECT config_name, count(*) AS records, CAST(sum(length(raw_line)) AS BIGINT) AS signs FROM (SELECT config_name, regexp_replace(regexp_replace(raw_line, '\\r$', ''), '\"', '', 'g') AS raw_line FROM sample_line WHERE raw_line IS NOT NULL) GROUP BY 1")
def p3_file_records(spark, d):
    """Lines of each configuration written as files, a line end within quotes after every line's text, and read again as records."""
    lines = table(spark, d, "sample_line").where("raw_line is not null").select("config_name", F.regexp_replace(F.regexp_replace("raw_line", r"\r$", ""), '"', "").alias("text"))
    root = shared_folder(spark, "records")
    lines.select("config_name", F.concat(F.lit('"'), "text", F.lit('\n"')).alias("value")).write.partitionBy("config_name").text(root)
    out = None
    for name in sorted(r[0] for r in lines.select("config_name").distinct().collect()):  # a handful of configurations
        own = rejects.records_of_files(spark, f"{root}/config_name={name}", name).select("config_name", F.length(F.regexp_replace("raw_line", '["\n]', "")).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("config_name").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("signs"))


# granularities and names


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS month_end, o_orderdate + INTERVAL 1 MONTH AS next_month, o_orderdate + INTERVAL 7 DAY AS next_week, o_orderdate + INTERVAL 15 MINUTE AS next_quarter,
CAST(len(generate_series(o_orderdate + INTERVAL 1 DAY, date_trunc('month', o_orderdate - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH, INTERVAL 1 DAY)) AS INTEGER) AS days_left FROM orders""")
def granularity_steps(spark, d):
    """Steps of granularities given in several notations, and the stamps up to the end of a month."""
    from tidemark.functions.granularity import stamps

    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast(NTZ).alias("at")).withColumn("month_end", bucket_end(F.col("at"), parse("1 month")).cast(NTZ))
    steps = {"next_month": "1month", "next_week": "7 days", "next_quarter": "00:15:00"}
    return rows.select("o_orderkey", "month_end", *((F.col("at") + parse(g).interval()).cast(NTZ).alias(n) for n, g in steps.items()), F.size(stamps(F.col("at"), F.col("month_end"), "1 day, 0:00:00")).alias("days_left"))


@query("SELECT p_partkey, 'Part=' || p_partkey || ',Brand=' || replace(p_brand, '#', ',') AS dn, 'part_' || p_partkey AS plain, CAST(p_size * 1048576 AS BIGINT) AS bytes FROM part")
def quoted_names(spark, d):
    """Names with signs that must be quoted stay one name, sizes in words become bytes."""
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("Part="), "p_partkey", F.lit(",Brand="), F.replace("p_brand", F.lit("#"), F.lit(","))).alias("a b`c"), F.concat(F.lit("part_"), "p_partkey").alias("plain"))
    return rows.select("p_partkey", F.expr(names.quoted("a b`c").replace('"', "`") if names.quoted("a b`c").startswith('"') else names.quoted("a b`c")).alias("dn"), "plain", (F.col("p_size") * names.parse_size("1MB")).cast("bigint").alias("bytes"))


# tables on disk


@query("""
WITH f AS (SELECT l_suppkey AS e, l_shipdate AS t, arg_max(l_extendedprice, (l_extendedprice, l_quantity)) AS price, arg_max(l_quantity, (l_extendedprice, l_quantity)) AS quantity FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_suppkey AS e, l_shipdate AS t, max(-l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT e AS entity_id, t AS timestamp, coalesce(g.price, f.price) AS price, f.quantity, CAST(CASE WHEN g.price IS NULL THEN 1 ELSE 2 END AS BIGINT) AS job_id FROM f LEFT JOIN g USING (e, t)""")
def trend_table_upserts(spark, d):
    """Two packages stored one after the other, the second with some keys and one column; then the partitions are folded."""
    made = store.TrendTable(spark, shared_folder(spark, "trend"), "entity_id bigint, timestamp timestamp, created timestamp, job_id bigint, price double, quantity double", parse("12month"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), "l_returnflag")
    made.store(rows.drop("l_returnflag"), job=1)
    made.store(rows.where("l_returnflag = 'R'").select("entity_id", "timestamp", (-F.col("price")).alias("price")), job=2)
    made.compact()
    return _naive(made.read().drop("created"))


@query("""
WITH r AS (SELECT entity_id, epoch_us("timestamp") AS t, (epoch_us("timestamp") + 3599999999) // 3600000000 * 3600 AS pe, epoch_us(modified) AS m, delivery_id AS d, power_kwh AS p FROM trend_delivery WHERE entity_id IS NOT NULL AND "timestamp" IS NOT NULL AND modified IS NOT NULL),
v AS (SELECT entity_id, t, pe, arg_max(struct_pack(p := p), (m, d)).p AS p FROM r WHERE m <= (pe + 259200) * 1000000 GROUP BY 1, 2, 3)
SELECT entity_id, CAST(pe AS BIGINT) AS period_end, CAST(count(p) AS BIGINT) AS count_now, CAST(count(DISTINCT p) AS BIGINT) AS distinct_now, CAST(min(p) AS DOUBLE) AS min_now, CAST(max(p) AS DOUBLE) AS max_now, CAST(sum(p) AS DOUBLE) AS total_now FROM v GROUP BY 1, 2 HAVING count(p) > 0""")
def p2_stream(spark, d):
    """The state of late aggregates after deliveries came in three batches, the first of them twice."""
    state = LateAggregates(spark, shared_folder(spark, "late"), {"entity_id": "bigint"}, "decimal(12,3)", 3600, 3 * 86400)
    rows = table(spark, d, "trend_delivery").select("entity_id", F.col("timestamp").cast("timestamp").alias("event"), F.col("modified").cast("timestamp").alias("arrival"), F.col("delivery_id").alias("tie"), F.col("power_kwh").alias("value"))
    for batch in (0, 1, 2, 0):
        state.batch(rows.where(F.pmod(F.xxhash64("tie"), F.lit(3)) == batch))  # all rows come, in batches that mix times
    return _naive(state.statistics().drop("median_now").where("count_now > 0"))


# attributes and notifications


@query("""
WITH f AS (SELECT o_custkey AS e, o_orderdate AS t, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1, 2),
h AS (SELECT e, t, CASE WHEN p = '1-URGENT' THEN 'late' ELSE s END AS s, p, CASE WHEN p = '1-URGENT' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS m FROM f),
c AS (SELECT *, lag((s, p)) OVER w AS b, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY e ORDER BY t)),
kept AS (SELECT e, t, s, p, m FROM c WHERE k = 1 OR b IS DISTINCT FROM (s, p))
SELECT e AS entity_id, t AS timestamp, m AS modified, s AS status, p AS priority, lead(t) OVER (PARTITION BY e ORDER BY t) AS "end", t = max(t) OVER (PARTITION BY e) AS is_current FROM kept""")
def attribute_store_cycle(spark, d):
    """Attributes staged twice, the second time corrected, compacted, with the end of validity and the current rows."""
    from tidemark.warehouse import AttributeTable

    held = AttributeTable(spark, shared_folder(spark, "attribute"), {"status": "string", "priority": "string"})
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    held.store(rows, F.lit("2024-01-01").cast("timestamp"), [F.col("o_orderkey")])
    last = store.latest(rows, ["entity_id", "timestamp"], [F.col("o_orderkey")])
    held.store(last.where("priority = '1-URGENT'").select("entity_id", "timestamp", F.lit("late").alias("status")), F.lit("2024-02-01").cast("timestamp"))
    held.compact()
    held.refresh()
    now = held.current().select("entity_id", F.col("timestamp").alias("__now"))
    return _naive(held.with_end().join(now, "entity_id").withColumn("is_current", F.col("timestamp") == F.col("__now")).drop("__now"))


EVENTS = {
    "trend": [
        {"title": "Raw events", "data_source": "app", "entity_type": "user", "granularity": "15m", "partition_size": "30d", "parts": [{"name": "app_user_15m", "trends": [{"name": "value", "data_type": "double precision", "time_aggregation": "MAX"}], "generated_trends": [{"name": "twice", "data_type": "double precision", "expression": "value * 2"}]}]},
        {"data_source": "app", "entity_type": "user", "granularity": "1h", "partition_size": "30d", "parts": [{"name": "app_user_1h", "trends": [{"name": "samples", "data_type": "bigint"}, {"name": "value", "data_type": "double precision", "time_aggregation": "MAX"}]}]},
        {"data_source": "app-view", "entity_type": "user", "granularity": "1h", "partition_size": "30d", "parts": [{"name": "view_user_1h", "trends": [{"name": "doubled", "data_type": "double precision"}]}]},
    ],
    "notification": [{"data_source": "alarms", "attributes": [{"name": "rule_id", "data_type": "integer"}, {"name": "details", "data_type": "text"}, {"name": "weight", "data_type": "integer"}]}],
    "virtual-entity": {"group": "SELECT DISTINCT concat('group ', pmod(CAST(substr(name, 6) AS BIGINT), 10)) AS name FROM entity_user"},
    "relation": [{"name": "user->group", "source_entity_type": "user", "target_entity_type": "group", "cardinality": "many-to-one", "query": 'SELECT u.id, g.id FROM entity."user" u JOIN entity."group" g ON g.name = concat(\'group \', pmod(CAST(substr(u.name, 6) AS BIGINT), 10))'}],
    "materialization": [
        {"target_trend_store_part": "app_user_1h", "sources": [{"trend_store_part": "app_user_15m"}], "function": {"kind": "time", "source": "app_user_15m"}, "processing_delay": "1s", "reprocessing_period": "100000d"},
        {"target_trend_store_part": "view_user_1h", "sources": [{"trend_store_part": "app_user_1h"}], "view": 'SELECT entity_id, timestamp, value * 2 AS doubled FROM trend."app_user_1h" WHERE value > 50', "processing_delay": "1s", "reprocessing_period": "100000d"},
    ],
    "trigger": [{"name": "high", "kpi_data": [{"name": "doubled", "data_type": "numeric"}], "kpi_function": 'SELECT entity_id, timestamp, doubled FROM trend."view_user_1h"', "thresholds": [{"name": "most", "data_type": "numeric", "value": 180}], "condition": "doubled > most", "weight": "SELECT CASE WHEN $1.doubled > 190 THEN 9 ELSE 5 END", "notification": "SELECT format('%s', $1.entity_id)", "granularity": "1h", "notification_store": "alarms"}],
}


@query("""
WITH r AS (SELECT user_id AS u, ts, max(value) AS v FROM events GROUP BY 1, 2),
h AS (SELECT u, time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS t, count(*) AS n, max(v) AS v FROM r GROUP BY 1, 2),
a AS (SELECT u, t, CASE WHEN v * 2 > 190 THEN 9 ELSE 5 END AS w FROM h WHERE v > 50 AND v * 2 > 180)
SELECT 'app_user_15m' AS what, count(*) AS rows, count(DISTINCT u) AS entities, max(ts) AS latest FROM r
UNION ALL SELECT 'app_user_1h', count(*), count(DISTINCT u), max(t) FROM h
UNION ALL SELECT 'view_user_1h', count(*), count(DISTINCT u), max(t) FROM h WHERE v > 50
UNION ALL SELECT 'alarms', CAST(sum(w) AS BIGINT), count(DISTINCT u), max(t) FROM a
UNION ALL SELECT 'user->group', count(DISTINCT u), count(DISTINCT u % 10), NULL FROM r""")
def instance_cycle(spark, d):
    """An instance initialized in an empty warehouse, files loaded into it, entities and relations derived, parts materialized, a trigger run, all reported."""
    house = Warehouse(spark, shared_folder(spark, "instance"))
    setup.initialize(house, Instance(given=EVENTS))
    path = shared_folder(spark, "events")
    table(spark, d, "events").select(F.concat(F.lit("user "), "user_id").alias("entity"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stamp"), "value").write.option("header", True).csv(path)
    form = csv.CsvPackage("stamp", granularity="15m", entity_type="user", columns={"value": Format("double precision", null="")})
    house.load(path, form, "app")
    setup.derive(house)
    setup.materialize(house, now=datetime(2100, 1, 1))
    setup.create_notifications(house, "high")
    alarms, pairs = house.notifications("alarms"), house.relation("user->group")
    parts = {p.name: house.part(p.name).read() for s in house.catalog.trend_stores.values() for p in s.parts}
    out = house.catalog.report(parts, spark).withColumnRenamed("part", "what")
    out = out.unionByName(alarms.agg(F.lit("alarms").alias("what"), F.sum("weight").alias("rows"), F.countDistinct("entity_id").alias("entities"), F.max("timestamp").alias("latest")))
    return _naive(out.unionByName(pairs.agg(F.lit("user->group").alias("what"), F.count(F.lit(1)).alias("rows"), F.countDistinct("target_id").alias("entities"), F.lit(None).cast("timestamp").alias("latest"))))
