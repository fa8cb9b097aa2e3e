"""Queries of the measurement operators: aggregation, packages, storing, attributes, increments, triggers, functions, reports.

The tables stand in for stores: events is a part of trends by user, lineitem a
daily part by supplier, orders the history of attributes of a customer,
customer, nation and region are entities with their relations.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog
from tidemark.functions import datatypes, names
from tidemark.functions.granularity import bucket_end, most_recent, parse, partition_index, partition_size, stamps
from tidemark.operators import aggregate, attributes, package, relations, store, triggers
from tidemark.sources import csv
from tidemark.sources.tables import table
from tidemark.streaming import incremental

NTZ = "timestamp_ntz"
MONEY = "decimal(18,2)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("timestamp"), F.col("value").cast(MONEY).alias("value"))


VALUE = [aggregate.Measure("value", "numeric", "sum", "sum")]


def _out(df: DataFrame) -> DataFrame:
    """Stamps without zone, decimals as doubles, so both engines give one type."""
    kinds = dict(df.dtypes)
    return df.select(*((F.col(c).cast(NTZ) if k.startswith("timestamp") else F.col(c).cast("double") if k.startswith("decimal") else F.col(c)).alias(c) for c, k in kinds.items()))


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _bucket(step: str) -> str:
    return f"time_bucket(INTERVAL {step}, ts - INTERVAL 1 MICROSECOND) + INTERVAL {step}"


def _agg_sql(bucket: str) -> str:
    return f"SELECT user_id AS entity_id, {bucket} AS timestamp, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2"


@query(_agg_sql(_bucket("1 hour")))
def time_agg_1h(spark, d):
    return _out(aggregate.time_aggregate(_events(spark, d), VALUE, "1h"))


@query(_agg_sql(_bucket("15 minute")))
def time_agg_15m(spark, d):
    return _out(aggregate.time_aggregate(_events(spark, d), VALUE, "15m"))


@query(_agg_sql(_bucket("30 minute")))
def time_agg_30m(spark, d):
    return _out(aggregate.time_aggregate(_events(spark, d), VALUE, "30m"))


@query(_agg_sql("date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY"))
def time_agg_1d(spark, d):
    return _out(aggregate.time_aggregate(_events(spark, d), VALUE, "1d"))


@query(_agg_sql("date_trunc('week', ts - INTERVAL 1 MICROSECOND) + INTERVAL 7 DAY"))
def time_agg_1w(spark, d):
    return _out(aggregate.time_aggregate(_events(spark, d), VALUE, "1w"))


@query(_agg_sql("date_trunc('month', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH"))
def time_agg_1month(spark, d):
    return _out(aggregate.time_aggregate(_events(spark, d), VALUE, "1month"))


@query("""
SELECT user_id AS entity_id, TIMESTAMP '2024-01-03 12:00:00' AS timestamp, count(*) AS samples, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events WHERE ts > TIMESTAMP '2024-01-03 11:00:00' AND ts <= TIMESTAMP '2024-01-03 12:00:00' GROUP BY 1""")
def time_agg_single_chunk(spark, d):
    return _out(aggregate.time_aggregate_chunk(_events(spark, d), VALUE, "1h", datetime(2024, 1, 3, 12)))


@query(f"""
WITH a AS (SELECT user_id AS e, {_bucket("15 minute")} AS t, count(*) AS s, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
b AS (SELECT e, date_trunc('day', t - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS t, sum(s) AS s, sum(v) AS v FROM a GROUP BY 1, 2)
SELECT e AS entity_id, date_trunc('week', t - INTERVAL 1 MICROSECOND) + INTERVAL 7 DAY AS timestamp, CAST(sum(s) AS BIGINT) AS samples, CAST(sum(v) AS DOUBLE) AS value
FROM b GROUP BY 1, 2""")
def time_agg_cascade_15m_1d_1w(spark, d):
    steps = [aggregate.Step("p_15m", "p_1d", "time", "1d"), aggregate.Step("p_1d", "p_1w", "time", "1w")]
    start = aggregate.time_aggregate(_events(spark, d), VALUE, "15m")
    return _out(aggregate.run_cascade({"p_15m": start}, steps, {}, VALUE)["p_1w"])


@query("""
WITH a AS (SELECT user_id AS e, date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS t, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS v FROM events GROUP BY 1, 2)
SELECT e AS entity_id, date_trunc('week', t - INTERVAL 1 MICROSECOND) + INTERVAL 7 DAY AS timestamp, round(sum(v) / count(*), 6) AS value FROM a GROUP BY 1, 2""")
def time_agg_cascade_average(spark, d):
    """An average of averages."""
    measures = [aggregate.Measure("value", "double precision", "avg", "avg")]
    steps = [aggregate.Step("raw", "day", "time", "1d"), aggregate.Step("day", "week", "time", "1w")]
    return aggregate.run_cascade({"raw": _events(spark, d).withColumn("value", F.col("value").cast("double"))}, steps, {}, measures)["week"].select("entity_id", F.col("timestamp").cast(NTZ).alias("timestamp"), F.round("value", 6).alias("value"))


def _orders_by_day(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").cast(MONEY).alias("total"))
    return orders


def _relation(spark, d, name, source, target):
    return relations.refresh(table(spark, d, name).select(source, target))


TOTAL = [aggregate.Measure("total", "numeric", "sum", "sum")]


@query("""
SELECT CAST(c_nationkey AS BIGINT) AS entity_id, o_orderdate AS timestamp, count(*) AS samples, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def entity_agg_customer_nation(spark, d):
    return _out(aggregate.entity_aggregate(_orders_by_day(spark, d), _relation(spark, d, "customer", "c_custkey", "c_nationkey"), TOTAL))


@query("""
SELECT CAST(n_regionkey AS BIGINT) AS entity_id, o_orderdate AS timestamp, CAST(count(*) AS BIGINT) AS samples, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def entity_agg_nation_region(spark, d):
    by_nation = aggregate.entity_aggregate(_orders_by_day(spark, d), _relation(spark, d, "customer", "c_custkey", "c_nationkey"), TOTAL)
    return _out(aggregate.entity_aggregate(by_nation, _relation(spark, d, "nation", "n_nationkey", "n_regionkey"), TOTAL))


@query("""
WITH r AS (SELECT c_custkey AS s, CAST(c_nationkey AS BIGINT) AS t FROM customer UNION ALL SELECT c_custkey, 1000 FROM customer)
SELECT t AS entity_id, o_orderdate AS timestamp, count(*) AS samples, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN r ON o_custkey = s GROUP BY 1, 2""")
def entity_agg_fanout(spark, d):
    own = table(spark, d, "customer")
    edges = own.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("t")).union(own.select("c_custkey", F.lit(1000).cast("bigint")))
    return _out(aggregate.entity_aggregate(_orders_by_day(spark, d), relations.refresh(edges), TOTAL))


@query("""
SELECT l_suppkey AS entity_id, l_shipdate AS timestamp, count(*) AS samples, CAST(min(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS least, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS most,
count(l_tax) AS taxed, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount FROM lineitem GROUP BY 1, 2""")
def agg_function_list(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").alias("timestamp"), *(F.col(c).cast(MONEY).alias(n) for c, n in (("l_quantity", "least"), ("l_extendedprice", "most"), ("l_tax", "taxed"), ("l_discount", "discount"))))
    measures = [aggregate.Measure("least", "numeric", "min"), aggregate.Measure("most", "numeric", "max"), aggregate.Measure("taxed", "numeric", "count"), aggregate.Measure("discount", "numeric", "sum")]
    shifted = aggregate.time_aggregate(rows, measures, "1d")
    # daily stamps at midnight end their own bucket
    return _out(shifted)


@query("SELECT event_type, CAST(sum(CAST(user_id AS DECIMAL(38,0)) * 1000000000000) AS DOUBLE) AS total FROM events GROUP BY 1")
def promote_bigint_sum(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") * 1000000000000).alias("total"))
    return rows.groupBy("event_type").agg(datatypes.aggregate("sum", "total", "bigint").cast("double").alias("total"))


@query("SELECT event_type, count(*) AS samples, min(value) AS least, max(value) AS most, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean FROM events GROUP BY 1")
def agg_min_max_avg(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("least"), F.col("value").alias("most"), F.col("value").cast(MONEY).alias("mean"))
    kinds = (("min", "least", "double precision"), ("max", "most", "double precision"))
    out = rows.groupBy("event_type").agg(datatypes.aggregate("count", "mean", "numeric").alias("samples"), *(datatypes.aggregate(f, c, k).alias(c) for f, c, k in kinds), datatypes.aggregate("sum", "mean", "numeric").alias("total"))
    return out.select("event_type", "samples", "least", "most", (F.col("total").cast("double") / F.col("samples")).alias("mean"))


def _nodes(spark, d):
    return table(spark, d, "entity_node").select("id", "name", F.col("created").cast("timestamp").alias("created"), "entity_type_id")


@query("""
SELECT DISTINCT n.id AS source_id, s.id AS target_id FROM entity_node n JOIN v_site s ON s.name = nullif(regexp_extract(n.name, '^([a-z]+)-.*', 1), '')""")
def relation_regexp(spark, d):
    sites = table(spark, d, "v_site").select(F.col("id").alias("site"), F.col("name").alias("place"))
    nodes = _nodes(spark, d).withColumn("place", names.substring_from(F.col("name"), "^([a-z]+)-.*"))
    return relations.refresh(nodes.join(sites, "place").select("id", "site"))


@query("""
WITH v AS (SELECT DISTINCT node || '/meter' AS name FROM sample_reading WHERE node IS NOT NULL UNION SELECT name FROM entity_node)
SELECT id, name FROM entity_node
UNION ALL SELECT (SELECT max(id) FROM entity_node) + row_number() OVER (ORDER BY name), name FROM v WHERE name NOT IN (SELECT name FROM entity_node)""")
def virtual_entity_append(spark, d):
    """A meter for each node that reports, beside the nodes known."""
    entities = _nodes(spark, d)
    meters = table(spark, d, "sample_reading").select(F.concat("node", F.lit("/meter")).alias("name"))
    return relations.virtual_entities(entities, meters.union(entities.select("name"))).select("id", "name")


@query("SELECT row_id, node AS name, e.id AS entity_id FROM sample_text LEFT JOIN entity_node e ON e.name = node")
def entity_lookup_left(spark, d):
    return relations.resolve(table(spark, d, "sample_text").select("row_id", F.col("node").alias("name")), _nodes(spark, d))


@query("""
WITH a(alias, alias_type, id) AS (SELECT upper(name), 'short', id FROM entity_node UNION ALL SELECT upper(name), 'other', id + 1000000 FROM entity_node)
SELECT line_id, upper(r.node) AS alias, a.id AS entity_id FROM (SELECT sample_id AS line_id, node FROM sample_reading) r LEFT JOIN a ON a.alias = upper(r.node) AND a.alias_type = 'short'""")
def alias_lookup(spark, d):
    own = _nodes(spark, d).select(F.upper("name").alias("alias"), F.lit("short").alias("alias_type"), F.col("id").alias("entity_id"))
    known = own.union(own.select("alias", F.lit("other"), F.col("entity_id") + 1000000))
    rows = table(spark, d, "sample_reading").select(F.col("sample_id").alias("line_id"), F.upper("node").alias("alias"))
    return relations.resolve_alias(rows, known, "short")


@query("""
SELECT 'target_id' AS side, s.id, count(*) AS count FROM entity_node n JOIN v_site s ON s.name = split_part(n.name, '-', 1) GROUP BY 2 HAVING count(*) > 1""")
def relation_cardinality(spark, d):
    """Sites of several nodes, where one each was said."""
    return relations.violations(relation_regexp(spark, d), "one-to-one")


@query("""
SELECT s.id AS entity_id, time_bucket(INTERVAL 1 HOUR, "timestamp" - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS timestamp, count(*) AS samples, CAST(sum(CAST(power_kwh AS DECIMAL(18,6))) AS DOUBLE) AS power
FROM sample_reading r JOIN entity_node n ON n.name = r.node JOIN v_site s ON s.name = split_part(n.name, '-', 1) WHERE "timestamp" IS NOT NULL GROUP BY 1, 2""")
def entity_agg_node_site(spark, d):
    """Hourly power of each site, from its nodes' readings."""
    rows = table(spark, d, "sample_reading").select(F.col("node").alias("name"), F.col("timestamp").cast(NTZ).alias("timestamp"), F.col("power_kwh").cast("decimal(18,6)").alias("power"))
    placed = relations.resolve(rows, _nodes(spark, d)).where("entity_id is not null").drop("name")
    power = [aggregate.Measure("power", "numeric")]
    return _out(aggregate.entity_aggregate(aggregate.time_aggregate(placed, power, "1h"), relation_regexp(spark, d), power))


@query(f"""
WITH b AS (SELECT user_id AS e, {_bucket("1 hour")} AS t FROM events GROUP BY 1, 2),
s AS (SELECT e, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM b GROUP BY 1)
SELECT e AS entity_id, t AS timestamp FROM s ANTI JOIN b USING (e, t)""")
def missing_series(spark, d):
    present = _events(spark, d).select("entity_id", bucket_end(F.col("timestamp"), "1h").alias("timestamp")).distinct()
    spans = present.groupBy("entity_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    wanted = spans.select("entity_id", F.explode(stamps(F.col("a"), F.col("b"), "1h")).alias("timestamp"))
    return _out(store.missing_partitions(wanted, present, ["entity_id", "timestamp"]))


def _line_package(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_shipdate").alias("timestamp"), "l_linenumber", "l_quantity", "l_tax", "l_discount")


@query("SELECT l_orderkey AS entity_id, l_shipdate AS timestamp, l_quantity, l_tax FROM lineitem")
def filter_trends(spark, d):
    return package.filter_trends(_line_package(spark, d), lambda c: c in ("l_quantity", "l_tax"))


@query("SELECT l_orderkey AS entity_id, l_shipdate AS timestamp, l_linenumber, l_discount FROM lineitem")
def split_parts(spark, d):
    return package.route(_line_package(spark, d), {"l_linenumber": "blue", "l_discount": "blue", "l_quantity": "red"})["blue"]


@query("SELECT l_orderkey AS entity_id, l_shipdate AS timestamp, l_quantity FROM lineitem WHERE regexp_matches(CAST(l_orderkey AS VARCHAR), '^(?:1[0-9]|7)')")
def filter_rows_and_trends(spark, d):
    return package.filter_rows_and_trends(_line_package(spark, d).withColumn("entity_id", F.col("entity_id").cast("string")), "entity_id", "1[0-9]|7", "l_q").withColumn("entity_id", F.col("entity_id").cast("bigint"))


@query("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'x' || o_orderstatus END AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'O')
SELECT coalesce(a.k, b.k) AS entity_id, a.price, CASE WHEN b.k IS NOT NULL THEN b.status ELSE a.status END AS status, b.priority FROM a FULL JOIN b ON a.k = b.k""")
def merge_packages(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "entity_id")
    # what is not finished and what is not open: some are both, each is one
    a = orders.where("o_orderstatus <> 'F'").select("entity_id", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    b = orders.where("o_orderstatus <> 'O'").select("entity_id", F.when(F.expr("o_orderpriority <> '5-LOW'"), F.concat(F.lit("x"), "o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return package.merge([a, b], ["entity_id"])


@query("SELECT l_suppkey AS entity_id, l_shipdate AS timestamp, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS l_orderkey, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS l_quantity FROM lineitem GROUP BY 1, 2")
def upsert_latest(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").alias("timestamp"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return store.latest(rows, ["entity_id", "timestamp"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]).select("entity_id", "timestamp", "l_orderkey", "l_quantity")


@query("""
WITH a AS (SELECT o_orderkey AS entity_id, o_orderdate AS timestamp, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT o_orderkey AS entity_id, o_orderdate AS timestamp, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice + 1 END AS price FROM orders WHERE o_orderstatus <> 'O')
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.timestamp, b.timestamp) AS timestamp, CASE WHEN b.entity_id IS NOT NULL THEN b.price ELSE a.price END AS price, a.status,
CAST(CASE WHEN b.entity_id IS NOT NULL THEN 11 ELSE 10 END AS BIGINT) AS job_id, CASE WHEN a.entity_id IS NOT NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS created
FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.timestamp = b.timestamp""")
def upsert_partial_columns(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    base = orders.drop("o_orderpriority").where("status <> 'F'").withColumn("job_id", F.lit(10).cast("bigint")).withColumn("created", F.lit("2024-01-01").cast(NTZ))
    new = orders.where("status <> 'O'").select("entity_id", "timestamp", F.when(F.expr("o_orderpriority <> '5-LOW'"), F.col("price") + 1).alias("price"))
    return store.upsert(base, new, job=11, now=F.lit("2024-02-01").cast(NTZ))


@query("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderstatus <> 'O')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k)""")
def insert_missing(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    open_, done = (orders.where(F.col("o_orderstatus") != x).drop("o_orderstatus") for x in ("F", "O"))
    return store.insert_missing(open_, done.withColumn("v", F.col("v") * 2), ["k"])


@query("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderdate AS modified FROM orders), b AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v, TIMESTAMP '1997-01-01' AS modified FROM orders WHERE o_orderstatus = 'F')
SELECT a.k, coalesce(b.v, a.v) AS v, greatest(a.modified, coalesce(b.modified, a.modified)) AS modified FROM a LEFT JOIN b ON a.k = b.k""")
def update_existing(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("modified"), "o_orderstatus")
    orders, new = orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'").select("k", (F.col("v") * 2).alias("v"), F.lit("1997-01-01").cast(NTZ).alias("modified"))
    return store.update_existing(orders, new, ["k"], "modified")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate <> TIMESTAMP '1997-05-28'")
def clear_timestamp(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderdate", "timestamp")
    return store.clear(rows, datetime(1997, 5, 28)).select("o_orderkey", "o_totalprice")


def _history(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("timestamp"), "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""
SELECT entity_id, timestamp, o_orderkey, o_orderstatus FROM (
  SELECT o_custkey AS entity_id, o_orderdate AS timestamp, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS p, row_number() OVER w AS k FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE k = 1 OR p IS DISTINCT FROM o_orderstatus""")
def attr_history_compact(spark, d):
    return attributes.compact(_history(spark, d).drop("o_orderpriority"), order=["timestamp", "o_orderkey"], columns=["o_orderstatus"])


@query("SELECT o_custkey AS entity_id, max((o_orderdate, o_orderkey))[1] AS timestamp, max((o_orderdate, o_orderkey))[2] AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1".replace("max((o_orderdate, o_orderkey))[1]", "arg_max(o_orderdate, (o_orderdate, o_orderkey))").replace("max((o_orderdate, o_orderkey))[2]", "arg_max(o_orderkey, (o_orderdate, o_orderkey))"))
def attr_current(spark, d):
    return attributes.current(_history(spark, d), order=["timestamp", "o_orderkey"])


@query('SELECT o_custkey AS entity_id, o_orderdate AS timestamp, o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "end" FROM orders')
def attr_validity(spark, d):
    return attributes.with_end(_history(spark, d).select("entity_id", "timestamp", "o_orderkey"), order=["timestamp", "o_orderkey"])


@query("""
WITH h AS (SELECT o_orderkey AS e, o_orderdate AS t, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'), n AS (SELECT o_orderkey AS e, o_orderdate AS t, 'new' AS s FROM orders WHERE o_orderstatus <> 'O')
SELECT coalesce(h.e, n.e) AS entity_id, coalesce(h.t, n.t) AS timestamp, coalesce(n.s, h.s) AS status, CASE WHEN n.e IS NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2021-01-01' END AS modified FROM h FULL JOIN n ON h.e = n.e AND h.t = n.t""")
def attr_transfer_staged(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderstatus").alias("status"))
    history = rows.where("status <> 'F'").withColumn("modified", F.lit("2020-01-01").cast(NTZ))
    return attributes.transfer(history, rows.where("status <> 'O'").withColumn("status", F.lit("new")), F.lit("2021-01-01").cast(NTZ))


@query("SELECT user_id, event_type, min(ts) AS start, max(ts) AS \"end\", count(*) AS notifications FROM events GROUP BY 1, 2")
def notification_set(spark, d):
    return triggers.notification_sets(table(spark, d, "events").withColumnRenamed("ts", "timestamp"), ["user_id", "event_type"])


@query("""
SELECT user_id AS entity_id, ts AS timestamp, ts AS created, CAST(7 AS INTEGER) AS rule_id, concat_ws(chr(10), 'high: ' || event_type || ' > 20', 'user ' || user_id) AS details,
'{"event":"' || event_type || '","id":' || event_id || '}' AS data, CAST(CASE WHEN value > 30 THEN 500 WHEN value > 60 THEN 800 ELSE 100 END AS INTEGER) AS weight FROM events WHERE value > 20""")
def trigger_threshold(spark, d):
    rule = triggers.Trigger(
        "high",
        ("value", "event_type"),
        {"max_value": 20.0},
        "value > max_value",
        triggers.weights(("value > 30", 500), ("value > 60", 800), otherwise=100),
        "concat_ws('\n', format_string('high: %s > %.0f', event_type, max_value), format_string('user %s', entity_id))",
        "to_json(named_struct('event', event_type, 'id', event_id))",
        rule_id=7,
    )
    rows = table(spark, d, "events").withColumnRenamed("user_id", "entity_id").withColumnRenamed("ts", "timestamp")
    return rule.notifications(rows, F.col("timestamp"))


def _log(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("part"), bucket_end(F.col("ts"), "15m").alias("timestamp"), F.col("ts").alias("modified"))


_FOLD = f"SELECT event_type AS part, {_bucket('15 minute')} AS timestamp, max(ts) AS last FROM events GROUP BY 1, 2"


@query(_FOLD)
def modified_fold(spark, d):
    log = _log(spark, d)
    early, later = log.where(F.col("modified") < F.lit("2024-01-10").cast(NTZ)), log.where(F.col("modified") >= F.lit("2024-01-10").cast(NTZ))
    return store.fold_modified(later, store.fold_modified(early))


@query(f"""
WITH f AS ({_FOLD}), g AS (SELECT *, time_bucket(INTERVAL 1 HOUR, timestamp - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS t FROM f WHERE part IN ('click', 'error'))
SELECT 'hourly' AS target, t AS timestamp, max(last) AS max_modified,
'[' || string_agg('{{"part":"' || part || '","at":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.000') || '","last":"' || strftime(last, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(last, '%f'), 1, 3) || '"}}', ',' ORDER BY part, timestamp) || ']' AS fingerprint
FROM g GROUP BY t""")
def fingerprint_1h(spark, d):
    return incremental.fingerprints(store.fold_modified(_log(spark, d)), ("click", "error"), "1h", "hourly")


@query(f"""
WITH f AS ({_FOLD}), g AS (SELECT *, time_bucket(INTERVAL 1 HOUR, timestamp - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS t FROM f),
s AS (SELECT part AS target, t AS timestamp, max(last) AS max_modified, CAST(count(*) AS VARCHAR) AS fingerprint FROM g GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN hour(timestamp) % 3 = 0 THEN NULL WHEN hour(timestamp) % 3 = 1 THEN fingerprint ELSE '0' END AS processed FROM s)
SELECT target, timestamp, max_modified, fingerprint, processed FROM p WHERE timestamp < TIMESTAMP '2024-01-20' AND max_modified + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-20'
AND (processed IS NULL OR fingerprint <> processed) AND TIMESTAMP '2024-01-20' - INTERVAL 15 DAY < timestamp ORDER BY timestamp DESC, target LIMIT 50""")
def due_chunks(spark, d):
    f = store.fold_modified(_log(spark, d)).groupBy(F.col("part").alias("target"), bucket_end(F.col("timestamp"), "1h").alias("timestamp")).agg(F.max("last").alias("max_modified"), F.count("*").cast("string").alias("fingerprint"))
    state = f.withColumn("processed", F.when(F.hour("timestamp") % 3 == 0, None).when(F.hour("timestamp") % 3 == 1, F.col("fingerprint")).otherwise("0"))
    # a limit is the feature: the monitor takes so many at a time
    return incremental.due(state, F.lit("2024-01-20").cast(NTZ), F.expr("INTERVAL 30 MINUTES"), F.expr("INTERVAL 15 DAYS"), most=50)


@query("SELECT DISTINCT date_trunc('day', ts) AS begin FROM events WHERE date_trunc('day', ts) < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY - INTERVAL 2 DAY")
def retention_expired(spark, d):
    days = table(spark, d, "events").select(F.date_trunc("DAY", "ts").cast(NTZ).alias("begin")).distinct()
    return store.expired(days, F.lit("2024-01-20").cast(NTZ), F.expr("INTERVAL 7 DAYS"), F.expr("INTERVAL 1 DAY"))


@query("SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS index, count(*) AS samples FROM events GROUP BY 1")
def partition_indexes(spark, d):
    return table(spark, d, "events").groupBy(partition_index(F.col("ts"), "1d").alias("index")).agg(F.count("*").alias("samples"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity * 1000 AS milli FROM lineitem")
def generated_trend(spark, d):
    rows = table(spark, d, "lineitem")
    computed = {"net": "l_extendedprice * (1 - l_discount)", "milli": "l_quantity * 1000"}
    return rows.withColumns({n: F.expr(e).cast("double") for n, e in computed.items()}).select("l_orderkey", "l_linenumber", *computed)


@query("SELECT c_custkey, c_acctbal * 1000 AS mills, c_name AS label FROM customer WHERE c_acctbal > 0")
def view_projection(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", (F.col("c_acctbal") * 1000).alias("mills"), F.col("c_name").alias("label"))


_INTEGERS = "CASE WHEN bool_and(regexp_full_match(CAST({0} AS VARCHAR), '-?[1-9][0-9]*') AND TRY_CAST({0} AS SMALLINT) IS NOT NULL) THEN 'smallint' WHEN bool_and(TRY_CAST({0} AS INTEGER) IS NOT NULL) THEN 'integer' WHEN bool_and(TRY_CAST({0} AS BIGINT) IS NOT NULL) THEN 'bigint' END AS {1}"


@query(f"""
SELECT {_INTEGERS.format("o_orderkey", "keys")}, {_INTEGERS.format("o_custkey", "customers")}, {_INTEGERS.format("o_orderkey * 1000000007", "wide")},
CASE WHEN bool_and(regexp_full_match(CAST(o_totalprice AS VARCHAR), '[0-9]+')) THEN 'integer' WHEN bool_and(TRY_CAST(o_totalprice AS DOUBLE) IS NOT NULL) THEN 'real' END AS prices,
CASE WHEN bool_and(TRY_CAST(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' END AS dates,
CASE WHEN bool_or(TRY_CAST(o_orderpriority AS DOUBLE) IS NULL) THEN 'text' END AS names FROM orders""")
def infer_types(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("keys"), F.col("o_custkey").cast("string").alias("customers"), (F.col("o_orderkey") * 1000000007).cast("string").alias("wide"), F.col("o_totalprice").cast("string").alias("prices"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("dates"), F.col("o_orderpriority").alias("names"))
    return datatypes.infer(rows, rows.columns)


@query("""
SELECT o_orderkey, list_value(CAST(o_orderkey % 7 AS SMALLINT), NULL, CAST(o_custkey AS SMALLINT)) AS numbers, o_orderkey % 7 = 3 OR o_custkey = 3 AS has_three, list_has_all([1, 3], [CAST(o_orderkey % 7 AS INTEGER)]) AS contained FROM orders""")
def parse_arrays(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("{"), (F.col("o_orderkey") % 7).cast("string"), F.lit(",\\N,"), F.col("o_custkey").cast("string"), F.lit("}")).alias("t"), F.array((F.col("o_orderkey") % 7).cast("int")).alias("one"))
    numbers = datatypes.parse(F.col("t"), datatypes.Format("smallint[]"))
    return text.select("o_orderkey", numbers.alias("numbers"), F.coalesce(F.array_contains(numbers, F.lit(3).cast("smallint")), F.lit(False)).alias("has_three"), (F.size(F.array_except("one", F.array(F.lit(1), F.lit(3)))) == 0).alias("contained"))


@query("""
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS big, CAST(o_totalprice AS DECIMAL(38,9))::DOUBLE AS exact, o_orderdate AS stamp, o_orderstatus = 'F' AS finished, nullif(o_orderpriority, '5-LOW') AS label FROM orders""")
def parse_typed_columns(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("big"), F.col("o_totalprice").cast("string").alias("exact"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("o_orderstatus").alias("finished"), F.col("o_orderpriority").alias("label"))
    forms = {
        "big": datatypes.Format("bigint"),
        "exact": datatypes.Format("numeric"),
        "stamp": datatypes.Format("timestamp", pattern=datatypes.pattern("%Y-%m-%d %H:%M:%S")),
        "finished": datatypes.Format("boolean", true=("F",), false=("O", "P")),
        "label": datatypes.Format("text", null="5-LOW"),
    }
    return _out(text.select("o_orderkey", *(datatypes.parse(F.col(c), f).alias(c) for c, f in forms.items())))


@query("""
SELECT o_orderkey, coalesce(CAST(nullif(o_custkey, 7) AS VARCHAR), '\\N') AS number, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS flag, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp, '<' || o_orderpriority || '>' AS label, '{' || o_custkey || ',\\N}' AS list FROM orders""")
def serialize_values(spark, d):
    rows = table(spark, d, "orders")
    f = datatypes.Format
    return rows.select(
        "o_orderkey",
        datatypes.write(F.nullif(F.col("o_custkey"), F.lit(7)), f("bigint")).alias("number"),
        datatypes.write(F.col("o_orderstatus") == "F", f("boolean", true=("yes",), false=("no",))).alias("flag"),
        datatypes.write(F.col("o_orderdate"), f("timestamp")).alias("stamp"),
        datatypes.write(F.col("o_orderpriority"), f("text", prefix="<", postfix=">")).alias("label"),
        datatypes.write(F.array("o_custkey", F.lit(None).cast("bigint")), f("bigint[]")).alias("list"),
    )


@query("""
SELECT n_nationkey, 'Region=' || r_name || ',Nation=' || n_name AS dn, 'Nation' AS entity_type, n_name AS last_name, CAST(2 AS INTEGER) AS depth, 'Region=' || r_name || '\\,Nation=' || n_name AS escaped FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dn_explode(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dn = rows.select("n_nationkey", F.concat(F.lit("Region="), "r_name", F.lit(",Nation="), "n_name").alias("text")).withColumn("parts", names.explode_dn(F.col("text")))
    return dn.select("n_nationkey", names.implode_dn(F.col("parts")).alias("dn"), names.dn_entity_type(F.col("text")).alias("entity_type"), F.element_at("parts", -1)["name"].alias("last_name"), F.size(names.split_dn(F.col("text"))).alias("depth"), names.escape_commas(F.col("text")).alias("escaped"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"user\":' || user_id || ',\"kind\":\"' || event_type || '\"}' AS made FROM events")
def json_props(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))).alias("made"))


@query("""
SELECT p.p_partkey AS attribute_id, t.id AS tag_id FROM part p JOIN (SELECT row_number() OVER (ORDER BY brand) AS id, brand FROM (SELECT DISTINCT p_brand AS brand FROM part)) t ON t.brand = p.p_brand WHERE p_size <= 40""")
def case_insensitive_join(spark, d):
    """Parts linked with their brands as tags, written in other letter case; the links of large parts are known already."""
    part = table(spark, d, "part")
    tags = relations.numbered(part.select(F.col("p_brand").alias("name")).distinct(), ["name"], 0, "tag_id")
    wanted = part.select(F.upper("p_name").alias("name"), F.lower("p_brand").alias("tag"), "p_partkey", "p_size")
    own = part.select(F.col("p_partkey").alias("attribute_id"), F.concat_ws("#", "p_name", "p_partkey").alias("name"))
    named = wanted.select(F.concat_ws("#", "name", "p_partkey").alias("attribute"), "tag")
    known = part.where("p_size > 40").join(tags, F.col("name") == F.col("p_brand")).select(F.col("p_partkey").alias("attribute_id"), "tag_id")
    return attributes.tag_links(own, tags.select("tag_id", "name"), named, known)


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS entities, max(o_orderdate) AS latest FROM orders")
def report_attribute_stats(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    return _out(Catalog().report({"orders": rows}, spark).drop("part"))


@query("""
SELECT 'events' AS part, count(*) AS rows, count(DISTINCT user_id) AS entities, max(ts) AS latest FROM events
UNION ALL SELECT 'lines', count(*), count(DISTINCT l_suppkey), max(l_shipdate) FROM lineitem UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), max(o_orderdate) FROM orders""")
def report_store_counts(spark, d):
    kinds = {"events": ("events", "user_id", "ts"), "orders": ("orders", "o_custkey", "o_orderdate"), "lines": ("lineitem", "l_suppkey", "l_shipdate")}
    return _out(Catalog().report({part: table(spark, d, name).select(F.col(key).alias("entity_id"), F.col(at).cast("timestamp").alias("timestamp")) for part, (name, key, at) in kinds.items()}, spark))


@query("SELECT o_orderpriority AS priority, count(*) AS orders FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice > 1000 OR o_custkey >= 10) GROUP BY 1 ORDER BY 1 LIMIT 3")
def builder_select_group_limit(spark, d):
    # the limit is the clause under test
    kept = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O") & ((F.col("o_totalprice") > 1000) | (F.col("o_custkey") >= 10)))
    return kept.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders")).orderBy("priority").limit(3)


@query("SELECT count(*) AS orders FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'F'")
def bind_parameters(spark, d):
    return spark.sql("SELECT count(*) AS orders FROM {orders} WHERE o_custkey > :least AND o_orderstatus = :status", args={"least": 100, "status": "F"}, orders=table(spark, d, "orders"))


@query("""
SELECT 'left' AS kind, c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey
UNION ALL SELECT 'right', c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) RIGHT JOIN orders ON c_custkey = o_custkey""")
def left_right_join(spark, d):
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    left = customer.join(orders.where("o_totalprice > 400000"), on, "left").select(F.lit("left").alias("kind"), F.col("c_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    return left.union(customer.where("c_acctbal > 5000").join(orders, on, "right").select(F.lit("right"), "c_custkey", "o_orderkey"))


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 4")
def cross_filter(spark, d):
    # both sides named with a condition: the planner makes an equi-join of it
    return table(spark, d, "nation").join(table(spark, d, "region"), (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") > 4)).select("n_name", "r_name")


@query("""
WITH s AS (SELECT o_custkey AS store, max(o_orderdate) AS modified FROM orders GROUP BY 1), m AS (SELECT o_custkey AS store, max(o_orderdate) AS materialized FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT s.store, modified, materialized FROM s LEFT JOIN m USING (store) WHERE modified > materialized OR materialized IS NULL""")
def stale_curr(spark, d):
    orders = table(spark, d, "orders")
    made = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("store")).agg(F.max("o_orderdate").alias("materialized"))
    return attributes.stale(orders.groupBy(F.col("o_custkey").alias("store")).agg(F.max("o_orderdate").alias("modified")), made)


@query("SELECT n.n_name AS name, r.r_name AS region, count(*) AS customers FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1, 2 ORDER BY 1, 2")
def lookup_joins(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("name"), F.col("r_name").alias("region")).agg(F.count("*").alias("customers")).orderBy("name", "region")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders")
def csv_roundtrip(spark, d):
    """Written as text with tabs and \\N, and read again with typed columns. The folder must be one that all executors share."""
    from tidemark.session import shared_folder

    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    path = shared_folder(spark, "copy")
    csv.copy_to(rows, path)
    return csv.copy_from(spark, path, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double precision", "o_orderdate": "timestamp", "o_orderpriority": "text"})


_CORRECTED = "(SELECT ts, event_type, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' THEN value + 1 ELSE value END AS value FROM events)"


@query(_agg_sql(_bucket("1 hour")).replace("SELECT user_id", "SELECT event_type, user_id").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3").replace("FROM events", f"FROM {_CORRECTED}"))
def live_monitor_once(spark, d):
    """The hourly part of all events, made by the streaming monitor in two batches: everything, then what two corrected days change."""
    from tidemark.session import shared_folder

    root = shared_folder(spark, "monitor")
    rows = table(spark, d, "events").select("event_type", F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").cast(MONEY).alias("value"))
    within = (F.col("timestamp") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("timestamp") < F.lit("2024-01-05").cast("timestamp"))
    corrected = rows.withColumn("value", F.when(within, F.col("value") + 1).otherwise(F.col("value")).cast(MONEY))
    job = incremental.Materialization("hourly", ("events",), parse("1h"), lambda own: aggregate.time_aggregate(own, VALUE, "1h"), reprocessing=None)
    made = store.TrendTable(spark, f"{root}/hourly", "entity_id string, timestamp timestamp, created timestamp, job_id bigint, samples bigint, value decimal(28,2)", partition_size("1h"))
    held = {}
    monitor = incremental.LiveMonitor(spark, f"{root}/log", f"{root}/checkpoint", [job], lambda _: held["rows"], lambda m, own, stamps: made.store(own), lambda: datetime(2024, 6, 1))
    for source, at, changed in ((rows, "2024-03-01", F.lit(True)), (corrected, "2024-03-02", within)):
        # an entity for each kind of event of a user
        held["rows"] = source.select(F.concat_ws(":", "event_type", "entity_id").alias("entity_id"), "timestamp", "value")
        stamped = source.where(changed).withColumn("timestamp", bucket_end(F.col("timestamp"), "15m"))
        store.modified_log(stamped, "events", F.lit(at).cast("timestamp")).write.mode("append").parquet(f"{root}/log")
        monitor.start().awaitTermination()
    entity = F.split("entity_id", ":")
    return _out(made.read().select(entity[0].alias("event_type"), entity[1].cast("bigint").alias("entity_id"), "timestamp", "samples", "value"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def delete_using(spark, d):
    return store.delete_using(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("WITH big(k, price) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000) SELECT k, price * 2 AS doubled FROM big")
def with_query(spark, d):
    return spark.sql("WITH big(k, price) AS (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 400000) SELECT k, price * 2 AS doubled FROM big", orders=table(spark, d, "orders"))


@query("SELECT DISTINCT l_shipdate AS timestamp FROM lineitem")
def package_timestamps(spark, d):
    return package.timestamps(_line_package(spark, d))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS whole FROM events")
def unix_times(spark, d):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, d, "events").select("event_id", seconds.alias("seconds"), F.timestamp_seconds(seconds).cast(NTZ).alias("whole"))


@query("""
SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day, date_trunc('week', ts) AS week,
date_trunc('day', timezone('Europe/Amsterdam', timezone('UTC', ts))) AS local_day FROM events""")
def aligned_timestamps(spark, d):
    ts = F.col("ts")
    names_ = {"quarter": "15m", "hour": "1h", "day": "1d", "week": "1w"}
    local = most_recent(ts, "1d", "Europe/Amsterdam")
    return table(spark, d, "events").select("event_id", *(most_recent(ts, g).alias(n) for n, g in names_.items()), local.alias("local_day"))


@query("SELECT o_orderkey AS entity_id, CAST(o_custkey AS BIGINT) AS number, o_totalprice AS price, CAST(NULL AS VARCHAR) AS remark FROM orders")
def widened_attributes(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").cast("int").alias("number"), F.col("o_totalprice").alias("price"))
    return attributes.widen(rows, {"number": ("integer", "bigint"), "price": ("double precision", "integer"), "remark": ("text", "text")})


@query("""
SELECT o_custkey AS entity_id, TIMESTAMP '2024-01-01' AS timestamp, TIMESTAMP '2024-01-01' AS modified, CAST(count(*) AS BIGINT) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1""")
def sampled_view(spark, d):
    view = spark.sql("SELECT o_custkey AS entity_id, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM {orders} GROUP BY 1", orders=table(spark, d, "orders"))
    empty = spark.createDataFrame([], "entity_id bigint, timestamp timestamp_ntz, modified timestamp_ntz, orders bigint, spent double")
    return attributes.sample_view(empty, view, F.lit("2024-01-01").cast(NTZ))


@query("SELECT o_orderkey AS entity_id, o_orderdate AS timestamp, o_totalprice AS price, nullif(o_orderpriority, '5-LOW') AS label FROM orders")
def json_package(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("price"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("label"))
    return csv.package_from_json(csv.package_json(rows), "price double, label string").withColumn("timestamp", F.col("timestamp").cast(NTZ))


@query("""
SELECT event_type, CAST(avg(CAST(user_id AS DECIMAL(20,0))) * 0 + CAST(sum(user_id) AS DOUBLE) / count(*) AS DOUBLE) AS mean, CAST(sum(CAST(user_id AS SMALLINT)) AS BIGINT) AS total, max(CAST(user_id AS INTEGER)) AS most FROM events GROUP BY 1""")
def promoted_types(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("user_id"), F.col("user_id").cast("smallint").alias("small"), F.col("user_id").cast("int").alias("whole"))
    grouped = rows.groupBy("event_type").agg(F.sum("user_id").alias("s"), F.count("*").alias("n"), datatypes.aggregate("sum", "small", "smallint").alias("total"), datatypes.aggregate("max", "whole", "integer").alias("most"))
    return grouped.select("event_type", (F.col("s").cast("double") / F.col("n")).alias("mean"), "total", "most")


@query("""
WITH w AS (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY)) AS begin), p AS (SELECT DISTINCT date_trunc('day', ts) AS begin FROM events)
SELECT CAST(epoch(begin) // 86400 AS BIGINT) AS index FROM w ANTI JOIN p USING (begin)""")
def missing_partitions(spark, d):
    begin = F.lit("2023-12-27 00:00:00").cast("timestamp")
    wanted = spark.range(1).select(F.explode(stamps(begin, F.lit("2024-02-02 00:00:00").cast("timestamp"), "1d")).alias("begin")).select(partition_index(F.col("begin"), "1d").alias("index"))
    present = table(spark, d, "events").select(partition_index(F.col("ts"), "1d").alias("index")).distinct()
    return store.missing_partitions(wanted, present, ["index"])


@query("""
SELECT l_suppkey AS entity_id, date_trunc('month', l_shipdate - INTERVAL 1 MICROSECOND) + INTERVAL 1 MONTH AS timestamp, count(*) AS samples, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2""")
def supplier_months(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_extendedprice").cast(MONEY).alias("price"))
    return _out(aggregate.time_aggregate(rows, [aggregate.Measure("price", "numeric")], "1month"))


@query("""
SELECT CAST(row_number() OVER (ORDER BY user_id, ts, '{"type":"' || event_type || '","id":' || event_id || '}') + 100 AS BIGINT) AS id, user_id AS entity_id, ts AS timestamp, '{"type":"' || event_type || '","id":' || event_id || '}' AS data FROM events WHERE value > 90
UNION ALL SELECT 100, 1, TIMESTAMP '2020-01-01', NULL""")
def notification_append(spark, d):
    held = spark.createDataFrame([(100, 1, datetime(2020, 1, 1), None)], "id bigint, entity_id bigint, timestamp timestamp_ntz, data string")
    new = table(spark, d, "events").where("value > 90").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("timestamp"), F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")).alias("data"))
    return triggers.append(held, new)


@query("SELECT n_nationkey, n_name, 'nation-' || CAST(n_nationkey AS VARCHAR) AS label FROM nation WHERE n_name IN ('NATION_1', 'NATION_2') OR n_nationkey >= 20")
def literals_and_calls(spark, d):
    label = F.call_function("concat", F.lit("nation-"), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").where(F.col("n_name").isin("NATION_1", "NATION_2") | (F.col("n_nationkey") >= F.lit(20))).select("n_nationkey", "n_name", label.alias("label"))
