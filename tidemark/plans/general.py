"""Queries of the general training-data operators (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import grid, instants, late, rejects, spikes
from tidemark.sources.tables import table

PUBLISHED, CUT_OFF, HOUR = 300, 3 * 86400, 3600


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    timed = instants.with_instant(table(spark, d, "sample_text").select("row_id", "node", "timestamp"), table(spark, d, "v_site"))
    return instants.same_instant_pairs(timed, "row_id", "node", "instant_us")


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    timed = instants.with_instant(table(spark, d, "sample_text"), table(spark, d, "v_site"))
    return timed.select("row_id", "node", F.timestamp_micros("instant_us").cast("timestamp_ntz").alias("instant"), "outside_temp", "inside_temp", "power_kwh")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    timed = instants.with_instant(table(spark, d, "sample_text").select("row_id", "node", "timestamp"), table(spark, d, "v_site"))
    return instants.instant_classes(timed, "row_id", "node", "instant_us")


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return late.multisets(table(spark, d, "trend_delivery"), ["entity_id"], "timestamp", "modified", "delivery_id", "power_kwh", HOUR, {"first": PUBLISHED, "cutoff": CUT_OFF})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late.changed(_hours(spark, d), ["entity_id"], "first", "cutoff").select("entity_id", "period_end")


def p2_hours(spark: SparkSession, d: str) -> DataFrame:
    stats = late.statistics(_hours(spark, d), ["entity_id"], ["first", "cutoff"])
    exact = {c: F.col(c).cast("double").alias(c) for c in stats.columns if c.split("_")[0] in ("min", "max", "total", "median")}
    return stats.select(*(exact.get(c, F.col(c)) for c in stats.columns))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return rejects.split_lines(table(spark, d, "sample_line"), table(spark, d, "parser_config"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_lines(spark, d))


def p3_samples(spark: SparkSession, d: str) -> DataFrame:
    return rejects.samples(_lines(spark, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _power(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_series(table(spark, d, "sample_reading"), "node", "timestamp", "power_kwh", ["created", "sample_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.without_reading(_power(spark, d)).select("node", "period_end")


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    """Means to a millionth, so that they do not hang on the order in which parts are added."""
    return _power(spark, d).withColumn("mean", F.round("mean", 6))


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    return _power(spark, d).drop("mean")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.found(spikes.implausible(table(spark, d, "sample_reading"), "node", "timestamp", "sample_id"), "sample_id")


def p5_limits(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "sample_reading"), "node", "timestamp", "sample_id").where(F.col("kind") == "limit").select("sample_id", "field_name")


QUERIES = {f.__name__: f for f in (p1_found, p1_instants, p1_classes, p2_found, p2_hours, p3_found, p3_samples, p4_found, p4_series, p4_cells, p5_found, p5_limits)}

_TIMES = r"""
WITH z(abbreviation, zone, off) AS (VALUES
  ('CET', 'Europe/Amsterdam', 3600), ('CEST', 'Europe/Amsterdam', 7200), ('AEST', 'Australia/Sydney', 36000), ('AEDT', 'Australia/Sydney', 39600),
  ('NZST', 'Pacific/Auckland', 43200), ('NZDT', 'Pacific/Auckland', 46800), ('EAT', 'Africa/Nairobi', 10800), ('CST', 'America/Chicago', -21600),
  ('CDT', 'America/Chicago', -18000), ('JST', 'Asia/Tokyo', 32400), ('IST', 'Asia/Kolkata', 19800), ('ACST', 'Australia/Adelaide', 34200),
  ('ACDT', 'Australia/Adelaide', 37800), ('EET', 'Europe/Helsinki', 7200), ('EEST', 'Europe/Helsinki', 10800), ('NST', 'America/St_Johns', -12600),
  ('NDT', 'America/St_Johns', -9000), ('MST', 'America/Phoenix', -25200), ('EST', 'America/New_York', -18000), ('EDT', 'America/New_York', -14400),
  ('WET', 'Europe/Lisbon', 0), ('WEST', 'Europe/Lisbon', 3600), ('MST', 'America/Denver', -25200), ('MDT', 'America/Denver', -21600)),
m(word, month) AS (SELECT unnest(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']), unnest(range(1, 13))),
t AS (
  SELECT row_id, node, tz_name AS site_zone, date_order, upper(trim(trim(trim("timestamp", E' \t'), '"'), E' \t')) AS s
  FROM sample_text LEFT JOIN v_site ON name = split_part(node, '-', 1)),
c AS (
  SELECT *, regexp_extract(s, '^(.*?)( ?\[?([A-Z]+/[A-Z_]+)\]?)?$', ['head', 'x', 'named']) AS n FROM t),
o AS (
  SELECT *, n.named AS named, regexp_extract(n.head, '^(.*?[0-9])( ?([+-][0-9]{2}:?([0-9]{2})?)| ?([A-Z]+)| (AM|PM))?$', ['body', 'x', 'offset', 'mm', 'word', 'half']) AS p FROM c),
b AS (
  SELECT *, CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T?') OR NOT regexp_matches(s, '^(?:[A-Z]{3},? )?[0-9]') THEN '' WHEN p.body = '' THEN n.head ELSE p.body END AS body,
         CASE WHEN regexp_matches(p.body, ':[0-9]{2}|[0-9]{8}[T.]') THEN p.offset ELSE '' END AS off_text,
         CASE WHEN p.word IN ('AM', 'PM') THEN p.word ELSE '' END AS half, CASE WHEN p.word IN ('AM', 'PM') THEN '' ELSE p.word END AS word FROM o),
r AS (
  SELECT *,
    regexp_extract(body, '^([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]', ['y', 'm', 'd']) AS d1,
    regexp_extract(body, '^([0-9]{4})-([0-9]{3})T', ['y', 'j']) AS d2,
    regexp_extract(body, '^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}) ', ['a', 'b', 'y']) AS d3,
    regexp_extract(body, '^(?:[A-Z]{3}, )?([0-9]{1,2})[ -]([A-Z]{3})[ -]([0-9]{4}) ', ['d', 'w', 'y']) AS d4,
    regexp_extract(body, '^([0-9]{4})([0-9]{2})([0-9]{2})[T.]([0-9]{2})([0-9]{2})([0-9]{2})?(?:[.,]([0-9]+))?$', ['y', 'm', 'd', 'h', 'i', 's', 'f']) AS d5,
    regexp_extract(body, '[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?$', ['h', 'i', 's', 'f']) AS k
  FROM b),
q AS (
  SELECT row_id, node, s, site_zone, named, off_text, half, word,
    CASE WHEN d1.y <> '' THEN concat(d1.y, '-', d1.m, '-', d1.d)
         WHEN d2.y <> '' AND TRY_CAST(d2.j AS INT) BETWEEN 1 AND 365 + (TRY_CAST(d2.y AS INT) % 4 = 0)::INT THEN CAST(TRY_CAST(concat(d2.y, '-01-01') AS DATE) + TRY_CAST(d2.j AS INT) - 1 AS VARCHAR)
         WHEN d3.y <> '' THEN concat(d3.y, '-', CASE WHEN date_order = 'mdy' THEN concat(d3.a, '-', d3.b) WHEN date_order = 'dmy' THEN concat(d3.b, '-', d3.a) END)
         WHEN d4.y <> '' THEN concat(d4.y, '-', (SELECT month FROM m WHERE m.word = d4.w), '-', d4.d)
         WHEN d5.y <> '' THEN concat(d5.y, '-', d5.m, '-', d5.d) END AS date_text,
    CASE WHEN d5.y <> '' THEN d5.h ELSE k.h END AS h, CASE WHEN d5.y <> '' THEN d5.i ELSE k.i END AS i,
    CASE WHEN d5.y <> '' THEN d5.s ELSE k.s END AS sec, CASE WHEN d5.y <> '' THEN d5.f ELSE k.f END AS f
  FROM r),
w AS (
  SELECT *, TRY_CAST(date_text AS DATE) AS day, TRY_CAST(h AS INT) AS hh, TRY_CAST(i AS INT) AS mi, coalesce(TRY_CAST(sec AS INT), 0) AS ss,
    coalesce(TRY_CAST(left(rpad(f, 6, '0'), 6) AS BIGINT), 0) AS us FROM q),
v AS (
  SELECT *, (CAST(day AS TIMESTAMP) + to_seconds(3600 * CASE half WHEN 'AM' THEN hh % 12 WHEN 'PM' THEN hh % 12 + 12 ELSE hh END + 60 * mi + ss)) AS clock
  FROM w WHERE day IS NOT NULL AND mi <= 59 AND ss <= 59 AND (CASE WHEN half = '' THEN hh <= 23 ELSE hh BETWEEN 1 AND 12 END)),
u AS (
  SELECT row_id, node, us,
    CASE WHEN off_text <> '' THEN epoch_us(clock) - (CASE WHEN off_text[1] = '-' THEN -1 ELSE 1 END) * CAST(1000000 AS BIGINT) *
           (3600 * TRY_CAST(off_text[2:3] AS BIGINT) + 60 * coalesce(TRY_CAST(replace(off_text[4:], ':', '') AS BIGINT), 0))
         WHEN word IN ('Z', 'UTC', 'GMT') THEN epoch_us(clock)
         WHEN word <> '' THEN epoch_us(clock) - CAST(1000000 AS BIGINT) * (SELECT max(off) FROM z WHERE abbreviation = word AND zone = (SELECT max(zone) FROM z WHERE zone = site_zone AND abbreviation = word))
         ELSE (SELECT CASE WHEN count(DISTINCT x) = 1 THEN max(x) END FROM (
           SELECT epoch_us(timezone(CASE WHEN named <> '' THEN named ELSE site_zone END, clock)) + CAST(g.k AS BIGINT) * 1800000000 AS x FROM range(-4, 5) g(k)
           ) WHERE timezone(CASE WHEN named <> '' THEN named ELSE site_zone END, make_timestamptz(x)) = clock) END AS instant FROM v),
bare AS (
  SELECT row_id, node, CAST(split_part(s, '.', 1) AS HUGEINT) AS whole, rpad(split_part(s, '.', 2), 20, '0') AS fraction FROM t WHERE regexp_full_match(s, '[0-9]{9,19}(\.[0-9]+)?')),
e AS (
  SELECT row_id, node, CAST(whole AS VARCHAR) || fraction AS digits, length(CAST(whole AS VARCHAR)) AS wide FROM bare),
n AS (
  SELECT row_id, node, CAST(left(digits, wide - k + 6) AS BIGINT) AS instant FROM e, (VALUES (0), (3), (6), (9)) x(k)
  WHERE wide - k >= 1 AND CAST(left(digits, wide - k) AS HUGEINT) >= 1609459200 AND CAST(left(digits, wide - k) AS HUGEINT) < 1767225600),
i AS (SELECT row_id, node, instant + us AS instant FROM u WHERE instant IS NOT NULL UNION ALL SELECT row_id, node, instant FROM n)
"""

_LATE = """
WITH r AS (
  SELECT entity_id, epoch_us("timestamp") AS t, epoch_us(modified) AS m, delivery_id AS d, power_kwh AS p,
         (epoch_us("timestamp") + 3599999999) // 3600000000 * 3600 AS pe
  FROM trend_delivery WHERE entity_id IS NOT NULL AND "timestamp" IS NOT NULL AND modified IS NOT NULL),
f AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, t, m <= (pe + 300) * 1000000 ORDER BY m DESC, d DESC) AS k1,
         row_number() OVER (PARTITION BY entity_id, t, m <= (pe + 259200) * 1000000 ORDER BY m DESC, d DESC) AS k2 FROM r),
v AS (
  SELECT entity_id, pe, t, max(CASE WHEN k1 = 1 AND m <= (pe + 300) * 1000000 THEN p END) AS a,
         max(CASE WHEN k2 = 1 AND m <= (pe + 259200) * 1000000 THEN p END) AS b FROM f GROUP BY entity_id, pe, t)
"""

_LINES = """
WITH l AS (
  SELECT s.line_id, c.field_sep AS sep, c.decimal_mark AS mark, coalesce(c.null_literal, '') AS lit, string_split(c.column_list, ',') AS cols,
         regexp_replace(s.raw_line, '\\r$', '') AS raw
  FROM sample_line s JOIN parser_config c USING (config_name)
  WHERE coalesce(s.line_no, 0) <> 1 AND trim(regexp_replace(s.raw_line, '\\r$', '')) <> ''),
q AS (
  SELECT *, replace('^(?:"(?:[^"]|"")*"|[^"X]*)(?:X(?:"(?:[^"]|"")*"|[^"X]*))*$', 'X', sep) AS whole,
         replace('X("(?:[^"]|"")*"|[^"X]*)', 'X', sep) AS one FROM l),
ok AS (SELECT *, regexp_matches(raw, whole) AS fine FROM q),
f AS (SELECT *, CASE WHEN fine THEN regexp_extract_all(sep || raw, one, 1) END AS vals FROM ok),
c AS (
  SELECT *, unnest(cols) AS col, unnest(range(1, len(cols) + 1)) AS i FROM f WHERE fine AND len(vals) = len(cols)),
v AS (
  SELECT line_id, col, mark, lit,
         trim(CASE WHEN starts_with(vals[i], '"') THEN replace(substr(vals[i], 2, length(vals[i]) - 2), '""', '"') ELSE vals[i] END, ' ') AS x FROM c)
"""

_FAULTS = """SELECT line_id, 'quoting' AS fault FROM f WHERE NOT fine
UNION ALL SELECT line_id, 'column_count' FROM f WHERE fine AND len(vals) <> len(cols)
UNION ALL SELECT line_id, 'node' FROM v WHERE col = 'node' AND NOT regexp_full_match(x, '[a-z]+-[0-9]+')
UNION ALL SELECT line_id, 'timestamp' FROM v WHERE col = 'timestamp' AND NOT (
  regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})')
  AND x[12:13] <= '23' AND x[15:16] <= '59' AND x[18:19] <= '59' AND (x[20:20] = 'Z' OR (x[21:22] <= '23' AND x[24:25] <= '59'))
  AND TRY_CAST(x[1:10] AS DATE) IS NOT NULL)
UNION ALL SELECT line_id, col FROM v WHERE col IN ('outside_temp', 'inside_temp', 'power_kwh') AND x <> '' AND x <> lit
  AND NOT regexp_full_match(x, replace('[+-]?([0-9]+([D][0-9]*)?|[D][0-9]+)([eE][+-]?[0-9]+)?', 'D', mark))"""

_GRID = """
WITH r AS (
  SELECT node, epoch_us("timestamp") AS t, arg_max(power_kwh, (created, sample_id)) AS p FROM sample_reading
  WHERE node IS NOT NULL AND "timestamp" IS NOT NULL AND power_kwh IS NOT NULL GROUP BY 1, 2),
i AS (SELECT node, t, (t + 899999999) // 900000000 AS c, lead(t) OVER (PARTITION BY node ORDER BY t) AS n FROM r),
u AS (SELECT *, coalesce(least(n, t + 3600000000), c * 900000000) AS until FROM i),
x AS (SELECT *, unnest(generate_series(c, coalesce((n + 899999999) // 900000000, c))) AS cell FROM u),
g AS (
  SELECT node, cell, CAST(sum(CASE WHEN cell = c THEN 1 ELSE 0 END) AS BIGINT) AS readings,
         sum(greatest(0, least(until, cell * 900000000) - greatest(t, (cell - 1) * 900000000))) AS w FROM x GROUP BY 1, 2)
"""

SQL = {
    "p1_found": _TIMES + "SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM i a JOIN i b ON a.node = b.node AND a.instant = b.instant AND a.row_id < b.row_id",
    "p1_instants": _TIMES + "SELECT s.row_id, s.node, make_timestamp(i.instant) AS instant, outside_temp, inside_temp, power_kwh FROM sample_text s LEFT JOIN i USING (row_id)",
    "p1_classes": _TIMES + "SELECT node, instant AS instant_us, count(*) AS rows, min(row_id) AS first FROM i WHERE node IS NOT NULL GROUP BY 1, 2",
    "p2_found": _LATE
    + """SELECT entity_id, CAST(pe AS BIGINT) AS period_end FROM v GROUP BY entity_id, pe
HAVING sum(a) IS DISTINCT FROM sum(b)""",
    "p2_hours": _LATE
    + "SELECT entity_id, CAST(pe AS BIGINT) AS period_end, "
    + ", ".join(
        f"""CAST(count({c}) AS BIGINT) AS count_{m}, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_{m},
CAST(min({c}) AS DOUBLE) AS min_{m}, CAST(max({c}) AS DOUBLE) AS max_{m}, CAST(sum({c}) AS DOUBLE) AS total_{m},
CAST((quantile_disc(CAST({c} * 1000 AS BIGINT), 0.5) + -quantile_disc(CAST(-{c} * 1000 AS BIGINT), 0.5)) AS DOUBLE) / 2000 AS median_{m}"""
        for c, m in (("a", "first"), ("b", "cutoff"))
    )
    + " FROM v GROUP BY entity_id, pe",
    "p4_found": """
WITH r AS (
  SELECT node, (epoch_us("timestamp") + 899999999) // 900000000 AS c FROM sample_reading
  WHERE node IS NOT NULL AND "timestamp" IS NOT NULL AND power_kwh IS NOT NULL GROUP BY 1, 2),
g AS (SELECT node, unnest(generate_series(min(c), max(c))) AS c FROM r GROUP BY node)
SELECT node, CAST(c * 900 AS BIGINT) AS period_end FROM g ANTI JOIN r USING (node, c)""",
    "p5_limits": """
SELECT sample_id, 'outside_temp' AS field_name FROM sample_reading WHERE outside_temp < -95 OR outside_temp > 65
UNION ALL SELECT sample_id, 'inside_temp' FROM sample_reading WHERE inside_temp < -95 OR inside_temp > 95
UNION ALL SELECT sample_id, 'power_kwh' FROM sample_reading WHERE power_kwh < 0 OR power_kwh > 1e7""",
    "p3_found": _LINES + _FAULTS,
    "p3_samples": _LINES
    + """, bad AS ("""
    + _FAULTS
    + """)
SELECT line_id, max(x) FILTER (WHERE col = 'node') AS node,
  timezone('UTC', CAST(replace(max(x) FILTER (WHERE col = 'timestamp'), 'Z', '+00:00') AS TIMESTAMPTZ)) AS timestamp,
  max(TRY_CAST(replace(x, mark, '.') AS DOUBLE)) FILTER (WHERE col = 'outside_temp' AND x <> '' AND x <> lit) AS outside_temp,
  max(TRY_CAST(replace(x, mark, '.') AS DOUBLE)) FILTER (WHERE col = 'inside_temp' AND x <> '' AND x <> lit) AS inside_temp,
  max(TRY_CAST(replace(x, mark, '.') AS DOUBLE)) FILTER (WHERE col = 'power_kwh' AND x <> '' AND x <> lit) AS power_kwh
FROM v WHERE line_id NOT IN (SELECT line_id FROM bad) GROUP BY line_id""",
    "p4_cells": _GRID
    + """
SELECT node, CAST(cell * 900 AS BIGINT) AS period_end, readings, CAST(w AS DOUBLE) / 900000000 AS coverage,
  CASE WHEN readings > 0 THEN 'observed' WHEN w > 0 THEN 'filled' ELSE 'missing' END AS state FROM g""",
    "p4_series": _GRID.replace("(SELECT node, t, (t", "(SELECT node, t, p, (t").replace("AS w FROM x", """AS w,
         sum(CASE WHEN least(until, cell * 900000000) > greatest(t, (cell - 1) * 900000000) THEN p * (least(until, cell * 900000000) - greatest(t, (cell - 1) * 900000000)) END) AS area,
         arg_max(p, t) FILTER (WHERE cell = c) AS own FROM x""")
    + """
SELECT node, CAST(cell * 900 AS BIGINT) AS period_end, readings, round(CASE WHEN w > 0 THEN area / w ELSE own END, 6) AS mean, CAST(w AS DOUBLE) / 900000000 AS coverage,
  CASE WHEN readings > 0 THEN 'observed' WHEN w > 0 THEN 'filled' ELSE 'missing' END AS state FROM g""",
}
