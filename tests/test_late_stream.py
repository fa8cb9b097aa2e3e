import random
from datetime import datetime, timedelta
from decimal import Decimal

from tidemark.operators import late
from tidemark.streaming.late_stream import LateAggregates

T0 = datetime(2023, 3, 1, 22)
SCHEMA = "entity_id bigint, event timestamp, arrival timestamp, tie bigint, value decimal(12,3)"


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for i in range(200):
        event = T0 + timedelta(minutes=15 * r.randrange(24))
        rows.append((1 + i % 3, event, event + timedelta(minutes=r.choice([1, 5, 90, 3000, 9000])), i, None if i % 11 == 0 else Decimal(r.randrange(9))))
    rows += [(None, T0, T0, 900, Decimal(1)), (1, None, T0, 901, Decimal(1)), (1, T0, None, 902, Decimal(1))]
    cut_off = 3 * 86400
    state = LateAggregates(spark, str(tmp_path / "state"), {"entity_id": "bigint"}, "decimal(12,3)", 3600, cut_off)
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        state.start(source, str(tmp_path / "checkpoint")).awaitTermination()
    state.batch(spark.createDataFrame(rows[:60], SCHEMA))  # once more: nothing changes
    state.batch(spark.createDataFrame([], SCHEMA))
    direct = late.multisets(spark.createDataFrame(rows, SCHEMA), ["entity_id"], "event", "arrival", "tie", "value", 3600, {"now": cut_off})
    columns = ("entity_id", "period_end", "count_now", "distinct_now", "median_now", "total_now")
    known = lambda df: sorted(map(tuple, df.where("count_now > 0").select(*columns).collect()))
    assert known(state.statistics()) == known(late.statistics(direct, ["entity_id"], ["now"]))
    assert {r.total_now for r in state.totals().collect()} >= {r.total_now for r in late.totals(direct, ["entity_id"], ["now"]).where("total_now is not null").collect()}
