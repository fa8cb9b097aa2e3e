from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import spikes

T0 = datetime(2023, 3, 2, tzinfo=UTC)


def wave(n, seed=1):
    r = np.random.default_rng(seed)
    return 15 + 6 * np.sin(np.arange(n) / 40) + r.normal(0, 0.3, n)


def hits(x, limit=5.0):
    return np.flatnonzero(spikes.spikes(np.asarray(x, float), np.zeros(len(x), np.int64), limit)).tolist()


def test_single_and_short_patches():
    x = wave(600)
    x[100] += 9
    x[200:203] -= 7
    x[300:302] += 8
    assert hits(x) == [100, 200, 201, 202, 300, 301]


def test_shifts_waves_and_rest_are_sound():
    x = wave(600)
    x[300:] += 12
    assert hits(x) == []
    power = np.abs(wave(600))
    power[200:300] = 0
    power[310:400] = 0
    power[450], power[500], power[-2:] = 0, power[500] / 20, 0
    n = np.zeros(600, np.int64)
    stuck, spike = spikes.faults(n, np.arange(600), [power], (spikes.FIELDS[2],))[0]
    assert not stuck.any() and np.flatnonzero(spike).tolist() == [500]


def test_coarse_values():
    x = np.round(wave(600) * 2) / 2
    x[50] += 8
    assert hits(x) == [50]
    assert hits(np.full(100, 3.0)) == []


def test_series_do_not_touch():
    a, b = wave(200), wave(200, 2) + 300
    series = np.repeat([0, 1], 200)
    assert not spikes.spikes(np.concatenate([a, b]), series, 5.0).any()


def test_stuck_runs():
    x = wave(300)
    x[100:112] = x[100]
    assert np.flatnonzero(spikes.stuck_runs(x, np.zeros(300, np.int64))).tolist() == list(range(100, 112))
    x = wave(300)
    x[100:109] = x[100]
    assert not spikes.stuck_runs(x, np.zeros(300, np.int64)).any()
    coarse = np.repeat(np.arange(60) % 7, 6).astype(float)
    coarse[30:42] = 3.0
    assert not spikes.stuck_runs(coarse, np.zeros(len(coarse), np.int64)).any()
    assert not spikes.stuck_runs(np.zeros(50), np.zeros(50, np.int64), rest=0.0).any()


def frame(spark, x, node="a", start=0, power=None):
    rows = [(start + i, node, T0 + timedelta(minutes=5 * i), float(v), 20.0 + (i % 7) / 10, None if power is None else float(power[i]), "x") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id bigint, node string, timestamp timestamp, outside_temp double, inside_temp double, power_kwh double, kind string")


def found(df):
    return sorted(map(tuple, spikes.found(spikes.implausible(df, "node", "timestamp", "sample_id"), "sample_id").collect()))


def test_faults_by_kind(spark):
    x = wave(400)
    x[50], x[150:165], x[300] = 999.9, x[150], x[300] + 9
    df = frame(spark, x)
    again = df.where("sample_id in (150, 300)").selectExpr("sample_id + 10000 as sample_id", "node", "timestamp", "outside_temp", "inside_temp", "power_kwh", "kind")
    odd = spark.createDataFrame([(20000, None, T0, 500.0, 20.0, -1.0, "x"), (20001, "a", None, 1.0, None, None, "x")], df.schema)
    got = found(df.union(again).union(odd))
    expected = [(50, "outside_temp"), (300, "outside_temp"), (10300, "outside_temp"), (10150, "outside_temp"), (20000, "outside_temp"), (20000, "power_kwh"), *((i, "outside_temp") for i in range(150, 165))]
    assert got == sorted(expected)
    assert found(df.limit(0)) == []


def test_parts_of_a_long_source_do_not_show(spark, monkeypatch):
    x = wave(6000)
    x[[576, 2881, 4321]] += 9  # at borders of days
    x[3450:3465] = x[3450]
    whole = found(frame(spark, x))
    monkeypatch.setattr(spikes, "PART", 900)
    monkeypatch.setattr(spikes, "HALO", 100)
    assert found(frame(spark, x)) == whole
    monkeypatch.setattr(spikes, "BROADCAST_DAYS", 3)
    assert found(frame(spark, x)) == whole
    assert len(whole) == 18


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_tiny_series(n):
    masks = spikes.faults(np.zeros(n, np.int64), np.arange(n), [np.full(n, 1.0)] * 3)
    assert not any(m.any() for pair in masks for m in pair)


def test_shifts_do_not_hide_outliers():
    """A reading between an old level and a new one is an outlier of the new one."""
    x = 15 + np.random.default_rng(3).normal(0, 0.3, 400)
    x[200:] -= 9
    x[201] += 7
    assert hits(x) == [201]
    rows = np.arange(400)
    bounds = np.stack([np.zeros(400, np.int64), np.full(400, 400)])
    clean = rows != 201
    assert np.flatnonzero(spikes.level_shifts(x, clean, bounds, np.full(400, 0.3), 5.0)).tolist() == [200]


def test_readings_within_a_rest():
    power = np.abs(wave(300))
    power[100:200] = 0
    power[150], power[115] = 12.0, 0.01
    _, spike = spikes.faults(np.zeros(300, np.int64), np.arange(300), [power], (spikes.FIELDS[2],))[0]
    assert np.flatnonzero(spike).tolist() == [150]


def test_what_is_usual_adds_up():
    """Sketches of parts add up to that of the whole."""
    x = np.round(wave(3000), 2)
    whole = spikes.usual(spikes.sketch(x, np.zeros(3000, np.int64), np.ones(3000, bool), np.zeros(3000, bool), np.ones(3000, bool)), 1)
    parts = []
    for a, b in ((0, 1000), (1000, 2200), (2200, 3000)):
        low, high = max(0, a - 50), min(3000, b + 50)
        home = np.zeros(high - low, bool)
        home[a - low : b - low] = True
        parts.append(spikes.sketch(x[low:high], np.zeros(high - low, np.int64), home, np.zeros(high - low, bool), np.ones(high - low, bool)))
    merged = []
    for what in zip(*parts):
        series, bins, *sums = (np.concatenate(x) for x in zip(*what))
        merged.append(spikes._added(series, bins, *sums))
    merged = spikes.usual([[x[0], x[1], x[3], x[4], x[5]] for x in merged], 1)
    assert np.isclose(whole.noise, merged.noise, rtol=1e-6) and np.isclose(whole.phi, merged.phi, rtol=0.02) and whole.run == merged.run


def test_halves_of_a_source_share_what_is_usual(spark, monkeypatch):
    """A source that is quiet in one half and noisy in the other is judged by both, cut or not; a busy day is cut too."""
    r = np.random.default_rng(5)
    x = np.concatenate([20 + r.normal(0, 0.05, 3000), 20 + r.normal(0, 1.0, 3000)])
    x[[500, 1500, 4500]] += (2.0, 3.0, 12.0)
    whole = found(frame(spark, x))
    monkeypatch.setattr(spikes, "PART", 100)
    monkeypatch.setattr(spikes, "SLOT", 20)
    monkeypatch.setattr(spikes, "HALO", 60)
    assert found(frame(spark, x)) == whole and (4500, "outside_temp") in whole
