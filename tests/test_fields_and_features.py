"""Fields, behaviour, features and recordings on planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import behaviour, features, fields, recording
from pulsegrid.sources import paths


def test_patches(spark):
    rate = np.zeros((12, 15))
    rate[2:5, 2:5] = 5
    rate[5, 5] = 6  # touches the first patch at a corner
    rate[9:11, 10:12] = 9
    rows = spark.createDataFrame([(1, i, j, float(rate[i, j])) for i in range(12) for j in range(15)], "unit int, ix int, iy int, rate double")
    got = fields.patches(rows, 12, 15, 0.85).orderBy("patch").collect()
    assert [(r.area, r.peak) for r in got] == [(10, 6.0), (4, 9.0)] and abs(got[1].com_x - 9.5) < 1e-9


def test_smoothing_keeps_the_sum(spark):
    rows = spark.createDataFrame([(1, 6, 7, 10.0)], "unit int, ix int, iy int, n double")
    got = fields.smooth(rows, 1.0, 20, 20, "n").collect()
    assert abs(sum(r.n for r in got) - 10) < 1e-9 and max(got, key=lambda r: r.n)[1:3] == (6, 7)


def test_rate_at(spark):
    maps = spark.createDataFrame([(1, i, j, float(i + 10 * j)) for i in range(5) for j in range(5)], "unit int, ix int, iy int, rate double")
    points = spark.createDataFrame([(1, 2.5, 1.5), (1, 3.0, 1.5), (1, 99.0, 0.0)], "unit int, x double, y double")
    assert [r.rate for r in fields.rate_at(points, maps, (0.0, 0.0), (1.0, 1.0)).orderBy("x").collect()] == [12.0, 12.5, 0.0]


def test_bootstrap_and_shuffle(spark):
    rows = spark.range(3000).select(F.lit(0).alias("session"), F.col("id").alias("idx"), F.col("id").cast("double").alias("value"))
    n = fields.bootstrap_rows(rows.withColumn("value", F.lit(1.0)), 2, ["idx"]).groupBy("iter").count().collect()
    assert len(n) == 2 and all(2800 < r["count"] < 3200 for r in n)
    moved = {r.idx: r.value for r in fields.shuffle_blocks(rows.where("idx < 1025"), 100, ["value"], 3).collect()}
    assert sorted(moved.values()) == [float(i) for i in range(1025)] and all(moved[i] == i for i in range(1000, 1025))
    assert all(moved[i + 1] - moved[i] == 1 for i in range(1000) if (i + 1) % 100) and any(moved[i] != i for i in range(1000))


def test_gap_filling(spark):
    t = np.arange(60)
    y = np.sin(t / 8.0)
    y[20:24] = y[40:55] = np.nan
    rows = spark.createDataFrame([(0, int(i), None if np.isnan(v) else float(v)) for i, v in zip(t, y)], "session int, idx long, value double")
    smooth = behaviour.fill_smooth(rows, 5).orderBy("idx").toPandas().value.to_numpy()
    assert np.abs(smooth[20:24] - np.sin(t[20:24] / 8.0)).max() < 0.05 and np.isnan(smooth[40:55]).all()
    line = behaviour.fill_linear(rows, 5).orderBy("idx").toPandas().value.to_numpy()
    assert np.allclose(line[20:24], np.interp(t[20:24], [19, 24], [y[19], y[24]])) and np.isnan(line[45])


def test_oscillations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, 4000)
    x[1500:1900] += 3 * np.sin(2 * np.pi * 40 * np.arange(400) / 500)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "session int, idx long, value double")
    got = behaviour.oscillations(rows, (30.0, 50.0), 500.0, 2.0, 1.0, 5).collect()
    assert len(got) == 1 and abs(got[0].left - 1500) < 40 and abs(got[0].right - 1900) < 40


def test_rearing_and_exclusion(spark):
    rows = [(0, i, m, 0.0, 0.0, float(z)) for i in range(40) for m, z in (("head", 100 if 10 <= i < 30 else 20), ("spine", 20))]
    got = behaviour.rearing(spark.createDataFrame(rows, "session int, idx long, marker string, x double, y double, z double"), 50.0, 5, "head", "spine").collect()
    assert [(r.left, r.right) for r in got] == [(9, 29)]
    a = spark.createDataFrame([(0, 0.0, 100.0)], "session int, start double, stop double")
    b = spark.createDataFrame([(0, 40.0, 50.0)], "session int, start double, stop double")
    assert sorted((r.start, r.stop) for r in behaviour.without(a, b, 5.0).collect()) == [(0, 35), (55, 100)]


def test_hierarchical_selection(spark):
    rng = np.random.default_rng(5)
    label = np.repeat([0, 1, 2], 300)
    x = np.stack([np.where(label == 2, 8, 0), np.where(label == 1, 4, 0), np.zeros(900)], axis=1) + rng.normal(0, 0.5, (900, 3))
    rows = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(label, x)], "label int, f0 double, f1 double, f2 double")
    got = features.select_hierarchically(rows, ["f0", "f1", "f2"], "label", [0, 1, 2])
    assert len(got) == 2 and got[-1][1][0] in ("f0", "f1") and all("f2" not in f for _, f in got)


def test_training_split_and_draws(spark):
    periods = spark.createDataFrame([(0, "a", 10.0 * i, 10.0 * i + 8) for i in range(20)], "session int, label string, start double, stop double")
    split = features.training_split(periods, 0.9, 1.0).collect()
    assert len(split) == 20 and sum(r.train for r in split) == 18 and all(r.stop - r.start == 6 for r in split)
    rows = spark.createDataFrame([(0, i, "a" if i < 5 else "b") for i in range(50)], "session int, idx long, label string")
    drawn = features.balanced(rows, "label", 30).collect()
    assert sum(r.label == "a" for r in drawn) == sum(r.label == "b" for r in drawn) == 30


def test_chunks_on_a_grid(spark):
    chunks = spark.createDataFrame([("s", 0, 240), ("s", 1, 120), ("s", 2, 240), ("s", 3, 0)], "session string, chunk int, n_frames int")
    windows = spark.createDataFrame([("s", 10.0, 12.0), ("s", 20.0, 21.05), ("s", 30.0, 32.0), ("s", 40.0, 42.0)], "session string, start double, stop double")
    got = {r.chunk: r.start for r in recording.match_chunks(chunks, windows, 120.0).collect()}
    assert {k: round(v + 1 / 120, 6) for k, v in got.items()} == {0: 10.0, 1: 20.0, 2: 30.0}
    frames = spark.createDataFrame([("s", 0, 0, "m", 0.0, 1.0, 2.0), ("s", 2, 5, "m", 3.0, 4.0, 5.0)], "session string, chunk int, frame int, marker string, x double, y double, z double")
    grid = {r.idx: r for r in recording.on_grid(frames, recording.match_chunks(chunks, windows, 120.0), 120.0).collect()}
    assert set(grid) == {0, 20 * 120 + 5} and grid[0].x == recording.EPS32


def test_paths():
    p = paths.SessionPaths("labA-ab-05-20120312")
    assert p.subject == "000005" and p.file("res", 3).endswith("labA-ab-05-20120312.res.3") and p.file("fet", 1, "other").endswith(".fet.other.1")
    with pytest.raises(ValueError):
        paths.SessionPaths("nonsense")
    with pytest.raises(ValueError):
        p.file("clu")
    doc = '{"subjects": {"s": {"region": "ca1", "yaw": 1}}, "lists": {"l": [{"session": "a", "subject": "s", "yaw": 2}, {"session": "b", "subject": "s", "yaw": null}]}}'
    assert [(r["session"], r["region"], r["yaw"]) for r in paths.load_catalogue(doc)] == [("a", "ca1", 2), ("b", "ca1", 1)]
