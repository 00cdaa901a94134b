"""Selection of features, whitening by chunks, and sniffing, shaking, head movement and walks by pitch on planted series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import behaviour, selection, signal


def test_accumulate(spark):
    rng = np.random.default_rng(1)
    states = ["walk", "rear", "sit"]
    rows = []
    for s in range(6):
        for i in range(120):
            k = int(rng.integers(3))
            x = [float(v) for v in (5.0 * (k == 1) + rng.normal(), 3.0 * (k == 0) - 3.0 * (k == 2) + rng.normal(), rng.normal(), rng.normal(), 2.0 * (k == 1) + rng.normal())]
            rows.append((s, i, states[k], s < 5, *x))
    names = ["up", "fast", "noise", "other", "half"]
    df = spark.createDataFrame(rows + [(9, 0, "groom", True, 0.0, 0.0, 0.0, 0.0, 0.0), (9, 1, "sit", True, None, 0.0, 0.0, 0.0, 0.0)], "session int, idx long, label string, train boolean, " + ", ".join(f"{n} double" for n in names))
    got = selection.accumulate(df, names, states, least_bits=0.05, block=400, most=3).orderBy("level", "step").collect()
    assert {r.state for r in got} <= set(states) and len({r.state for r in got}) == 2 and {r.level for r in got} == {0, 1}
    for level in (0, 1):
        mine = [r for r in got if r.level == level]
        assert sorted(r.place for r in mine) == list(range(1, len(mine) + 1)) and mine[0].place == 1 and mine[0].feature in ("up", "fast", "half")
        assert max(r.accuracy for r in mine) > 0.9 and all(0 <= r.precision_state <= 1 and 0 <= r.sensitivity_rest <= 1 for r in mine)
    assert "noise" not in {r.feature for r in got if r.step == 1}
    assert selection.accumulate(df, ["noise"], states, least_bits=5.0).collect() == []
    rows, known = selection.normalise(df.where("session < 6"), ["up"])
    assert abs(rows.agg(F.avg("up")).first()[0]) < 1e-9 and abs(rows.agg(F.stddev_pop("up")).first()[0] - 1) < 1e-9 and set(known) == {"up"}


def test_whitened(spark):
    rng = np.random.default_rng(0)
    x = {0: np.cumsum(rng.normal(size=700)), 1: rng.normal(size=40), 2: np.full(30, 4.0), 3: np.array([1.0])}
    df = spark.createDataFrame([(s, i, float(v)) for s, a in x.items() for i, v in enumerate(a)], "session int, idx long, value double").repartition(3)
    got = {}
    for r in signal.whitened(df, ["session"], chunk=64).collect():
        got.setdefault(r.session, []).append((r.idx, r.value))
    for s in (0, 1):
        assert np.allclose([v for _, v in sorted(got[s])], signal.whiten(x[s]), atol=1e-9)
    assert all(v == 0 for s in (2, 3) for _, v in got[s])


def markers(spark, at):
    """at: marker -> (n, 3)."""
    return spark.createDataFrame([(0, i, m, *map(float, p)) for m, a in at.items() for i, p in enumerate(a)], "session int, idx long, marker string, x double, y double, z double")


def test_sniffing_and_shaking(spark):
    rate, n = 120.0, 2400
    t = np.arange(n) / rate
    on = (t > 8) & (t < 14)
    noise = np.random.default_rng(2).normal(0, 0.02, n)
    head = np.stack([10 + noise + on * np.sin(2 * np.pi * 11 * t), np.zeros(n), np.zeros(n)], axis=1)
    found = behaviour.sniffing(markers(spark, {"head_back": head, "spine_upper": np.zeros((n, 3))}), rate, threshold=1e-6).collect()
    assert len(found) == 1 and abs(found[0].t_first - 8) < 1.5 and abs(found[0].t_last - 14) < 1.5
    base = 2 * np.pi * 0.3 * t  # whole turns, so azimuths wrap
    at = lambda a: np.stack([np.cos(a), np.sin(a), np.zeros(n)], axis=1)
    body = {"spine_lower": np.zeros((n, 3)), "pelvis_root": at(base), "spine_middle": at(base + noise + on * 0.3 * np.sin(2 * np.pi * 15 * t))}
    for width in (None, 100):
        found = behaviour.shaking(markers(spark, body), rate, threshold=1e-6, width=width).collect()
        assert len(found) == 1 and abs(found[0].t_first - 8) < 1 and abs(found[0].t_last - 14) < 1


def test_head_moving_and_pitch(spark):
    n = 600
    x = np.cumsum(np.where((np.arange(n) > 200) & (np.arange(n) < 400), 1.0, 0.0))
    head = {m: np.stack([x + dx, np.zeros(n), np.zeros(n)], axis=1) for m, dx in (("head_back", 0), ("head_left", 1), ("head_front", 3), ("head_right", 1))}
    head["head_front"][:, 2] = np.where(np.arange(n) < 300, -3.0, 3.0)
    rows = markers(spark, head)
    for method in ("com", "vel"):
        found = behaviour.head_moving(rows, 100.0, method).collect()
        assert len(found) == 1 and abs(found[0].left - 200) < 3 and abs(found[0].right - 399) < 3
    with pytest.raises(ValueError):
        behaviour.head_moving(rows, 100.0, "other")
    walk = spark.createDataFrame([(0, 250, 350), (0, 10, 20)], "session int, start long, stop long")
    got = sorted((r.label, r.start, r.stop) for r in behaviour.walk_by_pitch(walk, rows).collect())
    assert got == [("walk_hang", 300, 350), ("walk_lang", 250, 300)]
