"""Shuffled place fields against plain counting, and patches of maps over iterations."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import fields, placefield


def test_shuffled_place_field(spark):
    rng = np.random.default_rng(1)
    n = 400
    track = [(s, i, float(rng.integers(0, 40)), float(rng.integers(0, 40))) for s in (1, 2) for i in range(n)]
    spikes = [(s, u, float(rng.integers(0, n)) / 10) for s in (1, 2) for u in ("a", "b") for _ in range(150)]
    positions = spark.createDataFrame(track, "session int, idx long, x double, y double").repartition(3)
    trains = spark.createDataFrame(spikes, "session int, unit string, t double")
    state = spark.createDataFrame([(1, 0.0, 21.0), (2, 5.0, 35.5)], "session int, start double, stop double")
    axes = {"ix": (F.col("x"), 0.0, 40.0, 4), "iy": (F.col("y"), 0.0, 40.0, 4)}
    kwargs = dict(state=state, width=4.0, sigma=None, min_occupancy=0.0)
    maps, summary = placefield.shuffled_place_field(trains, positions, 10.0, axes, 3, 20, **kwargs)
    plain_maps, plain_summary = placefield.place_field(trains, positions, 10.0, axes, **kwargs)
    got, occ = {}, {}
    for r in maps.collect():
        got.setdefault((r.unit, r.iter), Counter())[r.ix, r.iy] += r.n_spikes
        occ[r.ix, r.iy] = r.occ
    seen = {(s, i): (x, y) for s, i, x, y in track if (s == 1 and i < 210) or (s == 2 and 50 <= i < 355)}
    assert {k: round(v * 10) for k, v in occ.items()} == {k: v for k, v in Counter((int(x // 10), int(y // 10)) for x, y in seen.values()).items() if k in occ}
    kept = Counter(u for s, u, t in spikes if (s, round(t * 10)) in seen)
    assert {k: sum(v.values()) for k, v in got.items()} == {(u, i): kept[u] for u in "ab" for i in (1, 2, 3)}
    # Iterations differ from each other and from what was measured, in which blocks stay where they are.
    real = {u: Counter({(r.ix, r.iy): r.n_spikes for r in plain_maps.where(F.col("unit") == u).collect()}) for u in "ab"}
    assert all(got[u, 1] != got[u, 2] and got[u, 1] != real[u] for u in "ab")
    whole, _ = placefield.shuffled_place_field(trains, positions, 10.0, axes, 1, 10_000, **kwargs)
    assert Counter({(r.unit, r.ix, r.iy): r.n_spikes for r in whole.collect()}) == Counter({(u, *k): v for u in "ab" for k, v in real[u].items()})
    ranks = {r.unit: r for r in placefield.information_rank(plain_summary, summary).collect()}
    info = {(r.unit, r.iter): r.information for r in summary.collect()}
    for r in plain_summary.collect():
        assert ranks[r.unit].n_shuffles == 3 and ranks[r.unit].share == (1 + sum(info[r.unit, i] >= r.information for i in (1, 2, 3))) / 4


def test_patches_over_iterations(spark):
    rows = []
    for it in range(10):
        for x in range(8):
            for y in range(8):
                rate = 10.0 + it if (x, y) == (1, 1) else 9.0 if x <= 2 and y <= 2 else 30.0 if (x, y) == (6, 6) else 0.1
                rows.append(("s", it, "u", x, y, rate))
    maps = spark.createDataFrame(rows, "state string, iter int, unit string, ix int, iy int, rate double")
    peaks = {r.iter: r for r in fields.peak_patches(maps, 8, 8, 0.8).collect()}
    assert len(peaks) == 10 and all(p.area == 9 and p.peak == 10 + it for it, p in peaks.items())
    spread = {r.what: r for r in fields.patch_spread(fields.peak_patches(maps, 8, 8, 0.8), low=0.0, high=1.0).collect()}
    assert (spread["peak"].low, spread["peak"].high, spread["peak"].n, spread["area"].sd) == (10.0, 19.0, 10, 0.0) and abs(spread["com_x"].mean - 1) < 0.05
