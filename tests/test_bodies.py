"""Quantiles by cells, relabelled markers, joints, splines and waveforms against plain Python."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pulsegrid.functions import circular
from pulsegrid.operators import behaviour, binning, bodies, fields, models, motion, posture, quantiles, sequence, waveforms
from pulsegrid.sources import tables


@pytest.mark.parametrize("leaf", [0, 5, 10**9])
def test_quantiles(spark, monkeypatch, leaf):
    """Any number of rounds gives the same: ties, one value, infinities, null keys and null values."""
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    monkeypatch.setattr(quantiles, "CELLS", 4)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=301), "b": np.r_[np.zeros(40), rng.exponential(1e6, 21)], None: np.array([3.0]), "d": np.r_[-np.inf, rng.normal(size=8), np.inf], "e": np.full(9, 2.5)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("f", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"low": 0.1, "mid": 0.5, "high": 0.75, "top": 1.0}
    got = {r.k: r for r in quantiles.exact(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        v = np.sort(vs)
        for name, q in shares.items():
            at = q * (len(v) - 1)
            low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            want = low if at % 1 == 0 else low * (1 - at % 1) + high * (at % 1)
            assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)


def test_quantiles_of_all_and_of_none(spark, monkeypatch):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in quantiles.exact(df, [], "v", {"q": 0.25}).collect()] == [(25.0,)]
    assert quantiles.exact(df.where("false"), [], "v", {"q": 0.25}).count() == 0
    keyed = df.withColumn("k", F.col("v") % 5)
    want = {r.k: r.q for r in quantiles.exact(keyed, ["k"], "v", {"q": 0.3}).collect()}
    monkeypatch.setattr(quantiles, "GROUPS", 2)
    assert {r.k: r.q for r in quantiles.exact(keyed, ["k"], "v", {"q": 0.3}).collect()} == pytest.approx(want)
    assert binning.bin_smooth(keyed.where("false"), "v", "v", 0.0, 1.0, 3).count() == 0


def _wide(spark, at, names):
    """at: (session, idx) -> array of markers by x, y, z."""
    rows = [Row(session=s, idx=i, **{n: Row(x=float(p[0]), y=float(p[1]), z=float(p[2])) for n, p in zip(names, m)}, valid=True) for (s, i), m in at.items()]
    return spark.createDataFrame(rows)


def test_relabel(spark):
    names = ["a", "b", "c", "d"]
    rng = np.random.default_rng(2)
    base = np.array([[0, 0, 0], [40, 0, 0], [0, 40, 0], [0, 0, 40]], dtype=float)
    true = {(s, i): base + rng.normal(size=3) * 0.1 + i for s in range(2) for i in range(40)}
    mixed, spans = dict(true), [(0, 5, 12), (0, 12, 15), (1, 20, 39), (1, 0, 4), (0, 30, 31)]
    for s, start, stop in spans:
        for i in range(start, stop):
            mixed[s, i] = true[s, i][rng.permutation(4)]
    periods = spark.createDataFrame(spans, "session long, start long, stop long")
    got = {(r.session, r.idx): np.array([[r[n].x, r[n].y, r[n].z] for n in names]) for r in bodies.relabel(_wide(spark, mixed, names), periods, names, 10).collect()}
    assert set(got) == set(true)
    merged = [(0, 5, 15), (1, 20, 39)]
    want = {k: v.copy() for k, v in mixed.items()}
    for s, start, stop in merged:
        for i in range(start, stop):
            want[s, i] = min((want[s, i][list(p)] for p in permutations(range(4))), key=lambda m: ((m - want[s, i - 1]) ** 2).sum())
    for k, m in got.items():
        assert np.allclose(m, want[k])
        if any(s == k[0] and a <= k[1] < z for s, a, z in merged):
            assert np.allclose(m, true[k])


def test_virtual_joint(spark):
    """A body that turns about a point beside its centre: the point is found."""
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d"]
    shape = np.array([[30, 0, 0], [0, 30, 0], [-30, 0, 0], [0, -30, 0]], dtype=float)
    frames, turn, joint = {}, 0.0, np.array([0.0, 0.0, 50.0])
    for i in range(300):
        turn += rng.normal() * 0.2
        joint[:2] += rng.normal(size=2) * 3
        c, s = np.cos(turn), np.sin(turn)
        spin = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
        frames[0, i] = joint + (shape + [20, 0, 0]) @ spin.T  # the centre is 20 ahead of the joint
    found = posture.basis(_wide(spark, frames, names), names)
    offset = bodies.joint(bodies.joint_costs(found, 40.0, -40, 40, 1.0))
    r = offset.first()
    assert sorted((abs(r.x), abs(r.y))) == pytest.approx([0, 20], abs=3)
    moved = bodies.move_to_joint(found, offset, names).where("idx = 7").first()
    assert np.hypot(moved.hcom.x - sum(frames[0, 7][:, 0]) / 4, moved.hcom.y - sum(frames[0, 7][:, 1]) / 4) == pytest.approx(20, abs=3)
    assert moved.a.x - moved.hcom.x == pytest.approx(frames[0, 7][0, 0] - sum(frames[0, 7][:, 0]) / 4)


def test_spine(spark):
    names = list("abcde")
    rng = np.random.default_rng(4)
    at = {(0, i): np.cumsum(rng.uniform(5, 20, size=(5, 3)), axis=0) for i in range(6)}
    at[0, 5][2] = at[0, 5][1]  # two markers at one place: no curve
    frames = _wide(spark, at, names)
    places = [k / 1000 for k in range(1001)]
    rows = bodies.spine(frames, ["idx"], names, places, equal_length=False).orderBy("idx", "place").toPandas()
    for i in range(5):
        curve = rows[rows.idx == i][["x", "y", "z"]].to_numpy()
        for marker in at[0, i]:  # it passes all markers, and its second derivative is 0 at the ends
            assert np.sqrt(((curve - marker) ** 2).sum(axis=1)).min() < 0.1
        bend = np.abs(np.diff(curve, 2, axis=0)).max(axis=1)
        assert bend[0] < 0.02 * bend.max() and bend[-1] < 0.02 * bend.max()
        assert np.abs(np.diff(bend)).max() < 0.05 * bend.max()
    assert (rows[rows.idx == 5][["x", "y", "z"]] == 0).all(axis=None)
    even = bodies.spine(frames, ["idx"], names, [0, 0.25, 0.5, 0.75, 1], 2000).where("idx < 5").orderBy("idx", "place").toPandas()
    dense = bodies.spine(frames, ["idx"], names, list(np.linspace(0, 1, 2001)), 2000).where("idx = 3").orderBy("place").toPandas()[["x", "y", "z"]].to_numpy()
    steps = np.sqrt((np.diff(dense, axis=0) ** 2).sum(axis=1))
    assert steps.std() < 0.01 * steps.mean()
    assert np.allclose(even[even.idx == 3][["x", "y", "z"]].to_numpy(), dense[[0, 500, 1000, 1500, 2000]], atol=0.05)
    moved = bodies.evened(frames.where("idx = 3"), ["session", "idx"], names, 2000).first()
    assert (moved.a.x, moved.e.z) == (at[0, 3][0, 0], at[0, 3][4, 2]) and moved.c.x == pytest.approx(dense[1000, 0], abs=0.05)


def test_waveforms(spark):
    rng = np.random.default_rng(5)
    shape = np.array([0, 1, -2, -20, -60, -25, 3, 14, 30, 22, 9, 2], dtype=float)
    waves = np.stack([shape * a for a in (0.4, 1.0, 0.7)], axis=-1)[None] + rng.normal(size=(50, 12, 3))
    rows = [(1, s, c, k, float(waves[s, k, c])) for s in range(50) for k in range(12) for c in range(3)]
    rows += [(2, 0, 0, k, float(k)) for k in range(4)] + [(3, 0, 0, k, float(-k)) for k in range(4)]
    got = {r.unit: r for r in waveforms.metrics(spark.createDataFrame(rows, "unit long, spike long, channel long, sample long, value double"), 20_000.0).collect()}
    mean = waves.mean(axis=0)
    r = got[1]
    assert r.channel == 1 and r.amplitude == pytest.approx(np.ptp(mean[:, 1]))
    noise = np.median(np.abs(waves - waves.mean())) / 0.6745
    assert r.snr == pytest.approx(np.ptp(mean[:, 1]) / (2 * noise))
    assert (r.width_ms, r.left_ms, r.right_ms) == pytest.approx((0.2, 0.05, 0.1))
    assert r.symmetry == pytest.approx(2)
    assert (got[2].width_ms, got[2].left_ms, got[2].right_ms) == pytest.approx((0.15, None, 0.05))
    assert got[3].width_ms is None and got[3].symmetry is None


def test_egocentric_maps_by_condition(spark):
    """Smoothing keeps the sums far from the border, and a condition without spikes has no map."""
    track = spark.range(4000).select(F.lit(0).alias("session"), F.col("id").alias("idx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("nose_x"), F.lit(0.0).alias("nose_y"), (F.col("id") % 2).alias("half"))
    spikes = track.where("half = 0").select("session", "idx", F.lit("u").alias("unit"))
    centres = spark.createDataFrame([("u", 3.0, -2.0)], "unit string, cx double, cy double")
    axes = {"ix": (F.col("ahead"), -20.0, 20.0, 40), "iy": (F.col("left"), -20.0, 20.0, 40)}
    raw = fields.egocentric_maps(track, spikes, centres, axes, 10.0, ["half"]).collect()
    assert [(r.unit, r.half, r.ix, r.iy, r.n_spikes, r.occ, r.rate) for r in raw] == [("u", 0, 23, 18, 2000.0, 200.0, 10.0)]
    wide = fields.egocentric_maps(track, spikes, centres, axes, 10.0, ["half"], sigma=1.5)
    assert wide.agg(F.sum("n_spikes")).first()[0] == pytest.approx(2000) and wide.agg(F.min("rate")).first()[0] == pytest.approx(10)


def test_motion_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2)) @ [[3, 1], [0, 0.5]]
    x[17, 0] = np.nan
    rows = spark.createDataFrame([(0, i, float(a), float(c)) for i, (a, c) in enumerate(x)], "session long, idx long, a double, c double").repartition(5)
    full = np.nan_to_num(np.stack([np.concatenate([x[k] if 0 <= k < 200 else np.zeros(2) for k in range(i - 2, i + 2)]) for i in range(200)]))
    made = motion.embedded(rows, ["a", "c"], 4)
    values, vectors = motion.components(motion.gram(made), 3)
    _, sing, vh = np.linalg.svd(full, full_matrices=False)
    assert np.allclose(values, sing[:3])
    got = np.array([r.score for r in motion.scores(made, vectors).orderBy("idx").collect()])
    assert np.allclose(np.abs(got), np.abs(full @ vh[:3].T))
    assert motion.components(motion.gram(made.where("false")))[0].size == 0


def test_mirrored_boxcar(spark):
    x = np.arange(12.0) ** 2
    rows = spark.createDataFrame([(s, i, float(v)) for s in (0, 1) for i, v in enumerate(x)], "session long, idx long, value double")
    for width in (1, 4, 5):
        left = width // 2
        wide = np.pad(x, (left, width - 1 - left), mode="symmetric")
        want = [wide[i : i + width].mean() for i in range(len(x))]
        assert [r.smooth for r in sequence.boxcar_mirrored(rows, width).where("session = 1").orderBy("idx").collect()] == pytest.approx(want)


def test_band_periods(spark):
    """A tone in the middle third of the signal is found there, and nowhere in a constant one."""
    rng = np.random.default_rng(7)
    t = np.arange(3000) / 100
    x = rng.normal(size=3000) * 0.1 + np.where((t > 10) & (t < 20), np.sin(2 * np.pi * 15 * t), 0)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)] + [(1, i, 2.0) for i in range(500)], "session long, idx long, value double")
    found = behaviour.band_periods(rows, 100.0, (14.0, 16.0), 1e-4, 64, 256).collect()
    assert len(found) == 1 and found[0].session == 0
    assert found[0].t_first == pytest.approx(10, abs=0.6) and found[0].t_last == pytest.approx(20, abs=0.6)


def test_von_mises_draws(spark):
    for kappa in (0.0, 0.5, 4.0, 60.0):
        df = spark.range(20_000).select(circular.random_von_mises(F.col("id"), F.lit(3.0), F.lit(kappa)).alias("x"))
        r = df.agg(F.avg(F.cos("x")).alias("c"), F.avg(F.sin("x")).alias("s"), F.count("x").alias("n"), F.count_distinct("x").alias("d")).first()
        angle = np.linspace(-np.pi, np.pi, 20_001)
        density = np.exp(kappa * (np.cos(angle) - 1))
        want = (np.cos(angle) * density).sum() / density.sum()
        assert (r.n, r.d) == (20_000, 20_000)
        assert np.hypot(r.c, r.s) == pytest.approx(want, abs=0.02)
        assert kappa == 0 or abs(np.angle(np.exp(1j * (np.arctan2(r.s, r.c) - 3)))) < 0.05


def test_saved_ensemble_and_tables(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 3 + F.col("id") / 100).alias("f"))
    made = models.train_ensemble(rows, ["f"], "label", "logistic", 2)
    models.save_ensemble(spark, made, f"file://{tmp_path}/m")
    read = models.load_ensemble(spark, f"file://{tmp_path}/m")
    assert len(read) == 2
    both = [models.predict_ensemble(m, rows).orderBy("f").collect() for m in (made, read)]
    assert both[0] == both[1]
    root = f"file://{tmp_path}/tables"
    tables.save(spark.createDataFrame([("007", 1.0), ("b", 2.0)], "session string, t double"), root, "spikes")
    tables.save(spark.createDataFrame([("b", 3.0)], "session string, t double"), root, "spikes")
    got = tables.load(spark, root, "spikes", ["007", "b"], "t double, session string")
    assert sorted((r.session, r.t) for r in got.collect()) == [("007", 1.0), ("b", 3.0)]
    tables.save(spark.createDataFrame([("x", 3.0)], "session string, t double"), root, "states")
    asked = spark.createDataFrame([("b",), ("x",)], "session string")
    assert sorted(tuple(r) for r in tables.lacking(spark, root, ["spikes", "states"], asked).collect()) == [("b", "states"), ("x", "spikes")]
