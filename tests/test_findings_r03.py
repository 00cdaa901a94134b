"""Cases of the third round's findings."""

import time
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid import session
from pulsegrid.operators import assignment, behaviour, bodies, chunks, features, hmm, intervals, rangejoin, recording, sequence, spikes, states, stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_harmonic_numbers_take_bounded_steps(spark):
    """the factor of dependent tests isn't added up term by term for each row."""
    sizes = [1, 2, 31, 32, 33, 100, 5000]
    got = [r.h for r in spark.createDataFrame([(m,) for m in sizes], "m long").select(stats.harmonic(F.col("m")).alias("h")).collect()]
    assert np.allclose(got, [np.sum(1 / np.arange(1, m + 1)) for m in sizes], rtol=1e-14, atol=0)
    assert abs(spark.range(1).select(stats.harmonic(F.lit(10**12)).alias("h")).first().h - 28.208236780830847) < 1e-12
    rows = spark.range(40_000).select(F.lit(0).alias("g"), (F.col("id") * 7919 % 40_009 / 4e7 + 1e-7).alias("p"))
    found = stats.fdr(rows, "p", ["g"], dependent=True).toPandas().sort_values("p")
    raw = found.p.to_numpy() * 40_000 * np.sum(1 / np.arange(1, 40_001)) / np.arange(1, 40_001)
    assert np.allclose(found.adjusted, np.minimum.accumulate(raw[::-1])[::-1], rtol=1e-12)


def test_gaps_are_filled_without_open_frames(spark):
    """no frame is added up anew for each row."""
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None, None, None, 7.0, None])], "session int, idx long, value double")
    found = behaviour.fill_linear(rows, 1)
    assert "unboundedfollowing" not in plan(found).lower()
    assert [r.value for r in found.orderBy("idx").collect()] == [None, 1.0, 2.0, 3.0, None, None, None, 7.0, None]


def test_empty_periods_inside_others_meet_them(spark):
    """as in the SQL, a period without length that lies inside of another one has an overlap; one at its ends has none."""
    a = spark.createDataFrame([(0, 5, 5), (0, 0, 0), (0, 10, 10), (0, 8, 12), (0, 7, 6), (0, None, 3)], "session int, start long, stop long")
    b = spark.createDataFrame([(0, 0, 10)], "session int, start long, stop long")
    want = {(5, 5), (8, 10), (7, 6)}
    for width in (1, 3, 100):
        found = intervals.intersect_pairs(a, b, width).collect()
        assert len(found) == 3 and {(r.start, r.stop) for r in found} == want
        assert {(r.start, r.stop) for r in intervals.intersect_pairs(b, a, width).collect()} == want


def test_transitions_of_dense_periods_are_one_pass(spark):
    """Stops that all lie near each other make one stretch of a session; it is gone through once, in time that grows with its rows."""
    n = 60_000
    a = spark.range(n).select(F.lit(0).alias("session"), (F.col("id") * 3 - 5).alias("start"), (F.col("id") * 3).alias("stop"))
    b = spark.range(n).select(F.lit(0).alias("session"), (F.col("id") * 3 + 1).alias("start"), (F.col("id") * 3 + 2).alias("stop"))
    begun = time.perf_counter()
    found = states.transitions(a, b, 10).toPandas()
    assert time.perf_counter() - begun < 60
    assert found.dtypes.astype(str).to_dict() == {"session": "int32", "start": "int64", "stop": "int64"}
    assert sorted(found.start) == [3 * i - 9 for i in range(n)]


def test_correlograms_count_without_pairs(spark):
    """spikes at the same times, repeated keys and fractions of a bin are counted as by listing pairs, and no pair is listed."""
    rng = np.random.default_rng(3)
    rows = [(int(s), int(k), str(u), float(t)) for s, k, u, t in zip(rng.integers(0, 2, 400), rng.integers(0, 350, 400), rng.choice(list("abc"), 400), np.round(rng.uniform(-30, 30, 400), 1))]
    got = spikes.correlogram(spark.createDataFrame(rows, "session int, spike_id long, unit string, t double"), 0.3, 4).collect()
    want = Counter()
    for s, k, u, t in rows:
        for s2, k2, u2, t2 in rows:
            at = int(np.floor(0.5 + (t2 - t) / 0.3))
            if s == s2 and k != k2 and -1.35 <= t2 - t < 1.35 and abs(at) <= 4:
                want[s, u, u2, at] += 1
    assert {(r.session, r.g1, r.g2, r.bin): r.n for r in got} == want
    many = spark.range(200_000).select(F.lit(0).alias("session"), F.col("id").alias("spike_id"), F.lit("a").alias("unit"), (F.col("id") % 5).alias("t"))
    found = {r.bin: r.n for r in spikes.correlogram(many, 2, 1).collect()}
    assert found == {-1: 40_000**2 * (2 + 3), 0: 40_000**2 * (5 + 4) - 200_000, 1: 40_000**2 * (4 + 3)}


def test_many_windows_are_matched_in_one_pass(spark):
    """chunks take the first unused window of their length, as by trying all; tens of thousands in a session are no matter."""
    rng = np.random.default_rng(5)
    for tolerance in (0.2, 0.5, 1.5, 3.0, 0.0):
        for _ in range(60):
            lengths, wanted = rng.integers(1, 60, 40) / 10 * rng.choice([1, 5]), rng.integers(1, 30, 40) / 5
            used, want = set(), []
            for x in wanted:
                free = [i for i in range(len(lengths)) if i not in used and abs(lengths[i] - x) < tolerance]
                want.append(free[0] if free else -1)
                used.update(free[:1])
            assert recording.first_unused(lengths, wanted, tolerance).tolist() == want
    assert recording.first_unused(np.zeros(0), np.ones(2), 1.0).tolist() == [-1, -1]
    n = 40_000
    windows = spark.range(n).select(F.lit(0).alias("session"), (F.col("id") * 100.0).alias("start"), (F.col("id") * 100.0 + 1 + F.col("id") % 7).alias("stop"))
    chunks = spark.range(n).select(F.lit(0).alias("session"), F.col("id").alias("chunk"), ((1 + F.col("id") % 7) * 10).alias("n_frames"))
    begun = time.perf_counter()
    found = recording.match_chunks(chunks, windows, 10.0).toPandas()
    assert time.perf_counter() - begun < 60
    assert len(found) == n and np.allclose(found.start, found.chunk * 100 - 0.1)


def test_draws_from_samples_of_overlapping_periods(spark):
    """a sample in several periods of a label counts as often, and neither a pair nor a label is put in one task."""
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(int(s), i, int(t)) for i, (s, t) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 400, 300)))], "session int, idx long, t long")
    starts = rng.integers(0, 400, 200)
    periods = spark.createDataFrame([(int(s), str(x), int(a), int(a + d)) for s, x, a, d in zip(rng.integers(0, 2, 200), rng.choice(["u", "v"], 200), starts, rng.integers(-3, 90, 200))], "session int, label string, start long, stop long")
    pairs = rangejoin.points_in_periods(points, periods, 30).select("session", "idx", "t", "label")
    want = Counter(tuple(r) for r in pairs.collect())
    for width in (None, 50):
        counted = intervals.label_counts(points, periods, ["u", "v"], width=width)
        assert {(r.session, r.idx, r.t, r.label): r.n for r in counted.collect()} == want
    number = {}
    for r in pairs.withColumn("h", F.xxhash64("session", "idx", F.lit(0))).orderBy("label", "h", "session", "idx").collect():
        number.setdefault(r.label, []).append(r.idx)
    draws = spark.createDataFrame([(x, i) for x in "uv" for i in range(1, 41)], "label string, draw int").withColumn("k", F.xxhash64("label", "draw", F.lit(0))).collect()
    expected = {(r.label, r.draw): number[r.label][r.k % len(number[r.label])] for r in draws}
    for rows, times in ((pairs, None), (counted, "n")):
        got = features.balanced(rows, "label", 40, times=times)
        assert sorted(got.columns) == ["draw", "idx", "label", "session", "t"]
        assert {(r.label, r.draw): r.idx for r in got.collect()} == expected


def test_chunks_are_given_out_a_few_at_a_time(spark):
    """what is made of a batch of chunks isn't held as a whole, and batches have a limit of bytes."""
    session.ship(spark)
    assert int(spark.conf.get(session.BATCH_BYTES).rstrip("b")) <= 1 << 24
    seen = []

    class Frame:
        def mapInPandas(self, run, schema):
            for out in run(iter([pd.DataFrame({"k": range(64), "v": [np.zeros(8192)] * 64})])):
                seen.append(len(out))

    chunks.each(Frame(), lambda row: {"w": row["v"] + 1}, "k long, w array<double>")
    assert sum(seen) == 64 and max(seen) <= 4


def test_short_sessions_are_fitted_together():
    """sessions of one chunk share their steps; models, rounds and paths are those of each alone."""
    rng = np.random.default_rng(3)
    for d, k, kind in ((1, 2, "full"), (2, 3, "diag"), (2, 2, "tied"), (2, 3, "spherical"), (1, 1, "full")):
        sizes = [max(2 * k, n) for n in (1, 5, 9, 40, 70, 300)]
        xs = [rng.normal(size=(n, d)) + 3 * np.repeat(rng.integers(0, k, n // 5 + 1), 5)[:n, None] for n in sizes]
        for update in (True, False):
            many = hmm._Many(xs, k, kind)
            found, like, rounds = many.fit(30, 1e-2, update)
            for x, flat, a, n, path in zip(xs, zip(*found), like, rounds, many.paths(found)):
                model, b, m = hmm.fit_local(x, k, kind, 30, 1e-2, update)
                assert n == m and np.isclose(a, b) and np.allclose(hmm.Model(*flat).flat(), model.flat(), rtol=1e-6, atol=1e-9)
                assert (path == hmm.path_local(model, x)).all()
    assert [sorted(g) for g in hmm._together([5, hmm.AT_ONCE, 4])] == [[1], [0, 2]]


def test_short_sessions_are_dealt_over_tasks(spark):
    """few bytes of sessions aren't the work of one task."""
    rows = spark.range(12_000).select((F.col("id") % 400).alias("session"), F.col("id").alias("idx"), F.log1p(F.hash("id") % 97 + 97).alias("value"))
    seen, before = [], hmm.save

    def watched(df):
        seen.append(plan(df))
        return before(df)

    hmm.save = watched
    try:
        states_, models = hmm.gauss_hmm(rows, 2)
    finally:
        hmm.save = before
    assert any("MapInPandas" in p and "REPARTITION_BY_NUM" in p for p in seen)
    assert states_.count() == 12_000 and models.count() == 400


def test_periods_are_dealt_together(spark):
    """many assignments at once are those of each alone, ties included; a period of its anchor alone stays as it is."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 7):
        costs = rng.random((300, n, n))
        costs[::3], costs[1::5] = np.round(costs[::3] * 4), 0
        assert (assignment.assign_many(costs) == np.stack([assignment.assign(c) for c in costs])).all()
    rows, want = [], {}
    for s in range(3):
        at = rng.normal(size=(2, 3)) * 50
        for i in range(40):
            at = at + rng.normal(size=(2, 3)) * 0.1
            given = at[::-1] if i % 8 in (3, 4) else at
            want[s, i] = at.copy()
            rows.append((s, i, *[tuple(map(float, p)) for p in given]))
    point = "struct<x:double,y:double,z:double>"
    frames = spark.createDataFrame(rows, f"session int, idx long, a {point}, b {point}")
    spans = spark.createDataFrame([(s, start, stop) for s in range(3) for start, stop in ((1, 8), (9, 16), (18, 24), (26, 32), (34, 38), (40, 60))], "session int, start long, stop long")
    found = bodies.relabel(frames, spans, "ab", 8)
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert {(r.session, r.idx): np.array([r.a, r.b]).tolist() for r in found.collect()} == {k: v.tolist() for k, v in want.items()}


def test_behaviour_by_buckets(spark):
    """buckets with side rows give the periods that windows over whole sessions give, and no window holds a session."""
    rng = np.random.default_rng(5)
    rows = [(s, i, *map(float, rng.integers(0, 9, 3))) for s, n in ((0, 1), (1, 2), (2, 7), (3, 300)) for i in range(n)]
    track = spark.createDataFrame(rows, "session int, idx long, x double, y double, head_z double")
    listed = lambda df: sorted(map(tuple, df.collect()))
    want = listed(behaviour.basic_states(track, 15.0, 75.0, 1.25, 0.2, 0.1, 0.2))
    moved = listed(behaviour.moving(track, 5.0, 10.0, 2, 3))
    assert len(want) > 20 and len(moved) > 5
    for width in (4, 7, 1000):
        assert listed(behaviour.basic_states(track, 15.0, 75.0, 1.25, 0.2, 0.1, 0.2, width=width)) == want
        assert listed(behaviour.moving(track, 5.0, 10.0, 2, 3, width=width)) == moved
    for n in (1, 2, 3, 4, 5):
        whole = {(r.session, r.idx): r.smooth for r in sequence.boxcar_mirrored(track, n, value="x").where("session = 3").collect()}
        parts = {(r.session, r.idx): r.smooth for r in sequence.boxcar_mirrored(track, n, value="x", bucket=5).where("session = 3").collect()}
        assert whole.keys() == parts.keys() and all(np.isclose(whole[k], parts[k]) for k in whole)
    smooth = plan(sequence.boxcar_mirrored(track, 3, value="x", bucket=5))
    assert "_part" in smooth and "hashpartitioning(session#" not in smooth.split("Window")[-1].split("Exchange")[0]
