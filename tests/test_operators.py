"""Operators on small hand-made cases, and kernels on planted signals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.operators import filters, intervals, models, sequence, signal, spikes, states, stats
from pulsegrid.plans import stateql
from pulsegrid.sources import records, text_files
from pulsegrid.streaming import online


def periods(spark, *rows, session=0):
    return spark.createDataFrame([(session, float(a), float(b)) for a, b in rows], "session int, start double, stop double")


def listed(df):
    return sorted((r.start, r.stop) for r in df.collect())


def test_period_algebra(spark):
    walk, rear = periods(spark, (1, 3), (5, 8)), periods(spark, (2, 6))
    assert listed(intervals.intersect(walk, rear)) == [(2, 3), (5, 6)]
    assert listed(intervals.union(walk, rear)) == [(1, 8)]
    assert listed(intervals.subtract(walk, rear)) == [(1, 2), (6, 8)]
    assert intervals.duration(walk).first().duration == 5
    assert listed(intervals.union(periods(spark, (0, 5), (10, 15)), periods(spark, (3, 7), (20, 25)))) == [(0, 7), (10, 15), (20, 25)]
    assert listed(intervals.coalesce(periods(spark, (0, 5), (5, 10), (12, 12)))) == [(0, 10)]
    assert listed(intervals.fill_gaps(periods(spark, (0, 1), (1.5, 2), (3, 4)), 1.0)) == [(0, 2), (3, 4)]
    assert listed(intervals.complement(walk, periods(spark, (0, 10)))) == [(0, 1), (3, 5), (8, 10)]
    assert listed(intervals.subtract(walk, walk)) == [] and listed(intervals.intersect(walk, periods(spark))) == []
    assert listed(intervals.to_samples(periods(spark, (0.05, 0.25)), 10)) == [(0, 2)]


def test_masks(spark):
    ranges = spark.createDataFrame([(0, 2, 5), (0, 4, 6), (0, 9, 10)], "session int, start long, stop long")
    mask = intervals.to_mask(ranges)
    assert sorted(r.idx for r in mask.collect()) == [2, 3, 4, 5, 9]
    assert listed(intervals.from_mask(mask)) == [(2, 6), (9, 10)]


def test_crossings_and_pulses(spark):
    values = [0] * 20 + [2] * 40 + [0] * 40 + [2] * 50 + [0] * 50
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "session int, idx long, value double")
    assert listed(sequence.pulses(rows, 1.0)) == [(20, 60), (100, 150)]
    assert sorted((r.left, r.right) for r in sequence.crossings(rows, 1.0).collect()) == [(19, 59), (99, 149)]


def test_state_expressions(spark):
    rows = [(0, "walk", "w", 1.0, 3.0), (0, "walk", "w", 5.0, 8.0), (0, "rear", "r", 2.0, 6.0), (0, "theta", "t", 0.0, 5.5)]
    collection = spark.createDataFrame(rows, "session int, label string, key string, start double, stop double")
    assert listed(stateql.query(collection, "walk&rear")) == [(2, 3), (5, 6)]
    assert listed(stateql.query(collection, "w - r")) == [(1, 2), (6, 8)]
    assert listed(stateql.query(collection, "walk | rear & theta")) == [(1, 5.5)]
    with pytest.raises(ValueError):
        stateql.query(collection, "walk &")


def greedy_transitions(a, b, window):
    """Starts used by the stops of a, taken in order."""
    out, j = [], 0
    for stop in sorted(x for _, x in a):
        while j < len(b) and b[j] <= stop:
            j += 1
        if j < len(b) and b[j] - stop <= window:
            out.append(b[j])
            j += 1
    return out


def test_transitions(spark):
    rng = random.Random(5)
    cases = [([(0, 10), (12, 20)], [30, 38], 30), ([(0, 10.0), (11, 11.5)], [12.0, 12.0, 13.25], 2.0), ([(0, 5)], [5, 5.5], 0.5), ([], [3], 1), ([(0, 3)], [], 1)]
    for n in range(40):
        stops = sorted(rng.randint(0, 40) for _ in range(rng.randint(1, 14)))
        cases.append(([(x - 1, x) for x in stops], sorted(rng.randint(0, 45) for _ in range(rng.randint(1, 14))), rng.choice([1, 3, 8, 20])))
    a = [(i, float(x), float(y)) for i, (periods, _, _) in enumerate(cases) for x, y in periods]
    b = [(i, float(x), float(x) + 1) for i, (_, starts, _) in enumerate(cases) for x in starts]
    frames = [spark.createDataFrame(rows, "session int, start double, stop double") for rows in (a, b)]
    for window in sorted({w for _, _, w in cases}):
        got = {}
        for r in states.transitions(*frames, window).collect():
            got.setdefault(r.session, []).append(r.start + window)
        for i, (periods, starts, w) in enumerate(cases):
            if w == window:
                assert sorted(got.get(i, [])) == greedy_transitions(periods, starts, w), cases[i]
    found = {(r.session, r.stop): r.next_start for r in states.next_starts(*frames, 2.0).collect()}
    assert found[1, 10.0] == 12.0 and found[1, 11.5] == 12.0 and found[2, 5.0] == 5.5


def test_fdr_with_nulls(spark):
    rows = spark.createDataFrame([("g", 0.01), ("g", None), ("g", 0.02), ("g", 0.03), ("g", None), ("h", None)], "g string, p double")
    for dependent, factor in ((False, 1), (True, 1 + 1 / 2 + 1 / 3)):
        got = stats.fdr(rows, "p", ["g"], dependent=dependent).collect()
        assert all((r.adjusted is None and not r.rejected) if r.p is None else abs(r.adjusted - 0.03 * factor) < 1e-12 for r in got) and len(got) == 6


def test_complement_of_all_time(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 10, 15), (2, 3, 4)], "session int, start int, stop int")
    got = {tuple(r) for r in intervals.complement(rows).collect()}
    assert got == {(1, None, 0), (1, 7, 10), (1, 15, None), (2, None, 3), (2, 4, None)}


def test_expression_with_keys(spark):
    rows = [(1, "walk", "w", 0, 10), (1, "walk", "w", 20, 30), (1, "rear", "r", 5, 25), (1, "w", "q", 8, 9), (2, "walk", "w", 0, 1)]
    c = spark.createDataFrame(rows, "session int, label string, key string, start int, stop int")
    found = lambda e: sorted(tuple(r) for r in stateql.query(c, e).collect())
    assert found("walk & r") == [(1, 5, 10), (1, 20, 25)] and found("walk - r") == [(1, 0, 5), (1, 25, 30), (2, 0, 1)]
    assert found("w") == [(1, 8, 9)] and found("walk & r - w") == [(1, 5, 8), (1, 9, 10), (1, 20, 25)] and found("none | q") == [(1, 8, 9)]
    assert {tuple(r) for r in states.get(c, "w").collect()} == {(1, 8, 9)} and states.get(c, "r").count() == 1



def test_correlogram_against_brute_force(spark):
    rng = np.random.default_rng(0)
    t, g = np.sort(rng.integers(0, 200_000, 200)), rng.integers(0, 3, 200)
    rows = spark.createDataFrame([(0, i, int(u), int(x)) for i, (x, u) in enumerate(zip(t, g))], "session int, spike_id int, unit int, t long")
    got = {(r.g1, r.g2, r.bin): r.n for r in spikes.correlogram(rows, 20, 25).collect()}
    want = {}
    for i in range(200):
        for j in range(200):
            lag = int(t[j] - t[i])
            if i != j and -510 <= lag < 510:
                key = (int(g[i]), int(g[j]), int(np.floor(0.5 + lag / 20)))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_global_ids(spark):
    units = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 2), (2, 3)], "shank int, local int")
    assert sorted((r.shank, r.local, r.unit) for r in spikes.global_ids(units).collect()) == [(1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 2, 7), (2, 3, 8)]


def test_filters(spark):
    rate, n = 200.0, 2000
    t = np.arange(n) / rate
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 40 * t)
    low = signal.zero_phase(slow + fast, signal.butter(4, 10.0, rate), rate)
    assert np.abs(low - slow)[200:-200].max() < 0.02
    band = signal.zero_phase(slow + fast, signal.butter(3, (30.0, 50.0), rate, "bandpass"), rate)
    assert np.abs(band - fast)[200:-200].max() < 0.05
    response = np.abs(signal.frequency_response(signal.butter(4, 10.0, rate), np.array([0.0, 10.0, 80.0]), rate))
    assert np.allclose(response[:2], [1, np.sqrt(0.5)], atol=1e-6) and response[2] < 1e-3
    rows = spark.createDataFrame([(c, i, float(v)) for c in (0, 1) for i, v in enumerate(slow + c * fast)], "channel int, idx long, value double")
    got = signal.filtered(rows, 10.0, rate, ["channel"]).where("channel = 1").orderBy("idx").toPandas().value.to_numpy()
    # The ends are extended as far as the filter's order asks for; away from them it is the squared response.
    assert np.allclose(got, filters.both_ways(slow + fast, filters.sections(signal.butter(4, 10.0, rate)))) and np.abs(got - low)[200:-200].max() < 1e-5
    angle = signal.phase(rows, (1.0, 4.0), rate, ["channel"], 2).where("channel = 0").orderBy("idx").toPandas().phase.to_numpy()
    assert np.abs(np.angle(np.exp(1j * (angle - (2 * np.pi * 2 * t - np.pi / 2)))))[300:-300].max() < 0.1
    spectrum = signal.spectrogram(rows.where("channel = 1"), rate, ["channel"], 256, 128).groupBy("freq").agg(F.avg("power").alias("p")).orderBy(F.desc("p")).limit(2).collect()
    assert any(abs(r.freq - 40) < 2 for r in signal.spectrogram(rows.where("channel = 1"), rate, ["channel"]).where("freq > 20").groupBy("freq").agg(F.avg("power").alias("p")).orderBy(F.desc("p")).limit(1).collect()) and spectrum
    half = signal.resampled(rows.where("channel = 0"), rate, 100.0, ["channel"]).orderBy("idx").toPandas().value.to_numpy()
    assert len(half) == n // 2 and np.abs(half - slow[::2])[50:-50].max() < 0.02


def test_slepian():
    tapers = signal.slepian(128, 3.0, 5)
    assert np.allclose(tapers @ tapers.T, np.eye(5), atol=1e-8)
    assert np.abs(np.fft.fft(tapers[0], 4096))[:150].max() > 100 * np.abs(np.fft.fft(tapers[0], 4096))[400:2048].max()


def test_hmm(spark):
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 80)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(truth * 3 + rng.normal(0, 0.5, 320))], "session int, idx long, value double")
    got = models.hmm_states(rows, 2).orderBy("idx").toPandas().state.to_numpy()
    assert (got == truth).mean() > 0.98


def test_ensemble(spark):
    rng = np.random.default_rng(2)
    y = np.repeat([0, 1, 2], 100)
    x = np.array([[0, 0], [3, 0], [0, 3]])[y] + rng.normal(0, 0.4, (300, 2))
    rows = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y)], "f0 double, f1 double, label int")
    for backend in ("forest", "logistic"):
        found = models.predict_ensemble(models.train_ensemble(rows, ["f0", "f1"], "label", backend, 2), rows)
        assert found.where("prediction = label").count() > 285
        assert all(abs(sum(r.probability) - 1) < 1e-6 for r in found.limit(20).collect())


def test_record_files(spark, tmp_path):
    np.arange(40, dtype="<i2").tofile(tmp_path / "a.dat")
    got = records.read_samples(spark, str(tmp_path / "a.dat"), 4, channels=[0, 2], ranges=[(2, 4), (9, 10)]).orderBy("idx", "channel").collect()
    assert [(r.idx, r.channel, r.value) for r in got] == [(i, c, i * 4 + c) for i in (2, 3, 9) for c in (0, 2)]
    scaled = records.read_samples(spark, str(tmp_path / "a.dat"), 4, scale=0.5).where("idx = 1 AND channel = 3").first()
    assert scaled.value == 3.5
    np.array([100, 200, 300, 400, 500], "<i8").tofile(tmp_path / "s.res.1")
    np.array([2, 2, 2, 3, 3, 1], "<i4").tofile(tmp_path / "s.clu.1")
    assert sorted((r["sample"], r.local) for r in records.read_spikes(spark, str(tmp_path / "s"), [1]).collect()) == [(100, 2), (200, 2), (300, 3), (400, 3)]
    rows = spark.createDataFrame([("b.clu.1", i, [v]) for i, v in enumerate([2, 2, 3])] + [("b.clu.2", 0, [5])], "file string, idx int, values array<int>")
    made = records.write_records(rows, str(tmp_path), "clusters", header="distinct")
    assert {(r.file, r.n) for r in made.collect()} == {("b.clu.1", 3), ("b.clu.2", 1)}
    assert np.fromfile(tmp_path / "b.clu.1", "<i4").tolist() == [2, 2, 2, 3]
    with pytest.raises(Exception):
        records.write_records(rows, str(tmp_path), "clusters", header="distinct")
    np.array([3], "<i4").tofile(tmp_path / "f.fet")
    with open(tmp_path / "f.fet", "ab") as f:
        np.arange(6, dtype="<i8").tofile(f)
    assert [r["values"] for r in records.read_records(spark, str(tmp_path / "f.fet"), "features").orderBy("idx").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_text_files(spark, tmp_path):
    (tmp_path / "e.evt").write_text("# times\n100 Stim on\n200 Stim off\n\nnonsense\n300 Stim on\n400 Stim off\n")
    assert [(r.t, r.label) for r in text_files.read_events(spark, str(tmp_path / "e.evt"), "on", seconds=True).orderBy("t").collect()] == [(0.1, "Stim on"), (0.3, "Stim on")]
    (tmp_path / "p.txt").write_text("1 2\n# no\n3 4.5\n")
    assert listed(text_files.read_periods(spark, str(tmp_path / "p.txt"))) == [(1, 2), (3, 4.5)]
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    with pytest.raises(Exception):
        text_files.read_periods(spark, str(tmp_path / "bad.txt")).collect()
    name = spark.createDataFrame([("labA-ab-000005-20120312",), ("x-1",)], "n string").select(text.parse_session_name(F.col("n")).alias("p")).collect()
    assert tuple(name[0].p) == ("labA", "ab", "000005", "20120312") and name[1].p is None


def test_streaming(spark, sf_dir, tmp_path):
    source = f"{sf_dir}/events*.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("unit"))
    got = online.run_to_end(online.rates(stream, "1 day", "2 days"), f"{tmp_path}/rates", f"{tmp_path}/c1", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()
    values = [(0, i, float(v)) for i, v in enumerate([0, 2, 2, 0, 0, 3, 0])] + [(1, 0, 5.0), (1, 1, 0.0)]
    spark.createDataFrame(values, "session int, idx long, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session int, idx long, value double").parquet(f"{tmp_path}/in")
    found = online.run_to_end(online.crossings(stream, 1.0), f"{tmp_path}/out", f"{tmp_path}/c2")
    assert sorted((r.session, r.start, r.stop) for r in found.collect()) == [(0, 1, 3), (0, 5, 6), (1, 0, 1)]


def test_more_filters(spark):
    rate, n = 200.0, 2048
    t = np.arange(n) / rate
    x = np.sin(2 * np.pi * 10 * t)
    noise = np.random.default_rng(0).normal(0, 0.3, n)
    rows = spark.createDataFrame([(0, i, c, float(v)) for i in range(n) for c, v in ((0, x[i]), (1, np.sin(2 * np.pi * 10 * t[i] - 1.0) + noise[i]))], "session int, idx long, ch int, value double")
    found = {round(r.freq, 3): r for r in signal.coherence(rows, rate, ["session"]).collect()}
    best = min(found, key=lambda f: abs(f - 10))
    assert found[best].coherence > 0.9 and abs(abs(found[best].phase) - 1.0) < 0.1
    one = rows.where("ch = 0").drop("ch")
    for made in (signal.gaussian(one, 1.0, ["session"]), signal.boxcars(one, 3, 2, ["session"]), signal.fir(one, 31, 40.0, rate, ["session"])):
        y = made.orderBy("idx").toPandas().value.to_numpy()
        assert len(y) == n and np.corrcoef(x[100:-100], y[100:-100])[0, 1] > 0.999
    peak = signal.spectrum(one, rate, ["session"]).orderBy(F.desc("power")).first()
    assert abs(peak.freq - 10) < 2


def test_circular_extras(spark):
    from pulsegrid.functions import circular

    rng = np.random.default_rng(4)
    x = rng.vonmises(2.0, 4.0, 4000)
    rows = spark.createDataFrame([(0, float(v)) for v in x], "g int, a double")
    got = rows.groupBy("g").agg(circular.kappa(F.col("a")).alias("k")).first().k
    assert abs(got - 4) < 0.4
    assert abs(circular.median(rows, "a", ["g"]).first().median - 2.0) < 0.1
    density = spark.createDataFrame([(float(v),) for v in np.linspace(-np.pi, np.pi, 721)[:-1]], "a double").agg(F.sum(circular.von_mises(F.col("a"), F.lit(0.5), F.lit(3.0))).alias("s")).first().s
    assert abs(density * 2 * np.pi / 720 - 1) < 1e-6


def test_read_catalogue(spark, tmp_path):
    doc = '{"subjects": {"s1": {"strain": "x", "maze": "open"}}, "lists": {"a": [{"session": "n1", "subject": "s1", "maze": null, "trial": "all"}, {"session": "n2", "maze": "line", "order": 3}]}}'
    (tmp_path / "c.json").write_text(doc)
    rows = {r.session: r for r in text_files.read_catalogue(spark, str(tmp_path / "c.json")).collect()}
    assert (rows["n1"].position, rows["n1"].maze, rows["n1"].trial, rows["n1"].subject) == (0, "open", "all", "s1") and rows["n1"].fields["strain"] == "x"
    assert (rows["n2"].list, rows["n2"].maze, rows["n2"].trial, rows["n2"].subject) == ("a", "line", None, None) and rows["n2"].fields["order"] == "3"
