"""Sessions from each kind of input by one call, trials of their blocks."""

import pytest

from pulsegrid.operators import recording, sessions

RATE = 100.0


def frames(spark, chunks):
    return spark.createDataFrame([(1, c, f, "m", float(f), 1.0, 0.0) for c, n in chunks for f in range(n)], "session int, chunk long, frame long, marker string, x double, y double, z double")


def found(positions):
    return sorted((r.idx, r.x, r.z) for r in positions.collect())


def test_each_kind_of_input(spark):
    chunks = [(0, 200), (1, 300)]
    want = sorted([(f, float(f) or recording.EPS32, recording.EPS32) for f in range(200)] + [(500 + f, float(f) or recording.EPS32, recording.EPS32) for f in range(300)])
    for start, stop, names in (("0x0040", "0x0000", ["Nlx", "Vicon"]), ("0x0040", "Stopping Recording", ["nlx", "spots"]), ("0x0040", "0x0000", ["ephys", "motive"])):
        marks = spark.createDataFrame([(1, 10.0, f"TTL {start}"), (1, 12.0, stop), (1, 15.0, start), (1, 18.0, stop)], "session int, t double, label string")
        positions, streams = sessions.dispatch(names, events=marks, frames=frames(spark, chunks), rate=RATE)
        assert found(positions) == want and [(round(r.t0, 6), round(r.t1, 6), r.n_chunks) for r in streams.collect()] == [(9.99, 17.99, 2)]
    level = [5.0] * 1000 + [0.0] * 200 + [5.0] * 300 + [0.0] * 300 + [5.0] * 1200
    pulses = spark.createDataFrame([(1, i, v) for i, v in enumerate(level)] + [(2, i, 3.0) for i in range(50)], "session int, idx long, value double")
    for width in (None, 64):
        positions, streams = sessions.dispatch(["OpenEphys", "optitrack"], pulses=pulses, pulse_rate=100.0, frames=frames(spark, chunks), rate=RATE, width=width)
        assert found(positions) == want and streams.count() == 1
    spots = spark.createDataFrame([(1, f, float(f), 2.0, 3.0, 0.0) for f in range(50)], "session int, frame long, x1 double, y1 double, x2 double, y2 double")
    positions, streams = sessions.dispatch(["neuralynx", "whl"], spots=spots, recorded=spark.createDataFrame([(1, 25.0)], "session int, seconds double"))
    assert streams.first().rate == 2.0 and positions.count() == 100 and {r.marker for r in positions.collect()} == {"led_left", "led_right"}
    assert positions.where("idx = 0 AND marker = 'led_left'").first().x == recording.EPS32
    for names in (["nlx"], [], ["vicon"], ["other", "whl"]):
        with pytest.raises(ValueError):
            sessions.dispatch(names)


def test_trials(spark):
    blocks = spark.createDataFrame([(1, 0.0, 10.0), (1, 20.0, 21.0), (1, 30.0, 40.0), (2, 5.0, 9.0)], "session int, start double, stop double")
    listed = lambda df: sorted((r.session, r.start, r.stop) for r in df.collect())
    assert listed(sessions.setup_trial(blocks, (1.0, -1.0))) == [(1, 1.0, 9.0), (1, 31.0, 39.0), (2, 6.0, 8.0)]
    assert listed(sessions.setup_trial(blocks, drop=[0])) == [(1, 20.0, 21.0), (1, 30.0, 40.0)]
    assert listed(sessions.setup_trial(blocks, drop=[0], include=[0, 2])) == [(1, 0.0, 10.0), (1, 30.0, 40.0), (2, 5.0, 9.0)]
    segments = blocks.withColumnsRenamed({"session": "stream", "start": "t0", "stop": "t1"})
    assert sorted((r.stream, r.trial, r.start, r.stop) for r in sessions.whole(segments).collect()) == [(1, "all", 0.0, 40.0), (2, "all", 5.0, 9.0)]
