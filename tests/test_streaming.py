"""Streams with late, mixed and replayed batches against the same work on whole tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.streaming import online

START = dt.datetime(2024, 1, 1)


def feed(spark, folder, schema, batches):
    """A stream that reads one batch a file, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    for i in range(len(batches)):  # the order of files is that of their times
        import os

        for name in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_crossings_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    values = {s: [rng.choice([0.0, 2.0]) for _ in range(60)] for s in (1, 2)}
    values[2][-1] = 2.0
    rows = sorted(((s, i, v, at(10 * i)) for s, x in values.items() for i, v in enumerate(x)), key=lambda r: r[1] + rng.uniform(0, 4))
    batches = [rows[k : k + 17] for k in range(0, len(rows), 17)]
    # Rows that come when the watermark is past them, and one far ahead in a session of its own.
    batches += [[(9, 0, 0.0, at(10_000))], [(1, 3, 99.0, at(30)), (9, 1, 0.0, at(20_000))]]
    stream = feed(spark, f"{tmp_path}/in", "session long, idx long, value double, ts timestamp", batches)
    found = online.run_to_end(online.crossings_by_time(stream, 1.0, "60 seconds", 5_000), f"{tmp_path}/out", f"{tmp_path}/state").where("session < 9")
    want = []
    for s, x in values.items():
        first = None
        for i, v in enumerate(x):
            if v > 1 and first is None:
                first = i
            if v <= 1 and first is not None:
                want.append((s, first, i, True))
                first = None
        if first is not None:
            want.append((s, first, len(x), False))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_mark_pairs(spark, tmp_path):
    marks = [(1, 5, "stop"), (1, 10, "start a"), (1, 20, "stop"), (1, 20, "start b"), (1, 25, "start c"), (1, 30, "stop"), (1, 40, "stop"), (1, 41, "other"), (1, 50, "start d"), (2, 7, "start"), (2, 7, "stop")]
    rows = [(s, m, at(t)) for s, t, m in marks]
    stream = feed(spark, f"{tmp_path}/in", "session long, label string, ts timestamp", [rows[::2], rows[1::2], [(9, "x", at(5_000))], [(9, None, at(6_000))]])
    found = online.run_to_end(online.mark_pairs(stream, "start", "stop", "100 seconds", 1_000), f"{tmp_path}/out", f"{tmp_path}/state")
    base = int(found.agg(F.min("start")).first()[0]) - 7_000
    got = sorted((r.session, (r.start - base) // 1000, None if r.stop is None else (r.stop - base) // 1000) for r in found.collect())
    assert got == sorted([(1, 10, 20), (1, 20, 30), (1, 25, 40), (1, 50, None), (2, 7, None)], key=lambda r: (r[0], r[1]))


def test_replayed_batches_count_once(spark, tmp_path):
    stream = feed(spark, f"{tmp_path}/in", "session long, n long", [[(1, 1)], [(1, 2)]])
    out = online.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.n for r in out.collect()) == [1, 2]
    again = online.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/other")  # a new checkpoint replays everything
    assert sorted(r.n for r in again.collect()) == [1, 2]


@pytest.fixture(autouse=True)
def one_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_held_rows_are_pieces_of_state(spark, tmp_path, monkeypatch):
    """F16: rows are held in sorted pieces, not one by one; pieces that overlap, ties and rows held again come out in order."""
    from collections import Counter

    import pandas as pd

    calls = Counter()

    class State(dict):
        def __init__(self, name):
            self.name = name

        def updateValue(self, k, v):
            calls[self.name] += 1
            self[k] = v

        def getValue(self, k):
            return self[k]

        def removeKey(self, k):
            del self[k]

        def exists(self):
            return None in self

        def get(self):
            return self[None]

        def update(self, v):
            self[None] = v

    class Handle:
        timers = []
        getMapState = staticmethod(lambda name, *_: State(name))
        getValueState = staticmethod(lambda name, *_: State(name))
        registerTimer = timers.append

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    monkeypatch.setattr(online, "GATHER", 40)
    monkeypatch.setattr(online, "PIECE", 10)
    seen = []

    def step(state, rows):
        seen.extend(rows)
        return {"n": (state or {"n": 0})["n"] + len(rows)}, [(r[1],) for r in rows]

    work = online._InOrder(["idx", "value"], "idx long, value double", step, lambda state: [(-state["n"],)], ["session", "idx"], 5)
    work.init(Handle)
    rng = random.Random(1)
    rows = [(i // 3 + 1, i, rng.random() if i % 7 else None) for i in range(1000)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 200))
    frames = [pd.DataFrame(mixed[i : i + 16], columns=["ms", "idx", "value"]) for i in range(0, 1000, 16)]
    list(work.handleInputRows((4,), iter(frames), At(0)))
    assert calls["held"] <= 125
    out = pd.concat([part for ms in (100, 100, 250, 1000, 1000) for part in work.handleExpiredTimer((4,), At(ms), None)])
    assert seen == rows
    assert out["idx"].tolist() == [*range(1000), -1000] and set(out["session"]) == {4}
