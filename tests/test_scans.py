"""Two-level scans against windows over whole sessions and plain Python, their plans, and the assignment solver against all permutations."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import intervals, scans, sequence
from pulsegrid.operators.assignment import assign


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(s, t, rng.randint(-3, 3)) for s in range(4) for t in rng.sample(range(2000), 300 if s < 3 else 1)]
    return spark.createDataFrame(data, "session int, t long, v long").repartition(3).cache()


@pytest.mark.parametrize("width", [None, 1, 7, 100, 5000])
def test_along(rows, width):
    got = scans.along(rows, ["session"], "t", width, sums={"total": F.col("v")}, maxima={"top": F.col("v")}, lags={"was": F.col("v")}, leads={"next": F.col("t")}).collect()
    want = {}
    for s in range(4):
        mine = sorted((r.t, r.v) for r in rows.where(f"session = {s}").collect())
        for i, (t, v) in enumerate(mine):
            before = [x for _, x in mine[:i]]
            want[s, t] = (v, sum(before) + v, max(before, default=None), before[-1] if before else None, mine[i + 1][0] if i + 1 < len(mine) else None)
    assert {(r.session, r.t): (r.v, r.total, r.top, r.was, r.next) for r in got} == want


def periods(spark, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(s, a, a + rng.randint(0, 40)) for s in range(3) for a in rng.sample(range(1500), 60)], "session int, start long, stop long")


def listed(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("width", [3, 64, 10_000])
def test_operators_by_buckets(spark, rows, width):
    a, b = periods(spark, 1), periods(spark, 2)
    keep = lambda x, y: x & ~y
    assert listed(intervals.combine([a, b], keep, width=width)) == listed(intervals.combine([a, b], keep))
    assert listed(intervals.coalesce(a, gap=5, width=width)) == listed(intervals.coalesce(a, gap=5))
    assert listed(intervals.active_count(rows, a, width=width)) == listed(intervals.active_count(rows, a))
    for f in (sequence.crossings, sequence.pulses):
        assert listed(f(rows, 0.5, idx="t", value="v", width=width)) == listed(f(rows, 0.5, idx="t", value="v"))


def test_no_task_sorts_a_session(spark, rows):
    """Every window is inside of a bucket, or over the table of buckets."""
    a, b = periods(spark, 1), periods(spark, 2)
    for df in (intervals.combine([a, b], lambda x, y: x | y, width=50), intervals.active_count(rows, a, width=50), sequence.crossings(rows, 0.5, idx="t", value="v", width=50)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[(.*?)\](?:, \[(.*?)\])?\n", plan)
        assert windows and all("_bucket" in partition or "_bucket" in order for partition, order in windows)


def test_even_tasks(spark):
    """One session of a million rows: no group of a bucket has more than its share."""
    rows = spark.range(1_000_000).selectExpr("0 AS session", "id AS t", "id % 3 AS v")
    out = scans.along(rows, ["session"], "t", 50_000, sums={"total": F.col("v")})
    assert out.agg(F.max("total")).first()[0] == sum(i % 3 for i in range(1_000_000))
    assert out.groupBy(F.floor(F.col("t") / 50_000)).count().agg(F.max("count")).first()[0] == 50_000


def test_assignment():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        for _ in range(12):
            cost = rng.normal(size=(n, n)) if rng.random() < 0.5 else rng.integers(0, 4, size=(n, n)).astype(float)
            got = assign(cost)
            assert sorted(got) == list(range(n))
            assert abs(cost[np.arange(n), got].sum() - min(cost[np.arange(n), list(p)].sum() for p in permutations(range(n)))) < 1e-9
    points = rng.normal(size=(12, 3)) * 50
    mixed = rng.permutation(12)
    found = assign(((points[mixed][None, :, :] + rng.normal(size=3) - points[:, None, :]) ** 2).sum(axis=2))
    assert np.array_equal(mixed[found], np.arange(12))
