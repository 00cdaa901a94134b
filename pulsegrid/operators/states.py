"""Collections of named states (session, label, start, stop): selection, transitions, matrices, comparison."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import intervals, rangejoin

#: Stretches of a session that transitions() goes through in one group.
STRETCHES = 4096


def get(states: DataFrame, name: str) -> DataFrame:
    """Periods of the state whose label is name, else of the one whose key is (a small job looks for the label)."""
    if "key" not in states.columns:
        return states.where(F.col("label") == name).select("session", "start", "stop")
    labelled = not states.where(F.col("label") == name).isEmpty()
    return states.where(F.col("label" if labelled else "key") == name).select("session", "start", "stop")


def select(states: DataFrame, name: str, exclude: Sequence[str] = (), fill: float | None = None, trim: float = 0, min_duration: float | None = None) -> DataFrame:
    """A state after filling gaps, taking others away, trimming both ends and dropping short periods, in this order."""
    out = get(states, name)
    if fill is not None:
        out = intervals.fill_gaps(out, fill)
    for other in exclude:
        out = intervals.subtract(out, get(states, other))
    if trim:
        out = intervals.clean(intervals.shift(out, trim, -trim))
    return out if min_duration is None else out.where(F.col("stop") - F.col("start") >= min_duration)


def next_starts(a: DataFrame, b: DataFrame, window: float) -> DataFrame:
    """(session, stop, next_start): for each stop of a the first start of b after it, at most `window` later.

    Found by one window over both kinds of rows; a start may serve several stops.
    """
    rows = a.select("session", F.col("stop").alias("t"), F.lit(1).alias("_k")).unionByName(b.select("session", F.col("start").alias("t"), F.lit(0).alias("_k")))
    # Equal instants: starts come after stops in this order, so a start at the stop itself is not "after" it.
    ahead = Window.partitionBy("session").orderBy(F.desc("t"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_k") == 0, F.col("t")), ignorenulls=True).over(ahead)
    out = rows.withColumn("next_start", found).where("_k = 1")
    return out.where(F.col("next_start") - F.col("t") <= window).select("session", F.col("t").alias("stop"), "next_start")


def transitions(a: DataFrame, b: DataFrame, window: float) -> DataFrame:
    """(session, start, stop): the window around each start of b that follows a stop of a by at most `window`.

    Stops are taken in order; each gets the first start after it that no stop before has used, and uses it if it is near
    enough. A stop whose first start lies beyond the reach of the stop before depends on no earlier one: there the
    session is cut, and each group of stretches is gone through once. Where a session has no such stop, that's one pass
    over the times of all its rows. Repeated starts are used one by one.
    """
    rows = a.select("session", F.col("stop").alias("t"), F.lit(1).alias("_k")).unionByName(b.select("session", F.col("start").alias("t"), F.lit(0).alias("_k")))
    order = Window.partitionBy("session").orderBy("t", "_k")
    ahead = Window.partitionBy("session").orderBy(F.desc("t"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_next": F.last(F.when(F.col("_k") == 0, F.col("t")), ignorenulls=True).over(ahead),
        "_prev": F.last(F.when(F.col("_k") == 1, F.col("t")), ignorenulls=True).over(before),
    })
    fresh = (F.col("_k") == 1) & F.coalesce(F.col("_next") > F.col("_prev") + window, F.lit(True))
    rows = rows.withColumn("_cut", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Starts that no stop of their stretch reaches stay out, so that a stretch is as long as its stops are dense.
    near = rows.where((F.col("_cut") > 0) & ((F.col("_k") == 1) | (F.col("t") <= F.col("_prev") + window)))
    # Stretches that follow each other make one group, as the pass below begins anew by itself where one begins.
    ship(near.sparkSession)
    near = near.select("session", F.floor(F.col("_cut") / STRETCHES).alias("_group"), "t", "_k")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema.fields if f.name in ("session", "t"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "_k"], kind="stable")
        t, stop = group["t"].to_numpy(), group["_k"].to_numpy() == 1
        starts = t[~stop]
        ahead, times, stops, n = np.cumsum(~stop)[stop].tolist(), starts.tolist(), t[stop].tolist(), len(starts)
        at, used = 0, []
        for first, since in zip(ahead, stops):
            at = max(at, first)
            if at < n and times[at] - since <= window:
                used.append(at)
                at += 1
        return pd.DataFrame({"session": group["session"].iloc[0], "t": starts[used]})

    found = near.groupBy("session", "_group").applyInPandas(run, schema)
    return found.select("session", (F.col("t") - window).alias("start"), (F.col("t") + window).alias("stop"))


def pair_in_order(starts: DataFrame, stops: DataFrame, by: Sequence[str] = ("session",), t: str = "t") -> DataFrame:
    """(by, start, stop): the k-th start with the k-th of the stops that aren't before the first start; stop > start."""
    first = starts.groupBy(*by).agg(F.min(t).alias("_first"))
    later = stops.join(first, list(by)).where(F.col(t) >= F.col("_first"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(t))
    return starts.select(*by, F.col(t).alias("start"), number.alias("_k")).join(later.select(*by, F.col(t).alias("stop"), number.alias("_k")), [*by, "_k"]).where("stop > start").drop("_k")


def matrix(states: DataFrame, samples: DataFrame, labels: Sequence[str], width: float) -> DataFrame:
    """(session, idx, one 0/1 column for each label) for each sample (session, idx) by half-open sample ranges."""
    hits = rangejoin.points_in_periods(samples.select("session", "idx"), states, width, t="idx")
    wide = hits.groupBy("session", "idx").agg(*(F.max((F.col("label") == name).cast("int")).alias(name) for name in labels))
    return samples.select("session", "idx").join(wide, ["session", "idx"], "left").fillna(0, list(labels))


def confusion(pairs: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(truth, guess, n, precision, sensitivity): shares of the guess's and of the truth's totals."""
    counts = pairs.groupBy(truth, guess).agg(F.count("*").alias("n"))
    share = lambda c: F.col("n") / F.sum("n").over(Window.partitionBy(c))
    return counts.withColumns({"precision": share(guess), "sensitivity": share(truth)})


def reassign_short(states: DataFrame, label: str, threshold: float, default: str, longer: bool = False) -> DataFrame:
    """states in which periods of `label` shorter (or longer) than a threshold get the label `default`."""
    length = F.col("stop") - F.col("start")
    hit = (F.col("label") == label) & ((length > threshold) if longer else (length < threshold))
    return states.withColumn("label", F.when(hit, F.lit(default)).otherwise(F.col("label")))


def merge_labels(states: DataFrame, labels: Sequence[str], new: str) -> DataFrame:
    """The union of several states under a new label."""
    return intervals.coalesce(states.where(F.col("label").isin(list(labels))).select("session", "start", "stop")).withColumn("label", F.lit(new))


def listed(states: DataFrame) -> DataFrame:
    """(session, label, n_periods, total, first, last): what states a session has."""
    return states.groupBy("session", "label").agg(F.count("*").alias("n_periods"), F.sum(F.col("stop") - F.col("start")).alias("total"), F.min("start").alias("first"), F.max("stop").alias("last"))


def swapped(rows: DataFrame, code: str, a, b) -> DataFrame:
    """rows in which two codes have traded places."""
    return rows.withColumn(code, F.when(F.col(code) == a, F.lit(b)).when(F.col(code) == b, F.lit(a)).otherwise(F.col(code)))
