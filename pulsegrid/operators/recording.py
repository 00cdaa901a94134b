"""Putting recordings together: chunks of tracking matched to recorded windows, and placed on one grid of frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, small

EPS32 = 1.1920928955078125e-07


def match_chunks(chunks: DataFrame, windows: DataFrame, rate: float, tolerance: float = 0.2) -> DataFrame:
    """(session, chunk, start, stop): each chunk (session, chunk, n_frames), in order, with the first unused window
    (session, start, stop) of its length; both times one frame earlier.

    Windows of a session are sorted by length and cut where the reach of any chunk's length begins or ends; each piece keeps its unused
    windows in order, so a chunk looks at the first ones of the pieces in its reach. A task holds the times of a session's windows and chunks.
    """
    ship(chunks.sparkSession)
    c = chunks.where("n_frames > 0 AND session IS NOT NULL").select("session", "chunk", F.col("n_frames").cast("double").alias("n_frames"))
    w = windows.where("start IS NOT NULL AND stop IS NOT NULL").select(F.col("session").cast(c.schema["session"].dataType).alias("session"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields[:2])

    def run(c: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        c, w = c.sort_values(["chunk", "n_frames"], kind="stable"), w.sort_values(["start", "stop"], kind="stable")
        start, stop = w["start"].to_numpy(), w["stop"].to_numpy()
        which = first_unused(stop - start, c["n_frames"].to_numpy() / rate, tolerance)
        hit = which >= 0
        return pd.DataFrame({"session": c["session"][hit], "chunk": c["chunk"][hit], "start": start[which[hit]] - 1 / rate, "stop": stop[which[hit]] - 1 / rate})

    return c.groupBy("session").cogroup(w.groupBy("session")).applyInPandas(run, f"{schema}, start double, stop double")


def first_unused(lengths: np.ndarray, wanted: np.ndarray, tolerance: float) -> np.ndarray:
    """For each wanted length in order the first of `lengths` less than `tolerance` away that none before has taken, or -1."""
    n, order = len(lengths), np.argsort(lengths, kind="stable")
    by_length = lengths[order]
    kinds, kind = np.unique(wanted, return_inverse=True)
    # Ends of each reach by the comparison itself, near where a search for them points to.
    near = lambda i: np.abs(by_length[i] - kinds[some]) < tolerance  # noqa: B023, E731
    low, high = np.searchsorted(by_length, kinds - tolerance), np.searchsorted(by_length, kinds + tolerance, side="right")
    for place, inward, inside in ((low, 1, 0), (high, -1, -1)):
        for step in (-inward, inward):
            some = np.arange(len(kinds))
            while len(some):
                at = place[some] + (inside if step == inward else inside - inward)
                some = some[(at >= 0) & (at < n) & ((low[some] < high[some]) | (step != inward))]
                at = place[some] + (inside if step == inward else inside - inward)
                some = some[~near(at) if step == inward else near(at)]
                place[some] += step
    cuts = np.unique(np.concatenate([low, high, [0, n]]))
    pieces = [np.sort(order[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    heads, used = np.array([p[0] for p in pieces] + [n]), np.zeros(len(pieces), int)
    first, last = np.searchsorted(cuts, low), np.searchsorted(cuts, high)
    out = np.full(len(wanted), -1)
    for i, k in enumerate(kind.tolist()):
        if first[k] < last[k]:
            p = first[k] + int(heads[first[k] : last[k]].argmin())
            if heads[p] < n:
                out[i] = heads[p]
                used[p] += 1
                heads[p] = pieces[p][used[p]] if used[p] < len(pieces[p]) else n
    return out


def on_grid(frames: DataFrame, matched: DataFrame, rate: float, values: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = ("marker",)) -> DataFrame:
    """frames (session, chunk, frame, keys, values) on the session's grid: (session, idx, keys, values).

    Index 0 is the start of the first window; a recorded 0 becomes EPS32, as 0 stands for what was not recorded.
    """
    first = F.min("start").over(Window.partitionBy("session"))
    at = matched.withColumn("_i0", F.rint((F.col("start") - first) * rate).cast("long")).select("session", "chunk", "_i0")
    both = frames.join(small(at), ["session", "chunk"])
    return both.select("session", (F.col("_i0") + F.col("frame")).alias("idx"), *keys, *(F.when(F.col(v) == 0, F.lit(EPS32)).otherwise(F.col(v)).alias(v) for v in values))


def quality_table(contamination: DataFrame, snr: DataFrame | None = None, max_contamination: float = 0.02, min_snr: float = 2.0, min_spikes: int = 100, by: Sequence[str] = ("session", "unit")) -> DataFrame:
    """contamination (by, n_spikes, contamination) with snr (null if unknown) and single: whether a unit passes all limits."""
    rows = contamination if snr is None else contamination.join(snr, list(by), "left")
    if snr is None:
        rows = rows.withColumn("snr", F.lit(None).cast("double"))
    ok = (F.col("contamination") <= max_contamination) & (F.col("n_spikes") >= min_spikes) & (F.coalesce(F.col("snr"), F.lit(min_snr)) >= min_snr)
    return rows.withColumn("single", ok)
