"""Algebra of periods (session, start, stop), half-open, any numeric time.

Sets are combined by a sweep: each period gives a step up and a step down, steps are summed for each
instant before the shuffle, and running sums over a session tell which sets cover each stretch. That
is one exchange on the session for any set operation; no join, no pair of periods is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rangejoin, scans


def _window(by: Sequence[str], *order):
    return Window.partitionBy(*by).orderBy(*order)


def coalesce(periods: DataFrame, by: Sequence[str] = ("session",), gap: float = 0, strict: bool = False, width: float | None = None) -> DataFrame:
    """Merges periods that overlap, touch or, with gap, are apart by `gap` or less (strict: by less than `gap`).

    Empty periods take part and are dropped after merging, as a touching one bridges nothing. With a width, here and below, time is cut into buckets of
    that width, and no task sorts a whole session (scans.along).
    """
    rows = scans.along(periods, by, "start", width, ["start", "stop"], maxima={"_before": F.col("stop")})
    apart = F.col("start") - F.col("_before")
    joined = (apart < gap) if strict else (apart <= gap)
    fresh = F.when(joined, 0).otherwise(1)
    rows = scans.along(rows.drop("_island"), by, "start", width, ["start", "stop"], sums={"_island": fresh})
    merged = rows.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.where("stop > start").drop("_island")


def fill_gaps(periods: DataFrame, gap: float, by: Sequence[str] = ("session",), width: float | None = None) -> DataFrame:
    """Merges periods that are apart by less than `gap`."""
    return coalesce(periods, by, gap, strict=True, width=width)


def combine(sets: Sequence[DataFrame], keep: Callable[..., Column], by: Sequence[str] = ("session",), width: float | None = None) -> DataFrame:
    """Stretches where keep(in_first, in_second, ...) holds, merged. keep takes and gives boolean columns."""
    by = list(by)
    names = [f"_n{i}" for i in range(len(sets))]
    steps = None
    for i, s in enumerate(sets):
        usable = s.where("stop > start")
        for end, step in (("start", 1), ("stop", -1)):
            one = usable.select(*by, F.col(end).alias("_t"), *(F.lit(step if j == i else 0).cast("long").alias(n) for j, n in enumerate(names)))
            steps = one if steps is None else steps.unionByName(one)
    summed = steps.groupBy(*by, "_t").agg(*(F.sum(n).alias(n) for n in names))
    return _stretches(summed, names, keep, by, width)


def combine_labelled(periods: DataFrame, labels: Sequence[str], keep: Callable[..., Column], by: Sequence[str] = ("session",), label: str = "label", width: float | None = None) -> DataFrame:
    """combine() over the periods (by, label, start, stop) of each label, from one scan of the table."""
    by = list(by)
    names = [f"_n{i}" for i in range(len(labels))]
    rows = periods.where(F.col(label).isin(list(labels)) & (F.col("stop") > F.col("start")))
    steps = rows.select(*by, F.col(label).alias("_l"), F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).cast("long").alias("s")), F.struct(F.col("stop").alias("t"), F.lit(-1).cast("long").alias("s")))).alias("_e"))
    summed = steps.groupBy(*by, F.col("_e.t").alias("_t")).agg(*(F.sum(F.when(F.col("_l") == name, F.col("_e.s")).otherwise(0)).alias(n) for n, name in zip(names, labels)))
    return _stretches(summed, names, keep, by, width)


def _stretches(summed: DataFrame, names: list[str], keep: Callable[..., Column], by: list[str], width: float | None) -> DataFrame:
    state = scans.along(summed.select(*by, "_t", *(F.col(n).alias(f"{n}_") for n in names)), by, "_t", width, sums={n: F.col(f"{n}_") for n in names}, leads={"stop": F.col("_t")})
    kept = state.where(keep(*(F.col(n) > 0 for n in names)) & F.col("stop").isNotNull()).select(*by, F.col("_t").alias("start"), "stop")
    return coalesce(kept, by, width=width)


def union(*sets: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Canonical union."""
    both = sets[0].select(*by, "start", "stop")
    for s in sets[1:]:
        both = both.unionByName(s.select(*by, "start", "stop"))
    return coalesce(both, by)


def intersect(*sets: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Canonical intersection."""

    def every(*inside: Column) -> Column:
        out = inside[0]
        for x in inside[1:]:
            out = out & x
        return out

    return combine(sets, every, by)


def subtract(a: DataFrame, b: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Canonical a without b."""
    return combine((a, b), lambda x, y: x & ~y, by)


def intersect_pairs(a: DataFrame, b: DataFrame, width: float, by: Sequence[str] = ("session",)) -> DataFrame:
    """The overlap of each pair of periods, not merged; that of an empty period inside of another one is empty."""
    return rangejoin.overlaps(a, b, width, by).select(*by, "start", "stop")


def complement(periods: DataFrame, extent: DataFrame | None = None, by: Sequence[str] = ("session",)) -> DataFrame:
    """What is outside of the periods in each session's extent (by, start, stop).

    Without an extent, all time: what lies between the periods of a session and, with null starts and stops for ends that
    are open, before and after them. A session without periods isn't known then.
    """
    if extent is not None:
        return subtract(extent, periods, by)
    merged = coalesce(periods, by)
    w = _window(by, "start")
    before = merged.select(*by, F.lag("stop").over(w).alias("_from"), F.col("start").alias("_to"), F.col("stop").alias("_last"), F.lead("start").over(w).alias("_more"))
    bounds = F.array(F.struct(F.col("_from").alias("start"), F.col("_to").alias("stop")), F.when(F.col("_more").isNull(), F.struct(F.col("_last").alias("start"), F.lit(None).cast(periods.schema["stop"].dataType).alias("stop"))))
    return before.select(*by, F.explode(F.filter(bounds, lambda p: p.isNotNull())).alias("_p")).select(*by, "_p.start", "_p.stop")


def gaps(periods: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """Stretches between consecutive periods, which must not overlap."""
    nxt = F.lead("start").over(_window(by, "start"))
    return periods.select(*by, F.col("stop").alias("start"), nxt.alias("stop")).where("stop > start")


def shift(periods: DataFrame, by_start: float, by_stop: float | None = None) -> DataFrame:
    """Moves starts and stops; one number moves both."""
    return periods.withColumns({"start": F.col("start") + by_start, "stop": F.col("stop") + (by_start if by_stop is None else by_stop)})


def clean(periods: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Clamps to [low, high] and drops what is empty. Does not merge."""
    if low is not None:
        periods = periods.withColumns({"start": F.greatest("start", low), "stop": F.least("stop", high)})
    return periods.where("stop > start")


def duration(periods: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, duration, n_periods): sum of lengths; overlaps count twice, negative lengths as none."""
    return periods.groupBy(*by).agg(F.sum(F.greatest(F.col("stop") - F.col("start"), F.lit(0))).alias("duration"), F.count("*").alias("n_periods"))


def to_samples(periods: DataFrame, rate: float, n_samples: int | None = None) -> DataFrame:
    """Periods in seconds as sample ranges [rint(start * rate), rint(stop * rate)), clipped to n_samples."""
    bound = (lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(n_samples))) if n_samples is not None else (lambda c: F.greatest(c, F.lit(0)))
    at = lambda c: bound(F.rint(F.col(c) * rate).cast("long"))
    return periods.withColumns({"start": at("start"), "stop": at("stop")}).where("stop > start")


def to_mask(ranges: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, idx) of each sample inside any of the sample ranges."""
    return coalesce(ranges, by).select(*by, F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("idx"))


def from_mask(samples: DataFrame, by: Sequence[str] = ("session",), idx: str = "idx", width: float | None = None) -> DataFrame:
    """Runs of consecutive samples (one row each) as ranges [start, stop)."""
    rows = scans.along(samples, by, idx, width, sums={"_run": F.lit(1)}).withColumn("_run", F.col(idx) - F.col("_run"))
    return rows.groupBy(*by, "_run").agg(F.min(idx).alias("start"), (F.max(idx) + 1).alias("stop")).drop("_run")


def active_count(points: DataFrame, ranges: DataFrame, by: Sequence[str] = ("session",), t: str = "t", width: float | None = None) -> DataFrame:
    """points with active: number of ranges that hold each, both ends included; by one sweep, no join."""
    by = list(by)
    rows = points.withColumns({"_kind": F.lit(1), "_step": F.lit(0)})
    keep = [c for c in points.columns if c not in by and c != t]
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in keep]
    ends = [ranges.select(*by, F.col(end).alias(t), *blank, F.lit(kind).alias("_kind"), F.lit(step).alias("_step")) for end, kind, step in (("start", 0, 1), ("stop", 2, -1))]
    every = rows.unionByName(ends[0]).unionByName(ends[1])
    return scans.along(every, by, t, width, [t, "_kind"], sums={"active": F.col("_step")}).where("_kind = 1").drop("_kind", "_step")


def label_counts(points: DataFrame, ranges: DataFrame, labels: Sequence[str], by: Sequence[str] = ("session",), t: str = "t", width: float | None = None) -> DataFrame:
    """(points, label, n): for each label the number of its ranges [start, stop) that hold a point, where there are any; by one sweep, no pair is formed."""
    by, names = list(by), [f"_n{i}" for i in range(len(labels))]
    step = lambda s: [F.sum(F.when(F.col("label") == name, F.lit(s)).otherwise(0)).cast("long").alias(n) for n, name in zip(names, labels)]
    usable = ranges.where("stop > start")
    ends = [usable.groupBy(*by, F.col(end).alias(t)).agg(*step(s)) for end, s in (("start", 1), ("stop", -1))]
    keep = [c for c in points.columns if c not in by and c != t]
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in keep]
    every = points.withColumns({"_kind": F.lit(1), **{n: F.lit(0).cast("long") for n in names}})
    for one in ends:
        every = every.unionByName(one.select(*by, t, *blank, F.lit(0).alias("_kind"), *names))
    swept = scans.along(every, by, t, width, [t, "_kind"], sums={f"{n}_": F.col(n) for n in names}).where("_kind = 1")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("label"), F.col(f"{n}_").alias("n")) for n, name in zip(names, labels))))
    return swept.select(*points.columns, each.alias("_e")).select(*points.columns, "_e.label", "_e.n").where("n > 0")


def label_matrix(points: DataFrame, ranges: DataFrame, labels: Sequence[str], width: float, by: Sequence[str] = ("session",), t: str = "t", key: str = "event_id") -> DataFrame:
    """(by, key, one boolean column for each label): whether any range of that label holds the point, ends included."""
    hits = rangejoin.points_in_periods(points.select(*by, key, t), ranges, width, by, t, closed=True)
    wide = hits.groupBy(*by, key).agg(*(F.max(F.col("label") == name).alias(name) for name in labels))
    return points.select(*by, key).join(wide, [*by, key], "left").select(*by, key, *(F.coalesce(name, F.lit(False)).alias(name) for name in labels))
