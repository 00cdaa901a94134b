"""Running sums and neighbours along time in two levels: inside buckets of time, and from bucket to bucket by a table of one row a bucket.

A window over a whole session sorts it in one task. Here the rows of a (session, bucket) are one group, and only summaries of the buckets
are sorted by session, so that a long session spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near(rows: DataFrame, idx: str, width: int, before: int, after: int) -> DataFrame:
    """rows with _part, the bucket of `width` rows, and _side; rows near the ends of a bucket are in the neighbouring ones as well, with _side true.

    idx must be gapless. In a window over _part each row that isn't _side has `before` rows before it and `after` rows after it, up to the ends of its session.
    """
    if max(before, after) > width:
        raise ValueError("a bucket must be as wide as its side rows")
    at, place = F.floor(F.col(idx) / width).cast("long"), F.pmod(F.col(idx), F.lit(width))
    part = lambda step: F.struct((at + step).alias("_part"), F.lit(step != 0).alias("_side"))
    parts = F.array_compact(F.array(part(0), F.when(place < after, part(-1)), F.when(place >= width - before, part(1))))
    return rows.withColumn("_p", F.explode(parts)).select(*rows.columns, "_p._part", "_p._side")


def along(
    rows: DataFrame, by: Sequence[str], t: str, width: float | None, order: Sequence[str] | None = None,
    sums: Mapping[str, Column] = {}, maxima: Mapping[str, Column] = {}, lags: Mapping[str, Column] = {}, leads: Mapping[str, Column] = {},
) -> DataFrame:
    """rows with running sums and maxima (sums include the row, maxima are of the rows before), values of the row before and of that after.

    Rows are in order of `order` (t alone, if not given), whose first column must be t; ties have no order of their own. width: length of a bucket in units of t;
    without it a session is one group. The values of lags and leads mustn't be null.
    """
    by, order = list(by), list(order or [t])
    taken = {**{f"_s{i}": c for i, c in enumerate(sums.values())}, **{f"_m{i}": c for i, c in enumerate(maxima.values())}}
    taken |= {**{f"_g{i}": c for i, c in enumerate(lags.values())}, **{f"_d{i}": c for i, c in enumerate(leads.values())}}
    rows = rows.withColumns(taken)
    names = lambda prefix: [c for c in taken if c.startswith(prefix)]
    group = by
    if width is not None:
        rows = rows.withColumn("_bucket", F.floor(F.col(t) / width).cast("long"))
        group = [*by, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(*order)
    until, prior = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns(
        {**{c: F.sum(c).over(until) for c in names("_s")}, **{c: F.max(c).over(prior) for c in names("_m")}, **{c: F.lag(c).over(inside) for c in names("_g")}, **{c: F.lead(c).over(inside) for c in names("_d")}}
    )
    if width is not None:
        at = F.struct(*order)
        made = [F.sum(c).alias(c) for c in names("_s")] + [F.max(c).alias(c) for c in names("_m")] + [F.max_by(c, at).alias(c) for c in names("_g")] + [F.min_by(c, at).alias(c) for c in names("_d")]
        between = Window.partitionBy(*by).orderBy("_bucket")
        before = between.rowsBetween(Window.unboundedPreceding, -1)
        carried = rows.groupBy(*group).agg(*made).select(
            *group, *(F.sum(c).over(before).alias(f"{c}c") for c in names("_s")), *(F.max(c).over(before).alias(f"{c}c") for c in names("_m")),
            *(F.lag(c).over(between).alias(f"{c}c") for c in names("_g")), *(F.lead(c).over(between).alias(f"{c}c") for c in names("_d")),
        )
        out = out.join(carried, group)
        both = {**{c: F.col(c) + F.coalesce(f"{c}c", F.lit(0)) for c in names("_s")}, **{c: F.greatest(c, f"{c}c") for c in names("_m")}}
        both |= {c: F.coalesce(c, f"{c}c") for c in [*names("_g"), *names("_d")]}
        out = out.withColumns(both).drop("_bucket", *(f"{c}c" for c in taken))
    return out.withColumnsRenamed(dict(zip(taken, [*sums, *maxima, *lags, *leads])))
