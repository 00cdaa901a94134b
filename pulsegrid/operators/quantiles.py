"""Exact quantiles of large groups, without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: With more groups than this Spark's own percentile is taken.
GROUPS = 20_000
#: Rows of an interval whose values are counted one by one.
LEAF = 2_000_000
CELLS = 1024
ROUNDS = 8


def exact(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(by, one column for each share): quantiles interpolated between the two nearest ranks; nulls and NaN are left out.

    The interval of values that holds a rank is cut into equal cells, whose rows are counted with partial sums, and the cell
    with the rank is the next interval, until few rows are left in it or all are equal. Only those are counted value by
    value. Each round reads the rows once and shuffles counts of cells. The driver holds two intervals at most for each share
    and group, of GROUPS groups at most.
    """
    by = list(by)
    spark = df.sparkSession
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).limit(GROUPS + 1).collect()
    if len(groups) > GROUPS:
        return rows.groupBy(*by).agg(*(F.percentile("_v", F.lit(q)).alias(name) for name, q in shares.items()))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    keys = f"{keys}, " if keys else ""

    ranks = []  # (key, share, rank, its weight)
    wanted = {}  # (key, rank) -> (rows below the interval, rows in it, low, high)
    for g in groups:
        if g.n == 0:  # without keys an empty table has a row
            continue
        key = tuple(g[c] for c in by)
        for name, q in shares.items():
            at = q * (g.n - 1)
            for rank, weight in ((int(at), 1 - at % 1), (min(int(at) + 1, g.n - 1), at % 1)):
                ranks.append((*key, name, rank, weight))
                wanted[key, rank] = (0, g.n, g.low, g.high)

    def inside(todo) -> DataFrame:
        """Rows in the intervals that are still open, one interval each: they don't overlap."""
        cut = {(*key, below, low, high) for (key, _), (below, _, low, high) in todo.items()}
        cut = F.broadcast(spark.createDataFrame(sorted(cut, key=str), f"{keys}_below long, _low double, _high double"))  # at most GROUPS * 2 * shares rows
        within = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
        if not by:
            return rows.join(cut, within)
        same = [rows[c].eqNullSafe(cut[c]) for c in by]
        for one in same:
            within = within & one
        return rows.join(cut, within).select(*(rows[c] for c in by), "_v", "_below", "_low", "_high")

    def pick(counted: DataFrame, todo) -> None:
        """The cell of each wanted rank; counted: (by, _below, _low, cell, n, low, high)."""
        w = Window.partitionBy(*by, "_below", "_low").orderBy("cell")
        upto = counted.withColumn("upto", F.col("_below") + F.sum("n").over(w))
        asked = F.broadcast(spark.createDataFrame([(*key, below, rank) for (key, rank), (below, *_) in todo.items()], f"{keys}_below long, rank long"))
        same = upto["_below"] == asked["_below"]
        for c in by:
            same = same & upto[c].eqNullSafe(asked[c])
        hit = upto.join(asked, same & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        for r in hit.select(*(upto[c] for c in by), "rank", (F.col("upto") - F.col("n")).alias("below"), "n", "low", "high").collect():
            wanted[tuple(r[c] for c in by), r["rank"]] = (r.below, r.n, r.low, r.high)

    for _ in range(ROUNDS):
        todo = {k: v for k, v in wanted.items() if v[1] > LEAF and v[2] < v[3]}
        if not todo:
            break
        v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
        width = high - low  # infinite if a bound is; all between the bounds are one cell then
        at = F.when(v <= low, 0).when(v >= high, CELLS - 1).when(width == float("inf"), CELLS // 2).otherwise(F.least(F.floor((v - low) / width * CELLS).cast("int"), F.lit(CELLS - 1)))
        cells = inside(todo).groupBy(*by, "_below", "_low", at.alias("cell"))
        pick(cells.agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")), todo)
    todo = {k: v for k, v in wanted.items() if v[2] < v[3]}
    if todo:
        values = inside(todo).groupBy(*by, "_below", "_low", F.col("_v").alias("cell")).agg(F.count("*").alias("n"))
        pick(values.withColumns({"low": F.col("cell"), "high": F.col("cell")}), todo)

    found = {}
    for *key, name, rank, weight in ranks:
        one = found.setdefault(tuple(key), dict.fromkeys(shares, 0.0))
        if weight:
            one[name] += weight * wanted[tuple(key), rank][2]
    columns = ", ".join(f"`{name}` double" for name in shares)
    return spark.createDataFrame([(*key, *one.values()) for key, one in found.items()], f"{keys}{columns}")
