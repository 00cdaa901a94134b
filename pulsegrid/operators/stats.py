"""Multiple comparisons, rank transforms, normalisation, lagged association."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m in a bounded number of steps: term by term up to 32, then by the Euler-Maclaurin series, whose rest is below 1e-17 there."""
    terms = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), F.least(F.greatest(m, F.lit(1)), F.lit(32))), lambda i: 1.0 / i), F.lit(0.0), lambda a, b: a + b)
    x = m.cast("double")
    y = 1 / (x * x)
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))
    return F.when(m <= 32, terms).otherwise(series)


def fdr(df: DataFrame, p: str, by: Sequence[str], q: float = 0.05, dependent: bool = False) -> DataFrame:
    """df with adjusted and rejected: Benjamini-Hochberg, or Benjamini-Yekutieli for dependent tests.

    Adjusted values are capped at 1 for the former only. Ties of p share the value of their last rank. A null p takes
    no part: it isn't counted, and has a null adjusted value and is not rejected.
    """
    w = Window.partitionBy(*by)
    rank, m = F.row_number().over(w.orderBy(F.asc_nulls_last(p))), F.count(p).over(w)
    factor = harmonic(F.col("_m")) if dependent else F.lit(1.0)
    rows = df.withColumns({"_rank": rank, "_m": m}).withColumn("_c", factor).withColumn("_raw", F.col(p) * F.col("_m") * F.col("_c") / F.col("_rank"))
    least = F.min("_raw").over(w.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = F.when(F.col(p).isNotNull(), least if dependent else F.least(least, F.lit(1.0)))
    passing = F.when(F.col(p) <= F.col("_rank") / F.col("_m") * q / F.col("_c"), F.col(p))
    rows = rows.withColumn("adjusted", adjusted).withColumn("rejected", F.max(passing).over(w) >= F.col(p))
    return rows.withColumn("rejected", F.coalesce("rejected", F.lit(False))).drop("_rank", "_m", "_c", "_raw")


def uniform_ranks(df: DataFrame, value: str, by: Sequence[str], low: float = 0.0, high: float = 1.0, tie: str = "event_id") -> DataFrame:
    """df with uniform: rank over count, stretched to [low, high]."""
    w = Window.partitionBy(*by)
    return df.withColumn("uniform", low + (high - low) * F.row_number().over(w.orderBy(value, tie)) / F.count("*").over(w))


def zscore(df: DataFrame, value: str, by: Sequence[str], valid: Column | None = None, clip: float | None = None) -> DataFrame:
    """df with z, by the mean and population deviation of the valid rows; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*by)
    v = F.when(valid, F.col(value)) if valid is not None else F.col(value)
    spread = F.stddev_pop(v).over(w)
    z = (F.col(value) - F.avg(v).over(w)) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return df.withColumn("z", z if clip is None else F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), z)))


def lagged_correlation(samples: DataFrame, lags: Sequence[int], by: Sequence[str], idx: str, a: str, b: str) -> DataFrame:
    """(by, lag, n, r): Pearson correlation of a at idx with b at idx + lag, over one shuffle of (by, idx)."""
    by = list(by)
    right = samples.select(*by, F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(idx), F.col(b).alias("_b")).withColumn(idx, F.col(idx) - F.col("lag"))
    return samples.select(*by, idx, F.col(a).alias("_a")).join(right, [*by, idx]).groupBy(*by, "lag").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("r"))
