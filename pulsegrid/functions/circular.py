"""Circular statistics as columns and aggregates (angles in radians)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap(x: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def distance(a: Column, b: Column) -> Column:
    """a - b, wrapped."""
    return wrap(a - b)


def axial(x: Column, p: int = 1) -> Column:
    """p * x in [0, 2 pi)."""
    return F.pmod(x * p, F.lit(2 * 3.141592653589793))


def mean(x: Column) -> Column:
    return F.atan2(F.avg(F.sin(x)), F.avg(F.cos(x)))


def resultant(x: Column) -> Column:
    c, s = F.avg(F.cos(x)), F.avg(F.sin(x))
    return F.sqrt(c * c + s * s)


def variance(x: Column) -> Column:
    return F.lit(1.0) - resultant(x)


def std(x: Column) -> Column:
    """The angular deviation sqrt(2 (1 - R))."""
    return F.sqrt(F.lit(2.0) * (F.lit(1.0) - resultant(x)))


def std0(x: Column) -> Column:
    """The circular standard deviation sqrt(-2 ln R)."""
    return F.sqrt(F.lit(-2.0) * F.log(resultant(x)))


def ppc(x: Column) -> Column:
    """Pairwise phase consistency in closed form; null for fewer than two angles."""
    c, s, n = F.sum(F.cos(x)), F.sum(F.sin(x)), F.count(x)
    return F.when(n >= 2, (c * c + s * s - n) / (n * (n - 1)))


def moment(x: Column, p: int = 1) -> tuple[Column, Column]:
    """(length, angle) of the p-th trigonometric moment."""
    c, s = F.avg(F.cos(x * p)), F.avg(F.sin(x * p))
    return F.sqrt(c * c + s * s), F.atan2(s, c)


def concentration(r: Column) -> Column:
    """kappa of a mean resultant length, by the usual piecewise approximation of the inverse Bessel ratio."""
    low = 2 * r + r * r * r + 5 * F.pow(r, F.lit(5.0)) / 6
    mid = -0.4 + 1.39 * r + 0.43 / (1 - r)
    high = 1 / (r * r * r - 4 * r * r + 3 * r)
    return F.when(r < 0.53, low).when(r < 0.85, mid).otherwise(high)


def small_sample(kappa: Column, n: Column, bound: int = 15) -> Column:
    """The correction of kappa for samples of up to `bound` angles."""
    less = F.greatest(kappa - 2 / (n * kappa), F.lit(0.0))
    more = F.pow(n - 1, F.lit(3.0)) * kappa / (n * n * n + n)
    return F.when(n <= bound, F.when(kappa < 2, less).otherwise(more)).otherwise(kappa)


def rayleigh(df: DataFrame, angle: str, by: Sequence[str]) -> DataFrame:
    """(by, n, th0, r, log_z, p, kappa) for each group: Rayleigh's test of uniformity."""
    x = F.col(angle)
    out = df.groupBy(*by).agg(F.count(x).alias("n"), mean(x).alias("th0"), resultant(x).alias("r"))
    z = F.col("n") * F.col("r") * F.col("r")
    n = F.col("n")
    series = 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * F.pow(z, F.lit(3.0)) - 9 * F.pow(z, F.lit(4.0))) / (288 * n * n)
    return out.withColumns({"log_z": F.log(z), "p": F.exp(-z) * series, "kappa": small_sample(concentration(F.col("r")), n)})


def skew_kurtosis(df: DataFrame, angle: str, by: Sequence[str]) -> DataFrame:
    """(by, skew, skew0, kurtosis, kurtosis0) from the first two moments; the second around the mean needs a second pass in form, not in fact."""
    x = F.col(angle)
    r1, m1 = moment(x, 1)
    r2, m2 = moment(x, 2)
    out = df.groupBy(*by).agg(r1.alias("_r1"), m1.alias("_m1"), r2.alias("_r2"), m2.alias("_m2"))
    # The mean of sin(2 (x - m)) is the second moment turned by 2 m.
    turned = F.col("_m2") - 2 * F.col("_m1")
    skew, kurtosis = F.col("_r2") * F.sin(turned), F.col("_r2") * F.cos(turned)
    r1, r2 = F.col("_r1"), F.col("_r2")
    return out.select(
        *by, skew.alias("skew"), (r2 * F.sin(turned) / F.pow(1 - r1, F.lit(1.5))).alias("skew0"),
        kurtosis.alias("kurtosis"), ((kurtosis - F.pow(r1, F.lit(4.0))) / F.pow(1 - r1, F.lit(2.0))).alias("kurtosis0"),
    )


def kappa(x: Column) -> Column:
    """Concentration of a sample, corrected below 15 angles; infinite where all angles are equal, null without any."""
    n, r = F.count(x), resultant(x)
    plain = F.when(r >= 1, F.lit(float("inf"))).otherwise(concentration(r))
    return F.when(n > 1, F.when(plain == float("inf"), plain).otherwise(small_sample(plain, n, 14))).when(n == 1, plain)


def bessel_i0(x: Column, terms: int = 30) -> Column:
    """The modified Bessel function of order 0, by its series (for |x| up to about 20)."""
    q = x * x / 4
    out = F.lit(1.0)
    for k in range(terms, 0, -1):
        out = 1 + out * q / (k * k)
    return out


def von_mises(x: Column, mu: Column, kappa_: Column) -> Column:
    """Density of a von Mises distribution."""
    return F.exp(kappa_ * F.cos(x - mu)) / (2 * 3.141592653589793 * bessel_i0(kappa_))


def random_von_mises(key: Column, mu: Column, kappa_: Column, seed: int = 0, tries: int = 64) -> Column:
    """A random angle for each key, by rejection from a wrapped Cauchy law (Best and Fisher, 1979); the same for the same key and seed.

    At least two of three tries are accepted, so the odds that all fail (then the angle is null) are below 10**-30.
    """
    uniform = lambda i, j: (F.shiftrightunsigned(F.xxhash64(key, i, F.lit(j), F.lit(seed)), 11) + F.lit(0.5)) / float(1 << 53)
    tau = 1 + F.sqrt(1 + 4 * kappa_ * kappa_)
    rho = (tau - F.sqrt(2 * tau)) / (2 * kappa_)
    r = (1 + rho * rho) / (2 * rho)

    def attempt(i: Column) -> Column:
        z = F.cos(uniform(i, 0) * 3.141592653589793)
        f = (1 + r * z) / (r + z)
        c = kappa_ * (r - f)
        u = uniform(i, 1)
        ok = (c * (2 - c) > u) | (F.log(c / u) + 1 - c >= 0)
        angle = F.acos(F.greatest(F.least(f, F.lit(1.0)), F.lit(-1.0)))
        return F.struct(ok.alias("ok"), F.when(uniform(i, 2) > 0.5, angle).otherwise(-angle).alias("angle"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), attempt), lambda t: t["ok"])
    flat = (uniform(F.lit(0), 0) - 0.5) * 6.283185307179586
    return wrap(mu + F.when(kappa_ > 1e-6, F.get(found, F.lit(0))["angle"]).otherwise(flat))


def median(df: DataFrame, angle: str, by: Sequence[str], bins: int = 720) -> DataFrame:
    """(by, median): the direction of a diameter through an angle that halves the angles, on the side of their mean.

    For each angle the numbers of angles up to half a turn ahead and behind are compared; the least difference wins, the
    first by angle for an odd number of angles and the mean of the first two for an even one. Null angles don't count.
    Counts over whole bins come from a running sum around the circle; a bin and the one opposite to it are sorted
    together for the rest, so that work is spread over half as many tasks as bins and no pair of angles is formed.
    """
    from pyspark.sql import Window

    half, turn = bins // 2, 2 * 3.141592653589793
    width = turn / bins
    rows = df.where(F.col(angle).isNotNull()).select(*by, axial(F.col(angle)).alias("_x")).groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_side", (F.col("_x") >= 3.141592653589793).cast("int")).withColumn("_u", F.col("_x") - F.col("_side") * 3.141592653589793)
    rows = rows.withColumn("_b", F.least(F.floor(F.col("_u") / width).cast("int"), F.lit(half - 1)) + F.col("_side") * half)
    counts = rows.groupBy(*by, "_b").agg(F.sum("_n").alias("_n"), F.sum(F.cos("_x") * F.col("_n")).alias("_c"), F.sum(F.sin("_x") * F.col("_n")).alias("_s"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_t"), F.atan2(F.sum("_s"), F.sum("_c")).alias("_mean"))
    grid = total.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts.select(*by, "_b", "_n"), [*by, "_b"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    twice = grid.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + bins)))
    between = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(1, half - 1))
    grid = twice.withColumn("_between", F.coalesce(between, F.lit(0))).where(F.col("_b") < bins).select(*by, "_b", "_between", "_t", "_mean", F.col("_n").alias("_own"))
    both = rows.withColumn("_pair", F.col("_b") % half)
    up_to = Window.partitionBy(*by, "_pair").orderBy("_u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    side = lambda k: F.coalesce(F.sum(F.when(F.col("_side") == k, F.col("_n"))).over(up_to), F.lit(0))
    both = both.withColumns({"_r0": side(0), "_r1": side(1)})
    mine, other = F.when(F.col("_side") == 0, F.col("_r0")).otherwise(F.col("_r1")), F.when(F.col("_side") == 0, F.col("_r1")).otherwise(F.col("_r0"))
    found = both.withColumns({"_mine": mine, "_other": other}).join(grid, [*by, "_b"])
    ahead = F.col("_own") - F.col("_mine") + F.col("_between") + F.col("_other")
    found = found.withColumn("_off", F.abs(2 * ahead - F.col("_t") + F.col("_n")))
    least = found.groupBy(*by).agg(F.min("_off").alias("_least"))
    best = found.join(least, list(by)).where("_off = _least").groupBy(*by).agg(F.first("_t").alias("_t"), F.first("_mean").alias("_mean"), F.min(F.struct("_x", "_n")).alias("_1"), F.min_by("_x", "_x").alias("_lo"))
    second = found.join(best.select(*by, "_lo"), list(by)).join(least, list(by)).where("_off = _least AND _x > _lo").groupBy(*by).agg(F.min("_x").alias("_x2"))
    best = best.join(second, list(by), "left")
    x1 = F.col("_lo")
    x2 = F.when((F.col("_t") % 2 == 1) | (F.col("_1._n") > 1), x1).otherwise(F.coalesce("_x2", x1))
    middle = F.atan2(F.sin(x1) + F.sin(x2), F.cos(x1) + F.cos(x2))
    away = F.abs(distance(F.col("_mean"), middle)) > F.abs(distance(F.col("_mean"), middle + 3.141592653589793))
    return best.select(*by, axial(F.when(away, middle + 3.141592653589793).otherwise(middle)).alias("median"))
