"""Point processes: correlograms, intervals between events, rates, unit quality, annotations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, small
from . import rangejoin

#: Spikes that correlogram() looks up at once.
ROWS = 1 << 14


def correlogram(spikes: DataFrame, bin_size: int, half_bins: int, by: Sequence[str] = ("session",), unit: str = "unit", t: str = "t", key: str = "spike_id") -> DataFrame:
    """(by, g1, g2, bin, n): pairs of spikes by lag, over bins of -half_bins to half_bins.

    The lag is in [-W, W) with W = bin_size * (half_bins + 1/2); a spike is not paired with itself. Pairs aren't listed: in stretches of length W
    each time looks up where the bins around it begin in the times of every unit, so the work grows with the spikes and not with their pairs. A task
    holds the times of a stretch and of what it reaches.
    """
    ship(spikes.sparkSession)
    by, width = list(by), bin_size * half_bins + bin_size / 2
    rows = spikes.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("_key"), F.col(unit).alias("_unit"), F.col(t).alias("_t"))
    rows = rows.dropna(subset=[*by, "_t"])
    # Spikes of a unit at the same time are one row with their number; a row goes to its own stretch of time and, as a partner, to those it reaches.
    stretch = 8 * width
    at = lambda c: F.floor(c / F.lit(stretch)).cast("long")
    times = rows.groupBy(*by, "_unit", "_t").agg(F.count("*").alias("_n"))
    parts = times.withColumn("_at", F.explode(F.sequence(at(F.col("_t") - width), at(F.col("_t") + width)))).withColumn("_own", F.col("_at") == at(F.col("_t")))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name in by]
    kind = parts.schema["_unit"].dataType.simpleString()

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        code, units = pd.factorize(group["_unit"], use_na_sentinel=False)
        order = np.lexsort((group["_t"].to_numpy(), code))
        code, t, n, own = code[order], group["_t"].to_numpy()[order], group["_n"].to_numpy()[order], group["_own"].to_numpy()[order]
        found = np.zeros((len(units), len(units), 2 * half_bins + 1), np.int64)
        bounds = np.searchsorted(code, np.arange(len(units) + 1))
        ones = np.flatnonzero(own)
        for some in np.split(ones, range(ROWS, len(ones), ROWS)):
            for j in range(len(units)) if len(some) else ():
                two = slice(bounds[j], bounds[j + 1])
                total = np.concatenate([[0], np.cumsum(n[two])])
                each = n[some][:, None] * np.diff(total[_edges(t[two], t[some], bin_size, half_bins, width)], axis=1)
                firsts = np.flatnonzero(np.diff(code[some], prepend=-1))
                found[code[some[firsts]], j] += np.add.reduceat(each, firsts, axis=0)
        g1, g2, bins = np.nonzero(found)
        made = pd.DataFrame({name: [value] * len(bins) for name, value in zip(by, key)}, index=range(len(bins)))
        return made.assign(g1=units.take(g1), g2=units.take(g2), bin=bins - half_bins, n=found[g1, g2, bins])

    counted = parts.groupBy(*by, "_at").applyInPandas(lambda key, group: run(key[:-1], group), ", ".join([*kept, f"g1 {kind}", f"g2 {kind}", "bin int", "n long"]))
    # Pairs of rows with the same key, each with itself among them, were counted too.
    each = F.collect_list(F.struct(F.col("_unit").alias("u"), F.col("_t").alias("t")))
    alike = rows.groupBy(*by, "_key").agg(each.alias("_p"), F.count("*").alias("_many"))
    single = alike.where("_many = 1").select(*by, F.col("_p")[0]["u"].alias("g1"), F.col("_p")[0]["u"].alias("g2"), F.lit(0).alias("bin"))
    pairs = alike.where("_many > 1").select(*by, "_p", F.explode("_p").alias("_a")).select(*by, "_a", F.explode("_p").alias("_b"))
    lag = F.col("_b.t") - F.col("_a.t")
    pairs = pairs.where((lag >= -width) & (lag < width)).select(*by, F.col("_a.u").alias("g1"), F.col("_b.u").alias("g2"), F.floor(0.5 + lag / bin_size).cast("int").alias("bin"))
    same = single.unionByName(pairs.where(F.abs("bin") <= half_bins)).groupBy(*by, "g1", "g2", "bin").agg((-F.count("*")).alias("n"))
    return counted.unionByName(same).groupBy(*by, "g1", "g2", "bin").agg(F.sum("n").alias("n")).where("n > 0")


def _edges(two: np.ndarray, one: np.ndarray, bin_size: float, half_bins: int, width: float) -> np.ndarray:
    """(len(one), 2 * half_bins + 2): places in the sorted times `two` where the bins around each time of `one` begin, and where the last one ends.

    A place is where floor(0.5 + lag / bin_size) reaches the bin, by the same arithmetic as for single pairs: what searching for the edge itself
    finds is moved by as many places as rounding calls for.
    """
    bins = np.arange(-half_bins, half_bins + 2)

    def reached(place: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        lag = two[place] - one[row]
        at = np.floor(0.5 + lag / bin_size) >= bins[col]
        return np.where(col == 0, at & (lag >= -width), np.where(col == len(bins) - 1, at | (lag >= width), at))

    place = np.searchsorted(two, (one[:, None] + (bins - 0.5) * bin_size).ravel())
    row, col = np.divmod(np.arange(len(place)), len(bins))
    for step in (-1, 1):
        going = np.arange(len(place))
        while len(going):
            going = going[(place[going] > 0) if step < 0 else (place[going] < len(two))]
            hit = reached(place[going] + min(step, 0), row[going], col[going])
            going = going[hit if step < 0 else ~hit]
            place[going] += step
    return place.reshape(len(one), len(bins))


def correlogram_pairs(a: DataFrame, b: DataFrame, bin_size: int, half_bins: int, by: Sequence[str] = ("session",), t: str = "t", key: str = "spike_id") -> DataFrame:
    """The pairs that a correlogram of two trains counts: (by, columns of a, columns of b with the prefix b_, bin)."""
    width = bin_size * half_bins + bin_size / 2
    pairs = rangejoin.band(a, b, -width, width, by, t).where(F.col(key) != F.col("b_" + key))
    return pairs.withColumn("bin", F.floor(0.5 + (F.col("b_" + t) - F.col(t)) / bin_size).cast("int")).where(F.abs("bin") <= half_bins)


def normalise_correlogram(counts: DataFrame, spikes: DataFrame, bin_seconds: float, span: DataFrame, mode: str = "hz", by: Sequence[str] = ("session",), unit: str = "unit") -> DataFrame:
    """counts with value. hz: pairs per second and spike of g1; hz2: per second squared; scale: against independent trains."""
    sizes = spikes.groupBy(*by, unit).agg(F.count("*").alias("_size"))
    rows = counts.join(sizes.select(*by, F.col(unit).alias("g1"), F.col("_size").alias("_n1")), [*by, "g1"]).join(sizes.select(*by, F.col(unit).alias("g2"), F.col("_size").alias("_n2")), [*by, "g2"]).join(span, list(by))
    value = {
        "count": F.col("n").cast("double"),
        "hz": F.col("n") / (bin_seconds * F.col("_n1")),
        "hz2": F.col("n") / (bin_seconds * F.col("seconds")),
        "scale": F.col("n") * F.col("seconds") / (bin_seconds * F.col("_n1") * F.col("_n2")),
    }[mode]
    return rows.withColumn("value", value).drop("_n1", "_n2", "seconds")


def epoch_bias(epochs: DataFrame, bin_size: float, half_bins: int) -> DataFrame:
    """(bin, bias): share of the total epoch length that pairs of a lag can use; a quarter bin is lost at lag 0.

    A lag that no epoch is long enough for has a bias of 1.
    """
    lags = epochs.select((F.col("stop") - F.col("start")).cast("double").alias("length"), F.explode(F.sequence(F.lit(-half_bins), F.lit(half_bins))).alias("bin"))
    lost = F.when(F.col("bin") == 0, F.lit(0.25)).otherwise(F.abs("bin").cast("double")) * bin_size
    share = F.sum(F.greatest(F.col("length") - lost, F.lit(0.0))) / F.sum("length")
    return lags.groupBy("bin").agg(F.when(share > 0, share).otherwise(F.lit(1.0)).alias("bias"))


def intervals(spikes: DataFrame, by: Sequence[str], t: str = "t", key: str = "spike_id") -> DataFrame:
    """spikes with isi: time since the spike before of the same unit."""
    return spikes.withColumn("isi", F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(t, key)))


def contamination(spikes: DataFrame, refractory: float, by: Sequence[str], t: str = "t", key: str = "spike_id") -> DataFrame:
    """(by, n_spikes, contamination): share of intervals below the refractory time; 0 with fewer than two spikes."""
    rows = intervals(spikes, by, t, key)
    short = F.avg(F.when(F.col("isi").isNotNull(), (F.col("isi") < refractory).cast("double")))
    return rows.groupBy(*by).agg(F.count("*").alias("n_spikes"), F.coalesce(short, F.lit(0.0)).alias("contamination"))


def rates(spikes: DataFrame, bin_size: int, by: Sequence[str], t: str = "t") -> DataFrame:
    """(by, bin, n): counts in bins that have any."""
    return spikes.groupBy(*by, F.floor(F.col(t) / bin_size).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def boxcar_rates(spikes: DataFrame, bin_size: int, half: int, by: Sequence[str], t: str = "t") -> DataFrame:
    """(by, bin, n, window_n): counts in each bin that has any and in the 2 * half + 1 bins around it."""
    w = Window.partitionBy(*by).orderBy("bin").rangeBetween(-half, half)
    return rates(spikes, bin_size, by, t).withColumn("window_n", F.sum("n").over(w))


def global_ids(units: DataFrame) -> DataFrame:
    """units (shank, local) with unit: the local id moved by one more than the largest id of the shanks before.

    The offset of a shank is the running sum over shanks of (largest local id + 1).
    """
    top = units.groupBy("shank").agg((F.max("local") + 1).alias("_top"))
    before = F.coalesce(F.sum("_top").over(Window.orderBy("shank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each shank
    return units.join(small(top.withColumn("_offset", before).drop("_top")), "shank").withColumn("unit", F.col("local") + F.col("_offset")).drop("_offset")


def unit_lookup(annotations: DataFrame, units: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """annotations with the value of units that match on keys, only where exactly one does."""
    one = units.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")
    return annotations.join(one, list(keys), "left")
