"""Feature matrices: lagged information, hierarchical selection, embeddings, body frames, training samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import save, small
from . import binning

#: Leading bits of a row's hash that make its bucket in balanced().
BUCKET_BITS = 10


def lagged_information(samples: DataFrame, lags: Sequence[int], a: str, c: str, by: Sequence[str] = ("session",), idx: str = "idx") -> DataFrame:
    """(by, lag, mi): bits that bin a at a row has on bin c at the row `lag` later, around the end (rows are numbered from 0)."""
    by = list(by)
    size = samples.groupBy(*by).agg(F.count("*").alias("_t"))
    right = samples.join(size, by).select(*by, F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(idx), F.col(c).alias("_c"), "_t").withColumn(idx, F.pmod(F.col(idx) - F.col("lag"), F.col("_t"))).drop("_t")
    pairs = samples.select(*by, idx, F.col(a).alias("_a")).join(right, [*by, idx])
    return binning.mutual_information(pairs, [*by, "lag"], "_a", "_c")


def select_hierarchically(rows: DataFrame, features: Sequence[str], label: str, classes: Sequence, least_bits: float = 0.2, bins: int = 16) -> list[tuple]:
    """[(class, features)] in the order in which classes are told from those still left.

    In each round every left class is held against the other left ones; that with the greatest sum of information over
    `least_bits` goes, with its features by information. One job for each round; rounds are one less than classes.
    """
    long = rows.select(F.col(label).alias("_label"), F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("x")) for f in features))).alias("_f")).select("_label", "_f.name", "_f.x")
    w = Window.partitionBy("name")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    counts = long.withColumn("bin", F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1))).groupBy("name", "bin", "_label").agg(F.count("*").alias("n")).cache()
    left, out = list(classes), []
    while len(left) > 1:
        some = counts.where(F.col("_label").isin(left))
        both = some.withColumn("cls", F.explode(F.array(*map(F.lit, left)))).groupBy("name", "cls", "bin", (F.col("_label") == F.col("cls")).alias("own")).agg(F.sum("n").alias("n"))
        total = lambda *by: F.sum("n").over(Window.partitionBy("name", "cls", *by))
        q = both.withColumns({"t": total(), "a": total("bin"), "o": total("own")})
        mi = q.groupBy("name", "cls").agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("a") * F.col("o")))).alias("mi"))
        found = mi.where(F.col("mi") > least_bits).groupBy("cls").agg(F.sum("mi").alias("score"), F.sort_array(F.collect_list(F.struct("mi", "name")), asc=False).alias("f")).orderBy(F.desc("score"), "cls").limit(1).collect()
        if not found:
            break
        out.append((found[0].cls, [x.name for x in found[0].f]))
        left.remove(found[0].cls)
    counts.unpersist()
    return out


def quadratic(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with the squares and pairwise products of features."""
    made = {f"{a}_{c}": F.col(a) * F.col(c) for i, a in enumerate(features) for c in features[i:]}
    return rows.withColumns(made)


def yaw_consistency(yaws: DataFrame, by: Sequence[str], idx: str = "idx", shift: int = 5, marker: str = "marker") -> DataFrame:
    """(by, idx, ppc): pairwise phase consistency over markers of the yaw (column yaw) of a row against that `shift` rows before."""
    from ..functions import circular

    w = Window.partitionBy(*by, marker).orderBy(idx)
    turned = yaws.withColumn("_d", circular.wrap(F.col("yaw") - F.lag("yaw", shift).over(w))).where("_d IS NOT NULL")
    return turned.groupBy(*by, idx).agg(circular.ppc(F.col("_d")).alias("ppc"))


def body_frame(markers: DataFrame, by: Sequence[str], back: str, front: str, marker: str = "marker") -> DataFrame:
    """(by, marker, ahead, left, z): positions in the frame at `back` that points to `front`."""
    by = list(by)
    at = lambda name, c: F.max(F.when(F.col(marker) == name, F.col(c)))
    frame = markers.groupBy(*by).agg(at(back, "x").alias("_x"), at(back, "y").alias("_y"), F.atan2(at(front, "y") - at(back, "y"), at(front, "x") - at(back, "x")).alias("_yaw"))
    both = markers.join(frame, by)
    from ..functions import geometry

    ahead, left = geometry.to_frame(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("_yaw"))
    return both.select(*by, marker, ahead.alias("ahead"), left.alias("left"), "z")


def training_split(periods: DataFrame, share: float, trim: float, seed: int = 0) -> DataFrame:
    """periods (session, label, start, stop), trimmed at both ends, with train: true for about `share` of the periods of each label."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("session", "label", "start", F.lit(seed)), "session", "start"))
    n = F.count("*").over(Window.partitionBy("label"))
    kept = periods.withColumns({"start": F.col("start") + trim, "stop": F.col("stop") - trim}).where("stop > start")
    return kept.withColumn("train", rank <= F.ceil(n * share))


def balanced(rows: DataFrame, label: str, size: int, seed: int = 0, key: Sequence[str] = ("session", "idx"), times: str | None = None) -> DataFrame:
    """`size` draws with replacement from the rows of each label: rows are numbered by a hash and draws pick numbers.

    times: a column with how often a row stands for itself, which is left out of the result. Rows are numbered in buckets of their hash, so no task sorts a
    label, and only buckets that a draw falls in are.
    """
    hashed = F.xxhash64(*key, F.lit(seed))
    rows = rows.withColumns({"_h": hashed, "_w": F.lit(1).cast("long") if times is None else F.col(times).cast("long")}).withColumn("_b", F.shiftright("_h", 64 - BUCKET_BITS))
    rows = save(rows if times is None else rows.drop(times))
    totals = rows.groupBy(label, "_b").agg(F.sum("_w").alias("_t"))
    until = F.sum("_t").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    buckets = totals.select(label, "_b", (until - F.col("_t")).alias("_from"), until.alias("_to"))
    counts = totals.groupBy(label).agg(F.sum("_t").alias("_n"))
    draws = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(size)))).withColumn("_k", F.pmod(F.xxhash64(label, "draw", F.lit(seed)), F.col("_n")) + 1).drop("_n")
    draws = draws.join(buckets, label).where("_k > _from AND _k <= _to").select(label, "draw", "_b", (F.col("_k") - F.col("_from")).alias("_k"))
    draws = save(draws)
    near = rows.join(small(draws.select(label, "_b").distinct()), [label, "_b"], "left_semi")
    number = F.sum("_w").over(Window.partitionBy(label, "_b").orderBy("_h", *key).rowsBetween(Window.unboundedPreceding, 0))
    numbered = near.withColumn("_last", number)
    found = numbered.join(small(draws), [label, "_b"]).where("_k > _last - _w AND _k <= _last")
    return found.select(label, "draw", *(c for c in rows.columns if c not in (label, "_h", "_w", "_b")))
