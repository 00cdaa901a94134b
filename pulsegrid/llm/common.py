"""Shared helpers: working tables in the cluster's shared folder, table reading, checked broadcasts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship, work_folder

#: Characters of text on either side of a match that count as neighbourhood.
NEAR = 64
#: A table of ids may be broadcast up to this many rows (8 bytes each); beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Workspace:
    """Tables written to the shared folder: they cut lineage, survive lost executors and go when the program ends."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = work_folder(spark)
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pulsegrid_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(df._pulsegrid_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written by Spark to the shared folder with its partitions and their order; no plan is left of it."""
    sc, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if a count shows that it has `rows` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """name, or name with marks after it, such that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunked(array: Column, body: Callable[[Column], Column], size: int = 256) -> Column:
    """body over slices of an array of up to `size` elements, the results (arrays) joined: linear where body is quadratic."""
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(array, i + 1, F.lit(size)))
    return F.flatten(F.transform(slices, body))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, value, before, after) of the matches of a regular expression, in order.

    start and stop count code points from 0, stop exclusive; before and after are up to NEAR characters of the text on
    either side. The text is cut once, and positions are summed by slices, so the work stays linear in the text.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")
    size = 256

    def block(both: Column, first: Column) -> Column:
        """Matches first to first + size - 1, with starts from the end of the match before."""

        def step(acc: Column, i: Column) -> Column:
            value, gap = F.get(both["values"], i), F.get(both["gaps"], i)
            start = acc["at"] + F.length(gap)
            stop = start + F.length(value)
            left = F.concat(F.when(i > 0, F.concat(F.right(F.get(both["gaps"], i - 1), F.lit(NEAR)), F.get(both["values"], i - 1))).otherwise(F.lit("")), gap)
            right = F.concat(F.get(both["gaps"], i + 1), F.coalesce(F.get(both["values"], i + 1), F.lit("")), F.coalesce(F.left(F.get(both["gaps"], i + 2), F.lit(NEAR)), F.lit("")))
            row = F.struct(start.alias("start"), stop.alias("stop"), value.alias("value"), F.right(left, F.lit(NEAR)).alias("before"), F.left(right, F.lit(NEAR)).alias("after"))
            return F.struct(stop.alias("at"), F.array_append(acc["out"], row).alias("out"))

        last = F.least(first + (size - 1), F.size(both["values"]) - 1)
        return F.aggregate(F.sequence(first, last), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def whole(both: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(both["values"]) - 1, F.lit(size)), lambda i: block(both, i))

        def shift(done: Column) -> Column:
            ends = F.aggregate(done, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b["at"]))

            def moved(by: Column) -> Column:
                return F.flatten(F.transform(done, lambda b, i: F.transform(b["out"], lambda m: F.struct(
                    (m["start"] + F.get(by, i)).alias("start"), (m["stop"] + F.get(by, i)).alias("stop"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))))

            return let(ends, moved)

        return F.when(F.size(both["values"]) > 0, let(blocks, shift)).otherwise(empty)

    return let(F.struct(values.alias("values"), gaps.alias("gaps")), whole)


def range_bounds(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Lower bounds of all but the first of up to `parts` ranges of (a, b), both longs without nulls, that hold about as many rows each.

    Spark's range partitioner finds them from a sample; only the keys are shuffled.
    """
    dealt = keys.select("a", "b").repartitionByRange(parts, "a", "b")
    rows = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("a", "b")).alias("low")).collect()
    return sorted((r.low.a, r.low.b) for r in rows)[1:]


def range_of(a: Column, b: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of the range of (a, b): how many bounds are at most that, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps([{"a": x, "b": y} for x, y in bounds])), "array<struct<a:long,b:long>>")
    key = F.struct(a.alias("a"), b.alias("b"))

    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(known, at + width - 1) <= key, at + width).otherwise(at)

    widths = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)
