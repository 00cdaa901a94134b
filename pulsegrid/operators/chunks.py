"""Long series as chunks: (by, bucket, n, idx, one array for each column), so that no task holds a whole session.

A bucket is a stretch of idx. Its width is chosen for each session so that buckets hold about CHUNK rows where rows are evenly spread.
What chunks must know of each other goes through a table of summaries, one row a chunk, which is scanned in order for each session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save, ship, small

CHUNK = 1 << 13
#: Entries of arrays that each() gathers before it gives them out.
EACH = 1 << 15


def pack(rows: DataFrame, by: Sequence[str], values: Sequence[str], idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """rows as chunks, saved. idx must be a number that is unique in its group; rows without one are left out."""
    ship(rows.sparkSession)
    by = list(by)
    rows = rows.where(F.col(idx).isNotNull()).select(*by, F.col(idx).alias("idx"), *values)
    extent = rows.groupBy(*by).agg(F.min("idx").alias("_low"), F.max("idx").alias("_high"), F.count("*").alias("_n"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("_high") - F.col("_low") + 1) * chunk / F.col("_n")))
    extent = extent.select(*by, "_low", width.alias("_width"))
    dealt = rows.join(extent, by).withColumn("bucket", F.floor((F.col("idx") - F.col("_low")) / F.col("_width")).cast("long"))
    made = dealt.groupBy(*by, "bucket").agg(F.sort_array(F.collect_list(F.struct("idx", *values))).alias("_r"))
    return save(made.select(*by, "bucket", F.size("_r").alias("n"), F.col("_r.idx").alias("idx"), *(F.col(f"_r.{v}").alias(v) for v in values)))


def unpack(chunks: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, idx, values) of chunks."""
    return chunks.select(*by, F.explode(F.arrays_zip("idx", *values)).alias("_r")).select(*by, F.col("_r.idx").alias("idx"), *(F.col(f"_r.{v}").alias(v) for v in values))


def keys(rows: DataFrame, by: Sequence[str]) -> str:
    """The columns of `by` as a schema in words."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)


def each(chunks: DataFrame, work: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """work(row) of each row, as a row of `schema`; columns that it doesn't give are kept."""
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for at in range(len(batch)):
                row = {c: batch[c].iat[at] for c in batch.columns}
                made.append({**row, **work(row)})
                size += sum(len(x) for x in made[-1].values() if hasattr(x, "__len__"))
                if size >= EACH or at + 1 == len(batch):  # what is made of a batch isn't held as a whole
                    yield pd.DataFrame(made, columns=names)
                    made, size = [], 0

    return chunks.mapInPandas(run, schema)


def scan(summaries: DataFrame, by: Sequence[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(summaries of a session in order of bucket), with the columns of `by` put before what it returns, saved."""
    names = list(by)

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        out = work(group.sort_values("bucket").reset_index(drop=True))
        for i, name in enumerate(names):
            out.insert(i, name, key[i])
        return out

    return save(summaries.groupBy(*names).applyInPandas(run, f"{keys(summaries, by)}, {schema}"))


def meet(chunks: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """chunks joined with a table that has one row a session or chunk, which is sent to all where it is small."""
    return chunks.join(small(table), list(on))
