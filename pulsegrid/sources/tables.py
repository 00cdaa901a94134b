"""Tables of sessions (states, trials, spikes, positions) in one folder: Parquet, a partition for each session."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def save(rows: DataFrame, root: str, kind: str, by: Sequence[str] = ("session",)) -> None:
    """Writes rows as the table `kind`; sessions that rows hold are replaced, all others stay."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(f"{root}/{kind}")


def load(spark: SparkSession, root: str, kind: str, sessions: Iterable | None = None, schema: StructType | str | None = None, session: str = "session") -> DataFrame:
    """The table `kind`, or some sessions of it: only their folders are read.

    Without a schema, names of sessions that look like numbers or dates are read as such.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{root}/{kind}")
    return rows if sessions is None else rows.where(F.col(session).isin(list(sessions)))


def lacking(spark: SparkSession, root: str, kinds: Sequence[str], sessions: DataFrame) -> DataFrame:
    """(session, kind): what each session (session) has no rows of."""
    out = None
    for kind in kinds:
        have = load(spark, root, kind).select("session").distinct()
        one = sessions.select("session").distinct().join(have, "session", "left_anti").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out
