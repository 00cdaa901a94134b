"""Principal components of movement: embedded features, sums of products by Spark, a small eigenproblem, scores as columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def embedded(rows: DataFrame, features: Sequence[str], window: int, by: Sequence[str] = ("session",), idx: str = "idx") -> DataFrame:
    """rows with embedding: the features of this row and of the rows around, `window` in all (one more before if even); 0 where there is none."""
    w = Window.partitionBy(*by).orderBy(idx)
    at = lambda c, k: F.col(c) if k == 0 else (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w)
    value = lambda c, k: F.coalesce(F.nanvl(at(c, k).cast("double"), F.lit(0.0)), F.lit(0.0))
    first = -(window // 2)
    return rows.withColumn("embedding", F.array(*(value(c, k) for k in range(first, first + window) for c in features)))


def gram(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(i, j, value): sums of products of the entries i <= j of an array column. Each task gives one row for each pair."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[column].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "value": total[i, j]})

    return rows.select(column).mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def components(sums: DataFrame, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, vectors as rows) of gram(), the greatest first; the entry of greatest size of each is positive.

    The table has a row for each pair of entries, whatever the number of rows behind it.
    """
    pairs = sums.toPandas()
    if not len(pairs):
        return np.zeros(0), np.zeros((0, 0))
    full = np.zeros((pairs.j.max() + 1,) * 2)
    full[pairs.i, pairs.j] = full[pairs.j, pairs.i] = pairs.value
    values, vectors = np.linalg.eigh(full)
    vectors = vectors.T[::-1][:most]
    return np.sqrt(np.maximum(values[::-1][:most], 0)), vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]


def scores(rows: DataFrame, vectors: np.ndarray, column: str = "embedding") -> DataFrame:
    """rows with score: an array of the products of the embedding with each vector."""
    dot = lambda v: F.aggregate(F.zip_with(column, F.array(*map(F.lit, v.tolist())), lambda a, c: a * c), F.lit(0.0), lambda s, p: s + p)
    return rows.withColumn("score", F.array(*map(dot, vectors)))
