"""Selection of features for telling states apart: information first, then classifiers on one feature more at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save
from . import features as fe
from .models import BACKENDS

RESULT = (
    "state string, level int, step int, feature string, place int, accuracy double, precision_rest double, precision_state double, sensitivity_rest double, sensitivity_state double"
)


def normalise(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(rows with features less their means over their deviations, {feature: (mean, deviation)}); a constant feature is only centred."""
    made = rows.agg(*(f(x).alias(f"{n}_{x}") for x in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    known = {x: (made[f"m_{x}"] or 0.0, made[f"s_{x}"] or 1.0) for x in features}
    return rows.withColumns({x: (F.col(x) - m) / (s or 1.0) for x, (m, s) in known.items()}), known


def _predictions(train: DataFrame, test: DataFrame, ranked: Sequence[str], backend: str, seed: int) -> DataFrame:
    """test (y) with the prediction of a classifier on the first, the first two, ... features as p1, p2, ..."""
    out = test
    for k in range(1, len(ranked) + 1):
        assembled = VectorAssembler(inputCols=list(ranked[:k]), outputCol="_x", handleInvalid="skip")
        model = BACKENDS[backend](k, 2, seed).setFeaturesCol("_x").setLabelCol("y").fit(assembled.transform(train))
        out = model.transform(assembled.transform(out)).withColumn(f"p{k}", F.col("prediction").cast("int")).drop("_x", "rawPrediction", "probability", "prediction")
    return out


def accumulate(
    rows: DataFrame, features: Sequence[str], states: Sequence[str], label: str = "label", train: str = "train", key: Sequence[str] = ("session", "idx"),
    least_bits: float = 0.2, bins: int = 16, block: int = 15_000, backend: str = "logistic", most: int | None = None, seed: int = 0, squares: bool = False,
) -> DataFrame:
    """(state, level, step, feature, place, accuracy, ...) of rows (key, label, train, features): a row for each state but the last, and feature tried for it.

    Features are normalised (with squares, those and products of two are added before). From `block` draws of each state's training rows, states are told apart one
    after another by the information in features (features.select_hierarchically). For each state against those still left, classifiers
    are trained on its best feature, its two best, and so on, up to half of those selected or `most`; all of them judge the
    other rows in one pass, or the training rows if there are none. place orders the features of a state by how much each added: the first stays first.

    Without information over `least_bits` the states that are left have no rows. Rows with a null feature or another label don't count.
    """
    features, states = list(features), list(states)
    rows = rows.where(F.col(label).isin(states)).dropna(subset=features).select(*key, F.col(label).alias("label"), F.col(train).alias("_train"), *features)
    if squares:
        made = fe.quadratic(rows, features)
        features = [c for c in made.columns if c not in (*key, "label", "_train")]
        rows = made
    rows, _ = normalise(rows, features)
    rows = save(rows)
    drawn = save(fe.balanced(rows.where("_train"), "label", block, seed, key))
    order = fe.select_hierarchically(drawn, features, "label", states, least_bits, bins)
    out: list[tuple] = []
    left = list(states)
    held = rows.where("NOT _train")
    for level, (state, ranked) in enumerate(order):
        steps = min(len(ranked), most if most is not None else max(1, len(ranked) // 2))
        ranked = ranked[:steps]
        marked = lambda df: df.where(F.col("label").isin(left)).select(*ranked, (F.col("label") == state).cast("int").alias("y"))
        test = marked(held) if marked(held).limit(1).count() else marked(rows)
        judged = _predictions(marked(drawn), test, ranked, backend, seed)
        counts = [F.count_if((F.col("y") == a) & (F.col(f"p{k}") == p)).alias(f"c{k}{a}{p}") for k in range(1, steps + 1) for a in (0, 1) for p in (0, 1)]
        c = judged.agg(*counts).first()
        figures = []
        for k in range(1, steps + 1):
            n = {(a, p): c[f"c{k}{a}{p}"] for a in (0, 1) for p in (0, 1)}
            precision = [n[a, a] / max(1, n[a, a] + n[1 - a, a]) for a in (0, 1)]
            sensitivity = [n[a, a] / max(1, n[a, a] + n[a, 1 - a]) for a in (0, 1)]
            figures.append(((n[0, 0] + n[1, 1]) / max(1, sum(n.values())), *precision, *sensitivity))
        gain = np.diff([f[0] for f in figures])
        best = [0, *(1 + np.argsort(-gain, kind="stable")).tolist()]
        out += [(state, level, k + 1, ranked[k], best.index(k) + 1, *figures[k]) for k in range(steps)]
        left.remove(state)
    return rows.sparkSession.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in out], RESULT)
