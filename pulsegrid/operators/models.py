"""Models: Bayesian decoding as a plan, hidden Markov states (operators/hmm.py), classifier ensembles of Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, small
from .hmm import gauss_hmm, hmm_states  # noqa: F401

FLOOR = 1e-3


def _sent(rates: DataFrame):
    """F.broadcast if the map is small, by one count: a table of its bins or units is no larger."""
    return F.broadcast if rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df


def dense_map(rates: DataFrame) -> DataFrame:
    """rates (bin, unit, rate) with every pair of a bin and a unit; missing ones have rate 0. Bins times units must fit a broadcast."""
    grid = rates.select("bin").distinct().crossJoin(small(rates.select("unit").distinct()))
    return grid.join(rates, ["bin", "unit"], "left").fillna(0.0, ["rate"])


def decode(counts: DataFrame, rates: DataFrame, window: float, by: Sequence[str]) -> DataFrame:
    """(by, best, posterior): the bin of greatest posterior and its value, for counts (by, unit, n).

    log p(bin) = sum over units of n log(rate + FLOOR) - window * sum of (rate + FLOOR); ties go to the least bin.
    The map is joined as one row for each unit, so each count is read once and sums are partial.
    """
    by = list(by)
    sent = _sent(rates)
    prior = rates.groupBy("bin").agg((-F.sum(F.col("rate") + FLOOR) * window).alias("_p"))
    rows = counts.join(sent(rates.select("unit", "bin", F.log(F.col("rate") + FLOOR).alias("_l"))), "unit")
    score = rows.groupBy(*by, "bin").agg(F.sum(F.col("n") * F.col("_l")).alias("_s")).join(sent(prior), "bin").withColumn("_s", F.round(F.col("_s") + F.col("_p"), 9))
    top = F.max("_s").over(Window.partitionBy(*by))
    peak = score.withColumn("_top", top)
    return peak.groupBy(*by).agg(F.min(F.when(F.col("_s") == F.col("_top"), F.col("bin"))).alias("best"), (1 / F.sum(F.exp(F.col("_s") - F.col("_top")))).alias("posterior"))


#: Classifiers by name; further ones can be added.
BACKENDS = {
    "forest": lambda n_features, n_classes, seed: RandomForestClassifier(numTrees=20, seed=seed),
    "mlp": lambda n_features, n_classes, seed: MultilayerPerceptronClassifier(layers=[n_features, 25, n_classes], seed=seed, maxIter=60),
    "logistic": lambda n_features, n_classes, seed: LogisticRegression(maxIter=50),
    "boosted": lambda n_features, n_classes, seed: GBTClassifier(seed=seed, maxIter=10),
}


def register(name: str, make) -> None:
    """Adds a classifier: make(n_features, n_classes, seed) gives an estimator of Spark ML."""
    BACKENDS[name] = make


def train_ensemble(rows: DataFrame, features: Sequence[str] | str, label: str, backend: str = "forest", members: int = 3, seed: int = 0) -> list:
    """Models of bootstrap samples of rows (with replacement); boosted trees take two classes only."""
    n_classes = int(rows.agg(F.max(label)).first()[0]) + 1
    column = features if isinstance(features, str) else "_features"
    steps = [] if isinstance(features, str) else [VectorAssembler(inputCols=list(features), outputCol=column, handleInvalid="skip")]
    n_features = rows.schema[column].metadata.get("ml_attr", {}).get("num_attrs") if isinstance(features, str) else len(features)
    if n_features is None:
        n_features = len(rows.select(column).first()[0])
    out = []
    for i in range(members):
        estimator = BACKENDS[backend](n_features, n_classes, seed + i).setFeaturesCol(column).setLabelCol(label)
        out.append(Pipeline(stages=[*steps, estimator]).fit(rows.sample(withReplacement=True, fraction=1.0, seed=seed + i)))
    return out


def predict_ensemble(models: list, rows: DataFrame) -> DataFrame:
    """rows with probability (array: mean over the models) and prediction."""
    from pyspark.ml.functions import vector_to_array

    keep = list(rows.columns)
    for i, model in enumerate(models):
        made = model.transform(rows)
        rows = made.select(*rows.columns, vector_to_array("probability").alias(f"_p{i}"))
    names = [f"_p{i}" for i in range(len(models))]
    mean: Column = F.transform(F.arrays_zip(*names), lambda p: sum((p[n] for n in names[1:]), p[names[0]]) / len(names))
    rows = rows.select(*keep, mean.alias("probability"))
    return rows.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def save_ensemble(spark, models: list, folder: str) -> None:
    """Writes the models of an ensemble to a folder, with the list of them last."""
    for i, model in enumerate(models):
        model.write().overwrite().save(f"{folder}/member={i}")
    spark.createDataFrame([(i,) for i in range(len(models))], "member int").coalesce(1).write.mode("overwrite").json(f"{folder}/members")


def load_ensemble(spark, folder: str) -> list:
    members = sorted(r.member for r in spark.read.schema("member int").json(f"{folder}/members").collect())
    return [PipelineModel.load(f"{folder}/member={i}") for i in members]


def decode_position(counts: DataFrame, rates: DataFrame, centres: DataFrame, window: float, by: Sequence[str], sigma: float | None = None) -> DataFrame:
    """(by, n_units, peak, com, local): greatest bin's centre, posterior mean, and the mean under a Gaussian of sigma around the greatest bin.

    centres: (bin, x). Further axes are decoded by calling it with their centres; the scores are the same.
    """
    by = list(by)
    sent = _sent(rates)
    prior = rates.groupBy("bin").agg((-F.sum(F.col("rate") + FLOOR) * window).alias("_p"))
    rows = counts.join(sent(rates.select("unit", "bin", F.log(F.col("rate") + FLOOR).alias("_l"))), "unit")
    score = rows.groupBy(*by, "bin").agg(F.sum(F.col("n") * F.col("_l")).alias("_s"), F.count_distinct("unit").alias("_u"))
    score = score.join(sent(prior.join(centres, "bin")), "bin").withColumn("_s", F.round(F.col("_s") + F.col("_p"), 9))
    w = Window.partitionBy(*by)
    score = score.withColumn("_top", F.max("_s").over(w)).withColumn("_w", F.exp(F.col("_s") - F.col("_top")))
    score = score.withColumn("_at", F.min_by("x", F.struct(-F.col("_s"), F.col("bin"))).over(w))
    near = F.col("_w") * (F.exp(-(F.col("x") - F.col("_at")) * (F.col("x") - F.col("_at")) / (2 * sigma * sigma)) if sigma else F.lit(1.0))
    out = score.withColumn("_near", near).groupBy(*by).agg(
        F.max("_u").alias("n_units"), F.first("_at").alias("peak"), (F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("com"), (F.sum(F.col("_near") * F.col("x")) / F.sum("_near")).alias("local")
    )
    return out
