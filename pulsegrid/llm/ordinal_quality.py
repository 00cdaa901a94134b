"""Text quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(theta_j - w.x) with one weight vector w over hashed text features and
ordered thresholds theta_0 < theta_1 < ... The model gives each text its expected grade and the
probability of the highest grade, by which documents are selected.

Features are the distinct lower-cased words of the whole text, hashed to 2**BITS places, and the
shape of the text (shares of kinds of characters, repetition, lengths) in bins. Fitting takes a
bounded sample of rated documents: its gradients are summed over Spark partitions in each step of
L-BFGS. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import words
from .common import Workspace, read, unused

BITS = 18
SHAPES = 1024
SIZE = (1 << BITS) + SHAPES
#: Rated documents that a fit takes at most: those with the least hash of doc_id.
SAMPLE = 20_000
#: A word gets a weight if it is in so many documents of the sample, and if their mean grade is so many standard errors off.
LEAST_DOCS = 5
LEAST_Z = 4.0
PARTITIONS = 8


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


_KINDS = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"\n", b" \t\r", bytes(range(128, 256)), *(bytes([c]) for c in b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\")]


def _shape(body: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """One place for each text and property: properties in bins on a logarithmic scale."""
    n = np.diff(offsets)
    texts = np.repeat(np.arange(len(n)), n)
    of = np.zeros(256, np.int64)
    for i, kind in enumerate(_KINDS):
        of[list(kind)] = i + 1
    counts = np.bincount(texts * (len(_KINDS) + 1) + of[body], minlength=len(n) * (len(_KINDS) + 1)).reshape(len(n), -1)[:, 1:]
    shares = counts / np.maximum(n, 1)[:, None]
    n_words = np.diff(bounds)
    same = np.zeros(len(hashes) + 1)
    np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else [], out=same[1:])
    repeated = (same[bounds[1:]] - same[bounds[:-1]]) / np.maximum(n_words, 1)
    more = np.stack([repeated, distinct / np.maximum(n_words, 1), n_words / np.maximum(n, 1)], axis=1)
    bins = np.minimum(15, np.log2(1 + 4096 * np.concatenate([shares, more], axis=1)).astype(np.int64))
    long = np.minimum(15, np.log2(1 + n_words).astype(np.int64))
    bins = np.concatenate([bins, long[:, None]], axis=1)
    return (1 << BITS) + np.arange(bins.shape[1]) * 16 + bins


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the features that each text has, number of the first of each text and the total)."""
    body, offsets = words.raw(texts)
    hashes, bounds, _ = words.hash_words(body, offsets, words.NON_ALNUM)
    v, b = words.sorted_sets(hashes >> np.uint64(64 - BITS), bounds)
    shape = _shape(body, offsets, hashes, bounds, np.diff(b))
    width = shape.shape[1]
    ends = b + np.arange(len(b)) * width
    out = np.empty(ends[-1], np.int64)
    out[np.arange(len(v)) + np.repeat(ends[:-1] - b[:-1], np.diff(b))] = v.astype(np.int64)
    out[(ends[1:, None] - width + np.arange(width)).ravel()] = shape.ravel()
    return out, ends


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in words.pieces(whole, "text"):
            v, ends = features(batch.column(1))
            places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), places, batch.column(2)], ["grade", "places", "doc_id"])


def _sums(v: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v) + 1)
    np.cumsum(weights[v], out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _levels(s: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= j) of each text for j from -1 to the highest grade."""
    inner = _sigmoid(thresholds[None, :] - s[:, None])
    return np.concatenate([np.zeros((len(s), 1)), inner, np.ones((len(s), 1))], axis=1)


def _compact(number: np.ndarray):
    """Keeps the features that get a weight, by their numbers among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(1)
            ends = places.offsets.to_numpy().astype(np.int64)
            v = number[places.values.to_numpy()[ends[0] : ends[-1]]]
            ends = np.concatenate([[0], np.cumsum(v >= 0)])[ends - ends[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(v[v >= 0]))], ["grade", "places"])

    return run


def _gradient(weights, thresholds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta = weights.value, thresholds
        loss, slope, tilt, rows = 0.0, np.zeros(len(w)), np.zeros(len(theta)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grade = batch.column(0).to_numpy()
            places = batch.column(1)
            ends = places.offsets.to_numpy().astype(np.int64)
            v = places.values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            cdf = _levels(_sums(v, ends, w), theta)
            i = np.arange(len(grade))
            high, low = cdf[i, grade + 1], cdf[i, grade]
            p = np.maximum(high - low, 1e-12)
            loss -= float(np.log(p).sum())
            slope += np.bincount(v, weights=np.repeat(1 - high - low, np.diff(ends)), minlength=len(w))
            for j in range(len(theta)):
                d = cdf[:, j + 1] * (1 - cdf[:, j + 1]) / p
                tilt[j] += float(d[grade == j + 1].sum() - d[grade == j].sum())
            rows += len(grade)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([rows]), pa.array([tilt.tobytes()], pa.binary()), pa.array([slope.tobytes()], pa.binary())], ["loss", "rows", "tilt", "slope"])

    return run


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search; f gives (value, gradient)."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1e-12, np.sqrt(q @ q))
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        for _ in range(8):
            new, new_g = f(x - step * q)
            if new <= value - 1e-4 * step * (q @ g):
                break
            step /= 4
        else:
            return x
        s, y = -step * q, new_g - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - new < 1e-6 * max(1.0, abs(value))
        x, value, g = x + s, new, new_g
        if done:
            break
    return x


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE, ridge: float = 1e-4, steps: int = 40) -> Model | None:
    """A model of ratings (doc_id, grade from 0 to grades - 1), or None without any rated document.

    Rows with a null or unknown grade are ignored; of several ratings of one doc_id the least counts.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    rated = ratings.where(f"doc_id IS NOT NULL AND grade BETWEEN 0 AND {grades - 1}").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select(F.col("grade").cast("long").alias("grade"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = texts.mapInArrow(_extract, "grade long, places array<int>, doc_id long").repartition(PARTITIONS, "doc_id")
    rows = work.save(rows.sortWithinPartitions("doc_id", F.xxhash64("places")).drop("doc_id"))
    seen = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return None
    n_rows = sum(seen.values())
    mean = sum(g * n for g, n in seen.items()) / n_rows
    spread = max(1e-9, sum((g - mean) ** 2 * n for g, n in seen.items()) / n_rows)
    places = rows.select("grade", F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n"), F.sum("grade").alias("total"))
    off = F.abs(F.col("total") - F.col("n") * mean) / F.sqrt(F.col("n") * spread)
    known = places.where((F.col("n") >= LEAST_DOCS) & ((off >= LEAST_Z) | (F.col("place") >= 1 << BITS)))
    chosen = np.array(sorted(r.place for r in known.select("place").collect()), np.int64)  # SIZE at most
    number = np.full(SIZE, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    compact = work.save(rows.mapInArrow(_compact(number), "grade long, places array<int>"))
    work.drop(rows)
    share = np.cumsum([seen.get(g, 0) + 1 for g in range(grades)]) / (sum(seen.values()) + grades)
    first = np.log(share[:-1] / (1 - share[:-1]))
    gaps = lambda t: np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    ordered = lambda u: np.cumsum(np.concatenate([u[:1], np.exp(u[1:])]))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        u, w = x[: grades - 1], x[grades - 1 :]
        shared = spark.sparkContext.broadcast(w.astype(np.float32))
        parts = compact.mapInArrow(_gradient(shared, ordered(u)), "loss double, rows long, tilt binary, slope binary").collect()
        shared.destroy()
        n = max(1, sum(r.rows for r in parts))
        tilt = sum(np.frombuffer(r.tilt) for r in parts) / n
        slope = sum(np.frombuffer(r.slope) for r in parts) / n + ridge * w
        down = np.cumsum(tilt[::-1])[::-1] * np.concatenate([[1.0], np.exp(u[1:])])
        return sum(r.loss for r in parts) / n + ridge / 2 * float(w @ w), np.concatenate([down, slope])

    x = _minimise(value, np.concatenate([gaps(first), np.zeros(len(chosen))]), steps)
    work.drop(compact)
    weights = np.zeros(SIZE, np.float32)
    weights[chosen] = x[grades - 1 :]
    return Model(weights, ordered(x[: grades - 1]))


def _score(shared, thresholds: np.ndarray, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                v, ends = features(batch.column(batch.schema.get_field_index("text")))
                cdf = _levels(_sums(v, ends, shared.value), thresholds)
                expected = (1 - cdf[:, 1:-1]).sum(axis=1)
                columns = [*batch.columns, pa.array(expected), pa.array(1 - cdf[:, -2])]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return run


def score(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("expected_grade", "p_best")) -> DataFrame:
    """docs with expected_grade and p_best (or other names), the probability of the highest grade; both null without a model.

    docs needs a string column text; a null text counts as empty. Columns named like the results are replaced.
    """
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({name: F.lit(None).cast("double") for name in names})
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(shared, model.thresholds, names), f"{schema}, `{names[0]}` double, `{names[1]}` double")


def graded(labels: DataFrame) -> DataFrame:
    """Grade 2: good and not toxic; 1: one of these fails; 0: both."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def select(docs: DataFrame, ratings: DataFrame, least: float = 0.35) -> DataFrame:
    """docs with expected_grade, p_best and keep; keep holds where p_best is `least` or more, or where nothing is rated."""
    scored = score(docs, fit(docs, ratings))
    return scored.withColumn("keep", F.coalesce(F.col("p_best") >= least, F.lit(True)))


def keep_good(docs: DataFrame, ratings: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs that select() keeps, with the columns of docs, whatever their names.

    Null texts are judged as empty ones; repeated rows are kept or dropped together; where nothing is rated all rows stay.
    """
    names = unused(docs, "expected_grade"), unused(docs, "p_best")
    return score(docs, fit(docs, ratings), names).where(F.coalesce(F.col(names[1]) >= least, F.lit(True))).select(docs.columns)


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the best grade and the decision for each document."""
    out = select(read(spark, sf_dir, "documents").select("doc_id", "text"), graded(read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_best", 6).alias("p_best"), "keep")
