"""Principal components of waveforms: a basis as a table, its binary files, fitting and projection; links between atoms and fibres."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small

#: A file begins with five 32-bit numbers (channels, data tag, components, centred, shift), then doubles: means, then components.
HEADER = 5


def _bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    if len(rows) != 1:
        raise FileNotFoundError(path)
    return bytes(rows[0].content)


def load_basis(spark: SparkSession, path: str, n_samples: int) -> tuple[DataFrame, dict]:
    """((ch, component, vector), header) of a basis file; component -1 is the mean of a channel."""
    raw = _bytes(spark, path)
    if len(raw) < 4 * HEADER:
        raise ValueError(f"{path}: header of {len(raw)} bytes")
    n_ch, tag, n_comp, centred, shift = np.frombuffer(raw[: 4 * HEADER], "<i4").tolist()
    if len(raw) != 4 * HEADER + 8 * n_ch * (1 + n_comp) * n_samples:
        raise ValueError(f"{path}: {len(raw)} bytes don't hold {n_ch} channels of {n_comp} components of {n_samples} samples")
    values = np.frombuffer(raw[4 * HEADER :], "<f8")
    means, vectors = values[: n_ch * n_samples].reshape(n_ch, n_samples), values[n_ch * n_samples :].reshape(n_ch, n_comp, n_samples)
    rows = [(c, -1, means[c].tolist()) for c in range(n_ch)] + [(c, k, vectors[c, k].tolist()) for c in range(n_ch) for k in range(n_comp)]
    header = {"n_channels": n_ch, "n_components": n_comp, "n_samples": n_samples, "tag": tag, "centred": bool(centred), "shift": shift}
    return spark.createDataFrame(rows, "ch int, component int, vector array<double>"), header


def save_basis(basis: DataFrame, path: str, tag: int = 0, centred: bool = True, shift: int = 0) -> None:
    """Writes a basis (ch, component, vector), whose channels and components are numbered from 0; channels times components times samples is small."""
    rows = {(r.ch, r.component): r.vector for r in basis.collect()}
    n_ch, n_comp = 1 + max(c for c, _ in rows), 1 + max(k for _, k in rows)
    order = [(c, -1) for c in range(n_ch)] + [(c, k) for c in range(n_ch) for k in range(n_comp)]
    if set(order) != set(rows):
        raise ValueError("a basis has a mean and the same components for each channel")
    data = np.array([n_ch, tag, n_comp, int(centred), shift], "<i4").tobytes() + np.array([rows[key] for key in order], "<f8").tobytes()
    spark = basis.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def fit_basis(waveforms: DataFrame, components: int) -> DataFrame:
    """(ch, component, vector) of waveforms (ch, values): means, and the directions of greatest variance of each channel.

    Sums of products are added by Spark; only they, samples squared for each channel, go to the driver. Vectors have a positive greatest entry.
    """
    at = lambda name: F.posexplode("values").alias(name, f"_{name}")
    one = waveforms.select("ch", "values", at("i"))
    pairs = one.select("ch", "i", "_i", at("j")).where("j >= i")
    products = {(r.ch, r.i, r.j): r.s for r in pairs.groupBy("ch", "i", "j").agg(F.sum(F.col("_i") * F.col("_j")).alias("s")).collect()}
    sums = {(r.ch, r.i): (r.s, r.n) for r in one.groupBy("ch", "i").agg(F.sum("_i").alias("s"), F.count("*").alias("n")).collect()}
    rows = []
    for ch in sorted({c for c, _ in sums}):
        n = 1 + max(i for c, i in sums if c == ch)
        mean = np.array([sums[ch, i][0] / sums[ch, i][1] for i in range(n)])
        second = np.array([[products[ch, min(i, j), max(i, j)] for j in range(n)] for i in range(n)]) / sums[ch, 0][1]
        _, vectors = np.linalg.eigh(second - np.outer(mean, mean))
        rows.append((ch, -1, mean.tolist()))
        for k in range(components):
            v = vectors[:, -1 - k]
            rows.append((ch, k, (v * np.sign(v[np.abs(v).argmax()])).tolist()))
    return waveforms.sparkSession.createDataFrame(rows, "ch int, component int, vector array<double>")


def project(waveforms: DataFrame, basis: DataFrame, centred: bool = True) -> DataFrame:
    """waveforms (ch, values, other columns) with component and score: the product of a waveform, less its channel's mean, and each component.

    Products are taken inside the projection; the basis is sent to all tasks after a check of its size.
    """
    mean = basis.where("component = -1").select("ch", F.col("vector").alias("_mean"))
    both = small(basis.where("component >= 0").join(mean, "ch").groupBy("ch", "_mean").agg(F.sort_array(F.collect_list(F.struct("component", "vector"))).alias("_basis")))
    rest = F.zip_with("values", "_mean", lambda x, m: x - m) if centred else F.col("values")
    dot = lambda v: F.aggregate(F.zip_with(F.col("_rest"), v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    scored = waveforms.join(both, "ch").withColumn("_rest", rest).withColumn("_scores", F.transform("_basis", lambda b: F.struct(b["component"].alias("component"), dot(b["vector"]).alias("score"))))
    return scored.select(*waveforms.columns, F.explode("_scores").alias("_s")).select(*waveforms.columns, "_s.component", "_s.score")


def atom_to_fibre(links: DataFrame, include_zero: bool = False) -> DataFrame:
    """(atom, fibre) of links (idx, fibre), the entries of a linkage file in order: atoms are numbered from 1, fibre 0 is noise."""
    found = links.select((F.col("idx") + 1).alias("atom"), "fibre")
    return found if include_zero else found.where("fibre <> 0")


def fibre_to_atoms(links: DataFrame, include_zero: bool = False) -> DataFrame:
    """(fibre, n_atoms, atoms) with the atoms of each fibre in ascending order; use atom_to_fibre() where fibres may be huge, as noise is."""
    return atom_to_fibre(links, include_zero).groupBy("fibre").agg(F.count("*").alias("n_atoms"), F.sort_array(F.collect_list("atom")).alias("atoms"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(idx, fibre) of a linkage file."""
    from .records import read_records

    return read_records(spark, path, "parents").select("idx", F.col("values")[0].cast("int").alias("fibre"))
