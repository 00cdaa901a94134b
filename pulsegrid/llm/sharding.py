"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, number of the row), which puts equal texts side by side and parts even equal rows. Probes split the
key space; one job for each round counts the exact bytes and rows below every probe, over all
partitions, and the probes close in on each splitter until the bytes below it are within the tolerance
of its target or no row lies between its bounds. Each shard has FRAGMENTS splitters, so that the one
exchange which follows deals out fragments of near-equal bytes, whatever the keys; slots are numbered
inside fragments and shifted by the fragments' exact counts. Only probes and counts, whose number
depends on the number of shards alone, pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read

FRAGMENTS = 16
#: Part of a shard's mean bytes by which a splitter may miss its target; those inside a shard may miss by ten times as much.
TOLERANCE = 0.001
#: Probes for each open splitter and round.
PROBES = 15
ROUNDS = 200


def place(h: np.ndarray, d: np.ndarray, probe_h: np.ndarray, probe_d: np.ndarray) -> np.ndarray:
    """Number of probes (sorted pairs) that are at most (h, d)."""
    lo, hi = np.searchsorted(probe_h, h, side="left"), np.searchsorted(probe_h, h, side="right")
    for at in np.unique(lo[lo < hi]):
        mine = np.flatnonzero((lo == at) & (lo < hi))
        end = hi[mine[0]]
        lo[mine] = at + np.searchsorted(probe_d[at:end], d[mine], side="right")
    return lo


def _count(probe_h: np.ndarray, probe_d: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probe_h) + 1, np.int64), np.zeros(len(probe_h) + 1, np.int64)
        for batch in batches:
            h, d, s = (batch.column(i).to_numpy() for i in range(3))
            at = place(h, d, probe_h, probe_d)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["at", "size", "rows"])

    return run


def _below(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Exact (bytes, rows) below each probe."""
    h, d = (np.array([p[i] for p in probes], np.int64) for i in (0, 1))
    found = keys.mapInArrow(_count(h, d), "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found:
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def splitters(keys: DataFrame, parts: int, fragments: int = FRAGMENTS, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], int]:
    """Splitters of keys (h, d, size) into parts * fragments, and the number of rounds that it took."""
    total = keys.agg(F.sum("size"), F.count("*"), F.min("d"), F.max("d")).first()
    if not total[1]:
        return [], 0
    low_d, span = total[2], total[3] - total[2] + 1

    def to_key(x: int) -> tuple[int, int]:
        """The key at a place; that past all places is the greatest pair, which no row number reaches."""
        return (x // span - (1 << 63), x % span + low_d) if x < span << 64 else ((1 << 63) - 1, (1 << 63) - 1)

    n = parts * fragments
    goal = [total[0] * i / n for i in range(1, n)]
    allowed = [total[0] / parts * tolerance * (1 if i % fragments == 0 else 10) for i in range(1, n)]
    # Bounds as (place, bytes below, rows below).
    lower = [(0, 0, 0)] * (n - 1)
    upper = [((1 << 64) * span, total[0], total[1])] * (n - 1)
    done = lambda i: min(goal[i] - lower[i][1], upper[i][1] - goal[i]) <= allowed[i] or upper[i][2] - lower[i][2] <= 1 or upper[i][0] - lower[i][0] <= 1
    rounds = 0
    while rounds < ROUNDS and (open_ := [i for i in range(n - 1) if not done(i)]):
        rounds += 1
        wanted: set[int] = set()
        for a, b in {(lower[i][0], upper[i][0]) for i in open_}:
            mine = [i for i in open_ if (lower[i][0], upper[i][0]) == (a, b)]
            k = PROBES * len(mine)
            wanted.update(x for x in (a + (b - a) * j // (k + 1) for j in range(1, k + 1)) if a < x < b)
            # Where the bytes spread evenly, each splitter is close to its share of the gap.
            for i in mine:
                share = (goal[i] - lower[i][1]) / max(1, upper[i][1] - lower[i][1])
                x = a + int((b - a) * share)
                wanted.update(y for y in (x, x + 1) if a < y < b)
        probes = sorted(wanted)
        size, rows = _below(keys, [to_key(x) for x in probes])
        at = np.searchsorted(np.array(size), np.array(goal), side="right")
        for i in open_:
            j = int(at[i])
            for k in (j - 1, j):
                if 0 <= k < len(probes) and lower[i][0] < probes[k] < upper[i][0]:
                    found = (probes[k], size[k], rows[k])
                    if size[k] <= goal[i]:
                        lower[i] = found
                    else:
                        upper[i] = found
    chosen = [low[0] if g - low[1] <= up[1] - g else up[0] for g, low, up in zip(goal, lower, upper)]
    return [to_key(x) for x in np.maximum.accumulate(np.array(chosen, dtype=object))], rounds


def _assign(h: list[int], d: list[int]):
    probe_h, probe_d = np.array(h, np.int64), np.array(d, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (batch.schema.get_field_index(c) for c in ("_h", "_d"))
            at = place(batch.column(i).to_numpy(), batch.column(j).to_numpy(), probe_h, probe_d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "_fragment"])

    return run


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """docs with size, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    size is the text's UTF-8 bytes (null: none) plus 16. Shards hold near-equal bytes: as near as whole
    rows allow, repeated rows included. Null ids and texts are like others; one row goes to some shard, an empty table gives
    an empty one. Columns size, shard and slot are replaced; others pass through. Rows are numbered in a saved copy, so that all passes agree.
    """
    work = Workspace(docs.sparkSession)
    docs = docs.drop("size", "shard", "slot")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    docs = work.save(docs.withColumns({"size": size, "_h": F.xxhash64("text"), "_d": F.monotonically_increasing_id()}))
    return _deal(work, docs, docs.select(F.col("_h").alias("h"), F.col("_d").alias("d"), "size"), shards)


def _deal(work: Workspace, docs: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    found, _ = splitters(keys, shards)
    h, d = [x[0] for x in found], [x[1] for x in found]
    counts = {}
    if found:
        _, rows = _below(keys, found)
        total = keys.count()
        edges = [0, *rows, total]
        counts = {i: edges[i] for i in range(len(edges))}
    offset = [counts.get(i, 0) - counts.get(i // FRAGMENTS * FRAGMENTS, 0) for i in range(shards * FRAGMENTS)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    dealt = docs.mapInArrow(_assign(h, d), f"{schema}, _fragment long")
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("_fragment").orderBy("_h", "_d"))
    shift = F.get(F.lit(offset).cast("array<long>"), F.col("_fragment").cast("int"))
    out = dealt.withColumn("slot", within - 1 + shift).withColumn("shard", (F.col("_fragment") / FRAGMENTS).cast("int"))
    return out.drop("_h", "_d", "_fragment")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes; edge cases as for `shard`."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    work = Workspace(spark)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    # The digest of each text stands for it in the exchange.
    rows = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_d"))
    rows = work.save(rows)
    out = _deal(work, rows, rows.select(F.col("_h").alias("h"), F.col("_d").alias("d"), "size"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
