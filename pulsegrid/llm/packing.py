"""Packing of token sequences into as few bins of a capacity as best fit can, in bulk-synchronous rounds.

A round matches many pieces with many gaps at once. Pieces and gaps are range-sorted by falling size, gaps before pieces of the same size, and each
range is swept by a task of its own: a gap is pushed, a piece pops the gap pushed last, which is the smallest that is free and large enough (its
successor). What a range can't match, pieces at first and gaps after them, is matched between ranges by rank: only the numbers of
both go through the driver, and pieces meet gaps by an equi-join on their place in that order. So no gap is taken twice and no task
sees more than a range. A gap that could hold the largest piece several times is cut into as many gaps for the round. Then gaps are updated, and the
next round goes on with the pieces that are left.

Pieces above half the capacity open a bin each; those above a quarter follow, then the rest. When no piece of a
phase fits any more, bins are opened: at first as many as the phase's tokens fill, later as many as its pieces need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import Workspace, read
from .token_file import _encoder_of

CAPACITY = 4096
#: Rows of a range, about, and ranges at least.
RANGE_ROWS = 1 << 17
LEAST_RANGES = 12
#: Numbers of the bins that are opened for no piece of their own.
OPENED = 1 << 62


def _pieces(path: str, capacity: int, end: int):
    """Rows (doc_id, text) to (doc_id, piece, start, length, ids), ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(path)
        for whole in batches:
            for batch in words.pieces(whole, "text", 2 << 20):
                flat, at = encoder.batch(*words.raw(batch.column(1)), end)
                n = np.diff(at)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                size = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(size), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids], ["doc_id", "piece", "start", "length", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids) of docs (doc_id, text): ids of each text with `end` after them, cut after each `capacity`.

    A null or empty text has the end id only. Other columns are left out; rows that repeat have pieces each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids binary")


def matched(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of pieces, places of their gaps) of a sweep: each piece takes the last gap before it that none has taken, if any."""
    level = np.cumsum(np.where(is_piece, -1, 1))
    lowest = np.minimum.accumulate(np.minimum(level, 0))
    alone = is_piece & (lowest < np.concatenate([[0], lowest[:-1]]))
    at = np.flatnonzero(~alone)
    by = at[np.argsort(level[at] + is_piece[at], kind="stable")]
    # Of one level, gaps and pieces take turns; a gap without a piece after it stays free.
    second = np.flatnonzero(is_piece[by])
    return by[second], by[second - 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) of a range, sorted, to (part, piece, id, size, bin, rank): pieces with their bin, or else what is left with its rank."""
    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["key", "id"])])
    key, ids = (table.column(i).to_numpy() for i in range(2))
    if not len(key):
        return
    is_piece, size = key % 2 == 1, -(key // 2)
    of, gap = matched(is_piece)
    free = np.ones(len(key), bool)
    free[of] = free[gap] = False
    left = np.flatnonzero(free)
    first = int(is_piece[left].sum())
    rank = np.concatenate([np.arange(first), np.arange(len(left) - first)])
    at = np.concatenate([of, left])
    bins = pa.array(np.concatenate([ids[gap], np.zeros(len(left), np.int64)]), mask=np.arange(len(at)) >= len(of))
    ranks = pa.array(np.concatenate([np.zeros(len(of), np.int64), rank]))
    columns = [pa.array(np.full(len(at), part, np.int32)), pa.array(is_piece[at]), pa.array(ids[at]), pa.array(size[at]), bins, ranks]
    names = ["part", "piece", "id", "size", "bin", "rank"]
    whole = pa.RecordBatch.from_arrays(columns, names)
    for i in range(0, len(at), 1 << 16):
        yield whole.slice(i, 1 << 16)


def carry(left: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int, int]]:
    """Blocks (part, piece, first rank, last rank, first slot) of what is left of ranges (part, pieces, gaps), in order of parts.

    A block of pieces and one of gaps of another range share slots: pieces by rising rank, gaps by falling rank.
    """
    stack: list[list[int]] = []
    out, slot = [], 0
    for part, n_pieces, n_gaps in left:
        done = 0
        while done < n_pieces and stack:
            top = stack[-1]
            n = min(n_pieces - done, top[1])
            out.append((part, True, done, done + n - 1, slot))
            out.append((top[0], False, top[1] - n, top[1] - 1, slot))
            slot, done, top[1] = slot + n, done + n, top[1] - n
            if not top[1]:
                stack.pop()
        if n_gaps:
            stack.append([part, n_gaps])
    return out


def _round(work: Workspace, left: DataFrame, gaps: DataFrame, largest: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """One round: (pairs (item, bin, n), pieces that are left) of left (item, n) and gaps (bin, gap)."""
    spark = work.spark
    times: Column = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("int")
    cut = gaps.select("bin", "gap", times.alias("q")).select("bin", "gap", "q", F.explode(F.sequence(F.lit(1), F.col("q"))).alias("i"))
    size = F.floor(F.col("gap") / F.col("q")) + F.when(F.col("i") == F.col("q"), F.col("gap") % F.col("q")).otherwise(0)
    both = cut.select((-2 * size).cast("long").alias("key"), F.col("bin").alias("id")).unionByName(left.select((1 - 2 * F.col("n")).alias("key"), F.col("item").alias("id")))
    ranges = max(LEAST_RANGES, rows // RANGE_ROWS)
    swept = both.repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_sweep, "part int, piece boolean, id long, size long, bin long, rank long")
    swept = work.save(swept)
    rest = swept.where("bin IS NULL").drop("bin")
    counts = rest.groupBy("part").agg(F.count_if("piece").alias("pieces"), F.count_if(~F.col("piece")).alias("gaps")).collect()  # a row a range
    blocks = carry(sorted((r.part, r.pieces, r.gaps) for r in counts))
    known = F.broadcast(spark.createDataFrame(blocks, "of int, for_piece boolean, low long, high long, slot long"))  # four rows a range at most
    where = (F.col("part") == F.col("of")) & (F.col("piece") == F.col("for_piece")) & F.col("rank").between(F.col("low"), F.col("high"))
    rest = rest.join(known, where, "left")
    place = F.col("slot") + F.when(F.col("piece"), F.col("rank") - F.col("low")).otherwise(F.col("high") - F.col("rank"))
    met = rest.where("slot IS NOT NULL").groupBy(place.alias("place")).agg(
        F.max(F.when(F.col("piece"), F.col("id"))).alias("item"), F.max(F.when(~F.col("piece"), F.col("id"))).alias("bin"), F.max(F.when(F.col("piece"), F.col("size"))).alias("n")
    )
    pairs = work.save(swept.where("bin IS NOT NULL").select(F.col("id").alias("item"), "bin", F.col("size").alias("n")).unionByName(met.drop("place")))
    return pairs, rest.where("piece AND slot IS NULL").select(F.col("id").alias("item"), F.col("size").alias("n"))


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence, offset) of items (item, n): distinct longs from 0 with lengths of 1 to capacity.

    The items of a sequence lie one after another from offset 0 and have `capacity` together at most. Other lengths are an error; an
    empty table gives an empty result. Ties of size are broken by item and by sequence.
    """
    spark = items.sparkSession
    work = Workspace(spark)
    items = work.save(items.select(F.col("item").cast("long").alias("item"), F.col("n").cast("long").alias("n")))
    wrong = items.where(F.coalesce((F.col("n") < 1) | (F.col("n") > capacity) | (F.col("item") < 0), F.lit(True))).limit(1).count()
    if wrong:
        raise ValueError(f"items have numbers from 0 and lengths of 1 to {capacity}")
    large = items.where(F.col("n") > capacity // 2)
    placed = [large.select("item", F.col("item").alias("bin"), "n")]
    gaps = work.save(large.where(F.col("n") < capacity).select(F.col("item").alias("bin"), (capacity - F.col("n")).alias("gap")))
    opened = 0
    for low, high in ((capacity // 4, capacity // 2), (0, capacity // 4)):
        left = items.where((F.col("n") > low) & (F.col("n") <= high))
        openings, before = 0, None
        while True:
            s = left.agg(F.count("*").alias("count"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.max("n").alias("largest")).first()
            if not s["count"]:
                break
            fits = gaps.where(F.col("gap") >= s.least)
            rows = 0
            if s["count"] != before:
                rows = fits.agg(F.sum(F.greatest(F.lit(1), F.floor(F.col("gap") / s.largest)))).first()[0] or 0
            if not rows:
                need = -(-s.tokens // capacity) if not openings else -(-s["count"] // (capacity // s.largest))
                fresh = spark.range(OPENED + opened, OPENED + opened + need).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened, openings, before = work.save(gaps.unionByName(fresh)), opened + need, openings + 1, None
                continue
            before = s["count"]
            pairs, left = _round(work, left, fits, s.largest, rows + before)
            placed.append(pairs)
            gaps = work.save(gaps.unionByName(pairs.select("bin", (-F.col("n")).alias("gap"))).groupBy("bin").agg(F.sum("gap").alias("gap")).where("gap > 0"))
    every = placed[0].withColumn("round", F.lit(0))
    for k, pairs in enumerate(placed[1:], 1):
        every = every.unionByName(pairs.withColumn("round", F.lit(k)))
    before_it = Window.partitionBy("bin").orderBy("round", "item").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("item", F.col("bin").alias("sequence"), F.coalesce(F.sum("n").over(before_it), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, keep: Column | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset: doc_id, piece, start, length, `keep` of ids (ids itself), sequence_id, offset.

    Only texts of more than `capacity` ids are cut. Null texts, empty ones, repeated rows, null ids and other columns are as for `pieces`.
    """
    work = Workspace(docs.sparkSession)
    kept = F.col("ids") if keep is None else keep
    cut = pieces(docs, tokenizer, capacity, end)
    cut = work.save(cut.select(F.monotonically_increasing_id().alias("item"), "doc_id", "piece", "start", "length", kept))
    placed = best_fit(cut.select("item", F.col("length").alias("n")), capacity)
    return cut.join(placed, "item").drop("item").withColumnRenamed("sequence", "sequence_id")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of what `pack` returns: the ids of each sequence (32-bit numbers) and the lengths of its pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # a sequence has `capacity` pieces at most
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda x: x["length"]).alias("lengths"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens at most."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=F.crc32("ids").alias("ids_crc32"))
