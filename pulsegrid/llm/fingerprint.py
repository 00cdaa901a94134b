"""Document fingerprints: bottom-k sketches of shingle hashes; DataFrame functions only.

A sketch is the sorted array of the K least hashes of a text's distinct word shingles. Sketches of
parts merge into the sketch of the whole; two sketches estimate resemblance and containment, one the
number of distinct shingles. Where a text has fewer than K shingles the figures are exact but for
collisions of 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, let, range_bounds, range_of, read

K = 128
WIDTH = 5
#: Documents in a bucket of neighbours, and the most buckets.
BUCKET_ROWS = 64
MOST_BUCKETS = 1 << 16
#: Shingles of a part of a long text.
PART = 4096


def _least(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text: lower-cased words between white space, shingles of `width` words.

    Fewer words: the whole sequence is one shingle. A null text or one without words has an empty sketch.
    A text of more than PART words is sketched in parts, which overlap by width - 1 words, and these are merged.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def shingles(h: Column, first: Column, last: Column) -> Column:
        return F.transform(F.sequence(first, last), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))

    def of(h: Column) -> Column:
        end = F.size(h) - width
        parts = F.sequence(F.lit(0), end, F.lit(PART))
        merged = F.aggregate(parts, F.array().cast("array<bigint>"), lambda acc, i: merge(acc, _least(shingles(h, i, F.least(i + (PART - 1), end)), k), k))
        one = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))
        many = F.when(end < PART, _least(shingles(h, F.lit(0), end), k)).otherwise(merged)
        return F.when(F.size(h) >= width, many).when(F.size(h) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of rows; each task sends k hashes of a group at most."""
    ranked = df.select(*by, F.explode(column).alias("hash")).distinct()
    least = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).where(F.col("n") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets; 1 for two empty ones."""
    hits = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(merge(a, b, k), hits))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as base64 of its hashes, big-endian; empty for an empty one."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, tie and columns) with next: a struct of the columns of the row after it by descending doc_id.

    Ties of doc_id are in the order of tie; null ids come last; after the last row comes the first; an empty table
    gives an empty one. Rows are dealt out in ranges of neighbouring (doc_id, tie) that hold about as many rows each,
    so neither far-off nor repeated ids crowd one of them. A range's last row finds its successor in a copy of the
    next range's first row, of which there are MOST_BUCKETS at most.
    """
    # Descending order: bits are inverted, which unlike a change of sign can't overflow.
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = docs.withColumns({"_a": F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)), "_b": F.col("tie")})
    keys = rows.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    n = keys.count()
    bounds = range_bounds(keys, max(1, min(MOST_BUCKETS, n // BUCKET_ROWS)))
    rows = rows.withColumn("_bucket", range_of(F.col("_a"), F.col("_b"), bounds))
    key = F.struct(F.col("_a").alias("id"), F.col("_b").alias("tie"))
    heads = rows.groupBy("_bucket").agg(F.min(key).alias("key"))
    order = Window.orderBy("_bucket")
    heads = heads.withColumn("_before", F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy())))
    heads = Workspace(docs.sparkSession).save(heads)
    mine = F.broadcast(heads.select(F.col("_bucket"), F.col("key.id").alias("_id"), F.col("key.tie").alias("_tie"), "_before"))
    first = rows.withColumns({"_id": F.col("_a"), "_tie": F.col("_b")}).join(mine, ["_bucket", "_id", "_tie"])
    first = first.dropDuplicates(["_bucket"]).select(F.col("_before").alias("_bucket"), F.lit(True).alias("_copy"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tie"), *columns)
    both = rows.select("_bucket", F.lit(False).alias("_copy"), "doc_id", "tie", *columns).unionByName(first)
    within = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "tie")
    return both.withColumn("next", F.lead(F.struct(*columns)).over(within)).where("NOT _copy").drop("_bucket", "_copy")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness of both and of the next document's."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"tie": F.xxhash64("text"), "sketch": sketch(F.col("text"))})
    rows = with_next(docs, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
        F.round(distinct_count(F.col("sketch")), 3).alias("distinct_shingles"),
        F.round(containment(F.col("sketch"), F.col("edited_sketch")), 6).alias("contained_in_edited"),
    )
