"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit
   digest of the shingle set and the k least shingle hashes. Documents with equal sets form one
   class; from here on work is on classes.
2. Inverted lists: two sets with Jaccard similarity of `similarity` or more share at least `least`
   of their k retained values (the odds against are below MISS). So it is enough to index the
   k - least + 1 values of each class that fewest classes retain: two such classes meet in a list.
   Values of common passages are left out unless a class has little else.
   A class so small that its partners' sketches hold their whole sets needs only the exact prefix,
   n - ceil(similarity * n) + 1 values.
3. Lists of up to SMALL classes give pairs. In longer ones each class is compared with three pivots.
   What a long list holds of several components then gets a second index: the exact prefix of the full
   sets, rarest shingles first by counts over all of these texts, so that a shared template is in no
   list unless it makes up nearly all of a text. Pairs and pivots follow as before; what is left of
   long lists is compared in blocks of bounded size, so that no link between components is lost.
4. A pair's union sketch estimates its similarity; pairs that may reach the threshold are verified
   on their full shingle sets. Components follow by star contraction.

Sets are of 63-bit hashes of shingles: two different shingles of one pair of texts are taken for one with
odds of about n * n / 2**63, n being the number of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import BROADCAST_ROWS, Workspace, read, small
from .graph import components

#: Size of a sketch.
K = 24
#: Odds of a pair at the threshold to share fewer retained values than the index relies on.
MISS = 1e-6
#: Longest list that is expanded into its pairs.
SMALL = 64
#: Classes and, as far as texts aren't longer, shingles in a block of a long list.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
PIVOTS = 3
#: Counters of shingles, by which rare ones come first; their number decides on lengths of lists, not on results.
COUNTERS = 1 << 18


def least_shared(similarity: float, k: int = K) -> int:
    """Most values that two sets at the threshold share in a sketch of size k but for odds of MISS."""
    below = 0.0
    for n in range(k + 1):
        below += comb(k, n) * similarity**n * (1 - similarity) ** (k - n)
        if below > MISS:
            return max(1, n)
    return k


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    body, offsets = words.raw(texts)
    hashes, bounds, _ = words.hash_words(body, offsets)
    found, bounds = words.shingles(hashes, bounds, width)
    return words.sorted_sets(found >> np.uint64(1), bounds)


def _profile(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                v, bounds = _sets(batch.column(1), width)
                n = np.diff(bounds)
                digest = []
                for salt in (np.uint64(0x51), np.uint64(0xA7 << 32)):
                    total = np.zeros(len(v) + 1, np.uint64)
                    np.cumsum(words.mix(v ^ salt), out=total[1:])
                    digest.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                kept = np.minimum(n, k)
                ends = np.concatenate([[0], np.cumsum(kept)])
                at = np.repeat(bounds[:-1] - ends[:-1], kept) + np.arange(ends[-1])
                sketch = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v[at].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), sketch], ["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text_a"):
                a, at = _sets(batch.column(2), width)
                b, bt = _sets(batch.column(3), width)
                ok = [_similar(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]], percent) for i in range(batch.num_rows)]
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _estimate(similarity: float, k: int):
    """Column: the pair (na, sa, nb, sb) may reach the threshold, by sizes and by the sketch of the union."""
    shared = F.array_intersect("sa", "sb")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    hits = F.size(F.array_intersect(union, shared))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(100 * similarity)
    return fits & (hits * k >= least_shared(similarity, k) * F.size(union))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Size of the intersection of each set of a with each of b: products of 0/1 matrices over the values that both sides have."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    codes = np.intersect1d(*flat)
    out = np.zeros((len(a), len(b)), np.float32)
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    at = [np.searchsorted(codes, x) for x in flat]
    known = [(p < len(codes)) & (codes[np.minimum(p, len(codes) - 1)] == x) if len(codes) else np.zeros(len(x), bool) for p, x in zip(at, flat)]
    for start in range(0, len(codes), step):
        part = []
        for side, x in enumerate((a, b)):
            m = np.zeros((len(x), step), np.float32)
            here = known[side] & (at[side] >= start) & (at[side] < start + step)
            m[row[side][here], at[side][here] - start] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _block(width: int, percent: int, k: int, least: int):
    def run(group):
        """Links between components in one block of a list: rows of the list (q false) against those outside its largest component (q true)."""
        import pandas as pd

        group = group.drop_duplicates(["rep", "q"])
        rows, asked = group[~group.q].reset_index(drop=True), group[group.q].reset_index(drop=True)
        out = []
        if len(rows) and len(asked):
            sets = [[v[b[i] : b[i + 1]] for i in range(len(b) - 1)] for v, b in (_sets(pa.array(x.text), width) for x in (rows, asked))]
            shared = _overlaps([x[:k] for x in sets[1]], [x[:k] for x in sets[0]])
            na, nb = (np.array([len(s) for s in x]) for x in (sets[1], sets[0]))
            ok = np.minimum.outer(na, nb) * 100 >= np.maximum.outer(na, nb) * percent
            need = np.minimum(least, np.ceil(0.3 * np.minimum.outer(na, nb)))
            ok &= (shared >= need) & (asked.comp.to_numpy()[:, None] != rows.comp.to_numpy()[None, :])
            ok &= ~(rows.outside.to_numpy()[None, :] & (asked.rep.to_numpy()[:, None] > rows.rep.to_numpy()[None, :]))
            x, y = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if len(x):
                shared = _overlaps([sets[1][i] for i in x], [sets[0][i] for i in y])
                linked = 100 * shared >= percent * (na[x][:, None] + nb[y][None, :] - shared)
                ok[np.ix_(x, y)] &= linked
            i, j = np.nonzero(ok)
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while above.get(x, x) != x:
                    x = above[x]
                return x

            for x, y in zip(i.tolist(), j.tolist()):
                p, q = top(int(asked.comp[x])), top(int(rows.comp[y]))
                if p != q:
                    above[p] = q
                    out.append((int(asked.rep[x]), int(rows.rep[y])))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _count_shingles(width: int):
    """Rows (slot, n): shingles of all texts of a task, counted by a part of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                v, _ = _sets(batch.column(0), width)
                total += np.bincount((v % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    return run


def _exact_prefix(shared, width: int, percent: int):
    """Rows (rep, n, comp, text) to (rep, n, comp, value): the rarest values of each set, two of which similar sets share at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                v, bounds = _sets(batch.column(3), width)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((v, shared.value[(v % np.uint64(COUNTERS)).astype(np.int64)], text))
                first = np.arange(len(v)) - np.repeat(bounds[:-1], n) < np.repeat(n - (percent * n + 99) // 100 + 1, n)
                of = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(3)), pa.array(v[order][first].astype(np.int64))], ["rep", "n", "comp", "value"])

    return run


def _meet(work: Workspace, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components from an index (value, rep, n, comp), and its rows in lists that were too long to expand."""
    index = work.save(index)
    lengths = index.groupBy("value").agg(F.count("*").alias("length"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("length > 1 AND low < high")
    lengths = work.save(lengths.select("value", "length"))
    listed = work.save(index.join(lengths, "value"))  # written, so that the join may split a long list and only short ones are grouped
    work.drop(index)
    short = listed.where(F.col("length") <= SMALL).groupBy("value").agg(F.sort_array(F.collect_set(F.struct("rep", "comp"))).alias("r"))
    later = "flatten(transform(r, (x, i) -> transform(filter(slice(r, i + 2, size(r)), y -> y.comp <> x.comp), y -> struct(x.rep AS a, y.rep AS b))))"
    pairs = short.select(F.explode(F.expr(later)).alias("p")).select("p.a", "p.b")
    hot = listed.where(F.col("length") > SMALL)
    one = F.struct("rep", "comp")
    pivots = hot.groupBy("value").agg(*(F.min_by(one, F.xxhash64("rep", F.lit(i)) if i else F.col("rep")).alias(f"p{i}") for i in range(PIVOTS)))
    to_pivots = hot.join(small(work.save(pivots), BROADCAST_ROWS // 4), "value").select("rep", "comp", F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("p"))
    to_pivots = to_pivots.where("comp <> p.comp").select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))
    return pairs.unionByName(to_pivots).distinct(), hot


def _split(hot: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (value, rep, n, comp) of the long lists that are in several components still."""
    member = hot.drop("comp").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    apart = member.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return member.join(apart.select("value"), "value")


def _between(work: Workspace, rows: DataFrame, texts: DataFrame, block) -> DataFrame:
    """Links (u, v) between components of lists (value, rep, n, comp): what is outside a list's largest component against all of it, in blocks."""
    rows = work.save(rows)
    shares = rows.groupBy("value", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    lists = shares.groupBy("value").agg(
        F.max_by("comp", F.struct("rows", "comp")).alias("largest"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max_by("n", F.struct("rows", "comp")).alias("most_n"), F.max("rows").alias("most")
    )
    lists = lists.select("value", "largest", blocks(F.col("rows"), F.col("n")).alias("blocks"), blocks(F.col("rows") - F.col("most"), F.col("n") - F.col("most_n")).alias("asks"))
    spread = rows.drop("n").join(lists, "value").join(texts, "rep").withColumn("outside", F.col("comp") != F.col("largest"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    kept = ("value", "rep", "comp", "text", "outside")
    listed = spread.select(*kept, F.lit(False).alias("q"), own("blocks").alias("block"), every("asks").alias("ask"))
    asked = spread.where("outside").select(*kept, F.lit(True).alias("q"), every("blocks").alias("block"), own("asks").alias("ask"))
    return listed.unionByName(asked).groupBy("value", "block", "ask").applyInPandas(block, "u long, v long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, k: int = K) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text string).

    A document's set holds the distinct runs of `width` words after A-Z are lower-cased (fewer words:
    the whole sequence); documents are linked at Jaccard `similarity` (in hundredths) or more.
    component_id is the least doc_id reachable, kept tells the document that has it. Documents without
    words are linked with nothing. Rows of one doc_id count as one document; a null doc_id gives a null
    component_id and is kept. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    percent = round(100 * similarity)
    least = least_shared(similarity, k)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = work.save(docs.mapInArrow(_profile(width, k), "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>"))
    classes = work.save(
        profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    )
    values = classes.select("rep", "n", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    size = f"least(n, {k})"
    indexed = f"if(n <= {k * percent // 100}, n - (n * {percent} + 99) div 100 + 1, least({k - least + 1}, {size}))"
    prefix = (
        values.join(common, "value").groupBy("rep").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("lists", "value"))).alias("known"))
        .select("rep", "n", F.explode(F.expr(f"slice(known, 1, cast(greatest(0, {indexed} - ({size} - size(known))) AS int))")).alias("x"))
        .select(F.col("x.value").alias("value"), "rep", "n", F.col("rep").alias("comp"))
    )
    pairs, hot = _meet(work, prefix)
    side = classes.select("rep", "n", "sketch")
    def texts_of(ids: DataFrame) -> DataFrame:
        own = docs.join(small(ids.distinct()), "doc_id", "left_semi")
        return own.withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"]).drop("t")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
        candidates = work.save(both.where(_estimate(similarity, k)).select("a", "b").distinct())
        texts = work.save(texts_of(candidates.select(F.explode(F.array("a", "b")).alias("doc_id"))))
        full = candidates.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        links = work.save(full.mapInArrow(_verify(width, percent), "a long, b long").toDF("u", "v").distinct())
        work.drop(texts, candidates)
        return links

    links = confirm(pairs)
    found = components(work, links)
    rest = work.save(_split(hot, found).select("rep", "n", "comp").distinct())
    if not rest.isEmpty():
        texts = work.save(rest.join(texts_of(rest.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep"), "rep"))
        slots = texts.select("text").mapInArrow(_count_shingles(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
        counts = np.zeros(COUNTERS, np.int64)
        counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
        shared = spark.sparkContext.broadcast(counts)
        pairs, hot = _meet(work, texts.select("rep", "n", "comp", "text").mapInArrow(_exact_prefix(shared, width, percent), "rep long, n long, comp long, value long"))
        links = work.save(links.unionByName(confirm(pairs)))
        found = components(work, links)
        more = work.save(_between(work, _split(hot, found), texts.select("rep", "text"), _block(width, percent, k, least)))
        if not more.isEmpty():
            found = components(work, links.unionByName(more))
    whole = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = profile.drop("sketch").join(whole, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), similarity=0.85, width=3)


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs without the documents whose near-duplicate of a lesser doc_id stays; of rows with one doc_id, one stays."""
    work = Workspace(docs.sparkSession)
    found = work.save(near_duplicates(docs, similarity, width))
    gone = found.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(small(gone), "doc_id", "left_anti")
    repeated = work.save(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    repeated = small(repeated)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)
