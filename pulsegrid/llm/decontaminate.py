"""Benchmark decontamination: a BM25 index of test items, searched with block-max bounds by every training passage.

The index has an inverted list for each term: the entries that hold it with their BM25 impacts, divided by
the score that the entry reaches with its own text, so that 1 is a full match whatever the length. Lists are
in blocks with the greatest impact of each; blocks of all lists begin at the same entries, every BLOCK of
them. A passage (PASSAGE words, one every STRIDE words) is searched as WAND does it: where the greatest impacts
of its terms' lists together stay below the threshold it is done; otherwise the maxima of its terms' blocks are
summed, blocks that stay below are skipped in all lists, and the postings of the others are scored exactly.
No passage or item above the threshold is lost. What is retrieved is verified: both the question and
the answer of the item must overlap with the document's words around the passage.

An item of more than ENTRY words is cut into even entries of ENTRY words at most, so that each lies whole
in some passage; the index holds entries. Passages that retrieve entries of a cut item are verified as
runs: the words around them, as far to either side as the item is long, where these adjoin.

One pass over the documents, without a shuffle. The index is broadcast in parts of about PART_POSTINGS postings
(12 bytes each at most, and as much for the shingles of the items), an item in one part; more than PARTS_AT_ONCE
parts take further passes, so what is broadcast is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Workspace, read, small

K1, B = 1.2, 0.75
BLOCK = 16
PART_POSTINGS = 1 << 17
PARTS_AT_ONCE = 8
PASSAGE, STRIDE = 96, 32
#: So many words in a row lie whole in some passage wherever they start.
ENTRY = PASSAGE - STRIDE
SHINGLE = 5
#: Items of fewer words are no evidence: ordinary texts hold them.
LEAST_WORDS = SHINGLE


@dataclass
class Part:
    """Items of one part of the index."""

    ids: np.ndarray
    length: np.ndarray  # words of the item
    owner: np.ndarray  # item of each entry
    terms: np.ndarray  # sorted hashes
    list_max: np.ndarray  # greatest impact of each term
    blocks: np.ndarray  # first block of each term, and the total
    place: np.ndarray  # of each block: its entries are from place * BLOCK on
    block_max: np.ndarray
    postings: np.ndarray  # first posting of each block, and the total
    within: np.ndarray  # of each posting: its entry, counted from the first of the block
    impact: np.ndarray
    question: list[np.ndarray]  # shingle hashes
    answer: list[np.ndarray]


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): parted after the last question mark, else before the last sentence, else at the middle word."""
    head, mark, tail = text.rpartition("?")
    if mark and tail.strip():
        return head + mark, tail
    parts = re.split(r"(?<=[.!])\s+", text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    tokens = text.split()
    return " ".join(tokens[: len(tokens) // 2]), " ".join(tokens[len(tokens) // 2 :])


def _shingle_sets(texts: list[str]) -> list[np.ndarray]:
    body, offsets = words.raw(pa.array(texts, pa.string()))
    hashes, bounds, _ = words.hash_words(body, offsets, words.NON_ALNUM)
    v, b = words.sorted_sets(*words.shingles(hashes, bounds, SHINGLE))
    return [v[b[i] : b[i + 1]] for i in range(len(texts))]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = words.raw(batch.column(1))
        hashes, bounds, _ = words.hash_words(body, offsets, words.NON_ALNUM)
        n = np.diff(bounds).astype(np.int64)
        item = np.repeat(np.arange(batch.num_rows), n)
        # Entries are numbered over the batch; the words of an item are dealt evenly to its entries.
        parts = -(-n // ENTRY)
        before = np.cumsum(parts) - parts
        entry = before[item] + (np.arange(len(item)) - np.asarray(bounds)[item]) * parts[item] // n[item]
        owner, length = np.repeat(np.arange(batch.num_rows), parts), np.bincount(entry, minlength=int(parts.sum()))
        key, tf = np.unique(np.stack([entry.astype(np.uint64), hashes]), axis=1, return_counts=True) if len(hashes) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
        e = key[0].astype(np.int64)
        i = owner[e]
        columns = [batch.column(0).take(pa.array(i)), pa.array(e - before[i]), pa.array(key[1].view(np.int64)), pa.array(tf), pa.array(length[e].astype(np.int64)), pa.array(n[i])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "entry", "term", "tf", "length", "words"])


def build_index(items: DataFrame) -> Iterator[Part]:
    """Parts of the index of items (item_id, text). Statistics (document frequency, mean length) are over all items, by Spark.

    Null texts and texts of fewer than LEAST_WORDS words are left out; rows of one item_id and text count once.
    """
    items = items.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    work = Workspace(items.sparkSession)
    items = work.save(items.withColumn("item", F.xxhash64("item_id", "text")))
    schema = "item long, entry long, term long, tf long, length long, words long"
    postings = work.save(items.select("item", "text").mapInArrow(_postings, schema).where(F.col("words") >= LEAST_WORDS))
    stats = postings.groupBy("item", "entry").agg(F.max("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not stats.n:
        return
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(stats.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / stats.mean)
    weight = postings.join(df, "term").withColumn("weight", idf * F.col("tf") * (K1 + 1) / norm)
    own = weight.groupBy("item", "entry").agg(F.sum("weight").alias("own"))
    impacts = work.save(weight.join(own, ["item", "entry"]).select("item", "entry", "words", "term", (F.col("weight") / F.col("own")).alias("impact")))
    n_parts = max(1, -(-impacts.count() // PART_POSTINGS))
    for part in range(n_parts):
        mine = items.where(F.pmod("item", F.lit(n_parts)) == part)
        rows = sorted(mine.collect(), key=lambda r: (r.item_id, r.item))
        found = impacts.where(F.pmod("item", F.lit(n_parts)) == part).toArrow()
        if not found.num_rows:
            continue
        at = {r.item: i for i, r in enumerate(rows)}
        item = np.array([at[x] for x in found.column("item").to_pylist()], dtype=np.int64)
        length = np.zeros(len(rows), np.int64)
        length[item] = found.column("words").to_numpy()
        entries = np.maximum(1, -(-length // ENTRY))
        entry = (np.cumsum(entries) - entries)[item] + found.column("entry").to_numpy()
        pairs = [split_item(r.text) for r in rows]
        lists = _lists(found.column("term").to_numpy().view(np.uint64), entry, found.column("impact").to_numpy().astype(np.float32))
        ids = np.array([r.item_id for r in rows], np.int64)
        yield Part(ids, length, np.repeat(np.arange(len(rows)), entries), *lists, _shingle_sets([q for q, _ in pairs]), _shingle_sets([a for _, a in pairs]))


def _lists(term: np.ndarray, entry: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, ...]:
    """terms, list_max, blocks, place, block_max, postings, within and impact of a Part from its postings in any order."""
    terms, which = np.unique(term, return_inverse=True)
    order = np.lexsort((entry, which))
    which, entry, impact = which[order], entry[order], impact[order]
    place = entry // BLOCK
    fresh = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] != place[:-1])]))
    block_max = np.maximum.reduceat(impact, fresh)
    blocks = np.searchsorted(which[fresh], np.arange(len(terms) + 1))
    list_max = np.maximum.reduceat(block_max, blocks[:-1])
    return terms, list_max, blocks, place[fresh], block_max, np.append(fresh, len(entry)), (entry % BLOCK).astype(np.uint8), impact


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n numbers) of each pair, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _windows(n: np.ndarray) -> np.ndarray:
    """Number of passages of texts of n words."""
    return np.where(n > 0, 1 + np.maximum(0, -(-(n - PASSAGE) // STRIDE)), 0)


def retrieve(hashes: np.ndarray, bounds: np.ndarray, part: Part, threshold: float) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, entry, score) of every passage and entry whose score is `threshold` or more."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0),)
    at = np.searchsorted(part.terms, hashes)
    at[at == len(part.terms)] = 0
    known = np.flatnonzero(part.terms[at] == hashes)
    if not len(known):
        return none
    term = at[known]
    n = np.diff(bounds)
    per_text = _windows(n)
    text = np.repeat(np.arange(len(n)), per_text)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * STRIDE
    start = bounds[text] + first
    stop = np.minimum(start + PASSAGE, bounds[text + 1])
    lo, hi = np.searchsorted(known, start), np.searchsorted(known, stop)
    # The bound over whole lists; a repeated term counts again, which keeps it a bound.
    whole = np.zeros(len(known) + 1)
    np.cumsum(part.list_max[term], out=whole[1:])
    slack = threshold - 1e-6
    alive = np.flatnonzero(whole[hi] - whole[lo] >= slack)
    places = int(part.place.max()) + 1
    found = []
    for some in np.array_split(alive, -(-len(alive) // max(1, min(4096, (1 << 22) // places))) or 1):
        # The lists that a passage walks: its distinct terms.
        n_terms = hi[some] - lo[some]
        code = np.repeat(np.arange(len(some)), n_terms) * len(part.terms) + term[_ranges(lo[some], n_terms)]
        code.sort()
        code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
        row, t = code // len(part.terms), code % len(part.terms)
        # Bounds by block; where they stay below the threshold, all lists skip the block.
        n_blocks = part.blocks[t + 1] - part.blocks[t]
        block = _ranges(part.blocks[t], n_blocks)
        spot = np.repeat(row, n_blocks) * places + part.place[block]
        bound = np.bincount(spot, weights=part.block_max[block], minlength=len(some) * places)
        open_ = np.flatnonzero(bound >= slack)
        if not len(open_):
            continue
        rank = np.full(len(bound), -1)
        rank[open_] = np.arange(len(open_))
        kept = rank[spot] >= 0
        block, at_open = block[kept], rank[spot[kept]]
        n_postings = part.postings[block + 1] - part.postings[block]
        posting = _ranges(part.postings[block], n_postings)
        slot = np.repeat(at_open, n_postings) * BLOCK + part.within[posting]
        scores = np.bincount(slot, weights=part.impact[posting], minlength=len(open_) * BLOCK)
        hit = np.flatnonzero(scores >= threshold)
        spot = open_[hit // BLOCK]
        passage = some[spot // places]
        found.append((text[passage], first[passage], spot % places * BLOCK + hit % BLOCK, scores[hit]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def _runs(found: tuple[np.ndarray, ...], part: Part, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float, int, int]]:
    """(text, item, first word of the best passage, score, start, stop) of what is retrieved: the words to verify.

    Each passage of a whole item is for itself, with STRIDE words on either side, as a shingle of the item may
    reach over the passage's ends. Those of a cut item are one run where their surroundings adjoin.
    """
    text, first, entry, score = found
    item = part.owner[entry]
    cut = part.length[item] > ENTRY
    side = np.where(cut, part.length[item], STRIDE)
    start = np.maximum(bounds[text], bounds[text] + first - side)
    stop = np.minimum(bounds[text + 1], bounds[text] + first + PASSAGE + side)
    order = np.lexsort((-score, first, item, text))
    run: list | None = None
    for t, i, f, s, a, b, c in zip(*(x[order].tolist() for x in (text, item, first, score, start, stop, cut))):
        if run and c and run[:2] == [t, i] and a <= run[5]:
            run[5] = max(run[5], b)
            if s > run[3]:
                run[2:4] = f, s
            continue
        if run:
            yield tuple(run)
        run = [t, i, f, s, a, b]
    if run:
        yield tuple(run)


def _overlap(have: np.ndarray, want: np.ndarray) -> float:
    return float(np.isin(want, have).mean()) if len(want) else 1.0


def _search(shared, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                body, offsets = words.raw(batch.column(1))
                hashes, bounds, _ = words.hash_words(body, offsets, words.NON_ALNUM)
                out = []
                for part in shared.value:
                    best: dict[tuple[int, int], tuple] = {}
                    for text, item, first, score, start, stop in _runs(retrieve(hashes, bounds, part, threshold), part, bounds):
                        near = hashes[start:stop]
                        have, _ = words.shingles(near, np.array([0, len(near)]), SHINGLE)
                        q, a = (_overlap(have if len(want) != 1 else _with_whole(near, have, want), want) for want in (part.question[item], part.answer[item]))
                        new = (min(q, a), score, -first, q, a)
                        if (text, item) not in best or new > best[text, item]:
                            best[text, item] = new
                    out += [(text, int(part.ids[item]), -x[2], x[1], x[3], x[4], x[0] >= overlap) for (text, item), x in best.items()]
                columns = list(zip(*sorted(out))) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                made = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap", "contaminated"])

    return run


def _with_whole(near: np.ndarray, have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The passage's shingles, and the runs of fewer words that a short question or answer may equal."""
    runs = [have]
    for width in range(1, SHINGLE):
        if len(near) >= width:
            v = np.zeros(len(near) - width + 1, np.uint64)
            for i in range(width):
                v = words.mix(v * np.uint64(words._BASE) + near[i : len(near) - width + 1 + i])
            runs.append(v)
    return np.concatenate(runs)


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """One row for each document and item that it retrieves with a score of `threshold` of the item's own or more.

    An item of more than ENTRY words is retrieved by any of its entries, with the score of the best one.
    Columns doc_id, item_id, first_word of the best passage, score, question_overlap, answer_overlap
    (shares of the item's five-word shingles found there) and contaminated, which holds where both
    overlaps are `overlap` or more; a side without words counts as found, so that the other side, then the whole
    item, decides. Items of fewer than LEAST_WORDS words retrieve nothing. Null texts match nothing; a null doc_id stays null; repeated rows
    give repeated results; without items the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double, contaminated boolean"
    out = spark.createDataFrame([], schema)
    parts: list[Part] = []

    def scan() -> DataFrame:
        return docs.mapInArrow(_search(spark.sparkContext.broadcast(list(parts)), threshold, overlap), schema)

    for part in build_index(items):
        parts.append(part)
        if len(parts) == PARTS_AT_ONCE:
            out = out.unionByName(scan())
            parts = []
    return out.unionByName(scan()) if parts else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    work = Workspace(docs.sparkSession)
    found = work.save(search(docs, items).where("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct())
    return docs.join(small(found), "doc_id", "left_anti").select(docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all benchmark items."""
    out = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.withColumns({c: F.round(c, 5) for c in ("score", "question_overlap", "answer_overlap")})
