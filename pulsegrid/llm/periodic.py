"""Runs (maximal periodic stretches of words) by the suffix tree of each document.

Texts are cut into words and many documents are worked on together with numpy. Equal words of one document get equal
symbols, and each document ends with a symbol of its own, so the suffix tree of a batch is that of its documents side by side.

1. The suffix tree: suffixes are ordered by prefix doubling, which goes on only for those that aren't unique yet; common
   prefixes of neighbours follow from the kept ranks. An inner node is a stretch of the order between two smaller common
   prefixes, its children lie between the places where the prefix has just the node's depth.
2. Smaller-half traversal (Stoye and Gusfield): of each node's leaves all but those of its largest child are listed, which is
   at most n log n in total. A leaf i of a node of depth d starts a branching tandem repeat of period d if i + d (or, from the
   other side, i - d) is a leaf of the same node in another child.
3. Each run of exponent two or more ends with just one branching tandem repeat of its period: that is rotated to the left for as long as
   words stay equal. Periods that are multiples of a smaller one of the same run are merged into it.

Memory is bounded by a batch of about BATCH bytes, or the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import read

#: Words of a run at least, and periods in it at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Bytes of text whose tree is built at a time.
BATCH = 2 << 20
#: Words between ASCII blanks, as they are.
CASED = words.table(b"\x20\t\n\x0b\x0c\r", lower=False)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Marks of the first of each stretch of equal keys."""
    fresh = np.ones(len(sorted_keys), bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=fresh[1:])
    return fresh


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks of all suffixes by their first 1, 2, 4, ... symbols). The last symbol must occur once only."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = _starts(symbols[order])
    first = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    ranks, slots = [rank], np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    step = 1
    while len(slots):
        at = order[slots]
        key = rank[at] * n + rank[at + step]
        by = np.argsort(key, kind="stable")
        at = order[slots] = at[by]
        fresh = _starts(key[by])
        first = np.flatnonzero(fresh)
        rank = rank.copy()
        rank[at] = np.repeat(slots[first], np.diff(first, append=len(at)))
        ranks.append(rank)
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the next in order."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    equal = np.flatnonzero(ranks[0][a] == ranks[0][b])
    for level, after in enumerate(ranks[1:]):
        more = after[a[equal]] == after[b[equal]]
        ended, equal = equal[~more], equal[more]
        x, y = a[ended], b[ended]
        length = np.full(len(ended), 1 << level, np.int64)
        for k in reversed(range(level)):
            length += (ranks[k][x + length] == ranks[k][y + length]).astype(np.int64) << k
        out[ended] = length
    return out


def smaller_before(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in `at` the nearest one before it whose value is smaller, or -1: up and down a tree of minima."""
    minima = [values]
    while len(minima[-1]) > 1:
        x = minima[-1]
        if len(x) % 2:
            x = np.append(x, np.iinfo(x.dtype).max)
        minima.append(np.minimum(x[::2], x[1::2]))
    found = np.full(len(at), -1, np.int64)
    value, left, node = values[at], np.arange(len(at)), at.copy()
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for least in minima:
        hit = (node & 1 == 1) & (least[node - 1] < value[left])
        hits.append((left[hit], node[hit] - 1))
        left, node = left[~hit], node[~hit] >> 1
    who, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in reversed(range(len(minima))):
        who, node = np.concatenate([who, hits[level][0]]), np.concatenate([node, hits[level][1]])
        if level:
            right = 2 * node + 1
            inside = right < len(minima[level - 1])
            small = np.zeros(len(node), bool)
            small[inside] = minima[level - 1][right[inside]] < value[who[inside]]
            node = np.where(small, right, 2 * node)
    found[who] = node
    return found


def smaller_halves(prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the order, depth, first and last place of the node) of the leaves of each inner node but those of its largest child.

    Nodes of fewer than LEAST_PERIODS leaves are passed over: a run of as many periods has a leaf for each.
    """
    m = len(prefixes)
    at = np.flatnonzero(prefixes)
    low = smaller_before(prefixes, at) + 1
    high = m - 1 - smaller_before(prefixes[::-1], m - 1 - at)
    wide = high - low + 1 >= LEAST_PERIODS
    at, low, high = at[wide], low[wide], high[wide]
    if not len(at):
        return at, at, at, at
    by = np.argsort(low * (m + 1) + high, kind="stable")
    at, low, high = at[by], low[by], high[by]
    fresh = _starts(low * (m + 1) + high)
    last = np.append(fresh[1:], True)
    node = np.cumsum(fresh) - 1
    begin = np.where(fresh, low, np.concatenate([[0], at[:-1] + 1]))
    begin, stop = np.concatenate([begin, at[last] + 1]), np.concatenate([at, high[last]])
    node = np.concatenate([node, node[last]])
    size = stop - begin + 1
    by = np.lexsort((-size, node))
    rest = by[~_starts(node[by])]
    first = np.flatnonzero(fresh)
    depth, low, high = prefixes[at[first]], low[first], high[first]
    n = size[rest]
    ends = np.cumsum(n)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[rest] - (ends - n), n)
    of = np.repeat(node[rest], n)
    return places, depth[of], low[of], high[of]


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats, by start and period."""
    n = len(symbols)
    order, ranks = suffix_order(symbols)
    place, depth, low, high = smaller_halves(common_prefixes(order, ranks))
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    leaf = order[place]
    starts, periods = [], []
    for start in (leaf, leaf - depth):
        other = start + depth if start is leaf else start
        ok = other >= 0
        at = where[np.where(ok, other, 0)]
        ok &= (low <= at) & (at <= high)
        start, period = start[ok], depth[ok]
        ok = symbols[start + period] != symbols[start + 2 * period]
        starts.append(start[ok])
        periods.append(period[ok])
    key = np.unique(np.concatenate(starts) * n + np.concatenate(periods))
    return key // n, key % n


def _rotations(symbols: np.ndarray, start: int, period: int) -> int:
    """How often a repeat can be rotated to the left: equal symbols before it, compared in stretches that double."""
    done, size = 0, 64
    while True:
        low = max(0, start - done - size)
        same = symbols[low : start - done] == symbols[low + period : start - done + period]
        differ = np.flatnonzero(~same)
        if len(differ):
            return done + len(same) - 1 - int(differ[-1])
        done += len(same)
        if low == 0:
            return done
        size *= 2


def runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of LEAST_WORDS and LEAST_PERIODS or more, by start and period."""
    if len(symbols) < LEAST_WORDS:
        return []
    start, period = branching_repeats(symbols)
    need = np.maximum(LEAST_WORDS - 2 * period, (LEAST_PERIODS - 2) * period)
    for k in range(1, LEAST_WORDS + 1):
        ok = need < k
        back = start - k
        ok |= (back >= 0) & (symbols[back] == symbols[back + period])
        start, period, need = start[ok], period[ok], need[ok]
    out = []
    by_end: dict[int, list[tuple[int, int]]] = {}
    for end, p in sorted(zip((start + 2 * period).tolist(), period.tolist())):
        known = by_end.setdefault(end, [])
        if any(p % q == 0 and length >= 2 * p for q, length in known):
            continue
        length = 2 * p + _rotations(symbols, end - 2 * p, p)
        if length >= max(LEAST_WORDS, LEAST_PERIODS * p):
            known.append((p, length))
            out.append((end - length, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the original words that a document of n words has, where the rule repeats its tail; else None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return i


def _stops(body: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The byte after each word."""
    ends = np.append(CASED[0][body], True)
    ends[offsets] = True
    breaks = np.flatnonzero(ends)
    return breaks[np.searchsorted(breaks, first, side="right")]


def _joined(body: np.ndarray, first: np.ndarray, stop: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the picked words with a space after each, the byte at which each begins and the total)."""
    size = stop[picked] - first[picked] + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(ends[-1]) + np.repeat(first[picked] - ends[:-1], size)
    out = body[np.minimum(index, max(0, len(body) - 1))]
    out[ends[1:] - 1] = 32
    return out, ends


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _documents(batch: pa.RecordBatch, change) -> Iterator[tuple]:
    """A row of COLUMNS for each document of a batch (doc_id, text)."""
    body, offsets = words.raw(batch.column(1))
    hashes, bounds, first = words.hash_words(body, offsets, CASED)
    stop = _stops(body, offsets, first)
    ids, counts = batch.column(0).to_pylist(), np.diff(bounds)
    picked = np.arange(len(hashes))
    for k in range(len(ids)):
        if (own := change(ids[k], int(counts[k]))) is not None:
            picked[bounds[k] : bounds[k + 1]] = bounds[k] + own
    text_of = np.repeat(np.arange(len(ids)), counts)
    keys = words.mix(hashes[picked] ^ words.mix(text_of.astype(np.uint64) + np.uint64(1)))
    places = np.arange(len(keys)) + text_of
    symbols = np.empty(len(keys) + len(ids), np.int64)
    symbols[places] = np.unique(keys, return_inverse=True)[1]
    symbols[bounds[1:] + np.arange(len(ids))] = len(keys) + np.arange(len(ids))
    mine: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    kept = np.ones(len(keys), bool)
    begins = bounds[:-1] + np.arange(len(ids))
    for start, length, period in runs(symbols):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        mine[k].append((start - int(begins[k]), length, period))
        kept[start - k + period : start - k + length] = False
    out, ends = _joined(body, first, stop, picked[kept])
    cuts = ends[np.concatenate([[0], np.cumsum(kept)])[bounds]]
    data = memoryview(np.ascontiguousarray(out))
    for k, doc_id in enumerate(ids):
        found = mine[k]
        best: tuple = (None,) * 4
        if found:
            s, n, p = found[0]
            for x in found[1:]:
                if x[1] * p > n * x[2]:  # in order of start and period, so only a greater exponent takes its place
                    s, n, p = x
            best = (s, n, p, 1000 * n // p)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        yield (doc_id, len(found), *best, _sha(listed.encode()), _sha(data[cuts[k] : max(cuts[k], cuts[k + 1] - 1)]))


def _find(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for whole in batches:
            for batch in words.pieces(whole, "text", BATCH):
                columns = list(zip(*_documents(batch, change)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names)

    return run


def _unchanged(doc_id: int | None, n: int) -> None:
    return None


def periodic_runs(docs: DataFrame, change=_unchanged) -> DataFrame:
    """Runs of each row of docs (doc_id, text; other columns are left out), and digests of them and of the text without repeats.

    n_runs, the run of the greatest exponent (start, length, period, exponent_milli; ties: smallest start, then period),
    runs_sha256 of all runs and collapsed_sha256 of the words that no run holds after its first period. A null or empty text has no runs and
    the digests of nothing; rows that repeat get the same result each; an empty table gives an empty one. A text of any length is
    worked on as a whole. change(doc_id, n) may give the numbers of the original words to take in place of words 0 to n - 1.
    Words are told apart by 64-bit hashes within one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(change), COLUMNS)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the tails of a tenth of them repeated by rule (not those of a null doc_id)."""
    return periodic_runs(read(spark, sf_dir, "documents"), _planted)
