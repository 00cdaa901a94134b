"""Collocations: phrases of two to four words that occur together more often than their parts suggest.

1. Shards of texts (about SHARD words) become generalised suffix automata of bounded depth. The states of an automaton are the classes
   of substrings with the same end positions; they are found with numpy by sorting the positions by their words read backwards,
   where each class is a stretch of positions. A state has its longest substring, its number of end positions and its suffix
   link, the class of the longest suffix that occurs more often.
2. Every substring of up to two words is listed from the states of each shard with its count, as a 64-bit hash, and Spark adds the counts. Hashes that
   occur `least` times or more go into a filter of BITS bits, whatever their number. Another phrase may pass it by chance, which costs time only.
   A second pass cuts the pieces where a word or pair of words doesn't pass the filter, as no frequent phrase goes over such a
   place, and makes a filter of the substrings of three and four words in the same way.
3. A third pass lists the substrings that pass their filters, now as text, so counts are exact.
4. Phrases are scored by their weakest cut, and those that are nearly always part of a longer one go. The phrases that are longer by one
   word suffice for that: their suffix link leads to the phrase without its first word, the other edge to that without its last.

No task sees more than a shard, and nothing but the two filters goes through the driver (BITS / 8 bytes each).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import Workspace, read

#: Longest phrase, and words of the substrings that are counted first.
DEPTH = 4
FIRST_DEPTH = 2
#: Words of a shard, about: texts are added until it has as many.
SHARD = 1 << 18
#: Rows that a shard gives out at once.
ROWS = 1 << 15
#: Bits of the filter, and of one row of it (what Spark's bitmap functions use).
BITS = 1 << 27
ROW_BITS = 1 << 15
#: Bytes at which pieces end, and those between words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
KIND = words.table(b"\x20\x09" + ENDS)
_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+")
#: Language of documents without one.
NO_LANG = "und"
_U = np.uint64


def _stretches(keys: np.ndarray) -> np.ndarray:
    """Marks of the first of each stretch of equal keys."""
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    return fresh


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, dense rank of each from 1)."""
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(_stretches(keys[order]))
    return order, rank


class Automaton:
    """Generalised suffix automaton of the substrings of up to `depth` symbols.

    room[i] says how many symbols up to i belong to one piece. For each state: length of its longest and shortest
    substring, number and one of its end positions, and the suffix link (-1: the empty substring).
    """

    def __init__(self, symbols: np.ndarray, room: np.ndarray, depth: int):
        n = len(symbols)
        self.depth, self.room = depth, np.minimum(room, depth)
        order, rank = (np.argsort(symbols), symbols + 1) if depth < 2 or not n else (None, symbols + 1)
        reach = 1
        while reach < depth and n:
            back = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.room > reach)
            back[inside] = rank[inside - reach]
            order, rank = _ranks(rank * (int(rank.max()) + 1) + back)
            reach *= 2
        room = self.room[order]
        common = np.zeros(n + 1, np.int64)  # with the position before in order; none at the ends
        same = np.ones(max(0, n - 1), bool)
        for d in range(depth if n else 0):
            same = same & (room[1:] > d) & (room[:-1] > d)
            at = np.flatnonzero(same)
            same[at] = symbols[order[at + 1] - d] == symbols[order[at] - d]
            common[1:n] += same
        state_at = np.zeros(0, np.int64)
        before: tuple[np.ndarray, np.ndarray] | None = None
        self.length, self.shortest, self.count, self.end, self.link = (np.zeros(0, np.int64) for _ in range(5))
        for d in range(1, depth + 1):
            start = np.flatnonzero((room >= d) & (common[:n] < d))
            if not len(start):
                break
            breaks = np.flatnonzero(common < d)  # starts of other stretches and ends are breaks as well
            size = breaks[(np.cumsum(common < d) - 1)[start] + 1] - start
            if before is None:
                link, fresh = np.full(len(start), -1), np.ones(len(start), bool)
            else:
                marks = np.zeros(n, np.int64)
                marks[before[0]] = 1
                parent = (np.cumsum(marks) - 1)[start]
                link, fresh = state_at[parent], size < before[1][parent]
            made = len(self.length) + np.cumsum(fresh) - 1
            state = np.where(fresh, made, link)
            self.length[link[~fresh]] = d
            k = int(fresh.sum())
            self.length, self.shortest = np.append(self.length, np.full(k, d)), np.append(self.shortest, np.full(k, d))
            self.count, self.end, self.link = np.append(self.count, size[fresh]), np.append(self.end, order[start[fresh]]), np.append(self.link, link[fresh])
            before, state_at = (start, size), state

    def substrings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an end position, length, count) of each distinct substring: those of a state have as many ends as it has."""
        n = self.length - self.shortest + 1
        of = np.repeat(np.arange(len(n)), n)
        length = self.shortest[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return self.end[of], length, self.count[of]


def _hashes(word: np.ndarray, end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each substring from those of its words."""
    out = np.zeros(len(end), _U)
    for j in range(int(length.max()) if len(length) else 0):
        inside = length > j
        at = np.where(inside, end - length + 1 + j, 0)
        out = np.where(inside, words.mix(out * _U(words._BASE) + word[at]), out)
    return out


class _Shard:
    """Words of some texts: hash (by language), symbol, whether it opens a piece, language and, with texts, place in the bytes."""

    def __init__(self, parts: list[tuple], texts: bool):
        self.word, self.opens, self.lang = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4))
        self.distinct, self.symbol = np.unique(self.word, return_inverse=True)
        if texts:
            sizes = np.array([len(p[0]) for p in parts])
            before = np.cumsum(sizes) - sizes
            self.body = np.concatenate([p[0] for p in parts]).tobytes()
            self.first, self.limit = (np.concatenate([p[k] + at for p, at in zip(parts, before)]) for k in (2, 5))

    def room(self, opens: np.ndarray) -> np.ndarray:
        """Number of words since the last that opens a piece, itself included."""
        n = np.arange(len(opens))
        return n - np.maximum.accumulate(np.where(opens, n, 0)) + 1

    def text(self, i: int) -> str:
        return _WORD.match(self.body, self.first[i], self.limit[i])[0].lower().decode("utf-8", "replace")


def _shards(batches: Iterator[pa.RecordBatch], langs: dict[int, str], texts: bool = False) -> Iterator[_Shard]:
    """Shards of rows (lang, text). langs gets the language of each code; `texts` keeps the bytes of words."""
    is_end = np.zeros(256, bool)
    is_end[list(ENDS)] = True
    codes: dict[str, int] = {}
    held: list[tuple] = []
    n = 0
    for whole in batches:
        for batch in words.pieces(whole, "text"):
            body, offsets = words.raw(batch.column(1))
            hashes, bounds, first = words.hash_words(body, offsets, KIND)
            passed = np.cumsum(is_end[body], dtype=np.int32)[first]
            opens = np.concatenate([[True], passed[1:] != passed[:-1]]) if len(first) else np.zeros(0, bool)
            opens[bounds[:-1][bounds[:-1] < len(first)]] = True
            mine = []
            for x in batch.column(0).to_pylist():
                if x not in codes:
                    codes[x] = len(codes)
                    langs[codes[x]] = x
                mine.append(codes[x])
            lang = np.repeat(np.array(mine, np.int64), np.diff(bounds))
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in codes], _U)
            held.append((body if texts else body[:0], words.mix(hashes ^ salt[lang]) if len(lang) else hashes, first, opens, lang, np.repeat(offsets[1:], np.diff(bounds))))
            n += len(first)
            if n >= SHARD:
                yield _Shard(held, texts)
                held, n = [], 0
    if n:
        yield _Shard(held, texts)


def _hashed(h: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(h), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS]) for x in (h.view(np.int64), count)], ["h", "f"])


def _count_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (hash, count) of the substrings of up to FIRST_DEPTH words of each shard."""
    for shard in _shards(batches, {}):
        end, length, count = Automaton(shard.symbol, shard.room(shard.opens), FIRST_DEPTH).substrings()
        yield from _hashed(_hashes(shard.word, end, length), count)


def _cut(shard: _Shard, bits: np.ndarray) -> tuple[np.ndarray, Automaton]:
    """(frequent words of a shard, the automaton of them), with pieces cut at what doesn't pass the filter."""
    one = np.arange(len(shard.distinct))
    frequent = _passes(bits, _hashes(shard.distinct, one, np.ones(len(one), np.int64)))[shard.symbol]
    opens = shard.opens | ~frequent
    opens[1:] |= ~frequent[:-1]
    at = np.flatnonzero(~opens)
    opens[at] = ~_passes(bits, _hashes(shard.word, at, np.full(len(at), 2)))
    kept = np.flatnonzero(frequent)
    return kept, Automaton(shard.symbol[kept], shard.room(opens)[kept], DEPTH)


def _count_long(shared):
    """Rows (lang, text) to (hash, count) of the substrings of more than FIRST_DEPTH words of each shard, whose pairs pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, {}):
            kept, automaton = _cut(shard, shared.value)
            end, length, count = automaton.substrings()
            at = np.flatnonzero(length > FIRST_DEPTH)
            yield from _hashed(_hashes(shard.word[kept], end[at], length[at]), count[at])

    return run


def _filter(counts: DataFrame, least: int) -> np.ndarray:
    """The bits of hashes that are counted `least` times or more: BITS / 8 bytes, built by Spark in rows of ROW_BITS."""
    kept = counts.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    places = F.array(F.col("h").bitwiseAND(BITS - 1) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(BITS - 1) + 1)
    bit = kept.select(F.explode(places).alias("b"))
    rows = bit.groupBy(F.bitmap_bucket_number("b").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r.row - 1) * (ROW_BITS // 8)
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in (h & _U(BITS - 1), (h >> _U(32)) & _U(BITS - 1)):
        ok &= (bits[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
    return ok


def _count_phrases(shared):
    """Rows (lang, text) to (lang, phrase, words, f) of each shard: phrases that pass the filters, and all words of a language (no phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (short, long), langs = shared.value, {}
        for shard in _shards(batches, langs, texts=True):
            kept, automaton = _cut(shard, short)
            end, length, count = automaton.substrings()
            some = (length <= FIRST_DEPTH) | _passes(long, _hashes(shard.word[kept], end, length))
            end, length, count = end[some], length[some], count[some]
            known: dict[int, str] = {}
            symbols = shard.symbol[kept]
            names = ["lang", "phrase", "words", "f"]
            for i in range(0, len(end), ROWS):
                some = slice(i, i + ROWS)
                phrases = []
                for e, d in zip(end[some].tolist(), length[some].tolist()):
                    parts = []
                    for at in range(e - d + 1, e + 1):
                        s = int(symbols[at])
                        if s not in known:
                            known[s] = shard.text(int(kept[at]))
                        parts.append(known[s])
                    phrases.append(" ".join(parts))
                of = [langs[x] for x in shard.lang[kept[end[some]]].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(phrases, pa.string()), pa.array(length[some]), pa.array(count[some])], names)
            total = np.bincount(shard.lang, minlength=len(langs))
            every = [langs[x] for x in range(len(langs))]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([""] * len(every), pa.string()), pa.array(np.zeros(len(every), np.int64)), pa.array(total)], names)

    return run


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of one to four words that occur `least` times or more, and (lang, "", 0, number of words)."""
    spark = docs.sparkSession
    work = Workspace(spark)
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    short = _filter(rows.mapInArrow(_count_first, "h long, f long"), least)
    long = _filter(rows.mapInArrow(_count_long(spark.sparkContext.broadcast(short)), "h long, f long"), least)
    counted = rows.mapInArrow(_count_phrases(spark.sparkContext.broadcast((short, long))), "lang string, phrase string, words long, f long")
    total = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return work.save(total.where((F.col("f") >= least) | (F.col("words") == 0)))


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, first: int = 2000) -> DataFrame:
    """The `first` phrases of each language of docs (lang, text; other columns are left out): lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the parts at its weakest cut, n the words of the language; score is
    floor(2000000 * a / (l + r)). Phrases that occur less than `least` times are no candidates; those whose occurrences are to `covered`
    percent or more inside of one longer candidate are dropped. Null and empty texts have no words, a null language is NO_LANG, repeated rows count again,
    and an empty table gives an empty result. Ties of score and a are ranked by phrase.
    """
    grams = phrase_counts(docs, least)
    parts = F.split("phrase", " ")
    phrases = grams.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), parts.alias("w"))
    known = grams.where("words >= 1").select("lang", F.col("phrase").alias("part"), "f")
    cuts = phrases.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words").cast("int")), " ").alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = "decimal(38,0)"
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS {wide}) * 2000000BD) div (CAST(l AS {wide}) + r)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.where("words >= 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(2), F.col("words").cast("int")), " "), F.array_join(F.slice("w", F.lit(1), F.col("words").cast("int") - 1), " "))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most").cast(wide) < covered * F.col("a").cast(wide), F.lit(True)))
    ranked = own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    n = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= first).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces
), occurrences AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM listed, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k
), f AS (
  SELECT lang, phrase, k, count(*) AS f FROM occurrences GROUP BY lang, phrase, k
), n AS (
  SELECT lang, sum(len(w)) AS n FROM listed GROUP BY lang
), candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.w, unnest(range(1, len(c.w))) AS k FROM candidates c
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase
  FROM (SELECT lang, a, w, unnest(range(1, len(w))) AS i FROM candidates), (VALUES (2), (3), (4)) AS ends(j)
  WHERE j > i AND j <= len(w) AND j - i + 1 < len(w)
), kept AS (
  SELECT w.* FROM weakest w
  LEFT JOIN (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase) i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE most IS NULL OR 100 * most < 80 * w.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
