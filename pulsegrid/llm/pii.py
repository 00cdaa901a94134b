"""Personal data: base patterns, and a contextual bootstrap that finds identifiers the patterns miss.

DataFrame functions only. Base spans come from regular expressions; their positions from the lengths of
what lies between the matches. The spans are seeds: the words around them are lexical patterns. Patterns
and identifier-like tokens form a graph; confidence flows from seeds to patterns (share of a pattern's
instances that are believed to be of its kind) and back (an instance is believed through the patterns
that find it) for some rounds. What confident patterns extract beyond the base spans is added.

Only occurrences that may be of a kind enter the graph: those with enough digits may be of any, those with an
at sign may be mail addresses, groups of hex digits and colons may be ip addresses, and groups of digits that
blanks join are one phone or card number. A pattern's share for a kind is over what may be of it. Edges are counted per (pattern, instance)
before anything is joined; only patterns that pass the thresholds go on, so a frequent word that finds a
large part of all tokens is one row that is dropped as soon as it is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, chunked, let, matches, read

#: The kinds in the order of reports, with their patterns. The look-behinds only skip starts from which
#: no further match is possible; `card` matches whole runs of 16 to 19 digits, as no other run passes its check.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that holds wherever a pattern can match.
_HINTS = {"email": "@", "ip": "\\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
#: Tokens that may be identifiers, those of an ip address in hex groups, and digit groups joined by single blanks.
TOKEN = r"(?<!\S)(?=[^0-9@:\s]*+[0-9@:])\S++"
HEX_GROUPS = r"(?<![0-9A-Za-z:])(?=:*+[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"
_GROUP = r"\(?[0-9]++(?:[().-]++[0-9]++)*+\)?"
JOINED = rf"(?<![A-Za-z0-9(+.@/_-])(?<![0-9] ){_GROUP}(?: {_GROUP})++(?![A-Za-z0-9@])"

ROUNDS = 3
#: A pattern needs so many distinct seeds, and so large a share of believed instances.
LEAST_SEEDS = 5
LEAST_SHARE = 0.6
#: An instance is added if it is believed to this degree. With so many digits it may be of any kind.
LEAST_BELIEF = 0.6
LEAST_DIGITS = 4
#: Kinds as bits, in the order of PATTERNS.
_BIT = {kind: 1 << i for i, kind in enumerate(PATTERNS)}
_ANY = sum(_BIT.values())
_NUMBER = _BIT["phone"] | _BIT["card"]


def _spans(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, stop, value, before, after) of the matches of a pattern; start and stop count code points."""
    found = matches(text, pattern)
    empty = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")
    return F.when(text.contains(hint) if hint == "@" else text.rlike(hint), found).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    digits = F.reverse(F.transform(F.filter(F.split(_digits(value), ""), lambda d: d != ""), lambda d: d.cast("int")))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Parts of more than three digits that are small (leading zeros) pass as well.
        return F.forall(F.split(value, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of (start, stop, value, before, after) of the base patterns in a text; empty for a null text."""
    text = F.coalesce(text, F.lit(""))

    def passing(kind: str) -> Column:
        return F.filter(_spans(text, PATTERNS[kind], _HINTS[kind]), lambda s: _passes(kind, s["value"]))

    return {kind: passing(kind) for kind in PATTERNS}


def _word(text: Column, last: bool) -> Column:
    """The last or first word of a text, lower-cased, without marks at its ends. Of a longer one what lies within NEAR characters is seen."""
    word = F.regexp_extract(text, "(\\S++)\\s*$" if last else "^\\s*(\\S++)", 1)
    return F.lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}=:]+|[^\\p{L}\\p{N}=:]+$", ""))


def _apart(spans: Column, others: Column) -> Column:
    """The spans, in the order of their starts, that overlap with none of the others; others needn't be in order."""

    def both(b: Column) -> Column:
        def block(some: Column) -> Column:
            return let(some, lambda some: let(near(some), lambda near: F.filter(some, lambda s: ~F.exists(near, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])))))

        def near(some: Column) -> Column:
            ends = F.struct(F.get(some, F.lit(0))["start"].alias("first"), F.array_max(F.transform(some, lambda s: s["stop"])).alias("last"))
            return let(ends, lambda e: F.filter(b["others"], lambda o: (o["start"] < e["last"]) & (e["first"] < o["stop"])))

        return F.when((F.size(b["others"]) == 0) | (F.size(b["spans"]) == 0), b["spans"]).otherwise(chunked(b["spans"], block))

    return let(F.struct(spans.alias("spans"), others.alias("others")), both)


def _mentions(kinds: Column, text: Column) -> Column:
    """Occurrences for the graph: the base spans, and tokens outside of them, with the words on either side.

    kinds: array of (kind, start, stop, value, before, after).
    """

    def one(kind: Column, s: Column, may: Column, joined: bool) -> Column:
        left, right = _word(s["before"], True), _word(s["after"], False)
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), left.alias("left"), right.alias("right"), may.alias("may"), F.lit(joined).alias("joined"))

    def may(s: Column, numbers: int) -> Column:
        digits = F.length(_digits(s["value"])) >= LEAST_DIGITS
        mail = F.when(s["value"].contains("@"), F.lit(_BIT["email"])).otherwise(F.lit(0))
        return F.when(digits, F.lit(numbers)).otherwise(mail.bitwiseOR(F.when(s["value"].rlike(HEX_GROUPS), F.lit(_BIT["ip"])).otherwise(F.lit(0))))

    def admitted(tokens: Column, numbers: int) -> Column:
        return F.filter(F.transform(tokens, lambda t: one(none, t, may(t, numbers), False)), lambda m: m["may"] > 0)

    def with_joined(both: Column) -> Column:
        tokens, joined = both["tokens"], both["joined"]
        # A part of a joined number is no number of its own.
        whole = let(_apart(tokens, joined), lambda free: F.concat(admitted(free, _ANY), admitted(F.array_except(tokens, free), _ANY - _NUMBER)))
        opened = F.when(F.size(joined) > 0, whole).otherwise(admitted(tokens, _ANY))
        return F.concat(opened, F.transform(joined, lambda t: one(none, t, F.lit(_NUMBER), True)))

    none = F.lit(None).cast("string")
    seeds = F.transform(kinds, lambda s: one(s["kind"], s, F.lit(_ANY), False))
    tokens = _apart(_spans(text, TOKEN, "[0-9@:]"), kinds)
    joined = _apart(F.filter(_spans(text, JOINED, "[0-9]\\)? \\(?[0-9]"), lambda t: F.length(_digits(t["value"])) >= LEAST_DIGITS), kinds)
    return F.concat(seeds, let(F.struct(tokens.alias("tokens"), joined.alias("joined")), with_joined))


def _edges(mentions: DataFrame) -> DataFrame:
    """(pattern, kind of the seed or null, instance, may) of mentions: the word before, and both words around."""
    m = mentions.where("left <> ''")
    one = m.select(F.concat(F.lit("L "), "left").alias("pattern"), "kind", F.xxhash64("value").alias("instance"), "may")
    two = m.where("right <> ''").select(F.concat(F.lit("B "), "left", F.lit(" _ "), "right").alias("pattern"), "kind", F.xxhash64("value").alias("instance"), "may")
    return one.unionByName(two).groupBy("pattern", "kind", "instance").agg(F.bit_or("may").alias("may"))


def _may(kind: Column, may: Column) -> Column:
    """Whether the bits hold a kind."""
    bit = F.coalesce(*(F.when(kind == k, F.lit(b)) for k, b in _BIT.items()))
    return may.bitwiseAND(bit) > 0


def confident_patterns(work: Workspace, mentions: DataFrame) -> DataFrame:
    """(pattern, kind, share) of the patterns that are confident after the last round.

    Identifiers that are believed in a round support all patterns they occur with in the next one, like seeds.
    """
    edges = work.save(_edges(mentions))
    total = edges.groupBy("pattern", "instance").agg(F.bit_or("may").alias("may")).groupBy("pattern")
    total = work.save(total.agg(F.count("*").alias("all"), *(F.count_if(_may(F.lit(k), F.col("may"))).alias(k) for k in PATTERNS)).where(f"all >= {LEAST_SEEDS}"))
    instances = F.coalesce(*(F.when(F.col("kind") == k, F.col(k)) for k in PATTERNS))
    seeds = edges.where("kind IS NOT NULL").withColumn("belief", F.lit(1.0))
    unseen = edges.where("kind IS NULL").drop("kind")

    def weighed(support: DataFrame) -> DataFrame:
        """Patterns with enough support (pattern, kind, instance, belief) and the share of it; an instance counts once."""
        each = support.groupBy("pattern", "kind", "instance").agg(F.max("belief").alias("belief"))
        found = each.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("belief").alias("belief")).where(f"n >= {LEAST_SEEDS}")
        return work.save(found.join(total, "pattern").select("pattern", "kind", F.least(F.lit(1.0), F.col("belief") / instances).alias("share")))

    patterns = weighed(seeds)
    for _ in range(ROUNDS):
        if patterns.isEmpty():
            break
        sure = patterns.where(f"share >= {LEAST_SHARE / 2}")
        belief = unseen.join(sure, "pattern").where(_may(F.col("kind"), F.col("may"))).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("share", F.lit(0.99)))))).alias("belief"))
        believed = work.save(belief.where(f"belief >= {LEAST_BELIEF}"))
        nxt = weighed(seeds.unionByName(unseen.join(believed, "instance").where(_may(F.col("kind"), F.col("may"))).select(seeds.columns)))
        work.drop(patterns, believed)
        patterns = nxt
    return patterns.where(f"share >= {LEAST_SHARE}").select("pattern", "kind", "share")


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows (doc_id, base, added): arrays of (kind, start, stop, value), stop exclusive.

    base is in the order of kinds, then of starts; added holds what the bootstrap found besides, none of it inside a
    base span. A null or empty text has empty arrays; repeated rows are found one by one; other columns are ignored; an
    empty table gives an empty result, and a text of any length is searched as a whole.
    """
    work = Workspace(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    found = base_spans(F.col("text"))

    def labelled(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.struct(F.lit(kind).alias("kind"), *(s[f].alias(f) for f in ("start", "stop", "value", "before", "after"))))

    kinds = F.concat(*map(labelled, PATTERNS))
    rows = docs.select("doc_id", text.alias("text"), kinds.alias("base"))
    plain = F.transform("base", lambda s: s.dropFields("before", "after"))
    rows = rows.select("doc_id", plain.alias("base"), F.when(F.col("text").rlike("[0-9@:]"), _mentions(F.col("base"), F.col("text"))).alias("mentions"))
    rows = work.save(rows.withColumn("row", F.monotonically_increasing_id()))
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    sure = work.save(confident_patterns(work, mentions))
    if sure.isEmpty():
        return rows.select("doc_id", "base", F.expr("filter(base, s -> false)").alias("added"))
    open_ = mentions.where("kind IS NULL AND left <> ''").drop("kind")
    by = lambda pattern: open_.withColumn("pattern", pattern).join(sure, "pattern").where(_may(F.col("kind"), F.col("may")))
    both = by(F.concat(F.lit("L "), "left")).unionByName(by(F.concat(F.lit("B "), "left", F.lit(" _ "), "right")))
    best = both.groupBy("row", "start", "stop", "value", "joined").agg(F.max_by("kind", F.struct("share", "kind")).alias("kind"))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop", "value", "joined"))).alias("added"))
    # A joined number holds its parts.
    over = lambda s, t: t["joined"] & ~s["joined"] & (t["start"] < s["stop"]) & (s["start"] < t["stop"])
    kept = F.filter("added", lambda s: ~F.exists("added", lambda t: over(s, t)))
    added = added.select("row", F.transform(kept, lambda s: s.dropFields("joined")).alias("added"))
    return rows.drop("mentions").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.expr("filter(base, s -> false)")).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:stop of spans, by kind in the order of PATTERNS, then by start, joined by commas."""
    kinds = F.array(*map(F.lit, PATTERNS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base spans, and all spans."""
    found = find(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
