"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are values assigned to a name such as `token` or `password`, quoted or not, what follows `Bearer`, blocks of private keys, and
runs of 12 or more characters of the usual key alphabets with at least one digit. Each has properties of the string (length, kinds of
characters and changes between them, coverage by dictionary words), of the path (the document's source) and of the neighbouring words. The
dictionary is the DICTIONARY_WORDS words that most documents hold, counted by Spark, besides some fixed ones. A random forest is trained by
Spark ML on labelled findings and then evaluated inside the projection, as a walk over arrays: no join, no shuffle, no Python.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, checkpointed, let, matches, read, unused

TREES, DEPTH, SEED = 24, 8, 7
#: Labelled findings of the built-in training set.
FINDINGS = 8000
#: Characters of text on either side that the forest sees.
BESIDE = 48
MARK = "<SECRET>"

#: Words of the corpus in the dictionary, of so many letters.
DICTIONARY_WORDS = 2048
WORD_LETTERS = (3, 24)
#: Pairs of letters that count as usual: those that most words of the dictionary hold.
USUAL_PAIRS = 240

#: Names that announce a secret, words that announce something else, path parts, words that stand for a value, and dictionary words.
SECRET_NAMES = "token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential"
OTHER_NAMES = "sha|md5|commit|checksum|digest|hash|uuid|guid|isbn|version|build|revision|etag|order|invoice|phone|serial|example|sample"
TEST_PATHS = "test|example|sample|fixture|doc|demo"
CONFIG_PATHS = "\\.env|config|settings|\\.ya?ml|\\.ini|\\.properties|deploy"
PLACEHOLDERS = "your|here|change|insert|dummy|example|sample|placeholder|none|null|undefined|required|optional|true|false|redacted|hidden|xxx+|\\*\\*\\*+|todo|default"
DICTIONARY = (
    "the and for with that this from have not are was you your all can one use new get set add data file name path user test example sample version "
    "image index page item list table value key code type text line size time date year server client local home lib bin usr src http https www com org "
    "html json linux gnu python java node module package class function return string number place holder here change insert dummy required optional invalid missing"
).split()

_NAME = "token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"
_SET = rf"(?:{_NAME})[\"']?\s{{0,16}}[=:]>?\s{{0,16}}"
_QUOTED = rf"(?<=[\"'])(?<=(?i:{_SET}[\"']))(?:[^\"'\r\n]{{6,}}+(?=[\"'])|[^\"'\s]{{6,}}+)"
_PLAIN = rf"(?<=[=:>\s])(?=[^\s\"'<>,;=:])(?<=(?:[=:>]|[Rr])\s{{0,16}})(?<=(?i:{_SET}|(?<![a-z])bearer\s{{1,16}}))[^\s\"'<>,;]{{6,}}+"
_BLOCK = r"-----BEGIN [A-Z ]{0,30}?PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,30}?PRIVATE KEY-----"
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
#: A block of a private key, a value after a telling name, or a run of key characters with a digit.
CANDIDATE = f"{_BLOCK}|{_QUOTED}|{_PLAIN}|{_RUN}"

FEATURES = [
    "length", "digits", "upper", "lower", "marks", "changes", "hex", "distinct", "dictionary", "longest_letters",
    "secret_name", "other_name", "assigned", "quoted", "test_path", "config_path", "prefixed", "only_digits", "dashes",
    "words", "unknown_letters", "placeholder", "code", "block", "usual_pairs",
]


def dictionary(docs: DataFrame) -> list[str]:
    """The fixed words and the DICTIONARY_WORDS words (runs of letters, lower-cased) that most texts of docs hold, ties by word."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("word")
    counts = docs.select(word).where(F.length("word").between(*WORD_LETTERS)).groupBy("word").agg(F.count("*").alias("n"))
    # Saved first, so that executors merge what the tasks found and the driver gets the words only.
    top = Workspace(docs.sparkSession).save(counts.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).select("word"))
    return sorted({*DICTIONARY, *(r.word for r in top.collect())})


def _known(words: list[str] | None) -> Column:
    """The dictionary as one constant column."""
    return F.from_json(F.lit(json.dumps(DICTIONARY if words is None else words)), "array<string>")


def _usual_pairs(words: list[str] | None) -> Column:
    """The USUAL_PAIRS pairs of letters that most words of the dictionary hold, as one constant column."""
    counts = Counter(p for w in (DICTIONARY if words is None else words) for p in {w[i : i + 2] for i in range(len(w) - 1)})
    top = sorted(counts, key=lambda p: (-counts[p], p))[:USUAL_PAIRS]
    return F.from_json(F.lit(json.dumps(top)), "array<string>")


def _features(c: Column, before: Column, after: Column, path: Column, words: list[str] | None = None) -> list[Column]:
    """One double for each of FEATURES."""
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    without = lambda pattern: n - F.length(F.regexp_replace(c, pattern, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "\u0001"), "[A-Z]", "\u0002"), "[a-z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    changes = F.length(F.regexp_replace(kinds, "(.)\\1++", "$1")) - 1
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    left, low = F.lower(before), F.lower(F.coalesce(path, F.lit("")))
    # Parts of the value at marks, digits and changes to upper case; a block of a key isn't looked at.
    cut = F.when(c.startswith("-----BEGIN"), F.lit("")).otherwise(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")))
    parts = F.filter(F.split(cut, "[^\\p{L}]+"), lambda x: F.length(x) > 0)
    letters = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x))
    known, usual = _known(words), _usual_pairs(words)
    pairs = F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    covered = letters(F.filter(parts, lambda x: (F.length(x) >= WORD_LETTERS[0]) & F.array_contains(known, x)))
    return [
        F.least(n, F.lit(200.0)), without("[0-9]") / n, without("[A-Z]") / n, without("[a-z]") / n, without("[^A-Za-z0-9]") / n,
        changes / n, flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), F.size(F.array_distinct(F.split(c, ""))) / n,
        covered / n, F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x))) / n,
        flag(left.rlike(f"(?:{SECRET_NAMES})[a-z_]*[\"']?\\s*(?:[=:]>?|is)?\\s*[\"']?$")), flag(left.rlike(f"(?:{OTHER_NAMES})")),
        flag(before.rlike("[=:]>?\\s*[\"']?$")), flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        flag(low.rlike(TEST_PATHS)), flag(low.rlike(CONFIG_PATHS)), flag(c.rlike("^(?:ghp_|gho_|sk-|pk_|AKIA|xox[abp]-|glpat-|eyJ)")),
        flag(c.rlike("^[0-9]+$")), without("-") / n,
        F.size(parts).cast("double"), (letters(parts) - covered) / n, without(f"(?i:{PLACEHOLDERS})") / n,
        flag(c.rlike("[(){}\\[\\]$]|^[a-z_]+(?:\\.[A-Za-z_]+)+$")), flag(c.startswith("-----BEGIN")),
        let(pairs, lambda xs: F.size(F.filter(xs, lambda x: F.array_contains(usual, x))) / F.greatest(F.size(xs), F.lit(1)).cast("double")),
    ]


def labelled_findings(spark: SparkSession, n: int = FINDINGS, words: list[str] | None = None) -> DataFrame:
    """(before, value, after, path, label): n findings by rule, half of them secrets, the same at each call with the same words.

    They stand in for findings that people have labelled; fit() takes any table of these columns. Secrets are digests, base64, prefixed keys, letters,
    passphrases of words, passwords, key blocks and numbers in groups; the others are digests of something else, numbers, names, versions,
    placeholders, single words and code.
    """
    i = F.col("id")
    known = _known(words)
    draw = lambda salt, k: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(k)).cast("int")
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), draw(salt, len(xs)) + 1)
    # Words are drawn once for each row, into one array, so the dictionary is in the plan once.
    draws = [f"p{k}{end}" for k in range(5) for end in ("", "a", "b")] + [f"w{k}{end}" for k in (4, 5) for end in ("", "a", "b")] + ["w0", "w3", "s1"]
    drawn = F.transform(F.array(*map(F.lit, draws)), lambda salt: F.get(known, F.pmod(F.xxhash64(i, salt), F.size(known)).cast("int")))
    any_word = lambda salt: F.get(F.col("drawn"), F.lit(draws.index(salt)))
    digest = F.sha2(F.concat_ws("-", i.cast("string"), F.lit("finding")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", "")
    # A word of the dictionary, or one that isn't there, from the ends of two.
    new_word = lambda salt: F.when(draw(salt, 2) == 0, any_word(salt)).otherwise(F.concat(F.left(any_word(f"{salt}a"), F.lit(3)), F.right(any_word(f"{salt}b"), F.lit(3))))
    word = F.when(draw("fixed", 2) == 0, pick("w1", ["value", "thing", "onder", "thention", "enanle", "quemente", "lichkeit", "menteador", "station", "hereing", "sample", "example"])).otherwise(any_word("w0"))
    label = draw("label", 2)
    length = F.element_at(F.array(*map(F.lit, (16, 20, 24, 32, 40, 40, 40, 48, 64))), draw("len", 9) + 1)
    cased = lambda x: F.when(draw("case", 6) == 0, F.upper(x)).otherwise(x)
    name = pick("name", ["token", "secret", "password", "api_key", "apiKey", "access_key", "AWS_SECRET_ACCESS_KEY", "private_key", "auth_token", "client_secret", "credential", "DB_PASSWORD", "passphrase"])
    glue = pick("glue", [' = "', "='", ': "', "=", ": ", ' = "', ' = "', " = "])
    number = lambda salt, digits: F.lpad(draw(salt, 10**digits).cast("string"), digits, "0")
    sign = pick("sign", ["-", "_"])
    kind = draw("kind", 12)
    letters = F.substring(F.regexp_replace(base64, "[^A-Za-z]", ""), 1, F.least(length, F.lit(28)))
    alphabet = F.substring(F.lit("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"), draw("from", 20) + 1, draw("many", 12) + 12)
    passphrase = F.call_function("array_join", F.slice(F.array(*(new_word(f"p{k}") for k in range(5))), F.lit(1), 3 + draw("pw", 3)), sign)
    secret_value = (
        F.when(kind < 3, cased(F.substring(digest, 1, length)))
        .when(kind == 3, F.substring(base64, 1, length))
        .when(kind == 4, F.concat(pick("pre", ["ghp_", "sk-", "AKIA", "glpat-"]), F.substring(F.regexp_replace(base64, "[+/=]", ""), 1, 24)))
        .when(kind == 5, F.when(draw("low", 2) == 0, letters).when(draw("low2", 2) == 0, F.lower(letters)).otherwise(alphabet))
        .when(kind <= 7, F.concat(passphrase, F.when(draw("pn", 3) == 0, number("pnn", 2)).otherwise(F.lit(""))))
        .when(kind == 8, F.concat(F.initcap(any_word("s1")), number("s2", 4), pick("s3", ["!", "#", "$", "?", "x9"])))
        .when(kind == 9, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base64, F.lit("\n-----END RSA PRIVATE KEY-----")))
        .when(kind == 10, F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .otherwise(F.concat(F.substring(F.regexp_replace(base64, "[+=]", ""), 1, 30), F.lit("/"), F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[+=]", ""), 1, 9)))
    )
    other = draw("other", 16)
    other_value = (
        F.when(other <= 1, cased(F.substring(digest, 1, length)))
        .when(other == 2, F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .when(other == 3, F.substring(F.regexp_replace(digest, "[a-f]", "7"), 1, F.greatest(length / 2, F.lit(12)).cast("int")))
        .when(other == 4, F.concat(word, F.lit("-"), pick("w2", ["2024-01-15", "v1", "item_12", "0001"]), F.lit("-"), word))
        .when(other == 5, F.concat(pick("ph", ["your_token_here_1", "changeme123456", "xxxxxxxxxxxx1", "EXAMPLEKEY12345", "insert-key-here-0", "your-password-here", "changeme", "<hidden>", "********", "placeholder"])))
        .when(other == 6, F.concat(F.lit("/usr/lib/"), word, F.lit("64/"), word, F.lit("/v2")))
        .when(other == 7, F.concat(word, any_word("w3"), F.substring(F.regexp_replace(digest, "[a-f]", "3"), 1, 3)))
        .when(other == 8, F.concat(F.lit("20240115T1030"), F.substring(F.regexp_replace(digest, "[a-f]", "1"), 1, 4), F.lit("Z-id")))
        .when(other == 9, F.concat(F.upper(word), F.lit("_"), any_word("w3"), F.lit("_2")))
        .when(other <= 11, any_word("w4"))
        .when(other == 12, F.concat(new_word("w4"), pick("w7", ["", "-", "_"]), new_word("w5")))
        .when(other == 13, F.concat(pick("c1", ["process.env.", "os.environ.", "config.", "self."]), F.when(draw("up", 2) == 0, F.upper(any_word("w5"))).otherwise(any_word("w5")), pick("c3", ["", "_TOKEN", "_key", ".value"])))
        .when(other == 14, F.concat(pick("c2", ["get", "load", "read_", "fetch"]), F.initcap(any_word("w5")), F.lit("()")))
        .otherwise(F.concat(F.lit("${"), F.upper(any_word("w5")), F.lit("}")))
    )
    other_before = F.when(other <= 1, pick("ob", ["commit ", "sha256: ", "md5 = ", 'checksum: "', "digest=", "etag: \"", "revision "])).when(
        (other == 5) | (other >= 10), F.when(draw("bear", 8) == 0, F.lit("the bearer ")).otherwise(F.concat(name, glue))
    ).otherwise(pick("op", ["see the ", "order ", "the number ", "version ", "path=", "id: ", "and the ", "of on "]))
    lead = pick("lead", ["the ", "on a ", "", "set ", "\n", "est ", "of ", "export "])
    bearer = (kind <= 5) & (draw("bear", 6) == 0)
    secret_before = F.when(kind == 9, pick("kb", ["key: ", "\n", "", "private_key = \"", "the "])).when(bearer, F.lit("Authorization: Bearer ")).otherwise(F.concat(lead, cased(F.concat(name, glue))))
    before = F.when(label == 1, secret_before).otherwise(other_before)
    return spark.range(n, numPartitions=4).withColumn("drawn", drawn).select(
        before.alias("before"),
        F.when(label == 1, secret_value).otherwise(other_value).alias("value"),
        F.when(before.rlike("[\"']$"), F.concat(F.right(before, F.lit(1)), F.lit(" and"))).otherwise(pick("aft", [" and", "", ".", "\n", " the"])).alias("after"),
        pick("path", ["src0", "src7", "app/config.yml", "tests/fixture.py", "docs/example.md", ".env", "main.py"]).alias("path"),
        label.cast("double").alias("label"),
    )


def fit(findings: DataFrame, words: list[str] | None = None) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, value, after, path, label 0 or 1), with the words of the dictionary."""
    rows = findings.where("value IS NOT NULL AND label IS NOT NULL").select(
        array_to_vector(F.array(*_features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), words))).alias("features"), "label"
    )
    # The forest plans its input several times over: with all properties in each plan the driver's memory grew by gigabytes of
    # garbage. A checkpoint is planned once and keeps rows and partitions as they are, so the forest stays the same.
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(checkpointed(rows))


def _arrays(tree) -> dict:
    """A tree of Spark ML as arrays: feature (-1 at a leaf), threshold, left and right child, share of secrets."""
    out: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "p": []}

    def add(node) -> int:
        at = len(out["f"])
        stats = list(node.impurityStats().stats())
        for key, value in zip("ftlrp", (-1, 0.0, 0, 0, float(stats[1]) / max(1e-9, sum(map(float, stats))))):
            out[key].append(value)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            out["f"][at], out["t"][at] = split.featureIndex(), split.threshold()
            out["l"][at], out["r"][at] = add(node.leftChild()), add(node.rightChild())
        return at

    add(tree._call_java("rootNode"))
    return out


def forest(model: RandomForestClassificationModel) -> Column:
    """The trees as one constant column."""
    trees = [_arrays(t) for t in model.trees]
    return F.from_json(F.lit(json.dumps(trees)), "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,p:array<double>>>")


def _share(trees: Column, x: Column) -> Column:
    """Mean share of secrets in the leaves that x reaches."""

    def leaf(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            feature = F.get(tree["f"], node)
            return F.when(feature < 0, node).when(F.get(x, feature) <= F.get(tree["t"], node), F.get(tree["l"], node)).otherwise(F.get(tree["r"], node))

        return F.get(tree["p"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step))

    return F.aggregate(F.transform(trees, leaf), F.lit(0.0), lambda a, b: a + b) / F.size(trees)


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, path: str = "source", output: str = "findings") -> DataFrame:
    """docs with a column `output`: array of (start, stop, value, score, secret) in the order of the text.

    start and stop count code points from 0, stop exclusive. secret holds where the forest's share is
    over `threshold`. A null or empty text has an empty array. findings: labelled findings to train on
    instead of the built-in ones. The texts are read twice, at first for the dictionary. A column of that name is replaced; without a column `path` the path is empty.
    """
    words = dictionary(docs)
    # Saved first, so that the rules for findings and their properties are planned one after the other.
    trees = forest(fit(checkpointed(labelled_findings(docs.sparkSession, words=words)) if findings is None else findings, words))
    docs = docs.drop(output)
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))

    def judge(c: Column) -> Column:
        x = F.array(*_features(c["value"], F.right(c["before"], F.lit(BESIDE)), F.left(c["after"], F.lit(BESIDE)), where, words))

        def scored(score: Column) -> Column:
            return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["value"].alias("value"), F.round(score, 6).alias("score"), (score > threshold).alias("secret"))

        return let(let(x, lambda x: _share(trees, x)), scored)

    found = F.transform(matches(text, CANDIDATE), judge)
    return docs.withColumn(output, F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string,score:double,secret:boolean>>")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by MARK; n_chars, where there is one, follows the text.

    A null text stays null, all rows and columns stay, repeated rows are redacted alike; an empty table gives an empty one.
    """
    name = unused(docs, "findings")
    found = F.col(name)
    some = F.exists(found, lambda c: c["secret"])
    # The text between candidates stays; so do candidates that are no secrets.
    kept = lambda i: F.coalesce(F.when(F.get(found, i)["secret"], F.lit(MARK)).otherwise(F.get(found, i)["value"]), F.lit(""))
    pieces = F.transform(F.split("text", CANDIDATE, -1), lambda gap, i: F.concat(gap, kept(i)))
    text = F.when(some, F.array_join(pieces, "")).otherwise(F.col("text"))
    out = scan(docs, output=name).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score and the forest's decision; secrets only as digests."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", F.explode("findings").alias("f"))
    return found.select("doc_id", "f.start", "f.stop", F.sha2("f.value", 256).alias("value_sha256"), "f.score", "f.secret")
