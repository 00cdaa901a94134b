"""Collocations against SQL and brute force, and the bounded automaton against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import catalog, phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least, covered=80, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = [b for (lang2, q), b in found.items() if lang2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in inside):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:first]))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    got = sorted(map(tuple, catalog.QUERIES["op11_phrases"](spark, sf_dir).select(*columns.split(", ")).collect()))
    assert got == sorted(con.sql(f"SELECT {columns} FROM ({phrases.SQL})").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = ["New York is BIG. new york, NEW YORK; new\tyork  is", "", None, " .,;\n ", "é É été", "one " * 3000, "of the of the of"]
    texts += [" ".join(rng.choice("a b c d of the new york".split()) + rng.choice(["", "", ".", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(k, rng.choice(["en", "de", None, "und", ""]), t, 1, "x") for k, t in enumerate(texts)] + [(1, "en", "a b c d", 1, "x")] * 5
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, rank int, phrase string").repartition(3)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_brute_force(odd, least):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd, least).collect())) == expected(rows, least)
    assert sorted(map(tuple, phrases.collocations(odd, least, first=3).collect())) == expected(rows, least, first=3)


def test_small_shards(odd, monkeypatch):
    rows = [(r.lang, r.text) for r in odd.collect()]
    monkeypatch.setattr(phrases, "SHARD", 50)
    found = Counter()
    table = odd.select("lang", "text").na.fill("und", ["lang"]).where("text IS NOT NULL").toArrow().combine_chunks()
    for shard in phrases._shards(iter(table.to_batches(max_chunksize=7)), {}, texts=True):
        end, length, count = phrases.Automaton(shard.symbol, shard.room(shard.opens), 4).substrings()
        for e, d, c in zip(end.tolist(), length.tolist(), count.tolist()):
            found[" ".join(shard.text(i) for i in range(e - d + 1, e + 1))] += c
    want = Counter()
    for _, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            want.update(" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert found == want


def test_automaton():
    """Classes of equal end positions, with their links, on random pieces."""
    rng = random.Random(2)
    for depth in (1, 2, 3, 4, 6):
        for _ in range(60):
            n = rng.randint(0, 40)
            w = [rng.randrange(3) for _ in range(n)]
            opens = [i == 0 or rng.random() < 0.15 for i in range(n)]
            room, run = [], 0
            for o in opens:
                run = 1 if o else run + 1
                room.append(run)
            ends = {}
            for i in range(n):
                for d in range(1, min(depth, room[i]) + 1):
                    ends.setdefault(tuple(w[i - d + 1 : i + 1]), set()).add(i)
            classes = {}
            for p, e in ends.items():
                classes.setdefault(frozenset(e), []).append(p)
            a = phrases.Automaton(np.array(w, np.int64), np.array(room, np.int64), depth)
            longest = [tuple(w[e - m + 1 : e + 1]) for e, m in zip(a.end.tolist(), a.length.tolist())]
            assert sorted(longest) == sorted(max(c, key=len) for c in classes.values())
            for s, p in enumerate(longest):
                assert a.count[s] == len(ends[p]) and a.shortest[s] == min(len(q) for q in classes[frozenset(ends[p])])
                k = a.shortest[s] - 1
                assert a.link[s] == (longest.index(max(classes[frozenset(ends[p[len(p) - k :]])], key=len)) if k else -1)
            listed = {tuple(w[e - d + 1 : e + 1]): c for e, d, c in zip(*(x.tolist() for x in a.substrings()))}
            assert listed == {p: len(e) for p, e in ends.items()}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([("en", "a b a b")] * n, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, 1).collect())) == expected([("en", "a b a b")] * n, 1)


def test_shards_give_out_a_few_rows_at_once(monkeypatch):
    """op11 (check): no batch holds all that a shard gives out, and the batches add up to its phrases."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "ROWS", 10)
    texts = ["one two three. four five six seven", "one two three four", "eight nine"]
    full = np.full(phrases.BITS // 8, 255, np.uint8)
    table = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "text": texts})

    class Shared:
        value = full, full

    made = list(phrases._count_phrases(Shared)(iter([table])))
    assert max(b.num_rows for b in made) <= 10
    got = Counter({(r["lang"], r["phrase"]): r["f"] for b in made for r in b.to_pylist() if r["words"]})
    want = Counter()
    for lang, text in zip(["en", "en", "de"], texts):
        for piece in text.split("."):
            w = piece.split()
            want.update((lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want
    assert {(r["lang"], r["f"]) for b in made for r in b.to_pylist() if not r["words"]} == {("en", 11), ("de", 2)}
