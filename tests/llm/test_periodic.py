"""Periodic runs against brute force: every period of every document, with numpy."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pulsegrid.llm import catalog, periodic

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    """(start, length, period) of all runs: stretches where words a period apart are equal, less those of a smaller period."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    a, out = np.array([ids[x] for x in w], np.int64), []
    for q in range(1, len(a) // 3 + 1):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in edges.tolist():
            n = e - s + q
            if n >= max(24, 3 * q) and not any(t <= s and s + n <= t + m and q % p == 0 for t, m, p in out):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def values(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_contract(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalog.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: values(r) for r in rows} == {i: expected(i, t) for i, t in docs.items()}
    assert sum(r.n_runs for r in rows) > 0


def test_small_alphabets():
    rng = random.Random(5)
    for _ in range(400):
        symbols, want = [], []
        for k in range(rng.randint(1, 3)):
            w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 150))]
            for _ in range(rng.randint(0, 3)):
                if w:
                    a, p = rng.randrange(len(w)), rng.randint(1, 12)
                    for i in range(a, min(len(w), a + p * rng.randint(2, 8) + rng.randint(0, p))):
                        w[i] = w[a + (i - a) % p]
            want += [(s + len(symbols), n, p) for s, n, p in all_runs(w)]
            symbols += [x + 10 * k for x in w] + [1000 + k]
        assert periodic.runs(np.array(symbols, np.int64)) == want


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(7, "a b " * 20)] * n, "doc_id long, text string")
    assert [values(r) for r in periodic.periodic_runs(docs).collect()] == [(1, 0, 40, 2, 20000, hashlib.sha256(b"0,40,2\n").hexdigest(), hashlib.sha256(b"a b").hexdigest())] * n


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "y z " * 25), (5, "w " * 60_000), (6, "x X " * 12), (6, "x X " * 12), (8, "a b c d " * 5 + "a b c")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, period int, n_runs string").repartition(2)
    got = sorted(((r.doc_id or 0), r.n_runs, r.start, r.length, r.period) for r in periodic.periodic_runs(docs, periodic._planted).collect() if r.n_runs)
    want = sorted((r[0] or 0, *expected(*r)[:4]) for r in rows if r[0] is not None and expected(*r)[0])
    assert got == sorted([(0, 1, 0, 30, 1), *want])
    assert periodic.periodic_runs(docs.where("false")).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert [values(r) for r in periodic.periodic_runs(docs.where("doc_id < 4")).collect()] == [(0, None, None, None, None, nothing, nothing)] * 3
