"""Best-fit packing: rounds against a stack, whole results against the contract and a lower bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import catalog, packing


def test_sweep_is_a_stack():
    rng = random.Random(0)
    for _ in range(2000):
        marks = [rng.random() < rng.random() for _ in range(rng.randint(1, 40))]
        stack, want = [], []
        for i, piece in enumerate(marks):
            if not piece:
                stack.append(i)
            elif stack:
                want.append((i, stack.pop()))
        a, b = packing.matched(np.array(marks))
        assert sorted(zip(a.tolist(), b.tolist())) == want


def test_ranges_are_one_sweep():
    """Local sweeps and the carry between ranges match what one sweep over all ranges does."""
    rng = random.Random(1)
    for _ in range(500):
        parts = [[rng.random() < rng.random() for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 6))]
        whole = [(p, i) for p, marks in enumerate(parts) for i in range(len(marks))]
        a, b = packing.matched(np.array([parts[p][i] for p, i in whole], bool)) if whole else ([], [])
        want = {(whole[i], whole[j]) for i, j in zip(a, b)}
        got, rank, left = set(), {}, []
        for p, marks in enumerate(parts):
            of, gap = packing.matched(np.array(marks, bool)) if marks else (np.array([], int),) * 2
            got |= {((p, int(i)), (p, int(j))) for i, j in zip(of, gap)}
            rest = [i for i in range(len(marks)) if i not in {*of.tolist(), *gap.tolist()}]
            for piece in (True, False):
                rank[p, piece] = [i for i in rest if marks[i] == piece]
            left.append((p, len(rank[p, True]), len(rank[p, False])))
        slots = defaultdict(dict)
        for p, piece, low, high, slot in packing.carry(left):
            for r in range(low, high + 1):
                slots[slot + (r - low if piece else high - r)][piece] = (p, rank[p, piece][r])
        got |= {(s[True], s[False]) for s in slots.values()}
        assert got == want


def best_fit_decreasing(lengths, capacity):
    gaps, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = min((i for i in range(len(gaps)) if gaps[i] >= n), key=lambda i: gaps[i], default=None)
        if i is None:
            gaps.append(capacity)
            i, bins = len(gaps) - 1, bins + 1
        gaps[i] -= n
    return bins


def check(rows, capacity):
    """Sequences without gaps and overlaps; their number."""
    by = defaultdict(list)
    for offset, n, sequence in rows:
        by[sequence].append((offset, n))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("name", ["mixed", "tiny", "thirds", "large", "one", "none", "equal"])
def test_best_fit(spark, name):
    rng = random.Random(4)
    lengths = {
        "mixed": [rng.choice([rng.randint(1, 100), rng.randint(1, 40), rng.randint(20, 35)]) for _ in range(400)], "tiny": [2] * 500, "thirds": [rng.randint(31, 35) for _ in range(150)],
        "large": [rng.randint(51, 100) for _ in range(50)], "one": [100], "none": [], "equal": [50] * 31,
    }[name]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, n long")
    got = packing.best_fit(items, 100).collect()
    assert sorted(r.item for r in got) == list(range(len(lengths)))
    bins = check([(r.offset, lengths[r.item], r.sequence) for r in got], 100)
    least, bfd = max(-(-sum(lengths) // 100), sum(n > 50 for n in lengths)), best_fit_decreasing(lengths, 100)
    assert least <= bins <= bfd * 1.02 + 1


def test_wrong_lengths(spark):
    for rows in ([(0, 0)], [(0, 101)], [(-1, 5)], [(None, 5)], [(0, None)]):
        with pytest.raises(ValueError):
            packing.best_fit(spark.createDataFrame(rows, "item long, n long"), 100)


def test_contract(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = catalog.QUERIES["op12_best_fit"](spark, sf_dir).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want, total = {}, 0
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[d.doc_id, k] = (start, len(part), zlib.crc32(part.tobytes()))
    assert len(got) == len(rows) and got == want
    assert check([(r.offset, r.length, r.sequence_id) for r in rows], 4096) <= 1.01 * max(-(-total // 4096), sum(n > 2048 for _, n, _ in want.values())) + 1


def test_edges_and_sequences(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "word " * 700), (1, "word " * 700), (2, None), (2, ""), (None, "a b c"), (3, "some other text"), (4, "x y " * 40)]
    docs = spark.createDataFrame([(*r, 9, "s") for r in rows], "doc_id long, text string, length int, sequence_id string").repartition(3)
    packed = packing.pack(docs, path, capacity=64)
    cut = {(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in packed.collect()}
    assert sum(r.length for r in packed.collect()) == 2 * 701 + 2 + 4 + 4 + 81 and ((2, 0, 0, 1, b"\1\0\0\0") in cut)
    out = packing.sequences(packed).collect()
    for r in out:
        assert len(r.ids) == 4 * sum(r.lengths) <= 4 * 64
    texts = sorted(bytes(r.ids[4 * a : 4 * (a + n)]) for r in out for n, a in zip(r.lengths, np.cumsum([0, *r.lengths]).tolist()))
    assert texts == sorted(bytes(r.ids) for r in packed.collect())
    assert packing.pack(docs.where("false"), path).collect() == []
    for n in (1, 2):
        assert packing.pack(docs.where("doc_id = 3").union(docs.where("doc_id = 4")).limit(n), path).select(F.sum("length")).first()[0] in (4, 81, 85)
