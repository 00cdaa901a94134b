"""The bootstrap of contextual patterns against a plain Python version, with planted contexts among all documents of a table."""

import math
import random
import re

from pulsegrid.llm import pii
from tests.llm.test_contracts import base_spans

LONG = "w" * 50


def planted():
    """Seeds in contexts of their own, unseen numbers in the same contexts, and what only a second round can reach."""
    rng = random.Random(4)
    out = [f"please call the hotline +1 (555) 010-20{i:02d} today or write to user{i}@mail.org now" for i in range(12)]
    out += [f"please call the hotline 77-88-99{i:02d} today" for i in range(8)]
    out += [f"they left a desknote 77-88-99{i:02d} there" for i in range(8)]
    out += [f"they left a desknote 66-55-44{i:02d} there" for i in range(3)]
    out += [f"the {LONG}a 10.0.0.{i} up" for i in range(9)] + [f"the {LONG}b 2024.{i} up" for i in range(9)] + [f"the {LONG}a fe80:0:0:{i} up" for i in range(4)]
    out += [f"in the year {1900 + i} it {'rained' if rng.random() < 0.5 else 'snowed'}" for i in range(30)]
    return out


def plain_bootstrap(texts):
    """Added (kind, start, stop) of each text; numbers here are single words."""
    word = lambda w: re.sub(r"^[^\w=:]+|[^\w=:]+$", "", w.lower())
    bit = {k: 1 << i for i, k in enumerate(pii.PATTERNS)}
    mentions = []
    for n, text in enumerate(texts):
        base = base_spans(text)
        spans = [(k, a, z) for k, a, z in base]
        for m in re.finditer(r"\S+", text):
            if re.search(r"[0-9@:]", m[0]) and not any(a < m.end() and m.start() < z for _, a, z in base):
                spans.append((None, m.start(), m.end()))
        for kind, a, z in spans:
            value = text[a:z]
            may = sum(bit.values()) if kind or sum(c.isdigit() for c in value) >= 4 else (bit["email"] if "@" in value else 0) | (bit["ip"] if re.search(pii.HEX_GROUPS, value) else 0)
            before, after = text[max(0, a - 64) : a].split(), text[z : z + 64].split()
            left, right = word(before[-1]) if before else "", word(after[0]) if after else ""
            if may and left:
                mentions.append((n, a, z, kind, value, may, [f"L {left}"] + ([f"B {left} _ {right}"] if right else [])))
    total, seeds, unseen = {}, {}, {}
    for _, _, _, kind, value, may, patterns in mentions:
        for p in patterns:
            total.setdefault(p, {}).setdefault(value, 0)
            total[p][value] |= may
            if kind:
                seeds[p, kind, value] = 1.0
            else:
                unseen[p, value] = unseen.get((p, value), 0) | may

    def weighed(support):
        by = {}
        for (p, kind, value), belief in support.items():
            by.setdefault((p, kind), []).append(belief)
        return {k: min(1.0, sum(v) / sum(m & bit[k[1]] > 0 for m in total[k[0]].values())) for k, v in by.items() if len(v) >= pii.LEAST_SEEDS and len(total[k[0]]) >= pii.LEAST_SEEDS}

    shares = weighed(seeds)
    for _ in range(pii.ROUNDS):
        doubt = {}
        for (p, value), may in unseen.items():
            for kind in bit:
                if shares.get((p, kind), 0) >= pii.LEAST_SHARE / 2 and may & bit[kind]:
                    doubt[value, kind] = doubt.get((value, kind), 0.0) + math.log1p(-min(shares[p, kind], 0.99))
        believed = {k: 1 - math.exp(d) for k, d in doubt.items() if 1 - math.exp(d) >= pii.LEAST_BELIEF}
        support = dict(seeds)
        for (p, value), may in unseen.items():
            for kind in bit:
                if (value, kind) in believed and may & bit[kind]:
                    support[p, kind, value] = max(support.get((p, kind, value), 0), believed[value, kind])
        shares = weighed(support)
    out = [set() for _ in texts]
    for n, a, z, kind, value, may, patterns in mentions:
        found = [(shares[p, k], k) for p in patterns for k in bit if shares.get((p, k), 0) >= pii.LEAST_SHARE and may & bit[k]]
        if kind is None and found:
            out[n].add((max(found)[1], a, z))
    return out


def test_planted_contexts(spark, sf_dir):
    texts = planted()
    want = plain_bootstrap(texts)
    assert sum(map(len, want)) >= 15 and any("66-55-44" in texts[n] and want[n] for n in range(len(texts)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = pii.find(docs.unionByName(spark.createDataFrame([(-1 - n, t) for n, t in enumerate(texts)], docs.schema))).collect()
    got = {r.doc_id: {(s.kind, s.start, s.stop) for s in r.added} for r in rows}
    assert [got[-1 - n] for n in range(len(texts))] == want
    assert all(not found for i, found in got.items() if i >= 0)
    assert {r.doc_id: [(s.kind, s.start, s.stop) for s in r.base] for r in rows if r.doc_id < 0} == {-1 - n: base_spans(t) for n, t in enumerate(texts)}
