"""Each query with a contract against a plain Python version of it, over whole tables."""

import hashlib
import re
import zlib

import pytest

from pulsegrid.llm import catalog

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return {r.doc_id: r.text or "" for r in rows}


def result(spark, sf_dir, name):
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_shards(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op1_histogram_shards")
    assert out.keys() == docs.keys()
    shards = {}
    for i, r in out.items():
        assert r.size == len(docs[i].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[i].encode()) and r.law == "bytes" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(40))
    mean, largest = sum(r.size for r in out.values()) / 40, max(r.size for r in out.values())
    for rows in shards.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - mean) <= largest + 0.01 * mean


def test_fingerprints(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op3_fingerprints")
    assert out.keys() == docs.keys()

    def shingles(text):
        w = [x for x in re.split("[ \t\n\x0b\f\r]+", text.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(docs, reverse=True)
    off = []
    for at, i in enumerate(order):
        r, text, after = out[i], docs[i], docs[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(r.near_edited - like(shingles(text), shingles(edited)))
        assert abs(off[-1]) < 0.25
        assert abs(r.near_next - like(shingles(text), shingles(after))) < 0.25
        assert abs(r.distinct_shingles - len(shingles(text))) <= 0.5 * len(shingles(text))
    assert abs(sum(off) / len(off)) < 0.02
    by_text = {}
    for i, text in docs.items():
        assert by_text.setdefault(text, out[i].fingerprint) == out[i].fingerprint


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(digits):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows, docs):
    for i, r in rows.items():
        want = base_spans(docs[i])
        for kind in PII:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in want), (i, kind)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_pii(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op7_pii")
    assert out.keys() == docs.keys()
    check_pii(out, docs)


def test_bpe(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = result(spark, sf_dir, "op8_bpe")
    assert out.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_file(spark, sf_dir, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = result(spark, sf_dir, "op9_token_file")
    assert out.keys() == docs.keys()
    start = 0
    for i in sorted(docs):
        ids = [*library.encode(docs[i], add_special_tokens=False).ids, 1]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def components(docs, width=3, percent=85):
    """Brute force: all pairs of texts that share a shingle."""
    sets, texts = {}, {}
    for i, text in sorted(docs.items()):
        w = WORDS.findall(text.encode().translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
        texts.setdefault(sets[i], i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    lists = {}
    for s, i in texts.items():
        shared = {}
        for x in s:
            for j in lists.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            lists[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(texts[s]) if s else i) for i, s in sets.items()}


def test_near_dedup(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op10_near_dedup")
    want = components(docs)
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in out.items())
