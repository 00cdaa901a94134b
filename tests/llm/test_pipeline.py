"""The pipeline, stage by stage, against plain Python versions on whole tables."""

import hashlib
import re

import corpus_pipeline
from pulsegrid.llm import ordinal_quality
from tests.llm.test_contracts import components


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf_dir).persist())
    rows = [{r.doc_id: r for r in df.collect()} for df in kept]
    assert all(df.columns == docs.columns for df in kept[:-1])

    # Quality: the stage keeps what the operator selects.
    ratings = ordinal_quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    chosen = {r.doc_id for r in ordinal_quality.select(docs, ratings).where("keep").collect()}
    assert set(rows[1]) == chosen and 0 < len(chosen) < len(rows[0])

    # Near-duplicates: the least doc_id of each component, by all pairs.
    found = components({i: r.text or "" for i, r in rows[1].items()}, 5, 80)
    assert set(rows[2]) == {i for i, (_, c) in found.items() if i == c}

    # Decontamination: items that stand in a text as they are, or in other case.
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = {i: " ".join(re.findall(r"\w+", (r.text or "").lower())) for i, r in rows[2].items()}
    assert set(rows[3]) == {i for i, text in plain.items() if not any(item in text for item in items)}

    # Secrets: assigned hexadecimal strings.
    secret = re.compile(r'(?i)(token = ")[0-9a-f]{40}"')
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert r.text == secret.sub(r'\1<SECRET>"', rows[3][i].text) and r.n_chars == len(r.text)

    # Tokens.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert r.ids == library.encode(rows[4][i].text, add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(rows[4][i].text.encode()).hexdigest()


def test_held_out_quality(spark):
    """Half of the rated documents, not used for fitting."""
    sf_dir = "/root/testdata/sf0.01"
    ratings = ordinal_quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    half = ordinal_quality.select(docs.join(ratings, "doc_id", "left_semi"), ratings.where("doc_id % 2 = 0"))
    rest = half.join(ratings.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.keep for r in rest if r.grade == 2], [r.keep for r in rest if r.grade < 2]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.4
