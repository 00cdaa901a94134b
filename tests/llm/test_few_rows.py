"""All queries and the pipeline over tables of one row and of two."""

import pytest

import corpus_pipeline
from pulsegrid.llm import catalog

KEYS = {"op5_tool_calls": None, "op2_secret_scan": None, "op4_decontaminate": None, "op11_phrases": None, "op12_best_fit": 1}


@pytest.fixture(scope="module", params=[1, 2])
def tiny(request, spark, tmp_path_factory):
    n, folder = request.param, tmp_path_factory.mktemp("tiny")
    text = 'one two three four five six. token = "9fceb02d0ae598e95dc970b74767f19372d61af8" a.b@c.de'
    tables = {
        "documents": ([(7 - i, text, "en", "s", len(text)) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": ([(i, f"what is {i} two three four? five") for i in range(n)], "item_id long, text string"),
        "labels": ([(7 - i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int"),
        "conversations": ([("c", i, "assistant" if i else "user", "hello") for i in range(n)], "conv_id string, turn int, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return n, str(folder)


@pytest.mark.parametrize("name", [*catalog.QUERIES, "pipeline"])
def test_few_rows(spark, tiny, name):
    n, folder = tiny
    rows = (corpus_pipeline.run if name == "pipeline" else catalog.QUERIES[name])(spark, folder).collect()
    if name == "pipeline":
        assert [r.doc_id for r in rows] == [8 - n]  # equal texts: that of the least doc_id stays
    elif KEYS.get(name, 1):
        assert sorted(r.doc_id for r in rows) == list(range(8 - n, 8))
