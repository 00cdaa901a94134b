"""Content hashes, kept results, component bases, linkage and parameter files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import cache, components, parameters, records


def test_data_hash():
    h = cache.data_hash
    assert h({"a": 1, "b": [1, 2]}) == h({"b": [1, 2], "a": 1}) and h({1, 2, 3}) == h({3, 2, 1}) and len(h(None)) == 40 and len(h(1, "md5")) == 32
    values = [None, True, 1, 1.0, "1", b"1", [1], (1,), {1}, {1: 1}, np.array([1]), np.array([1.0]), np.array([[1]]), [1, 2], [2, 1], [[1], 2], "", [], float("nan")]
    assert len({h(v) for v in values}) == len(values) and h(np.int64(1)) == h(1)
    with pytest.raises(TypeError):
        h(object())


def test_content_hash(spark):
    rows = [(1, "a", 1.5, [1, 2]), (2, None, None, None), (2, None, None, None), (3, "", 0.0, [])]
    df = spark.createDataFrame(rows, "k long, s string, v double, xs array<int>")
    first = cache.content_hash(df)
    assert first == cache.content_hash(df.repartition(3).orderBy(F.desc("k"))) == cache.content_hash(df.select("xs", "v", "s", "k"))
    others = [df.limit(3), df.unionByName(df.where("k = 1")), df.withColumn("s", F.coalesce("s", F.lit(""))), df.withColumnRenamed("s", "t"), df.withColumn("k", F.col("k").cast("int")), df.withColumn("xs", F.lit(None).cast("array<int>"))]
    hashes = [cache.content_hash(x) for x in others]
    assert len({first, *hashes}) == 7
    moved = [spark.createDataFrame([r], "a string, b string") for r in [("x", None), (None, "x")]]
    assert cache.content_hash(moved[0]) != cache.content_hash(moved[1]) and cache.content_hash(df.limit(0)) == cache.content_hash(df.where("false"))


def test_cached_compute(spark, tmp_path):
    calls = []

    @cache.cached_compute(f"file://{tmp_path}/c", prefix="sum", by=("df", "power"))
    def total(df, power=1, note=""):
        calls.append(power)
        return df.agg(F.sum(F.pow("v", F.lit(power))).alias("s"))

    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert [total(df).first().s, total(df, note="other").first().s, total(df, 2).first().s, total(df.repartition(2), power=2).first().s] == [3, 3, 5, 5] and calls == [1, 2]
    assert total(df.unionByName(df)).first().s == 6 and total(df, overwrite=True).first().s == 3 and total(df, cache=False).first().s == 3 and calls == [1, 2, 1, 1, 1]
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "c").iterdir()) == ["sum"] * 3
    with pytest.raises(Exception):
        cache.stored(spark, f"file://{tmp_path}/c", "bad", lambda: spark.sql("SELECT raise_error('no') AS x"))
    assert not (tmp_path / "c" / "bad").exists()


def test_basis(spark, tmp_path):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(2, 6, 6))
    x = {c: rng.normal(size=(200, 6)) @ mix[c] + c for c in range(2)}
    waves = spark.createDataFrame([(c, i, v.tolist()) for c, a in x.items() for i, v in enumerate(a)], "ch int, spike long, values array<double>")
    basis = components.fit_basis(waves, 3)
    path = f"file://{tmp_path}/s.pca.1"
    components.save_basis(basis, path, tag=7, shift=2)
    back, header = components.load_basis(spark, path, 6)
    assert header == {"n_channels": 2, "n_components": 3, "n_samples": 6, "tag": 7, "centred": True, "shift": 2}
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, basis.collect()), key=str)
    got = {(r.ch, r.spike, r.component): r.score for r in components.project(waves, back).collect()}
    for c, a in x.items():
        rest = a - a.mean(axis=0)
        _, _, v = np.linalg.svd(rest)
        want = rest @ v[:3].T
        for k in range(3):
            mine = np.array([got[c, i, k] for i in range(200)])
            assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-6
    with pytest.raises(ValueError):
        components.load_basis(spark, path, 5)
    with pytest.raises(ValueError):
        components.save_basis(basis.where("component <> 1 OR ch = 0"), path)


def test_links(spark, tmp_path):
    rows = spark.createDataFrame([("x.clp", i, [v]) for i, v in enumerate([2, 0, 3, 2, 0])], "file string, idx long, values array<long>")
    records.write_records(rows, f"file://{tmp_path}", "parents", header="count")
    links = components.read_links(spark, f"file://{tmp_path}/x.clp")
    assert {r.atom: r.fibre for r in components.atom_to_fibre(links).collect()} == {1: 2, 3: 3, 4: 2}
    assert {r.fibre: (r.n_atoms, r.atoms) for r in components.fibre_to_atoms(links, include_zero=True).collect()} == {2: (2, [1, 4]), 3: (1, [3]), 0: (2, [2, 5])}


def test_parameters(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<parameters version="1"><nChannels>4</nChannels><anatomicalDescription><channelGroups><group><channel skip="0">3</channel><channel skip="1">1</channel></group></channelGroups></anatomicalDescription>'
        "<spikeDetection><channelGroups><group><channels><channel>2</channel><channel>0</channel></channels><nSamples>32</nSamples></group><group><channels><channel>5</channel></channels></group></channelGroups></spikeDetection></parameters>"
    )
    (tmp_path / "b.json").write_text(json.dumps({"spikeDetection": {"channelGroups": [{"channels": [4, 6]}, {"channels": []}, {"channels": [9]}]}, "anatomicalDescription": {"channelGroups": [{"channels": [{"id": 8, "skip": 0}]}]}, "lfpSampleRate": 1250.0, "x": None}))
    (tmp_path / "c.par").write_text("# old\n8 16\n50 20\n")
    found = {}
    for name in ("a.xml", "b.json", "c.par"):
        p = parameters.read_parameters(spark, f"file://{tmp_path}/{name}")
        found[name] = {r.path: r.value for r in p.collect()}, *(sorted((r.group, r.position, r.channel) for r in parameters.channel_groups(p, s).collect()) for s in ("spike", "anat"))
    values, spike, anat = found["a.xml"]
    assert values["nChannels"] == "4" and values["version"] == "1" and spike == [(0, 0, 2), (0, 1, 0), (1, 0, 5)] and anat == [(0, 0, 3), (0, 1, 1)]
    values, spike, anat = found["b.json"]
    assert values["lfpSampleRate"] == "1250.0" and values["x"] is None and spike == [(0, 0, 4), (0, 1, 6), (2, 0, 9)] and anat == [(0, 0, 8)]
    assert found["c.par"][0] == {"[0][0]": "8", "[0][1]": "16", "[1][0]": "50", "[1][1]": "20"}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "d.yaml").write_text(yaml.safe_dump({"spikeDetection": {"channelGroups": [{"channels": [1, 2]}]}}))
    assert sorted((r.group, r.position, r.channel) for r in parameters.channel_groups(parameters.read_parameters(spark, f"file://{tmp_path}/d.yaml")).collect()) == [(0, 0, 1), (0, 1, 2)]
