"""The pipeline's stages on a small table, each against a plain version of its decision."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from awkward import SCHEMA, rows
from sieveline.llm import packing, simhash, substring_dedup


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.sparkContext.setCheckpointDir(str(folder / "shared"))
    plain = [c for c in SCHEMA.names[:5]]
    spark.createDataFrame(rows(null_id=False), SCHEMA).select(*plain).write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out, str(folder)


def test_stages(steps):
    out, _ = steps
    names = ["input", *(n for n, _ in corpus_pipeline.STAGES)]
    assert len(corpus_pipeline.STAGES) == 5
    for name in names[:-1]:
        assert out[name].columns == SCHEMA.names[:5]
    tables = {n: out[n].collect() for n in names}
    # language: texts with letters stay
    assert {r.doc_id for r in tables["language"]} <= {r.doc_id for r in tables["input"] if any(c.isalpha() for c in r.text or "")}
    # near copies: the smallest id of each component
    given = sorted(tables["language"], key=lambda r: r.doc_id)
    first = {given[c].doc_id for _, c in simhash.brute_force([r.text for r in given])}
    assert Counter(r.doc_id for r in tables["near_copies"]) == Counter(first)
    # repeats
    given = tables["near_copies"]
    want = {r.doc_id: total - gone for r, (total, gone, _) in zip(given, substring_dedup.brute_force([r.text for r in given], 35), strict=True)}
    assert {r.doc_id: len(r.text.encode().split()) for r in tables["repeats"]} == want
    assert all(r.n_chars == len(r.text) for r in tables["repeats"])
    # mix: sources near their targets
    size, mixed = Counter(), Counter()
    for r in tables["repeats"]:
        size[r.source] += len(r.text.encode().split())
    for r in tables["mix"]:
        mixed[r.source] += len(r.text.encode().split())
    from sieveline.llm.mixing import targets

    assert all(abs(mixed[s] - t) <= 1 for s, t in targets(size).items())
    # pack: every document's ids, gapless
    assert sum(r.length for r in tables["pack"]) == sum(len(packing.ByteBpe().encode(r.text.encode())) + 1 for r in tables["mix"])


def test_run_is_all_stages(steps, spark):
    out, folder = steps
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(map(tuple, out["pack"].drop("sequence_id", "offset").collect()))
