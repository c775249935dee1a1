"""Patched frame-of-reference files: exact round trips against plain encoding."""

from __future__ import annotations

import zlib
from collections import Counter

import awkward
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sieveline.llm import token_store
from sieveline.llm.queries import QUERIES


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(plain, rows):
    """(doc, tokens, crc) of every row."""
    out = []
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    return out


def check(got, want):
    """The rows, without gaps, in ascending order of ids with missing ones first."""
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered][:-1]]).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=700))
def test_blocks_round_trip(values):
    v = np.array(values, np.uint32)
    data, starts = token_store.encode_blocks(v)
    assert (token_store.decode_blocks(data, starts)[: len(v)] == v).all() if len(v) else not len(data)


def test_outliers_cost_their_own_bytes_only():
    v = np.arange(1280, dtype=np.uint32) % 8 + 1000
    v[::128] = 4_000_000_000
    data, starts = token_store.encode_blocks(v)
    assert len(starts) == 10 and len(data) == 10 * (8 + 3 * 16 + 5)
    data, _ = token_store.encode_blocks(np.full(1280, 9, np.uint32))
    assert len(data) == 10 * 8


@pytest.mark.parametrize("file_ids", [4 << 20, 700])
def test_documents_come_back(spark, plain, tmp_path, file_ids):
    df = spark.createDataFrame(awkward.rows(), awkward.SCHEMA).repartition(5)
    path = str(tmp_path / "store")
    token_store.write_token_store(df, path, file_ids=file_ids)
    got = token_store.read_token_store(spark, path, keep_ids=True).collect()
    check(got, expected(plain, [r[:2] for r in awkward.rows()]))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 2 for r in got)
    stream = [i for r in sorted(got, key=lambda r: r.start) for i in r.ids]
    for start, n in ((0, 5), (690, 300), (len(stream) - 3, 50), (len(stream), 4), (123, 20_000)):
        parts = sorted(token_store.token_slice(spark, path, start, n).collect())
        assert [i for p in parts for i in p.ids] == stream[start : start + n]
        assert not parts or parts[0].start == start


def test_awkward_tables(spark, plain, tmp_path):
    names = T.StructType([T.StructField("number", T.LongType()), T.StructField("part", T.StringType()), T.StructField("ids", T.IntegerType())])
    rows = [(3, "a # b", 1), (3, "a # b", 1), (3, "c", 1), (None, None, 1), (None, "x # ##", 2), (-4, "", 3)]
    token_store.write_token_store(spark.createDataFrame(rows, names), str(tmp_path / "a"), id_col="number", text_col="part")
    got = token_store.read_token_store(spark, str(tmp_path / "a"), id_col="number")
    check(got.withColumnRenamed("number", "doc_id").collect(), expected(plain, [r[:2] for r in rows]))
    token_store.write_token_store(spark.createDataFrame([], awkward.SCHEMA), str(tmp_path / "b"))
    assert token_store.read_token_store(spark, str(tmp_path / "b")).collect() == []
    assert token_store.token_slice(spark, str(tmp_path / "b"), 0, 9).collect() == []


def test_bytes_that_are_no_text(spark, plain, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"ab\xff cd")), (2, bytearray(b"plain"))], "doc_id long, text binary")
    token_store.write_token_store(df, str(tmp_path / "c"))
    check(token_store.read_token_store(spark, str(tmp_path / "c")).collect(), expected(plain, [(1, "ab\ufffd cd"), (2, "plain")]))


def test_one_id_for_most_rows(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "PART_BYTES", 500)
    rows = [(7 if i % 3 else i, f"text {i % 5} of many") for i in range(300)] + [(None, f"no id {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_store.write_token_store(df, str(tmp_path / "d"), file_ids=50)
    got = token_store.read_token_store(spark, str(tmp_path / "d")).collect()
    check(got, expected(plain, rows))
    assert [r.n for r in spark.read.format("binaryFile").load(str(tmp_path / "d")).selectExpr("count(*) as n").collect()][0] > 20


def test_query(spark, plain):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_token_store"](spark, "/root/testdata/sf0.001").collect()
    check(got, expected(plain, given))
