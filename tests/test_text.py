"""Similarity, lists, replies and readers on hand-made texts."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import ranks, textpipe
from sieveline.operators import select as sel
from sieveline.sources import readers, sinks


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abc d", max_size=80), st.text("abc d", max_size=80))
def test_lcs_ratio(a, b):
    want = 100 if not a and not b else int(round(200 * _lcs(a, b) / (len(a) + len(b))))
    assert ranks.lcs_ratio(a, b) == want


def test_lcs_column(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("abc", ""), ("", ""), ("Age", "Age"), ("a b", "b a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select("a", "b", ranks.lcs_length(F.col("a"), F.col("b")).alias("l"), ranks.similarity(F.col("a"), F.col("b")).alias("s"))
    for r in out.collect():
        assert r["l"] == _lcs(r["a"], r["b"])
        assert r["s"] == ranks.lcs_ratio(r["a"], r["b"])


def test_fuzzy_match_takes_the_first_best_and_any_list_length(spark, monkeypatch):
    monkeypatch.setattr(ranks, "_MATCH_CHUNK", 2)
    concepts = spark.createDataFrame([("bmi", 0), ("age", 1), ("Age", 2), ("sex", 3)], "concept string, pos int")
    df = spark.createDataFrame([("Age.",), ("aXe",), ("sex",), (None,)], "t string")
    got = {r["t"]: r["concept"] for r in ranks.fuzzy_match(df, "t", concepts).collect()}
    # 'aXe' ties between 'age' and others below it: the first in the list wins
    assert got == {"Age.": "Age", "aXe": "age", "sex": "sex", None: "bmi"}


def test_replies(spark):
    texts = [
        '{"reasoning": "a", "score": 0.5}', 'Sure!\n{"reasoning": "b",\n "score": 1}\nDone', '{"score": "0.25"}',
        "nothing", '{"score": "high"}', "{broken", '{"score": NaN}', '{"reasoning": "only"}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id int, text string")
    got = {r["sample_id"]: r["score"] for r in textpipe.parse_scores(df).collect()}
    assert got == {0: 0.5, 1: 1.0, 2: 0.25, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_list_round_trip(spark):
    df = spark.createDataFrame([(["a", "b c", "d"],)], "x array<string>")
    assert df.select(tx.numbered_list("x").alias("t")).select(tx.numbered_items("t")).first()[0] == ["a", "b c", "d"]


def test_ranked_list_selection(spark):
    concepts = spark.createDataFrame([(c, i) for i, c in enumerate(["age", "bmi", "sex", "glucose"])], "concept string, pos int")
    lists = spark.createDataFrame([("m", 0, "Glucose"), ("m", 1, "bmi"), ("m", 2, "glucose!")], "k string, pos int, text string")
    full = sel.select_ranked(lists, ["k"], concepts, ratio=1.0).orderBy("pos").collect()
    names = [r["concept"] for r in full]
    assert names[:2] == ["glucose", "bmi"] and set(names) == {"age", "bmi", "sex", "glucose"}
    assert len(sel.select_ranked(lists, ["k"], concepts, ratio=0.5).collect()) == 2
    assert len(sel.select_ranked(lists, ["k"], concepts, topk=3).collect()) == 3


def test_borda_counts_missing_concepts_last(spark):
    concepts = spark.createDataFrame([("a",), ("b",), ("c",)], "concept string")
    samples = spark.createDataFrame(
        [("m", 0, 0, "b"), ("m", 0, 1, "a"), ("m", 0, 2, "c"), ("m", 1, 0, "b"), ("m", 1, 1, "c")],
        "k string, sample_id int, pos int, concept string")
    got = {r["concept"]: (r["mean_rank"], r["pos"]) for r in ranks.borda(samples, ["k"], "sample_id", concepts).collect()}
    assert got == {"b": (1.0, 0), "c": (2.5, 1), "a": (3.0, 2)}


def test_sequential_selection_visits_every_concept():
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return "Glucose" if len(asked) == 1 else "something else"

    order = textpipe.sequential_selection(["age", "glucose", "bmi"], ask, lambda c: float(len(c)), "AUROC", start=["age"])
    assert [c for c, _ in order][:2] == ["age", "glucose"] and len(order) == 3
    assert "['age']" in asked[0] and "1.0" in asked[0]


def test_arff(spark, tmp_path):
    path = tmp_path / "x.arff"
    path.write_text(
        "% comment\n@RELATION t\n@ATTRIBUTE age REAL\n@attribute 'own tel' {none, 'yes, sir'}\n"
        "@attribute n integer % note\n@data\n% c\n\n1.5,'yes, sir',3\n?,none,4\n"
    )
    df = readers.read_arff(spark, str(path))
    assert df.dtypes == [("age", "double"), ("own tel", "string"), ("n", "double")]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1.5, "yes, sir", 3.0), (None, "none", 4.0)]


def test_named_prompt_files(spark, tmp_path):
    d = tmp_path / "pima"
    d.mkdir()
    (d / "diabetes_template.txt").write_text("T\n{concept}")
    (d / "diabetes_template_rank.txt").write_text("R")
    (d / "diabetes_context.txt").write_text("C")
    rows = {(r["datapred"], r["kind"]): r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert rows == {
        ("pima/diabetes", "template"): "T\n{concept}", ("pima/diabetes", "template_rank"): "R", ("pima/diabetes", "context"): "C",
    }


def test_size_arguments():
    with pytest.raises(ValueError):
        sel.check_size(0.5, 0.5)
    with pytest.raises(ValueError):
        sel.check_size()
    sel.check_size(threshold=0)


def test_upsert_last_batch_wins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    got = {r["k"]: r["v"] for r in sinks.upsert([a, b], ["k"]).collect()}
    assert got == {1: "x", 2: None, 3: "z"}
