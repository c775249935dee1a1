"""Rows that operators must survive: nulls, empty and very long texts, copies, ties, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import types as T

LONG = " ".join(random.Random(5).choices(["ab", "cd", "ef", "gh", "ij\n", "käl"], k=60_000))


def texts() -> list[str | None]:
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 6))) for _ in range(400)]
    out: list[str | None] = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 120))) for _ in range(60)]
    passage = " ".join(draw.choices(vocabulary, k=70))
    out += [f"{out[i]} {passage} {out[i + 1]}" for i in range(6)]
    out += [out[0], out[1], out[1]]  # exact copies
    out += [out[i].replace(" ", "\n", 3) + " Tail" for i in range(5, 9)]  # near copies
    out += [None, None, "", " \t\n", "...!!! 123", "one", "word " * 300, "été naïve 你好 \U0001f600", "x" * 5000, LONG]
    return out


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves, or that are awkward to write
    T.StructField("key", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("score", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("a b.c", T.IntegerType()),
    T.StructField("id", T.StructType([T.StructField("x y", T.IntegerType())])),
])


def rows(null_id: bool = True) -> list[tuple]:
    out = []
    for i, t in enumerate(texts()):
        source = [None, "s1", "s2", "s2", "s2", "t"][i % 6]
        out.append((i, t, [None, "en", "de"][i % 3], source, len(t) if t is not None else None, "k", i, "old", "old", i, (i,)))
    out.append(out[3])  # a repeated row
    if null_id:
        out.append((None, "a row without an id, which stays what it is", "en", "s1", 3, None, None, None, None, None, None))
    return out
