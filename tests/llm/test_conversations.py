"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from sieveline.llm import conversations
from sieveline.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
PUT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def cheapest(rows):
    """(cost, audit, lines): the least (cost, audit) over states, row by row. ``rows`` holds (role, text, fault)."""
    best = {"": (0, "", ())}

    def offer(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    for i in range(len(rows) + 1):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                offer(best, PUT[state], (cost + 2, audit + "I", (*lines, NAMES[PUT[state]] + ":")))
        if i == len(rows):
            break
        role, text, fault = rows[i]
        new: dict = {}
        for state, (cost, audit, lines) in best.items():
            offer(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            if role[:1] in AFTER[state]:
                offer(new, AFTER[state][role[:1]], (more, audit + "K", (*lines, f"{role}:{text}")))
            offer(new, PUT[state], (more + 2, audit + "R", (*lines, f"{NAMES[PUT[state]]}:{text}")))
        best = new
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    """{conv: report} of (conv, turn, role, text) rows."""
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, given in groups.items():
        given.sort()
        seen, marked = set(), []
        for _, _, role, text in given:
            tail = text.rstrip(SPACE)
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for has, t, _, _ in given if has}
        cost, audit, lines = cheapest(marked)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:], strict=False)]
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def damaged(rows, every=20):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % every
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        if draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        if draw == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)


SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("cost", T.StringType()),
])


def rows() -> list[tuple]:
    draw = random.Random(6)
    words = ["Yes.", "No!", "why?", "so it ends", "tail \n", "done. \t", "", " \r\n", "é你.", "a:b\nc."]
    out = []
    for conv in range(60):
        for turn in range(draw.choice([1, 2, 3, 5, 9, 23])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sys"])
            out.append((conv, draw.choice([turn, turn, turn, turn + 2, None]), role, draw.choice([*words, None])))
    out += [(None, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(12)]
    out += [(100, None, None, None), (101, None, "user", "one."), (102, -5, "assistant", "x" * 30_000), (103, 1 << 62, "user", "far."), (103, -(1 << 62), "assistant", "near.")]
    out += [(104, 0, "system", "be brief."), (104, 1, "user", "hi.")] + [(104, 2, "user", "again.")] * 40
    out += [(105, t // 2, draw.choice(["user", "assistant", "system"]), f"{t}{draw.choice(['.', ''])}") for t in range(300)]
    return [(*r, "k", 1, "old") for r in out]


def report_of(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


@pytest.mark.parametrize("limits", [{}, {"LONG_ROWS": 3, "PIECE": 5, "SEGMENT": 3, "BATCH": 9}, {"LONG_BYTES": 10_000, "PIECE": 100, "SEGMENT": 7}])
def test_awkward_rows(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(conversations, name, value)
    want = expected(r[:4] for r in rows())
    report, edited = conversations.repair(spark.createDataFrame(rows(), SCHEMA).repartition(4))
    assert report_of(report) == {c: w[:-1] for c, w in want.items()}
    lines: dict = {}
    for r in sorted(edited.collect(), key=lambda r: r.place):
        assert r.place == len(lines.setdefault(r.conv_id, [])) and r.edit in "KRI"
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: list(w[-1]) for c, w in want.items() if w[-1]}


def test_damage(spark):
    got = conversations.damage(spark.createDataFrame(rows(), SCHEMA), every=7).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, damaged((r[:4] for r in rows()), every=7)))


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    given = [tuple(r) for r in table.collect()]
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in given}
    want |= {c: w[:-1] for c, w in expected(damaged(given)).items()}
    assert report_of(QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01")) == want


def test_empty(spark):
    report, edited = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert report.collect() == [] and edited.collect() == []
    assert report.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_segments_agree_with_one_auction(monkeypatch):
    draw = np.random.default_rng(2)
    sequences = [draw.choice([0, 1, 1, 2, 2, 3, 4, 8, 9, 10], size=n).astype(np.int8) for n in (0, 1, 2, 7, 20, 33, 40, 40)]
    ends, last = np.tile(conversations._CLOSED, (len(sequences), 1)), np.ones(len(sequences), bool)
    whole = conversations.solve(sequences, ends, last, [0])
    monkeypatch.setattr(conversations, "SEGMENT", 4)
    assert conversations.solve(sequences, ends, last, [0]) == whole
    for s, found in zip(sequences, whole, strict=True):
        rows = [("suat"[c & 7 if c & 7 < 4 else 3], "x", "blank" if c & 7 == 4 else "truncated" if c & 8 else None) for c in s.tolist()]
        assert (found[0][0], found[0][2].decode()) == cheapest(rows)[:2]
