"""Operators on texts against plain versions, over awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from awkward import SCHEMA, rows
from sieveline.llm import language, mixing, packing, pitman_yor, simhash, substring_dedup, token_files, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).checkpoint()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def split(text):
    return (text or "").encode().split()


def same_rest(out, docs, replaced):
    """The columns that the operator did not replace come through unchanged."""
    rest = [c for c in docs.columns if c not in replaced]
    cols = [F.col(f"`{c}`") for c in rest]
    assert sorted(map(repr, out.select(*cols).collect())) == sorted(map(repr, docs.select(*cols).collect()))


@pytest.mark.parametrize("window", [2, 5, 35])
def test_repeats_are_cut_as_by_a_plain_count(docs, window):
    given = rows()
    want = Counter((r[0], n, k, h) for r, (n, k, h) in zip(given, substring_dedup.brute_force([r[1] for r in given], window), strict=True))
    out = substring_dedup.remove_repeats(docs, window=window, bits=16)
    same_rest(out, docs, {"text"})
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.h) for r in out.select("doc_id", "n_words", "n_removed", substring_dedup.kept_hash().alias("h")).collect())
    assert got == want


def test_a_crowded_sketch_changes_nothing(docs):
    """A sketch too small to tell anchors apart lets all windows through to the exact step."""
    small = substring_dedup.remove_repeats(docs, window=10, bits=8).select("doc_id", "n_removed", "kept_text")
    large = substring_dedup.remove_repeats(docs, window=10, bits=20).select("doc_id", "n_removed", "kept_text")
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))


def test_a_text_repeats_itself(spark):
    text = " ".join(["a"] * 40 + [f"w{i}" for i in range(50)])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert substring_dedup.remove_repeats(df, window=35).select("n_removed").collect()[0][0] == 40


@pytest.mark.parametrize("bits,shingle", [(4, 4), (3, 2), (0, 4)])
def test_fingerprints_and_components(docs, bits, shingle):
    given = rows(null_id=False)
    want = simhash.brute_force([r[1] for r in given], shingle, bits)
    out = simhash.near_duplicates(docs.filter("doc_id is not null"), shingle=shingle, bits=bits).collect()
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in out)
    assert got == Counter((g[0], f"{p:016x}", given[c][0]) for g, (p, c) in zip(given, want, strict=True))


def test_split_groups_lose_no_link(spark):
    """Many fingerprints near one point: groups are dealt out by parities and find the same links."""
    draw = np.random.default_rng(1)
    center = draw.integers(0, 1 << 63, dtype=np.uint64)
    prints = {int(center)}
    while len(prints) < 300:
        flip = sum(1 << int(b) for b in draw.choice(64, 3, replace=False))
        prints.add(int(center) ^ flip)
    prints |= {int(x) for x in draw.integers(0, 1 << 63, 50, dtype=np.uint64)}
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    def roots(limit):
        links = simhash.near_links(df, 4, limit).collect()
        found = dict(simhash.union_find([r.a for r in links], [r.b for r in links]))
        return {p: found.get(p, p) for (p,) in df.collect()}
    every = list(prints)
    pairs = [(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 4]
    sign = lambda x: int(np.uint64(x).view(np.int64))
    found = dict(simhash.union_find([sign(a) for a, _ in pairs], [sign(b) for _, b in pairs]))
    want = {sign(p): found.get(sign(p), sign(p)) for p in every}
    assert roots(1 << 21) == want
    assert roots(1 << 14) == want


def test_one_of_each_group_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    named = simhash.near_duplicates(docs).filter("doc_id is not null")
    want = {r.component_id for r in named.collect()} | {None}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_a_repeated_id_loses_no_other_text(spark):
    rows = [(1, "completely other words live in here today", "x"), (1, "nothing of that kind is told by this one", "x"), (2, "completely other words live in here today", "x"), (None, "some words without an id", "y"), (None, "some words without an id", "y"), (3, "some words without an id", "z")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, one string"))
    assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[1], rows[5]])
    alone = simhash.drop_near_duplicates(spark.createDataFrame(rows[3:5], "doc_id long, text string, one string"))
    assert [tuple(r) for r in alone.collect()] == [rows[3]]


def test_equal_rows_of_two_sources_stay_apart(spark):
    """Targets are 14 words of x and 6 of y (5 to 2); rows of y equal rows of x but for the source."""
    rows = [(i, f"w{i} of many", s) for i in range(3) for s in ("x", "y")] + [(9, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r.source] += len(r.text.split())
    assert got == {s: math.floor(t + 0.5) for s, t in mixing.targets({"x": 11, "y": 9}).items()}


def test_many_copies_in_the_mix(spark):
    df = spark.createDataFrame([(5, "one text of five words", "x")] * 400 + [(i, f"word {i}", "y") for i in range(20, 90)], "doc_id long, text string, source string")
    got, want = Counter(), Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id] += len(r.text.split())
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_mix_meets_targets(docs):
    given = rows()
    out = mixing.mix(docs, block=16).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(split(r[1]))) for r in given)
    by_source = Counter()
    for r in given:
        by_source[r[3]] += len(split(r[1]))
    want = mixing.targets(by_source)
    order = ["s1", "s2", "t", None]
    assert sum(want.values()) == pytest.approx(sum(by_source.values()))
    assert all(want[s] <= 3 * by_source[s] + 1e-6 for s in order)
    source = {r[0]: r[3] for r in given}
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == by_source[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(docs.repartition(3), block=16).collect()))


def test_mix_takes_a_prefix_of_each_stream(docs):
    """Whatever the schedule, a source's words are taken in passes over its stream."""
    for r in mixing.mix(docs, block=7).collect():
        goal = math.floor(r.target + 0.5)
        passes, rest = divmod(goal, r.source_size) if r.source_size else (0, 0)
        assert r.taken == passes * r["size"] + max(0, min(r["size"], rest - r.start))


def test_mixed_documents_hold_the_words_taken(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(split(r.text))
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_schedule_is_even(spark):
    plan = [{"target": t, "size": 10_000, "blocks": 10, "need": t // 1000, "last": 0} for t in (5000, 2000, 1000)]
    slots = [r.no for r in mixing.schedule(spark, plan, 1000).orderBy("slot").collect()]
    assert Counter(slots) == {0: 5, 1: 2, 2: 1}
    plan = [{"target": t, "size": 10**7, "blocks": 10**4, "need": t // 1000, "last": 0} for t in (5_000_000, 3_000_000)]
    slots = [r.no for r in mixing.schedule(spark, plan, 1000).orderBy("slot").collect()]
    for i in range(0, len(slots) - 100, 50):
        assert abs(slots[i : i + 100].count(0) - 62.5) < 4


@pytest.mark.parametrize("text", [r[1] for r in rows()][60:])
def test_ids_are_the_tokenizer_files(text):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = packing.ByteBpe()
    for t in (text or "", (text or "") + "<|endoftext|>x", "<|endoftext|>"):
        assert bpe.encode(t.encode()).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(docs):
    capacity = 64
    pieces = packing.token_pieces(docs, capacity=capacity, keep_ids=True)
    out = packing.pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity=capacity).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows():
        ids = slow.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r[0], n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    rooms = {}
    for r in out:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    counts = Counter(r.length for r in out)
    assert packing.lower_bound(counts, capacity) <= len(rooms) <= sum(t for _, t in packing.best_fit_decreasing(counts, capacity))


def brute_bins(sizes, capacity):
    """The fewest sequences, by trying every place for every length."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                rooms[j] -= sizes[i]
                place(i + 1, rooms)
                rooms[j] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("levels", [32, 1])
def test_bin_completion_is_near_the_optimum(monkeypatch, levels):
    monkeypatch.setattr(packing, "_LEVELS", levels)  # 1: every level above the last makes its fillings anew
    draw = np.random.default_rng(4)
    equal = 0
    for _ in range(40):
        sizes = draw.integers(10, 70, 11).tolist()
        patterns = packing.bin_completion(Counter(sizes), 100)
        held = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 100
            for s in pattern:
                held[s] += times
        assert held == Counter(sizes)
        used, least = sum(t for _, t in patterns), brute_bins(sizes, 100)
        assert least <= used <= least + 1
        equal += used == least
    assert equal == 40
    for _ in range(60):  # few lengths, often repeated
        sizes = draw.choice([10, 13, 17, 22, 31, 36, 44, 50], 12).tolist()
        assert sum(t for _, t in packing.bin_completion(Counter(sizes), 100)) == brute_bins(sizes, 100)


def test_many_short_and_many_equal_lengths():
    for counts, least in (({1025: 1200, 511: 1200, 2: 409_600}, 1300), ({2: 10**9, 2048: 10**8}, 10**8 + -(-(10**9) // 1024)), ({1: 5, 2047: 4}, 5)):
        patterns = packing.bin_completion(counts, 2048)
        held = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 2048 and times > 0
            held.update({s: times * n for s, n in Counter(pattern).items()})
        assert held == counts and sum(t for _, t in patterns) == least


def test_fillings_come_in_order_of_waste():
    counts = {3: 2, 4: 1, 5: 3, 9: 1}
    found = [f for f in packing._fillings(sorted(counts), counts, 14) if f is not None]
    assert found[0] == (9, 5) and all(sum(a) >= sum(b) for a, b in zip(found, found[1:], strict=False))
    assert len(found) == len(set(found)) and (5, 5, 4) not in found  # 9 takes the place of 5 and 4


def test_bin_completion_beats_best_fit():
    counts = {60: 2, 50: 2, 30: 2, 20: 2, 40: 1}
    assert sum(t for _, t in packing.bin_completion(counts, 100)) <= sum(t for _, t in packing.best_fit_decreasing(counts, 100))
    with pytest.raises(ValueError):
        packing.bin_completion({101: 1}, 100)


def test_pitman_yor_counts_and_probabilities(docs):
    given = rows()
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    out = pitman_yor.score_texts(docs, ~language.held_out("doc_id", 7, 2)).collect()
    counts = Counter()
    for r in given:
        if learn(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), None])
    total, names = sum(counts.values()), len(counts)
    want = Counter()
    for r in given:
        tokens = [*(r[1] or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (total + names + 1)) for t in tokens)
        want[r[0], learn(r[0]), len(tokens), sum(t in counts for t in tokens), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in out)
    again = pitman_yor.score_texts(docs, ~language.held_out("doc_id", 7, 2)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_pitman_yor_is_a_distribution(spark):
    """Over one context, the known words and one unknown one share a probability of 1."""
    known = ["a b", "a c", "a b", "a a", "c"]
    ask = [f"a {w}" for w in ("a", "b", "c", "never")]
    df = spark.createDataFrame([(i, t, i < len(known)) for i, t in enumerate([*known, *ask, "a"])], "doc_id long, text string, learn boolean")
    out = {r.doc_id: r for r in pitman_yor.score_texts(df, F.col("learn")).collect()}
    # p("a", w, end) = p(a | start) p(w | a) p(end | w): remove what does not depend on w | a
    model = {"strength": 1.0, "seed": 11, "vocabulary": 4, "discount": 0.5, "root_discount": 0.5, "states": []}
    each, context, customers = np.array([2, 1], np.uint32), np.array([3, 9, 3], np.uint16), np.array([5, 1, 2])
    token, tables, root, root_tables = next(pitman_yor._seatings(model, 0, each, context, customers))
    assert token.tolist() == [0, 0, 1] and tables.tolist() == [1, 1, 1] and root.tolist() == [2, 1]
    p = pitman_yor._root(model, root, root_tables, int(root.sum()), int(root_tables.sum()), 1 / 5)
    unknown = (1 + 0.5 * root_tables.sum()) / 5 / (1 + root.sum())
    assert p.sum() + 3 * unknown == pytest.approx(1)
    assert out[6].score > out[7].score > out[8].score  # seen twice, seen once, never seen


def test_seating_matches_the_expected_number_of_tables():
    draw = np.random.default_rng(0)
    got = pitman_yor.seat(np.full(20_000, 10), np.full(20_000, 2.0), 0.5, draw).mean()
    exact = {1: 1.0}  # tables after the first customer, then one customer at a time
    for m in range(1, 10):
        nxt = Counter()
        for t, p in exact.items():
            new = 2.0 / (2.0 + m - 0.5 * t)
            nxt[t + 1] += p * new
            nxt[t] += p * (1 - new)
        exact = nxt
    assert got == pytest.approx(sum(t * p for t, p in exact.items()), rel=0.02)


def test_a_frequent_token_is_spread(spark):
    """The end of every text and a word in every text meet in no one block."""
    rows = spark.createDataFrame([(i, True, f"a{i} the b{i}".encode()) for i in range(3000)], "id long, learn boolean, text binary")
    frequent, spread = pitman_yor._frequent(rows, 3000, 48)
    assert pitman_yor._END in frequent
    blocks = pitman_yor._blocks(rows, 48, 16, frequent, spread).filter("kind = 2").collect()
    sizes = [len(pitman_yor.unpacked(b["c"], np.int64)) for b in blocks]
    assert sum(sizes) == 4 * 3000 and max(sizes) < 2 * 4 * 3000 / 48


def test_each_context_has_its_own_restaurant(spark):
    """Of 70,000 words that occur once, each is the context of one customer; the start of one a text."""
    texts = [(i, True, " ".join(f"w{j}" for j in range(i * 1000, i * 1000 + 1000)).encode()) for i in range(70)]
    rows = spark.createDataFrame(texts, "id long, learn boolean, text binary")
    frequent, spread = pitman_yor._frequent(rows, 70, 48)
    table = pitman_yor._blocks(rows, 48, 16, frequent, spread)
    model = {"strength": 1.0, "seed": 11, "states": [], "vocabulary": 0, "discount": 0.5, "root_discount": 0.5}
    answers, _, counts = pitman_yor._sweep(table, [], model, len(frequent))
    found = Counter(x for r in answers.filter("bucket >= 0").collect() for x in pitman_yor.unpacked(r["b"], np.int64).tolist())
    assert counts[0] == 70 * 1001 and set(found) == {1, 70} and found[1] == 70_000


def test_context_lowers_perplexity(spark):
    text = [" ".join(["up", "down"] * 30), " ".join(["left", "right"] * 30)]
    df = spark.createDataFrame([(i, text[i % 2], i < 20) for i in range(24)], "doc_id long, text string, learn boolean")
    out = pitman_yor.score_texts(df, F.col("learn")).filter("not learned").collect()
    assert all(r.score > r.base_score * 0.5 for r in out)


def test_toxic_passages(spark):
    draw = np.random.default_rng(2)
    clean = ["".join(draw.choice(list("abcdefgh"), 7)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = draw.choice(clean, draw.integers(5, 80)).tolist()
        toxic = i % 4 == 0
        if toxic:
            at = int(draw.integers(0, len(words)))
            words[at:at] = ["idiot", "Scum!"]
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    texts += [(400, None), (401, ""), (402, "the idiot, SCUM and more"), (402, "the idiot, SCUM and more")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("old"))
    marks = spark.createDataFrame([*labels[:300], (7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(df, marks, bits=18).collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    assert [(i, t, by[i].score) for i, t in labels[300:] if by[i].predicted != t] == []
    assert by[400].predicted == by[401].predicted == 0 and by[402].predicted == 1
    found = by[300].passages
    assert len(found) == 1 and found[0].last - found[0]["first"] == 1 and found[0].expected < 0.05
    assert all(0 <= r.score <= 1 for r in out)


def test_texts_that_share_a_passage_all_teach(spark):
    """Only copies (but for case and what is no letter) of a class are left out."""
    passage = " ".join(f"{a}{b}" for a in "abcdefghijkl" for b in "mnopqrstuvwx")
    own = ["".join("abcdefghij"[int(c)] for c in str(100 + i)) for i in range(50)]
    texts = [(i, f"{passage} {w} own".encode()) for i, w in enumerate(own)]
    texts += [(90, f"{passage.upper()}, {own[0]} 12 own!".encode()), (91, f"own {passage} {own[0]}".encode()), (92, texts[0][1])]
    labels = spark.createDataFrame([*((i, i % 2) for i in range(50)), (90, 0), (91, 0), (92, 1)], "id long, toxic int")
    out = toxicity.teaching(spark.createDataFrame(texts, "id long, text binary"), labels).collect()
    assert sorted((r.id, r.toxic) for r in out) == [*((i, i % 2) for i in range(50)), (91, 0), (92, 1)]


def test_maximal_segments_match_a_plain_definition():
    """Each segment beats all its parts, and nothing larger does so (checked by brute force)."""
    draw = np.random.default_rng(3)
    for _ in range(200):
        v = draw.integers(-3, 4, draw.integers(1, 14)).astype(float)
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(v)]
        want, todo = [], [(0, len(v))]
        while todo:  # the best segment of a stretch (shortest on ties), then what lies beside it
            a, b = todo.pop()
            best = max(((v[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 0:
                i, j = -best[2], -best[2] - best[1]
                want.append((i, j))
                todo += [(a, i), (j, b)]
        assert sum(v[a:b].sum() for a, b in got) == pytest.approx(sum(v[a:b].sum() for a, b in want))
        assert max((v[a:b].sum() for a, b in got), default=0) == max((v[a:b].sum() for a, b in want), default=0)


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, none, bits=12)
    same_rest(out, docs, {"text", "score"})
    assert {r.predicted for r in out.collect()} == {0}
    every = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, every, bits=12).collect()} == {1}


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("old"))
    held = language.held_out("doc_id", 4, 2)
    out = language.identify(docs, ~held, per_language=200).filter(held).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_text_in_no_learned_language_goes(spark):
    """Junk with letters goes, labelled texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [hashlib.sha512(str(i).encode()).hexdigest() * 3 for i in range(40)]
    noise += [base64.b64encode(hashlib.sha512(x.encode()).digest() * 4).decode() for x in noise]
    both = docs.unionByName(spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(noise)], docs.schema))
    kept = {r.doc_id for r in language.keep_identified(both, learn=~language.held_out("doc_id", 4, 2)).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).collect()}
    assert min(kept) >= 0 and len(clean & kept) >= 0.99 * len(clean)


def test_language_of_awkward_rows(docs):
    learn = F.col("doc_id") < 50
    out = language.identify(docs, learn, per_language=20, epochs=1)
    same_rest(out, docs, {"score"})
    by = {r.doc_id: r for r in out.collect()}
    given = rows()
    for r in given:
        letters = any(c.isalpha() for c in r[1] or "")
        assert by[r[0]].lang_pred in (("en", "de") if letters else ("und",))
    kept = language.keep_identified(docs, learn, least=0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in given if any(c.isalpha() for c in r[1] or "")}
    untaught = language.identify(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_network_tables_equal_the_network():
    draw = np.random.default_rng(0)
    model = language.ByteCnn(["x", "y", "z"], seed=3)
    x = draw.integers(0, 256, (40, language.WINDOW)).astype(np.uint8)
    want = model._forward(x)[3]
    assert np.allclose(language.probabilities(model.tables(), x), want, atol=1e-5)


def test_network_gradients():
    draw = np.random.default_rng(1)
    model = language.ByteCnn(["x", "y"], embed=3, filters=2, seed=1)
    for name in ("embed", "bias", "dense", "shift"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.filters = [f.astype(np.float64) for f in model.filters]
    x, y = draw.integers(0, 256, (5, 30)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.log(model._forward(x)[3][np.arange(5), y]).mean()
    for w, g in zip(model._weights(), model._gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = w[at], 1e-6
        w[at] = keep + step
        up = loss()
        w[at] = keep - step
        down = loss()
        w[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3)


def test_token_files(docs, spark, tmp_path):
    out = token_files.corpus_tokens(docs, str(tmp_path / "files"), file_bytes=300).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r[0], len(slow.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    out = sorted(out, key=lambda r: r.number)
    assert [r.number for r in out] == list(range(len(out)))
    assert all(b.start == a.start + a.n_tokens + 1 for a, b in zip(out, out[1:], strict=False))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_documents_cross_blocks_and_files(spark, tmp_path, block):
    end = 9
    stream = [[1, 2, 3], [], [9], [4, 5, 9, 9, 6], [7, 8, 1, 2], [3, 9, 5]]
    for i, ids in enumerate(stream):
        (tmp_path / f"f{i}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    out = sorted(token_files.document_tokens(spark, str(tmp_path), end_id=end, block_tokens=block).collect(), key=lambda r: r.number)
    flat = [t for ids in stream for t in ids]
    want, start = [], 0
    for i, t in enumerate([*flat, end]):
        if t == end:
            want.append((len(want), start, i - start))
            start = i + 1
    assert [(r.number, r.start, r.n_tokens) for r in out] == want


@pytest.mark.parametrize("name", ["number", "part", "row", "place", "given", "ids"])
def test_token_counts_with_clashing_names(spark, tmp_path, name):
    texts = ["one two", None, "", "x " * 3000, "one two"] + ["a"] * 200
    rows = [(i if i != 2 else None, t, "old") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{name} long, text string, file string").repartition(3).checkpoint()
    out = token_files.corpus_tokens(df, str(tmp_path / "files"), id_col=name, file_bytes=100).collect()
    bpe = packing.ByteBpe()
    assert Counter((r[0], r[4]) for r in out) == Counter((i, len(bpe.encode((t or "").encode()))) for i, t, _ in rows)
    assert sorted(r[2] for r in out) == list(range(len(rows))) and len({r[1] for r in out}) > 4


def test_texts_that_are_not_utf8(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"ab\xff cd"))], "doc_id long, text binary").checkpoint()
    n = len(packing.ByteBpe().encode("ab\ufffd cd".encode()))
    assert [r.n_tokens for r in token_files.corpus_tokens(df, str(tmp_path / "files")).collect()] == [n]
    assert [r.length for r in packing.token_pieces(df).collect()] == [n + 1]


def test_empty_tables(nothing, spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        substring_dedup.remove_repeats(nothing), simhash.near_duplicates(nothing), simhash.drop_near_duplicates(nothing),
        mixing.mix(nothing), mixing.mixed_documents(nothing), language.identify(nothing, F.lit(True)),
        language.keep_identified(nothing, F.lit(True)), toxicity.score_toxicity(nothing, none),
        pitman_yor.score_texts(nothing, F.lit(True)),
        packing.pack(packing.token_pieces(nothing), ["doc_id", "piece"]),
    ):
        assert out.collect() == []
    assert token_files.corpus_tokens(nothing, str(tmp_path / "none")).collect() == []


def test_kept_hash_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    got = substring_dedup.remove_repeats(df).select(substring_dedup.kept_hash()).collect()[0][0]
    assert got == hashlib.sha256(b"").hexdigest()
