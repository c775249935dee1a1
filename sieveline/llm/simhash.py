"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at ``bits`` or fewer differing bits share a point at most half as far from
each of them. So every distinct fingerprint stands for all its variants within half the
radius, the variants are shuffled, and fingerprints that share a variant are linked.

Variants are shuffled by their leading bits, and a fingerprint travels once to each group of
leading bits that its variants have; the task that receives it writes out the variants with
those leading bits. That moves tens of numbers for each fingerprint in place of thousands.
Fingerprints that share a variant are within the radius of each other (triangle inequality),
so links along the sorted members of a variant lose nothing and never list all pairs. Each
link's distance is verified all the same.

A group whose variants would be too many for one task (many near copies) is dealt into
sub-groups by parities of the remaining bits; a sub-group generates its own variants only.

Null and empty texts have fingerprint zero and are linked like any other. Equal texts have
equal fingerprints and one component. Rows that repeat an id go by their texts, each with the
component of its own. A component's id is its smallest non-null doc_id. Texts of any length
count whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import SPACES, batch_of, by_group, runs, slices, words
from sieveline.llm.components import connected_components, union_find
from sieveline.llm.frames import fresh, kept, named, row_key

#: Variants that one task sorts at once.
GROUP_VARIANTS = 2 << 20
_LANES = np.uint64(0x0101010101010101)


def _normal_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[SPACES] = 0x20
    return table


_NORMAL = _normal_table()


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The SimHash of every text: a bit is set if over half of the shingles' XXH64 (seed 42) have it."""
    starts, ends, before = words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # one space after each word, A-Z folded: a shingle is then a slice
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    inside = ~SPACES[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    if len(ends) and ends[-1] == len(data):
        data = np.append(data, np.uint8(0x20))
        keep = np.append(keep, True)
    # texts that end in a word run into the next one: write the missing spaces
    glued = np.flatnonzero(ends[:-1] == starts[1:]) + 1
    text = _NORMAL[data[keep]]
    if len(glued):
        text = np.insert(text, begin[glued] - 1 - np.arange(len(glued)), np.uint8(0x20))
    text = text.tobytes()
    counts = np.diff(before)
    n = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + before[row]
    last = np.minimum(first + shingle, before[row + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[i:j], 42) for i, j in zip(begin[first].tolist(), (begin[last] + lengths[last]).tolist(), strict=True)), np.uint64, len(first))
    # eight byte-wide counters in a number, over blocks of at most 255 shingles
    blocks = -(-n // 255)
    block_row = np.repeat(np.arange(len(n)), blocks)
    block_at = (np.cumsum(n) - n)[block_row] + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    some = np.flatnonzero(n)
    row_at = (np.cumsum(blocks) - blocks)[some]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, block_at)
        per_text = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), row_at, axis=0)
        bits = per_text * 2 > n[some][:, None]
        for byte in range(8):
            out[some] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprint_task(shingle: int):
    """Every column but the text, and the text's fingerprint."""

    def task(batches):
        for rows, data, offsets in slices(batches, "text"):
            names = [n for n in rows.schema.names if n != "text"]
            prints = pa.array(fingerprints(data, offsets, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], prints], names=[*names, "fp"])

    return task


def _flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _parity(values: np.ndarray, masks: list[int]) -> np.ndarray:
    """A linear hash: one parity bit for each mask, so that hash(a ^ b) = hash(a) ^ hash(b)."""
    out = np.zeros(len(values), np.int64)
    for i, m in enumerate(masks):
        out |= (np.bitwise_count(values & np.uint64(m)) & 1).astype(np.int64) << i
    return out


def _masks(tail: int, n: int) -> list[int]:
    draw = np.random.default_rng(tail).integers(0, 1 << 63, 64, np.uint64)
    return [int(m) & ((1 << tail) - 1) for m in draw[:n]]


def variants(found: np.ndarray, lead: int, bucket: int, half: int, sub: int = 0, sub_bits: int = 0):
    """Variants whose ``lead`` leading bits are ``bucket`` (and parities ``sub``), whose they are, and the bits changed."""
    tail = 64 - lead
    masks = _masks(tail, sub_bits)
    far = np.bitwise_count((found >> np.uint64(tail)) ^ np.uint64(bucket)) if lead else np.zeros(len(found), np.uint8)
    low = found & np.uint64((1 << tail) - 1)
    mine = _parity(low, masks)
    made, of, changed = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]

    def add(at, flips, d):
        made.append((low[at][:, None] ^ flips[None, :]).ravel())
        of.append(np.repeat(at, len(flips)))
        changed.append(np.tile(np.bitwise_count(flips) + np.uint8(d), len(at)))

    for d in range(half + 1):
        at = np.flatnonzero(far == d)
        if not len(at):
            continue
        flips = _flips(tail, half - d)
        if not sub_bits:
            add(at, flips, d)
            continue
        # parities are linear: only flips with the missing parity lead into this sub-group
        hashes = _parity(flips, masks)
        for h in np.unique(hashes):
            add(at[mine[at] == (sub ^ int(h))], flips[hashes == h], d)
    return np.concatenate(made), np.concatenate(of), np.concatenate(changed)


def _collide(points: np.ndarray, of: np.ndarray, changed: np.ndarray, found: np.ndarray, bits: int):
    """Index pairs that hold the members of equal variants together.

    For an even radius any two members are within it: neighbours are paired. For an odd one,
    members that changed one bit more than half are paired with one that changed less.
    """
    left = right = np.zeros(0, np.uint64)
    exact = bits % 2 == 1
    if not exact:
        room = max(1, int(len(found) - 1).bit_length())
        short = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(room) << np.uint64(room)) | of.astype(np.uint64)
        short.sort()
        at = np.flatnonzero(short[1:] >> np.uint64(room) == short[:-1] >> np.uint64(room))
        low = np.uint64((1 << room) - 1)
        left, right = short[at] & low, short[at + 1] & low
        # two variants may meet in the shortened key: then sort by the whole variant
        exact = bool((np.bitwise_count(found[left] ^ found[right]) > bits).any())
    if exact:
        last = changed > bits // 2
        order = np.lexsort((of, last, points))
        points, of, last = points[order], of[order].astype(np.uint64), last[order]
        first = runs(points)
        head = np.repeat(first[:-1], np.diff(first))
        at = np.arange(len(points))
        other = np.where(last, head, at - 1)
        use = (at > head) & ~(last & last[head])
        left, right = of[other[use]], of[at[use]]
    pairs = np.unique(left << np.uint64(32) | right)
    left, right = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    near = (left != right) & (np.bitwise_count(found[left] ^ found[right]) <= bits)
    return left[near], right[near]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(lead: int, bits: int):
    def task(key, batches):
        found = np.concatenate([b.column("fp").to_numpy() for b in batches]).view(np.uint64)
        points, of, changed = variants(found, lead, key[0], (bits + 1) // 2, key[1], key[2])
        left, right = _collide(points, of, changed, found, bits)
        stars = union_find(left.tolist(), right.tolist())
        a = found[[x for x, _ in stars]].view(np.int64) if stars else []
        b = found[[y for _, y in stars]].view(np.int64) if stars else []
        yield batch_of(_EDGES, [a, b])

    return task


def _ball(bits: int, half: int) -> int:
    return sum(math.comb(bits, r) for r in range(half + 1))


def near_links(prints: DataFrame, bits: int, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """(a, b): a forest of links in which any two of the distinct ``fp`` within ``bits`` are connected."""
    half = (bits + 1) // 2
    n = prints.count()
    lead = min(28, max(0, math.ceil(math.log2(max(1, n * _ball(64, half) / group_variants)))))
    steps = _flips(lead, half)
    prefix = F.shiftrightunsigned("fp", 64 - lead) if lead else F.lit(0).cast("long")
    sent = prints.select("fp", prefix.alias("own")).select("fp", F.explode(F.array(*[F.struct(F.col("own").bitwiseXOR(F.lit(int(s)).cast("long")).alias("bucket"), F.lit(_ball(64 - lead, half - int(s).bit_count())).cast("long").alias("load")) for s in steps])).alias("to")).select("fp", "to.*")
    loads = sent.groupBy("bucket").agg(F.sum("load").alias("load"))
    split = F.ceil(F.log2(F.col("load") / F.lit(group_variants))).cast("int")
    heavy = loads.filter(F.col("load") > group_variants * 2).select("bucket", split.alias("sub_bits"))
    sent = sent.select("bucket", "fp").join(heavy, "bucket", "left").withColumn("sub_bits", F.coalesce("sub_bits", F.lit(0)))
    sent = sent.select("bucket", F.explode(F.expr("sequence(0, shiftleft(1, sub_bits) - 1)")).alias("sub"), "sub_bits", "fp")
    return sent.groupBy("bucket", "sub", "sub_bits").applyInArrow(by_group(_link(lead, bits), _EDGES), "a long, b long")


def _rooted(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root is its component's smallest fingerprint."""
    nodes = kept(prints.select("fp").distinct())
    roots = connected_components(near_links(nodes, bits))
    joined = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(``id_col``, fingerprint, component_id) for every row of ``df``."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(text_col).cast("binary").alias("text"))
    prints = kept(rows.mapInArrow(_fingerprint_task(shingle), "id long, fp long"))
    first = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    nodes = kept(_rooted(prints, bits).join(first, "fp"))
    ids = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out = prints.join(nodes.join(ids, "root").select("fp", "component_id"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """``df`` with one row of each component: the one with its smallest id, missing ids last.

    Rows are told apart by id, text and all other columns (two 64-bit hashes), so an id that
    repeats with another text loses nothing.
    """
    one, two = fresh(df, "one"), fresh(df, "two")
    keyed = df.withColumn(one, row_key(id_col, text_col)).withColumn(two, F.xxhash64(F.lit(1), *[named(c) for c in df.columns]))
    rows = keyed.select(named(id_col).cast("long").alias("id"), F.col(one).alias("one"), F.col(two).alias("two"), named(text_col).cast("binary").alias("text"))
    prints = kept(rows.mapInArrow(_fingerprint_task(shingle), "id long, one long, two long, fp long"))
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "one", "two")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    chosen = _rooted(prints, bits).join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.one").alias(one), F.col("first.two").alias(two))
    return keyed.join(chosen, [one, two], "left_semi").dropDuplicates([one, two]).select(*[named(c) for c in df.columns])


def brute_force(texts: list[str | None], shingle: int = 4, bits: int = 4) -> list[tuple[int, int]]:
    """(fingerprint, position of the first text reachable) by plain loops; for tests."""
    prints = []
    for t in texts:
        w = bytes(t or "", "utf-8").lower().split()
        pieces = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    pairs = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= bits]
    roots = dict(union_find([i for i, _ in pairs], [j for _, j in pairs]))
    return [(p, roots.get(i, i)) for i, p in enumerate(prints)]
