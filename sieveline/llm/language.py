"""Language identification by a byte convolutional network.

Bytes of fixed-length windows are embedded, filters of several widths slide over them, each
filter's largest response in the window is kept, and a softmax layer names the language. The
network is trained in numpy on the driver, on a bounded sample of labelled rows: at most
``per_language`` rows of each language, the ones with the smallest hash of their id, and from
each at most ``sample_chars`` characters at a hashed place. Half of the training windows
change their case, so that a text in capitals keeps its language.

Every window of every text is scored. A filter is a sum of table look-ups by byte pairs, so
scoring gathers rows of small tables. A text's probabilities are the mean over its windows,
weighted by the bytes in them.

A text that is null or has no letter is ``und`` with score 1, and so is every text, with
score 0, where no labelled row is given. Null ids count as held out. Repeated rows get equal
results. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import flat
from sieveline.llm.frames import fresh, named, schema_of, with_results

WINDOW, WIDTHS = 256, (2, 3, 4)


def training_sample(rows: DataFrame, per_language: int = 800, sample_chars: int = 1024) -> list[tuple[str, bytes]]:
    """(language, piece of text) of at most ``per_language`` rows of each language; ``rows``: id, text, lang."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 3.0 * per_language / n)))]), F.col("lang"))
    h = F.xxhash64("id", F.lit("sample"))
    at = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int")
    picked = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    found = picked.select("lang", "h", F.substring("text", at + 1, F.lit(sample_chars)).alias("text")).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (r["h"], r["text"] or "")):
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            out.append((r["lang"], (r["text"] or "").encode()))
    return out


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive zero-padded windows of the texts, and each one's text."""
    n = [-(-len(t) // size) for t in texts]
    out = np.zeros((sum(n), size), np.uint8)
    cells, at = out.reshape(-1), 0
    for t, k in zip(texts, n, strict=True):
        cells[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += k * size
    return out, np.repeat(np.arange(len(texts)), n)


class ByteCnn:
    """Embedding, multi-width filters, max pooling, softmax."""

    def __init__(self, classes: list[str], embed: int = 8, filters: int = 12, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.classes = classes
        self.embed = draw.normal(0, 0.5, (256, embed)).astype(np.float32)
        self.filters = [draw.normal(0, 1 / np.sqrt(w * embed), (w * embed, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * filters, np.float32)
        self.dense = draw.normal(0, 0.1, (len(WIDTHS) * filters, len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def _weights(self):
        return [self.embed, *self.filters, self.bias, self.dense, self.shift]

    def _forward(self, x):
        seen = self.embed[x]
        pooled, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = x.shape[1] - w + 1
            patches = np.concatenate([seen[:, i : i + n] for i in range(w)], 2)
            answer = patches @ f
            at = answer.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(answer, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(raw, 0)
        z = hidden @ self.dense + self.shift
        z = np.exp(z - z.max(1, keepdims=True))
        return where, raw, hidden, z / z.sum(1, keepdims=True)

    def _gradients(self, x, y):
        where, raw, hidden, p = self._forward(x)
        dz = p.copy()
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dh = (dz @ self.dense.T) * (raw > 0)
        d_embed, d_filters, at = np.zeros_like(self.embed), [], 0
        e = self.embed.shape[1]
        for w, f, best in zip(WIDTHS, self.filters, where, strict=True):
            g = dh[:, at : at + f.shape[1]]
            at += f.shape[1]
            codes = x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(w)]  # text, filter, tap
            patches = self.embed[codes].reshape(len(x), f.shape[1], w * e)
            d_filters.append(np.einsum("bfk,bf->kf", patches, g))
            back = (f.T[None] * g[:, :, None]).reshape(-1, e)
            np.add.at(d_embed, codes.reshape(-1), back)
        return [d_embed, *d_filters, dh.sum(0), hidden.T @ dz, dz.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.005, seed: int = 1) -> ByteCnn:
        draw = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self._weights()]
        second = [np.zeros_like(w) for w in self._weights()]
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(order), batch):
                step += 1
                at = order[i : i + batch]
                for w, m, v, g in zip(self._weights(), first, second, self._gradients(x[at], y[at]), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self):
        """The network for scoring: filter responses as sums of rows looked up by byte pair or byte, and the top layer."""
        e = self.embed.shape[1]
        one = [[self.embed @ f[i * e : (i + 1) * e] for i in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        two, three, four = one
        return pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3]), self.bias, self.dense, self.shift


def probabilities(tables, x: np.ndarray) -> np.ndarray:
    """The class probabilities of windows, as the network computes them."""
    a2, a3, b3, a4, b4, bias, dense, shift = tables
    out = np.empty((len(x), len(shift)), np.float32)
    for i in range(0, len(x), 128):
        part = x[i : i + 128]
        codes = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        top = np.concatenate([
            a2[codes].max(1),
            (a3[codes[:, :-1]] + b3[part[:, 2:]]).max(1),
            (a4[codes[:, :-2]] + b4[codes[:, 2:]]).max(1),
        ], 1)
        z = np.maximum(top + bias, 0) @ dense + shift
        z = np.exp(z - z.max(1, keepdims=True))
        out[i : i + 128] = z / z.sum(1, keepdims=True)
    return out


def train(sample: list[tuple[str, bytes]], epochs: int = 3, seed: int = 0) -> ByteCnn | None:
    classes = sorted({lang for lang, _ in sample})
    if not classes:
        return None
    draw = np.random.default_rng(seed)
    texts, labels = [], []
    for lang, text in sample:
        for i in range(0, max(1, len(text) - WINDOW // 4), WINDOW):
            piece = text[i : i + WINDOW]
            how = draw.integers(4)
            if how < 2:
                whole = piece.decode("utf-8", "ignore")
                piece = (whole.upper() if how else whole.lower()).encode()[:WINDOW]
            if how == 2 and len(piece) > 40:
                piece = piece[: int(draw.integers(24, len(piece)))]
            texts.append(piece)
            labels.append(classes.index(lang))
    keep = [i for i, t in enumerate(texts) if t]
    x, _ = windows([texts[i] for i in keep])
    return ByteCnn(classes, seed=seed).fit(x, np.array(labels)[keep], epochs=epochs, seed=seed + 1)


def junk(sample: list[tuple[str, bytes]], seed: int = 5) -> list[tuple[str, bytes]]:
    """As many pieces of no language as the largest one has: hexadecimal, base64, and texts with their bytes shuffled."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(max(Counter(lang for lang, _ in sample).values(), default=0)):
        noise = draw.bytes(int(draw.integers(40, 1024)))
        text = np.frombuffer(sample[int(draw.integers(len(sample)))][1], np.uint8)
        out.append(("und", [noise.hex().encode(), base64.b64encode(noise), draw.permutation(text).tobytes()][i % 3][:1024]))
    return out


def _identify(shared, none: bool):
    def task(batches):
        classes, tables = shared.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(batch.num_rows, "und", object), np.where(letters, 0.0, 1.0)
            if classes:
                lengths = np.where(letters, np.diff(offsets), 0)
                n = -(-lengths // WINDOW)
                begin = 0
                while begin < len(n):
                    end = max(begin + 1, int(np.searchsorted(np.cumsum(n[begin:]), 8192, "right")) + begin)
                    total = np.zeros((end - begin, len(classes)))
                    for at, x, weight in _parts(data, offsets, lengths, begin, end):
                        np.add.at(total, at, probabilities(tables, x) * weight[:, None])
                    some = np.flatnonzero(lengths[begin:end]) + begin
                    share = total[some - begin] / lengths[some][:, None]
                    if none and "und" in classes:
                        share[:, classes.index("und")] = 0
                    best = share.argmax(1)
                    names[some] = np.array(classes, object)[best]
                    scores[some] = np.clip(share[np.arange(len(some)), best], 0, 1)
                    begin = end
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    return task


def _parts(data, offsets, lengths, begin, end, most: int = 16384):
    """Windows of rows ``begin`` to ``end``: (row, windows, bytes in each), one long text in pieces."""
    if end - begin == 1 and lengths[begin] > most * WINDOW:
        text = data[offsets[begin] : offsets[begin + 1]]
        pieces = [text[i : i + most * WINDOW].tobytes() for i in range(0, len(text), most * WINDOW)]
        groups = [([p], np.zeros(1, np.int64)) for p in pieces]
    else:
        rows = np.arange(begin, end)
        groups = [([data[offsets[r] : offsets[r] + lengths[r]].tobytes() for r in rows], rows - begin)]
    for texts, rows in groups:
        x, of = windows(texts)
        if len(x):
            size = np.array([len(t) for t in texts])
            first = np.searchsorted(of, of)
            yield rows[of], x, np.minimum(WINDOW, size[of] - (np.arange(len(of)) - first) * WINDOW).astype(np.float64)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Is the row kept from learning? By crc32 of the id's text; null ids are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, epochs: int = 3, none: bool = False) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; rows where ``learn`` holds and the language is known teach.

    These two replace columns of the same name. With ``none``, a further class learned from
    :func:`junk` takes its part of the probability but is not named.
    """
    taught = df.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    taught = taught.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = training_sample(taught, per_language)
    model = train(sample + junk(sample) if none else sample, epochs)
    shared = df.sparkSession.sparkContext.broadcast((model.classes, model.tables()) if model else ([], None))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(F.struct("*").alias("row"), F.col(text_col).cast("binary").alias("text"), letters.alias("letters"))
    out = rows.mapInArrow(_identify(shared, none), schema_of(rows, ["row"], "lang_pred string, score double"))
    return with_results(out, "row", ["lang_pred", "score"])


def keep_identified(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.25) -> DataFrame:
    """``df`` without the rows whose text has no letter, or no language with a score of ``least`` beside junk's."""
    row = fresh(df, "whole_row")
    found = identify(df.withColumn(row, F.struct("*")), learn, id_col, text_col, lang_col, none=True)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col(row).getField(c).alias(c) for c in df.columns])
