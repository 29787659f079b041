"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a linear function of its whole text's features: the shares of its words and of its
three-byte sequences, hashed to WORDS and GRAMS places, as square roots, and a few measures of shape. Preference
pairs of a good and a bad document teach the weights by logistic loss on the differences of their features.
The cut is a quantile, at the share of bad documents, of the scores of labelled documents that taught no weights,
and the worth is mapped to 0..1 by a logistic curve that meets THRESHOLD at that cut.

Labels come from at most SAMPLE rows, the first by hash of their id outside the held-out fold; all else
covers every document. Scoring goes over the texts once, in Arrow batches.

Nulls and edge cases: a null or empty text is scored like any other, by features of zero; rows without a
label teach nothing; a document labelled several times teaches each of its labels once, and of several rows of one id the
text with the smallest hash teaches; with labels of one kind only, or none, all documents score the share
of good labels held between 0.05 and 0.95 (none: 0.5); a null id is scored and counts as held out
if the empty text's CRC does (it does: remainder 0); an empty table gives no rows; other columns are
ignored by the scores and pass through the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, table

#: The most labelled rows that are learned from, and the share of them that sets the cut.
SAMPLE = 6_000
CUT_SHARE = 0.25
PAIRS = 50_000
STEPS = 200
FOLDS = 5
WORDS, GRAMS, SHAPES = 1 << 11, 1 << 11, 8
FEATURES = WORDS + GRAMS + SHAPES
THRESHOLD = 0.3
#: Texts are featured in groups of about this many bytes.
_AT_ONCE = 1 << 21


@lru_cache(1 << 16)
def _word_place(word: bytes) -> int:
    return crc32(word) % WORDS


def _shape(raw: bytes, words: list[bytes], chars: np.ndarray) -> list[float]:
    """Repetition, letter case, marks, digits, word length, variety of lines and characters."""
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * SHAPES
    letters, upper, digits = int(chars[65:91].sum() + chars[97:123].sum()), int(chars[65:91].sum()), int(chars[48:58].sum())
    marks = int(chars[33:127].sum()) - letters - digits
    lines = raw.split(b"\n")
    shares = chars[chars > 0] / size
    return [
        math.sqrt(sum(map(eq, words, words[1:])) / n), len(set(words)) / n, math.sqrt(upper / max(1, letters)), math.sqrt(marks / size),
        math.sqrt(digits / size), min(2.0, size / n / 10), len(set(lines)) / len(lines), float(-(shares * np.log2(shares)).sum()) / 8,
    ]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES numbers per text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(raws):
        end, held = at, 0
        while end < len(raws) and (held == 0 or held + len(raws[end]) <= _AT_ONCE):
            held += len(raws[end])
            end += 1
        _fill(out[at:end], raws[at:end])
        at = end
    return out


def _fill(out: np.ndarray, raws: list[bytes]) -> None:
    sizes = np.array([len(r) for r in raws])
    own = np.repeat(np.arange(len(raws)), sizes)
    joined = np.frombuffer(b"".join(raws), np.uint8)
    if len(joined) > 2:
        gram = joined[2:].astype(np.uint32) | joined[1:-1].astype(np.uint32) << np.uint32(8) | joined[:-2].astype(np.uint32) << np.uint32(16)
        place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAMS.bit_length() + 1)
        inside = own[2:] == own[:-2]
        found = np.bincount(own[2:][inside] * GRAMS + place[inside], minlength=len(raws) * GRAMS).reshape(-1, GRAMS)
        out[:, WORDS : WORDS + GRAMS] = np.sqrt(found / np.maximum(1, sizes - 2)[:, None])
    for i, raw in enumerate(raws):
        words = raw.split()
        counts = np.bincount(np.fromiter(map(_word_place, words), np.int64, len(words)), minlength=WORDS)
        out[i, :WORDS] = np.sqrt(counts / max(1, len(words)))
        out[i, WORDS + GRAMS :] = _shape(raw, words, np.bincount(np.frombuffer(raw, np.uint8), minlength=256))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as compressed arrays: most places of a text are empty."""
    for batch in batches:
        x = [zstandard.ZstdCompressor(level=1).compress(row.tobytes()) for row in features(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "y"])


def loss(w: np.ndarray, z: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the preferred side winning, and its gradient."""
    worth = z @ w.astype(z.dtype)  # a product of mixed kinds would copy z
    lead = worth[better] - worth[worse]
    lost = 1 / (1 + np.exp(np.clip(lead, -30, 30)))
    pull = np.bincount(worse, lost, len(z)) - np.bincount(better, lost, len(z))
    return float(np.logaddexp(0, -lead).mean() + ridge / 2 * w @ w), (pull / len(better)).astype(z.dtype) @ z + ridge * w


def fit(z: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float) -> np.ndarray:
    """The weights that lessen loss(), by gradient steps of a length that Barzilai and Borwein's rule sets."""
    w = np.zeros(z.shape[1])
    value, gradient = loss(w, z, better, worse, ridge)
    rate = 1 / max(1e-12, float(np.linalg.norm(gradient)))
    for _ in range(STEPS):
        while True:  # halve the step until it lessens the loss
            new = w - rate * gradient
            after, turned = loss(new, z, better, worse, ridge)
            if after <= value or rate < 1e-12:
                break
            rate /= 2
        step, bend = new - w, turned - gradient
        w, value, gradient = new, after, turned
        curve = float(step @ bend)
        rate = float(step @ step) / curve if curve > 0 else rate * 2
        if np.abs(gradient).max() < 1e-6:
            break
    return w


class BradleyTerry:
    """worth(x) = w . (x - mean) / scale; score = logistic(slope * (worth - cut) + logit(THRESHOLD))."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, seed: int = 7):
        """x is standardised in place, which spares the driver a copy."""
        self.constant = None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            self.constant = 0.5 if not len(y) else float(min(0.95, max(0.05, len(good) / len(y))))
            return
        draw = np.random.default_rng(seed)
        # The same share of either kind is set aside for the cut; of a kind with one row, that row does both.
        aside = np.concatenate([draw.permutation(g)[: math.ceil(len(g) * CUT_SHARE)] for g in (good, bad)])
        taught = np.setdiff1d(np.arange(len(y)), aside)
        pairs = [draw.choice(own if len(own := np.intersect1d(g, taught)) else g, PAIRS) for g in (good, bad)]
        self.mean = x.mean(axis=0)
        x -= self.mean
        self.scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + np.float32(1e-3)
        x /= self.scale
        self.w = fit(x, *pairs, ridge)
        worth = x @ self.w.astype(x.dtype)
        judged = np.sort(worth[aside])
        at = int((y[aside] == 0).sum())
        self.cut = float((judged[at - 1] + judged[at]) / 2)
        self.slope = 4 / max(1e-6, float(np.median(worth[good]) - np.median(worth[bad])))

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float64) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.worth(x) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)), -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BradleyTerry:
    """A model from the labels outside the held-out fold."""
    open_rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc32_of_id(id_col) % FOLDS != 0))
    chosen = open_rows.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(SAMPLE)
    # At most SAMPLE rows of two numbers are broadcast, and as many rows of features come to the driver.
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("t")).select("t.t", "y")
    rows = one.mapInArrow(_featured, "x binary, y int").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.x)))  # the tasks' order must not matter
    x = np.empty((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.x)), np.float32)
    return BradleyTerry(x, np.array([r.y for r in rows]))


def _scored(model: BradleyTerry, texts: pa.Array, step: int = 512) -> np.ndarray:
    parts = [model.score(features(texts.slice(i, step).to_pylist())) for i in range(0, len(texts), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scored(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), (crc32_of_id(id_col) % FOLDS == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scored(model, batch.column(at)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
