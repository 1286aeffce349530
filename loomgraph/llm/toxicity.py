"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A text's features are the distinct hashes of its
words, its word pairs and its pairs with one word left out. Training is per-coordinate FTRL-proximal with L1, in one task over a
bounded sample of labelled rows: at most ``sample_rows`` of at most SAMPLE_BYTES bytes each, those whose text's hash is least,
which is also their order, so ids play no part. Features are made by all tasks before. The weights that L1 leaves are few
(2**BITS at most) and are broadcast. Scoring reads every whole text.

Null texts are empty; an empty text scores the bias. Labels that are null don't train; of several labels of a document the
largest holds. Rows without a doc_id are scored, not trained on. Without any label to learn from every score is 0. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts

BITS = 20
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 32_768
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 0.0, 4
POSITIVE_WEIGHT = 3.0  # toxic documents are few
THRESHOLD = 0.7
PART = 1 << 20
ODD, ODD_INVERSE = 0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)
PAIR, SKIP, MIX = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for name, base in (("up", ODD), ("down", ODD_INVERSE)):
            _tables[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PART, base, np.uint64))])
    return _tables["up"], _tables["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def words(raw: bytes) -> np.ndarray:
    """64-bit hash of each word, in order. Long texts are hashed in parts that end between words where they can."""
    raw = raw.lower()
    up, down = _powers()
    out = []
    at = 0
    while at < len(raw):
        part = np.frombuffer(raw, np.uint8, min(PART, len(raw) - at), at)
        inside = WORD_BYTE[part]
        if at + len(part) < len(raw) and not inside.all():
            part = part[: len(part) - int(inside[::-1].argmin())]
            inside = inside[: len(part)]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        out.append(_mix((sums[edge[:, 1]] - sums[edge[:, 0]]) * down[edge[:, 0]]))
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature index) of every n-gram and skip-gram of the texts, repeats included."""
    per = [words(t.encode()) for t in batch]
    sizes = np.fromiter(map(len, per), np.int64, len(per))
    h = np.concatenate([np.zeros(0, np.uint64), *per])
    text = np.repeat(np.arange(len(batch)), sizes)
    near, far = text[1:] == text[:-1], text[2:] == text[:-2]
    pair = _mix(h[:-1] * PAIR + h[1:])[near]
    skip = _mix(h[:-2] * SKIP + h[2:])[far]
    index = np.concatenate([h, pair, skip]) >> np.uint64(64 - BITS)
    return np.concatenate([text, text[:-1][near], text[:-2][far]]), index.astype(np.int64)


def example(text: str) -> np.ndarray:
    """The different features of a text and the bias, index 2**BITS."""
    return np.append(np.unique(features([text])[1]), 1 << BITS).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the non-zero weights after FTRL-proximal steps over (features, label) in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full((1 << BITS) + 1, L1)
    l1[-1] = 0

    def weight(i: np.ndarray) -> np.ndarray:
        w = (np.sign(z[i]) * l1[i] - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= l1[i], 0.0, w)

    for _ in range(epochs):
        for i, y in rows:
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (POSITIVE_WEIGHT if y else 1.0)
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weight(np.arange(len(z)))
    keep = np.flatnonzero(w)
    return keep, w[keep]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most ``sample_rows`` labelled documents that aren't held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(~is_held_out(F.col("doc_id")) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    short = texts(df).where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", F.xxhash64("text").alias("key"), "text")
    least = short.select("doc_id", "key").join(known, "doc_id").orderBy("key", "doc_id").limit(sample_rows).select("doc_id", "key", "y").distinct()
    chosen = short.join(F.broadcast(least), ["doc_id", "key"])  # sample_rows rows of three numbers

    def prepare(batches):
        for b in batches:
            if b.num_rows:
                i = pa.array([example(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), i], names=["key", "y", "i"])

    def run(batches):
        rows = [(i.values.to_numpy(), y) for b in batches for y, i in zip(b.column("y").to_pylist(), b.column("i"))]
        index, value = train(rows) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(value, pa.float64())], names=["i", "w"])

    ready = chosen.select("key", "y", "text").mapInArrow(prepare, "key long, y int, i array<int>").orderBy("key", "y").limit(sample_rows)
    got = ready.mapInArrow(run, "i long, w double").collect() if sample_rows else []
    return np.array([r["i"] for r in got], np.int64), np.array([r["w"] for r in got])


class Scorer:
    """Scores of texts by the sparse weights."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray]) -> None:
        index, value = weights
        self.known = bool(len(index))
        self.w = np.zeros((1 << BITS) + 1)
        self.w[index] = value

    def __call__(self, batch: list[str]) -> np.ndarray:
        total = np.full(len(batch), self.w[-1])
        for k in range(0, len(batch), 256):
            text, i = features(batch[k : k + 256])
            live = self.w[i] != 0
            pairs = np.unique(text[live] << BITS | i[live])
            np.add.at(total, k + (pairs >> BITS), self.w[pairs & (1 << BITS) - 1])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35))) if self.known else np.zeros(len(batch))


def score(df: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted per document."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        scorer = Scorer(shared.value)

        def run(batch: list[str]) -> dict[str, list]:
            p = scorer(batch)
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return run

    return map_texts(texts(df), make, "score double, predicted int")


def reject(df: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores below ``threshold``."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(scorer([t or "" for t in b.column("text").to_pylist()]) < threshold))

    return df.mapInArrow(run, df.schema)


def score_documents(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    scored = score(df, fit(df, labels, sample_rows))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
