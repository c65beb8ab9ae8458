"""Factorisation machine for document quality.

Features are hashed words (the logarithm of their count, scaled to length one),
structure statistics of the whole text, and its length. Pairwise interactions have
low rank and are summed in linear time: half of (sum of v x) squared less the sum
of (v x) squared, for each factor. The model is fitted on a bounded sample of
labelled rows and applied to all texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 15
STATS = 14
SIZE = WORDS + STATS
CACHE_WORDS = 500_000


class _Buckets(dict):
    """Word -> hash bucket."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = bucket = zlib.crc32(word) % WORDS
        return bucket


def features(text: bytes, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; an empty text has statistics only."""
    words = text.lower().split()
    counts = Counter(words)
    index = np.fromiter(map(buckets.__getitem__, counts), np.int32, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, w = max(len(text), 1), max(len(words), 1)
    letters = max(int(bytes_[65:91].sum() + bytes_[97:123].sum()), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: float(bytes_[list(chars)].sum()) / w
    stats = [
        1.0,
        np.log1p(len(words)) / 8,
        np.log1p(len(text)) / 10,
        min(len(text) / w / 10, 3),
        min(share(b"#*$%&"), 3),
        min(share(b"|<>"), 3),
        min(share(b"!?"), 3),
        min(share(b".,;:"), 3),
        float(bytes_[65:91].sum()) / letters,
        float(bytes_[48:58].sum()) / n * 5,
        float(bytes_[128:].sum()) / n * 2,
        len(counts) / w,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)) / 5,
    ]
    return np.r_[index, np.arange(WORDS, SIZE, dtype=np.int32)], np.r_[value, np.array(stats, np.float32)]


class FactorisationMachine:
    """Logistic, second order, fitted by Adagrad on mini-batches."""

    def __init__(self, rank: int = 8, seed: int = 5):
        self.bias = 0.0
        self.w = np.zeros(SIZE, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((SIZE, rank)) * 0.05).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, the factors' sums, and v x by entry; starts: of each row's entries."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + pairs, sums, vx

    def probability(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, starts)[0], -30, 30).astype(np.float64)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, batch: int = 128, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        labels = np.array([r[2] for r in rows], np.float32)
        if not len(rows):
            self.v[:] = 0
            return self
        mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(mean / (1 - mean)))
        seen_w, seen_v = np.full(SIZE, 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            shuffled = order.permutation(len(rows))
            for a in range(0, len(rows), batch):
                some = shuffled[a : a + batch]
                index, value = (np.concatenate([rows[i][k] for i in some]) for k in (0, 1))
                lens = np.array([len(rows[i][0]) for i in some])
                starts = np.r_[0, np.cumsum(lens)[:-1]]
                score, sums, vx = self.raw(index, value, starts)
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
                each = np.repeat(error, lens) * value
                gv_each = each[:, None] * (np.repeat(sums, lens, axis=0) - vx)
                touched, where = np.unique(index, return_inverse=True)
                gw = np.bincount(where, each, len(touched)).astype(np.float32) + l2 * self.w[touched]
                gv = np.stack([np.bincount(where, gv_each[:, f], len(touched)) for f in range(self.v.shape[1])], axis=1).astype(np.float32) + l2 * self.v[touched]
                seen_w[touched] += gw * gw
                seen_v[touched] += gv * gv
                self.w[touched] -= rate * gw / np.sqrt(seen_w[touched])
                self.v[touched] -= rate * gv / np.sqrt(seen_v[touched])
        return self


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = _Buckets()
    for batch in batches:
        rows = [features(t.as_buffer().to_pybytes() if t.is_valid else b"", buckets) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], names=["label", "index", "value"])


def _score(model: FactorisationMachine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                rows = [features(t.as_buffer().to_pybytes() if t.is_valid else b"", buckets) for t in some.column(2)]
                index, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
                starts = np.r_[0, np.cumsum([len(i) for i, _ in rows])[:-1]]
                p = model.probability(index, value.astype(np.float32), starts)
                yield pa.record_batch([some.column(0), some.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000, rank: int = 8) -> FactorisationMachine:
    """A model of the labels, from the `sample` rows of them that come first by the hash of their id.

    Rows with a null id or a label other than 0 or 1 are no examples. Without
    examples every score is one half.
    """
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    chosen = good.orderBy(F.xxhash64("doc_id"), "label").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_extract, "label int, index binary, value binary")
    rows = [(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4"), r["label"]) for r in found.collect()]
    rows.sort(key=lambda r: (zlib.crc32(r[0].tobytes() + r[1].tobytes()), r[2]))  # whatever order the tasks ended in
    return FactorisationMachine(rank).fit(rows)


def score_quality(docs: DataFrame, model: FactorisationMachine, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null texts count as empty, repeated rows score alike."""
    three = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return three.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
