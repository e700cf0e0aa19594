"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, mix, stored, word_hashes

BITS = 18


def features(text: np.ndarray | None, orders: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices of a text's word n-grams up to ``orders``, and their values:
    log counts, scaled to length 1. Words part from punctuation; case is kept."""
    words = word_hashes(text, lower=False, split_punctuation=True) if text is not None else np.zeros(0, np.uint64)
    grams, hashes = [words], words
    for k in range(1, orders):
        hashes = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[k:]) if len(words) > k else hashes[:0]
        grams.append(hashes)
    index, count = np.unique((np.concatenate(grams) & np.uint64((1 << BITS) - 1)).astype(np.int32), return_counts=True)
    value = np.log1p(count)
    return index, (value / np.sqrt(value @ value) if len(value) else value).astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss. Coordinate
    2**BITS is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, 1 << BITS), np.append(value, 1.0)
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] += g * g


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, epochs: int = 4) -> np.ndarray:
    """Weights from at most ``sample`` labelled rows (a documented bound: those with
    the least md5 of doc_id), none of them held out. Rows without label, doc_id or
    document teach nothing; without any, all weights are 0. One executor task runs
    the updates in md5 order, so reruns agree; its memory is bounded by ``sample``."""
    md5 = F.md5(F.col("doc_id").cast("string"))
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label")).orderBy(md5, "doc_id").limit(sample)
    rows = stored(rows, "quality-sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(md5.alias("draw"), "label", "text")

    def extract(batches):
        for batch in batches:
            made = [features(t) for t in byte_views(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                names=["draw", "label", "index", "value"],
            )

    def learn(batches):
        # views into the batches: the sample is held once
        table = [(i.view(np.int32), v.view(np.float32), y) for b in batches for y, i, v in zip(b.column(1).to_pylist(), byte_views(b.column(2)), byte_views(b.column(3)))]
        model = Ftrl()
        for _ in range(epochs):
            for i, v, y in table:
                model.learn(i, v, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    seen = chosen.mapInArrow(extract, "draw string, label int, index binary, value binary")
    model = seen.repartition(1).sortWithinPartitions("draw", "label", "index").mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(model[0]["weights"], np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``docs`` columns ``keep`` and ``score``: the chance of label 1, from the whole
    text alone. Null and empty texts get the bias's score. The model is broadcast;
    its size is fixed (1 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    fields = docs.select(*keep).schema

    def run(batches):
        w = shared.value
        for batch in batches:
            scores = []
            for text in byte_views(batch.column(batch.num_columns - 1)):
                index, value = features(text)
                scores.append(float(w[index] @ value + w[-1]))
            scores = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])

    text = F.col("text").alias("_scored_text")
    return docs.select(*keep, text).mapInArrow(run, fields.add("score", "double"))
