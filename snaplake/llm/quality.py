"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed words and of hashed word shapes (how capitals, letters, digits and marks
follow each other, and whether the word repeats the one before), weighted by TF-IDF and projected on the
leading singular directions of a sample of labelled rows. Each text's cosines with all vectors of the
sample are computed exactly, block by block; its nearest neighbours vote with their similarity.

The sample is at most ``SAMPLE`` labelled rows, the ones whose ids hash lowest, so no order of the input
decides. It is all that is broadcast.

Edge cases: null and word-less texts get the sample's share of label 1; without labels every score is 0.5.
A row with several labels takes part once per distinct label; null labels do not take part. Label, language, source and
id are no input of a score. Repeated rows are scored one by one; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.text import BYTES, LOWER, Texts, blank, blocks, owner, runs

SAMPLE = 4096
WORDS, SHAPES = 1024, 512
DIMENSIONS = 64
NEIGHBOURS = 25
SHAPE_WEIGHT = 2.0
ROWS = 512
POWER = 8

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
_CLASS[range(0x41, 0x5B)] = ord("A")
_CLASS[range(0x30, 0x3A)] = ord("0")


def counts(part: Texts) -> Iterator[np.ndarray]:
    """Blocks of at most ``ROWS`` rows of counts, WORDS + SHAPES wide."""
    low = LOWER[part.data]
    inside = ~blank(low)
    starts, ends = runs(inside)
    text = owner(part.starts, starts)
    word = BYTES.spans(BYTES.sums(low), starts, ends)
    kind = _CLASS[part.data]
    turn = inside & np.concatenate(([True], (kind[1:] != kind[:-1]) | ~inside[:-1]))
    at = np.concatenate(([0], np.cumsum(turn)))
    shape = BYTES.spans(BYTES.sums(kind[turn]), at[starts], at[ends]) % np.uint64(SHAPES - 1) + np.uint64(1)
    if len(word):
        again = np.concatenate(([False], (word[1:] == word[:-1]) & (text[1:] == text[:-1])))
        shape[again] = 0
    column = np.concatenate((word % np.uint64(WORDS), shape + np.uint64(WORDS))).astype(np.int64)
    row = np.concatenate((text, text))
    width = WORDS + SHAPES
    edges = np.searchsorted(text, np.arange(0, len(part.starts) + ROWS, ROWS))
    for k, first in enumerate(range(0, len(part.starts), ROWS)):
        n = min(ROWS, len(part.starts) - first)
        mine = np.concatenate([np.arange(edges[k], edges[k + 1]), len(text) + np.arange(edges[k], edges[k + 1])])
        flat = (row[mine] - first) * width + column[mine]
        yield np.bincount(flat, minlength=n * width).reshape(n, width).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model(NamedTuple):
    """Inverse document frequencies, projection, the labelled vectors, their labels and mean label."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, x: np.ndarray) -> np.ndarray:
        x = np.log1p(x) * self.idf
        return np.hstack((_unit(x[:, :WORDS]), SHAPE_WEIGHT * _unit(x[:, WORDS:])))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        some = x.any(axis=1)
        if not len(self.labels) or not some.any():
            return out
        cosine = _unit(self.weighted(x[some]) @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** POWER
        out[some] = np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)
        return out


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    """Of the sample's counts and labels (0 or 1)."""
    labels = labels.astype(np.float64)
    if not len(labels):
        return Model(np.ones(WORDS + SHAPES, np.float32), np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(idf, np.zeros((0, 0)), np.zeros((0, 0)), labels, float(labels.mean()))
    parts = [x[i : i + ROWS] for i in range(0, len(x), ROWS)]  # block by block, so the driver holds the sample once
    _, directions = np.linalg.eigh(sum(w.T @ w for w in map(model.weighted, parts)))
    projection = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS], np.float32)
    vectors = np.vstack([_unit(model.weighted(part) @ projection) for part in parts])
    return model._replace(projection=projection, vectors=vectors.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out third, those whose ids hash lowest.

    The sample is chosen among ids; only its texts are brought together. Of rows with equal ids the least text counts.
    """
    known = labels.where(~held_out(id_column)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IS NOT NULL").distinct()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = known.join(source.select("id"), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = source.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for part in blocks(batch.column(0), pad=1) for x in counts(part)]
            rows = [x.tobytes() for block in found for x in block]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "label"])

    found = texts.mapInArrow(run, "x binary, label int").toArrow()
    data = found["x"].combine_chunks().buffers()[2] if len(found) else b""
    x = np.frombuffer(data, np.float32, len(found) * (WORDS + SHAPES)).reshape(-1, WORDS + SHAPES)
    return fit(x, found["label"].to_numpy())


def _scores(model, column: pa.Array) -> np.ndarray:
    found = [model.value.score(x) for part in blocks(column, pad=1) for x in counts(part)]
    return np.concatenate(found) if found else np.zeros(0)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1) and predicted label."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(held, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=["id", "score", "predicted"]
            )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows outside the held-out third, score all rows."""
    scored = score(docs, train(docs, labels, sample))
    return scored.withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows that are not rejected (score of 0.5 or more), every column as it was."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(held, batch.column(place)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
