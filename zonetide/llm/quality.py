"""Quality classifier: learned vectors of hashed word and character n-grams, averaged per document.

Features of a text are its words (what white space separates) and pairs of neighbouring words, runs of three and
four bytes, and, for pairs of equal words, one feature that all such pairs share. Each is hashed
to a row of a table of vectors. The mean of a document's vectors goes through a softmax over the two
classes. Vectors and weights are learned by stochastic gradient descent in numpy on the driver, from a
bounded sample. For scoring, each row of the table comes down to one number, its share of the score.

Null and empty texts have no features and score as the classes' bias has it. Repeated rows each get their
score. Without labels of both classes every score is 1: nothing is known against any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonetide.llm.common import (STEP, flat, held_out, labelled_sample, mixed, per_row, slices, span_hashes,
                                 spans_of, starts_within, text_of, unused_name)

SAMPLE_PER_CLASS = 1000  # labelled documents learned from, at most, of each class
SAMPLE_BYTES = 20_000    # longer texts aren't learned from
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
CUT = 0.7                # scores from here on stand for good texts

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SHIFT = np.uint64(64 - BUCKET_BITS)


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind of feature the buckets of all texts, and where each text's begin and the last ends."""
    data, bounds = flat(texts)
    starts, ends = spans_of(~_BLANK[data], starts_within(bounds, len(data)))
    words = span_hashes(data, starts, ends)
    rows = np.searchsorted(starts, bounds)
    pair = mixed(words[:-1] * np.uint64(STEP) + words[1:]) if len(words) else words
    pair[words[:-1] == words[1:]] = np.uint64(1) << np.uint64(63)
    inside = np.ones(len(pair), bool)
    inside[rows[(rows > 0) & (rows < len(words))] - 1] = False  # the last word of a text has no next one
    counts = np.concatenate(([0], np.cumsum(inside)))
    kinds = [words >> _SHIFT, pair[inside] >> _SHIFT]
    places = [rows, counts[np.minimum(rows, len(pair))]]
    for width in (3, 4):
        n = max(len(data) - width + 1, 0)
        gram = np.zeros(n, np.uint32)
        for i in range(width):
            gram |= data[i:i + n].astype(np.uint32) << np.uint32(8 * i)
        bucket = (gram * np.uint32(0x9E3779B1) + np.uint32(width)) >> np.uint32(32 - BUCKET_BITS)
        inside = np.ones(n, bool)
        for end in (bounds[1:-1, None] - np.arange(1, width)).ravel():
            if 0 <= end < n:
                inside[end] = False
        counts = np.concatenate(([0], np.cumsum(inside)))
        kinds.append(bucket[inside])
        places.append(counts[np.minimum(bounds, n)])
    return kinds, places


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each bucket for class 1 against class 0
    bias: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        kinds, places = features(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, place in zip(kinds, places, strict=True):
            total += per_row(np.add, self.weight[bucket], place, 0.0)
            count += np.diff(place)
        return total / np.maximum(count, 1) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))


def fit(sample: list[tuple[str, int]], seed: int = 1) -> Model:
    """Learns from (text, 1 if good) pairs. Every fifth document only calibrates the cut."""
    labels = np.array([label for _, label in sample])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), 30.0)
    documents = []
    for text, _ in sample:
        kinds, _ = features(pa.array([text], pa.large_string()))
        bucket, count = np.unique(np.concatenate([k.astype(np.int64) for k in kinds]), return_counts=True)
        documents.append((bucket, (count / max(count.sum(), 1)).astype(np.float32)))
    random = np.random.default_rng(seed)
    vectors = (random.random((1 << BUCKET_BITS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    order = np.arange(len(sample))
    learns = order[order % 5 != 4] if len(sample) >= 50 else order
    checks = order[order % 5 == 4] if len(sample) >= 50 else order
    share = np.bincount(labels[learns], minlength=2) / len(learns)
    steps, done = EPOCHS * len(learns), 0
    for _ in range(EPOCHS):
        for i in random.permutation(learns):
            bucket, count = documents[i]
            rows = vectors[bucket]
            hidden = count @ rows
            odds = hidden @ out + bias
            probability = np.exp(odds - odds.max())
            probability /= probability.sum()
            error = probability
            error[labels[i]] -= 1
            error *= 0.5 / max(share[labels[i]], 1e-9) * RATE * (1 - done / steps)
            back = out @ error
            out -= np.outer(hidden, error)
            bias -= error
            # A text's features are many; so that each moves enough, the step isn't divided among all.
            vectors[bucket] = rows - np.outer(np.sqrt(count), back)
            done += 1
    weight = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    plain = Model(weight, float(bias[1] - bias[0]))
    margin = np.array([plain.margins(pa.array([sample[i][0]], pa.large_string()))[0] for i in checks])
    truth = labels[checks]
    best, cut = -1.0, 0.0
    for at in np.quantile(margin, np.linspace(0.01, 0.99, 99)):
        found = np.mean([((margin[truth == c] >= at) == c).mean() for c in set(truth.tolist())])
        if found > best:
            best, cut = found, at
    # The cut found best becomes the score that stands for good texts.
    return Model(weight, plain.bias - float(cut) + float(np.log(CUT / (1 - CUT))))


def train(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from at most ``at_most`` labelled documents of each class, none of them held out."""
    return fit(labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), 4, 2),
                               at_most, SAMPLE_BYTES))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: better) to the documents; a column of that name is replaced,
    all others are kept. Texts of any length are read whole."""
    kept = docs.drop("score")
    names, whole = [*kept.columns, "score"], unused_name(kept, "whole")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, whole):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(shared.value.scores(batch.column(whole)))], names=names)

    return (kept.withColumn(whole, text_of(docs, text))
            .mapInArrow(scored, kept.withColumn("score", F.lit(0.0)).schema))
