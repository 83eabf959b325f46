"""Quality classifier: hashed word and character n-gram vectors, averaged over a document, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelloom.llm.common import labelled_sample
from panelloom.llm.textnum import blanks, code_points, groups, mixed, sums_by, word_hashes

#: Training texts of each label value, at most.
SAMPLE_PER_CLASS = 2_000
BITS = 17
DIMENSIONS = 16
CHARACTER_GRAMS = (3, 4, 5)
#: Passes over the sample, and more on small samples, until so many texts have been shown.
EPOCHS, LEAST_STEPS = 5, 12_000
RATE = 0.25
#: Features of training texts that are packed together.
PACK = 1 << 18
#: Score from which a document counts as good.
THRESHOLD = 0.3


def feature_buckets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets of the texts, kind by kind, each with the index at which every text's features begin.

    The kinds are words, pairs of neighbouring words (a word that repeats its neighbour gives the same pair whatever the word), and character n-grams
    inside words, whose boundaries count as one blank each. Case is kept.
    """
    points, at = code_points(texts)
    gap = blanks(points)
    starts, hashes = word_hashes(points, gap)
    shift = np.uint64(64 - BITS)
    out = [((hashes * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), np.searchsorted(starts, at))]
    if len(hashes) > 1:
        pair = np.where(hashes[:-1] == hashes[1:], np.uint64(1), mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]))
        text = np.searchsorted(at, starts, "right")
        same = text[:-1] == text[1:]
        out.append(((mixed(pair[same]) >> shift).astype(np.int64), np.searchsorted(starts[:-1][same], at)))
    letters = np.where(gap, np.uint32(32), points).astype(np.uint64)
    h, inner, n = letters, None, 1
    while n < max(CHARACTER_GRAMS):
        h = h[:-1] * np.uint64(0x100000001B3) + letters[n:]
        n += 1
        if n > 2:  # all but the first and the last character lie inside a word
            more = ~gap[n - 2:len(points) - 1]
            inner = more if inner is None else inner[:-1] & more
        if n in CHARACTER_GRAMS:
            places = np.flatnonzero(inner)
            out.append(((mixed(h[places] * np.uint64(2 * n + 1)) >> shift).astype(np.int64), np.searchsorted(places, at)))
    return out


@dataclass
class Model:
    """What scoring needs: for each bucket the difference of the two classes' outputs for its vector, and the same for the bias.

    The mean of vectors times the output layer is the mean of the vectors' own outputs, so a document's logit is a mean of these entries.
    """

    logits: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        """Probability of label 1 for each text, whole; a text without words has the score of the bias."""
        out = [np.zeros(0)]
        for own in groups(texts):
            z, n = np.zeros(len(own)), np.zeros(len(own))
            for buckets, first in feature_buckets(own):
                z += sums_by(self.logits[buckets], first)
                n += np.diff(np.append(first, len(buckets)))
            out.append(1.0 / (1.0 + np.exp(-np.clip(z / np.maximum(n, 1) + self.bias, -30, 30))))
        return np.concatenate(out)


class Bags:
    """Features of training texts: the distinct buckets of each, ascending, and how often it has them.

    The driver holds all bags of a sample while it learns, so each feature takes two bytes for the lower part of its bucket and one for its count (more if a count of
    its pack needs more); buckets from 65536 on are marked by where they begin. Packs are single arrays, which go back to the system as a whole.
    """

    def __init__(self, texts: list[str]) -> None:
        self.packs: list[tuple[np.ndarray, np.ndarray]] = []
        #: of each text: its pack, where it begins, where its upper buckets begin and where it ends
        self.places: list[tuple[int, int, int, int]] = []
        open_ids, open_counts, size = [], [], 0
        for n, t in enumerate(texts, 1):
            ids, counts = np.unique(np.concatenate([b for b, _ in feature_buckets([t])]), return_counts=True)
            self.places.append((len(self.packs), size, size + int(np.searchsorted(ids, 1 << 16)), size + len(ids)))
            open_ids.append(ids.astype(np.uint16))
            open_counts.append(counts.astype(np.uint32))
            size += len(ids)
            if size >= PACK or n == len(texts):
                every = np.concatenate(open_counts)
                self.packs.append((np.concatenate(open_ids), every.astype(np.min_scalar_type(every.max(initial=0)))))
                open_ids, open_counts, size = [], [], 0

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text ``k``, and the share of each in the text's features."""
        pack, first, upper, stop = self.places[k]
        ids, counts = (x[first:stop] for x in self.packs[pack])
        ids = ids.astype(np.int64)
        ids[upper - first:] += 1 << 16
        return ids, (counts / max(counts.sum(dtype=np.int64), 1)).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss: the vectors of all buckets and the output layer are learned together.

    With one label value only, every score is that value; without labels it is a half.
    """
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 20.0 * (2 * labels[0] - 1) if labels else 0.0)
    bags = Bags(texts)
    rng = np.random.default_rng(seed)
    vectors = np.empty((1 << BITS, DIMENSIONS), np.float32)
    for own in np.split(vectors, 32):  # the draws are float64, twice the size
        own[:] = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, own.shape)
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    epochs, done = max(EPOCHS, LEAST_STEPS // len(bags)), 0
    steps = epochs * len(bags)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, weight = bags[k]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            rows = vectors[ids]
            hidden = weight @ rows
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * p
            # rows move by the root of their share, so that rare features learn as well as frequent ones
            vectors[ids] = rows - (rate * np.sqrt(weight / weight.max()))[:, None] * back
    table = vectors @ output
    return Model((table[:, 1] - table[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled texts of each value, on the driver; held-out documents are never read."""
    return fit(*labelled_sample(docs, labels, label, folds, fold, per_class))


def quality_score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Score of a text column, in Arrow batches; the model (half a megabyte) is broadcast."""
    shipped = spark.sparkContext.broadcast((model.logits, model.bias))  # plain data: workers need not import this package

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_model = Model(*shipped.value)
        for texts in batches:
            yield pd.Series(own_model.scores(texts), dtype="float64")

    return F.pandas_udf(score, "double")(text)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Returns doc_id, score, predicted (1 if score >= threshold) for every row.

    Null and empty texts have no features and get the score of the bias; null ids stay null; equal rows get equal rows; an empty table gives no row. Other
    columns are not read.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), quality_score(docs.sparkSession, model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are.

    Each row is judged by its own whole text; null and empty texts have the score of the bias and go or stay as it says. Null ids and repeated rows are rows
    like others, an empty table gives no row, and further columns may have any name.
    """
    return docs.where(quality_score(docs.sparkSession, model, F.col("text")) >= threshold)
