"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelloom.llm.common import labelled_sample
from panelloom.llm.textnum import blanks, code_points, groups, mixed, sums_by, word_hashes

#: Training texts of each label value, at most.
SAMPLE_PER_CLASS = 2_500
BITS = 18
#: Features of a word are the word and its beginnings of these lengths, which families of rare words share.
BEGINNINGS = (4, 5)
#: Features found in fewer training texts carry no weight.
LEAST_TEXTS = 3
STEPS, RATE, MOMENTUM = 150, 0.1, 0.9
#: Pull of every weight towards 0, in documents: a word must explain more than this to keep a weight.
SHRINK = 1.0
#: Document score from which a text counts as toxic, and sentence score from which a sentence is pointed out.
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5


def sentence_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of the texts, the index at which each sentence's features begin, each sentence's text, and where it starts in its text.

    Sentences end at line feeds, full stops, exclamation and question marks; a sentence without a word is none. Words are runs of letters and digits,
    compared in lower case.
    """
    lowered = [low if len(low := t.lower()) == len(t) else "".join(c if len(c.lower()) > 1 else c.lower() for c in t) for t in texts]
    points, at = code_points(lowered)
    sign = (points < 48) | ((points > 57) & (points < 65)) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 128))
    gap = sign | blanks(points)
    starts, hashes = word_hashes(points, gap)
    ends = (points == 10) | (points == 33) | (points == 46) | (points == 63)
    sentence = np.cumsum(ends)[starts] if len(starts) else np.zeros(0, np.int64)
    opens = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(starts) else np.zeros(0, np.int64)
    text = np.searchsorted(at, starts[opens], "right") - 1
    number = np.cumsum(np.bincount(opens, minlength=len(starts))) - 1
    shift, kinds = np.uint64(64 - BITS), [(number << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64)]
    code, whole = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    for k in range(max(BEGINNINGS)):
        place = np.minimum(starts + k, len(points) - 1)
        whole &= ~gap[place]
        code = code * np.uint64(0x100000001B3) + points[place]
        if k + 1 in BEGINNINGS:
            kinds.append((number[whole] << BITS) | (mixed(code[whole] + np.uint64(k)) >> shift).astype(np.int64))
    found = np.sort(np.concatenate(kinds))
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found  # a feature counts once in a sentence
    return found & ((1 << BITS) - 1), np.searchsorted(found >> BITS, np.arange(len(opens))), text, starts[opens] - at[text] - 1


@dataclass
class Model:
    """A weight for each word bucket, and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, text and start of every sentence."""
        buckets, first, text, start = sentence_features(texts)
        z = sums_by(self.weights[buckets], first) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))), text, start

    def documents(self, scores: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or: a document is toxic unless each of its sentences is not."""
        return -np.expm1(np.bincount(text, np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=n))


def fit(texts: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Gradient ascent with momentum on the log-likelihood of document labels under the noisy-or, over all texts at each step.

    With P = 1 - prod(1 - p), the derivative for a sentence's logit is -p for label 0 and p (1 - P) / P for label 1, so of a toxic document the sentences
    that already explain it are pushed most: this is how the offending ones are found without sentence labels. ``shares`` weigh the label values.
    With one label value only, each text gets a score near it; without labels, near 0.
    """
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS), 8.0 if labels and labels[0] else -8.0)
    buckets, first, owner, base = [], [], [], 0
    for k, t in enumerate(texts):
        b, f, _, _ = sentence_features([t])
        buckets.append(b)
        first.append(f + base)
        owner.append(np.full(len(f), k))
        base += len(b)
    bucket, start, text = np.concatenate(buckets), np.concatenate(first), np.concatenate(owner).astype(np.int64)
    seen = np.zeros(1 << BITS, np.int64)
    for b in buckets:
        seen[np.unique(b)] += 1
    ids, compact = np.unique(bucket, return_inverse=True)
    active = seen[ids] >= LEAST_TEXTS
    sentence = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(bucket))))
    y, weigh = np.array(labels), np.array(shares)[np.array(labels)]
    w, bias, speed, speed_bias = np.zeros(len(ids)), -6.0, np.zeros(len(ids)), 0.0
    keep = active[compact]
    compact, sentence = compact[keep], sentence[keep]
    rate = RATE / np.sqrt(seen[ids])
    for _ in range(STEPS):
        z = np.bincount(sentence, w[compact], minlength=len(start)) + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        whole = -np.expm1(none)
        g = p * (np.where(y == 1, np.exp(none) / np.maximum(whole, 1e-12), -1.0) * weigh)[text]
        speed = MOMENTUM * speed + rate * np.bincount(compact, g[sentence], minlength=len(ids))
        speed_bias = MOMENTUM * speed_bias + RATE * g.sum() / len(texts)
        w += speed
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK * rate, 0.0)
        bias += speed_bias
    weights = np.zeros(1 << BITS)
    weights[ids] = w
    return Model(weights.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, fold: int = 1, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled texts of each value, on the driver; held-out documents are never read."""
    return fit(*labelled_sample(docs, labels, label, folds, fold, per_class))


def detect(docs: DataFrame, model: Model, threshold: float = THRESHOLD, sentence_threshold: float = SENTENCE_THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores every whole text and points out its offending sentences.

    Returns doc_id, score, predicted (1 if score >= threshold), spans: an array of (start, stop, score) of the sentences that score ``sentence_threshold`` or
    more, in characters of the text; a span ends where the next sentence with words begins.

    Null and empty texts have no sentence: score 0, no span. Null ids stay null; equal rows get equal rows; an empty table gives no row. Other columns are not
    read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # one megabyte of plain data: workers need not import this package

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_model = Model(*shipped.value)
        for texts in batches:
            scores, spans = [], []
            for own in groups(texts):
                p, text, start = own_model.sentences(own)
                whole = own_model.documents(p, text, len(own))
                found: list[list[dict]] = [[] for _ in own]
                for k in np.flatnonzero(p >= sentence_threshold):
                    t = text[k]
                    stop = start[k + 1] if k + 1 < len(p) and text[k + 1] == t else len(own[t])
                    found[t].append({"start": int(start[k]), "stop": int(stop), "score": float(p[k])})
                scores.extend(np.clip(whole, 0.0, 1.0))
                spans.extend(found)
            yield pd.DataFrame({"score": np.array(scores, dtype=float), "spans": spans})

    udf = F.pandas_udf(score, "score double, spans array<struct<start: int, stop: int, score: double>>")
    scored = docs.select(F.col(doc_id).alias("doc_id"), udf(F.col(text)).alias("s")).select("doc_id", "s.score", "s.spans")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
