"""Scores of the trained operators against plain loops: one text at a time, Python integers and floats, from the fitted weights."""

import math
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

from panelloom.llm import langid, quality_classifier, textnum, toxicity
from panelloom.llm.common import table

SF = "/root/testdata/sf0.001"
WRAP = 2**64
MIX, FIB, PRIME = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0x100000001B3
ODD = [int(x) for x in textnum.TWO_TABLES[0]]
EXTRA = ["", "a", "word", "One. Two! three?\nfour", "a  b\tb b", "é ß 中文 😀 Ünder", "x" * 200 + " y", "... !!! ???", "tail without end", "A-b_c 1234 12345", "\n\nlines\n\n"]


def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return rows + [(10_000 + k, t) for k, t in enumerate(EXTRA)]


def mixed(h):
    h = ((h ^ (h >> 31)) * MIX) % WRAP
    return h ^ (h >> 29)


def word_hash(word):
    total = sum((ord(c) + 1) * (ODD[i % 64] + i // 64 * 2) for i, c in enumerate(word))
    return mixed((total + len(word) * MIX) % WRAP)


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxic_score(text, weights, bias):
    """Noisy-or over sentences, each the logit of its distinct words and word beginnings."""
    clean = 1.0
    for sentence in re.split(r"[\n.!?]", text.lower()):
        buckets = set()
        for word in re.findall(r"[0-9a-z\x80-\U0010ffff]+", sentence):
            buckets.add(word_hash(word) >> (64 - toxicity.BITS))
            for n in toxicity.BEGINNINGS:
                if len(word) >= n:
                    code = 0
                    for c in word[:n]:
                        code = (code * PRIME + ord(c)) % WRAP
                    buckets.add(mixed((code + n - 1) % WRAP) >> (64 - toxicity.BITS))
        if buckets:
            clean *= 1 - min(sigmoid(sum(float(weights[b]) for b in buckets) + bias), 1 - 1e-12)
    return 1 - clean


def test_toxicity_against_loops(spark):
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    own = texts()
    got = {r.doc_id: r.score for r in toxicity.detect(spark.createDataFrame(own, "doc_id long, text string"), model).collect()}
    assert len(got) == len(own) and {round(s) for s in got.values()} == {0, 1}
    for d, t in own:
        assert got[d] == pytest.approx(toxic_score(t or "", model.weights, model.bias), abs=1e-6), t[:80]


def quality_score(text, logits, bias):
    """Mean of the table entries of all words, word pairs and character n-grams."""
    shift, own = 64 - quality_classifier.BITS, []
    words = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    own += [(h * FIB % WRAP) >> shift for h in words]
    own += [mixed(1 if a == b else mixed((a * FIB + b) % WRAP)) >> shift for a, b in zip(words, words[1:])]
    padded = " " + re.sub(r"[\x20\x09-\x0D]", " ", text) + " "
    for n in quality_classifier.CHARACTER_GRAMS:
        for i in range(len(padded) - n + 1):
            if " " not in padded[i + 1:i + n - 1]:
                h = 0
                for c in padded[i:i + n]:
                    h = (h * PRIME + ord(c)) % WRAP
                own.append(mixed(h * (2 * n + 1) % WRAP) >> shift)
    return sigmoid(sum(float(logits[b]) for b in own) / max(len(own), 1) + bias)


def test_quality_against_loops(spark):
    model = quality_classifier.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    own = [(d, t) for d, t in texts() if len(t or "") < 4000]
    got = {r.doc_id: r.score for r in quality_classifier.classify(spark.createDataFrame(own, "doc_id long, text string"), model).collect()}
    for d, t in own:
        assert got[d] == pytest.approx(quality_score(t or "", model.logits, model.bias), abs=1e-5), t[:80]


def test_language_against_loops(spark):
    import zstandard

    docs = table(spark, SF, "documents")
    known = langid.dictionaries(docs)
    parameters = zstandard.ZstdCompressionParameters(**langid.ENCODER)
    own = [(d, t) for d, t in texts() if len(t or "") < 60_000][::4] + [(99_999, " ".join(t for _, t in texts()[:40]))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(own, "doc_id long, text string"), known).collect()}
    for d, t in own:
        if not t or not any(c.isalpha() for c in t):
            assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
            continue
        raw, sizes = langid.letters(t), {}
        for lang, content in known.items():
            sizes[lang] = 0
            for at in range(0, len(raw), langid.PIECE_BYTES):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes[lang] += len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress(raw[at:at + langid.PIECE_BYTES]))
        best = min(sizes, key=lambda k: (sizes[k], k))
        second = sorted(sizes.values())[1]
        assert got[d].lang_pred == best and got[d].rejected == (second - sizes[best] < langid.MARGIN * sizes[best])
        assert got[d].score == pytest.approx(1 / sum(math.exp(-langid.NATS * min(s - sizes[best], 200)) for s in sizes.values()))


def some_texts(n, words, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(f"{chr(97 + k % 26)}{k:x}" for k in rng.integers(0, 1 << 20, words)) for _ in range(n)]


def test_packed_features_are_the_features(monkeypatch):
    own = [*EXTRA, *some_texts(20, 400), "a " * 700, "a b " * 40_000, "", *some_texts(5, 9)]
    for pack in (1, 1000, quality_classifier.PACK):
        monkeypatch.setattr(quality_classifier, "PACK", pack)
        bags = quality_classifier.Bags(own)
        assert len(bags) == len(own)
        for k, text in enumerate(own):
            ids, counts = np.unique(np.concatenate([b for b, _ in quality_classifier.feature_buckets([text])]), return_counts=True)
            got, weight = bags[k]
            assert got.tolist() == ids.tolist()
            assert weight.tolist() == (counts / max(counts.sum(), 1)).astype(np.float32).tolist()
    assert max(i for k in range(len(own)) for i in bags[k][0].tolist()) >= 1 << 16
    assert len(quality_classifier.Bags(["", ""])) == 2 and quality_classifier.Bags(["", ""])[1][0].size == 0


def test_fit_holds_few_bytes_a_feature(monkeypatch):
    """The driver holds the features of the whole sample: 300 texts of 1,000 words have over two million."""
    monkeypatch.setattr(quality_classifier, "EPOCHS", 1)
    monkeypatch.setattr(quality_classifier, "LEAST_STEPS", 1)
    own = some_texts(300, 1000)
    features = sum(len(np.unique(np.concatenate([b for b, _ in quality_classifier.feature_buckets([t])]))) for t in own)
    assert features > 2_000_000
    tracemalloc.start()
    try:
        quality_classifier.fit(own, [k % 2 for k in range(len(own))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    table = (1 << quality_classifier.BITS) * quality_classifier.DIMENSIONS * 4
    assert peak < 4 * features + table + 6_000_000
