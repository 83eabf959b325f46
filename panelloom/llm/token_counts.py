"""Token counts through a cache of digests: only texts never counted before are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.llm.common import new_folder
from panelloom.llm.textnum import TWO_TABLES, groups, stretch_hashes

#: Documents with more tokens are marked.
TOKEN_LIMIT = 4096
#: Characters encoded in one call, and words whose counts a task remembers.
CALL_CHARACTERS = 2_000_000
REMEMBERED = 400_000
_FIELDS = "digest binary, n_tokens long"


class Counter:
    """Token counts of whole texts with a sentencepiece model.

    No piece of the vocabulary has the word mark behind another character, so no merge can join the end of a word with the next word's mark, and a text's
    pieces are those of its words (each with the blanks before it) one after the other. Distinct words are therefore encoded once and
    remembered, by two 64-bit hashes. A model with
    such a piece, or one that does not mark the start, encodes texts as a whole.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        marked = self.encoder.encode("a b", out_type=str)
        self.by_word = all("▁" not in p.lstrip("▁") for p in pieces) and "".join(marked) == "▁a▁b" and self.encoder.encode(" a  b ", out_type=str, num_threads=1)[0] == "▁"
        self.blank = len(self.encoder.encode("a ")) - len(self.encoder.encode("a"))
        self.known = self._nothing()

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(ids) for ids in self.encoder.encode(texts, num_threads=1)]
        full = [" " + t.replace("▁", " ") for t in texts if t]
        words, ones, twos, at, places = [], [], [], 0, []
        for own in groups(full):
            joined = "".join(own)
            points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
            lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            blank = points == 32
            opens = blank.copy()
            opens[1:] &= ~blank[:-1]  # a word begins with the first of its blanks
            opens[np.cumsum(lengths) - lengths] = True
            starts = np.flatnonzero(opens)
            one, two = stretch_hashes(points, np.diff(np.append(starts, len(points))), *TWO_TABLES)
            places.append(np.searchsorted(starts, np.cumsum(lengths) - lengths) + at)
            at += len(starts)
            ones.append(one)
            twos.append(two)
            words.append((joined, starts))
        if not full:
            return [0] * len(texts)
        one, two = np.concatenate(ones), np.concatenate(twos)
        distinct, first, where = np.unique(one, return_index=True, return_inverse=True)
        other = two[first]
        if (two != other[where]).any():  # two words with one hash
            return [len(ids) for ids in self.encoder.encode(texts, num_threads=1)]
        held_one, held_two, held_counts = self.known
        spot = np.minimum(np.searchsorted(held_one, distinct), len(held_one) - 1)
        held = (held_one[spot] == distinct) & (held_two[spot] == other)
        counts, new = np.where(held, held_counts[spot], 0), np.flatnonzero(~held)
        texts_of = self._words(words, np.cumsum([0] + [len(s) for _, s in words]), first[new])
        counts[new] = [len(ids) if w != " " else self.blank for ids, w in zip(self.encoder.encode([w[1:] for w in texts_of], num_threads=1), texts_of)]
        if len(held_one) > REMEMBERED:
            self.known = self._nothing()
        else:
            free = new[held_one[spot[new]] != distinct[new]]
            into = np.searchsorted(held_one, distinct[free])
            self.known = tuple(np.insert(a, into, b[free]) for a, b in zip(self.known, (distinct, other, counts)))
        sums = iter(np.add.reduceat(counts[where], np.concatenate(places)).tolist())
        return [next(sums) if t else 0 for t in texts]

    @staticmethod
    def _nothing():
        return np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64)

    @staticmethod
    def _words(parts, firsts, wanted) -> list[str]:
        """The words with the given numbers, blanks included."""
        begin = np.concatenate([s for _, s in parts])[wanted].tolist()
        end = np.concatenate([np.append(s[1:], len(t)) for t, s in parts])[wanted].tolist()
        part = (np.searchsorted(firsts, wanted, "right") - 1).tolist()
        return [parts[p][0][a:b] for p, a, b in zip(part, begin, end)]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Stored counts (digest, n_tokens) of one tokenizer version, one row a digest; None if nothing was stored yet."""
    try:
        stored = spark.read.schema(_FIELDS).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, cache: str | None = None, limit: int = TOKEN_LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokens of every whole text, as the library counts them: no begin or end, no special tokens, no truncation.

    The cache is a Parquet folder shared by all executors, with a partition for each tokenizer version (the digest of the model file) and one row for each
    digest of a text. A text is normalised only as far as counts cannot change: null becomes empty. Copies are put together inside every task
    before the texts are shuffled by digest, the digests already stored are taken out, the rest is encoded in Arrow batches and appended. A
    second run over the same texts encodes nothing. Without ``cache`` a new one is made for this call.

    Returns doc_id, n_bytes, n_tokens, over_limit. Null and empty texts have 0 bytes and 0 tokens; null ids stay null; equal rows get equal rows; an empty
    table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    version = hashlib.sha256(model).hexdigest()
    folder = cache or new_folder(spark, "token-cache")
    shipped = spark.sparkContext.broadcast(model)  # the vocabulary, half a megabyte

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shipped.value)
        for texts in batches:
            out, own, size = [], [], 0
            for t in texts:
                if own and size + len(t) > CALL_CHARACTERS:
                    out.extend(counter.count(own))
                    own, size = [], 0
                own.append(t)
                size += len(t)
            yield pd.Series(out + counter.count(own), dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    distinct = keyed.select("digest", "text").dropDuplicates(["digest"])
    stored = read_cache(spark, folder, version)
    misses = distinct if stored is None else distinct.join(stored.select("digest"), "digest", "left_anti")
    counted = misses.select("digest", F.pandas_udf(encode, "long")("text").alias("n_tokens"))
    counted.write.mode("append").parquet(f"{folder}/version={version}")
    counts = read_cache(spark, folder, version)
    return (keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
