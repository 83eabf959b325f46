"""Language identification by compression with one zstandard dictionary per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from panelloom.llm.common import held_out

#: Raw bytes in each dictionary; training documents of a language, and characters of each, from which they are cut.
DICTIONARY_BYTES = 400_000
SAMPLE_DOCUMENTS = 1_000
SAMPLE_CHARACTERS = 2_000
#: Parts of a language in which the first documents are looked for.
SALTS = 64
#: A prediction is marked as rejected if the second language needs less than this share more bytes than the best.
MARGIN = 0.02
UNKNOWN = "und"
#: Bytes that are compressed together: every piece starts from the fresh dictionary, which stays in reach to its end.
PIECE_BYTES = 16_384
#: Greedy matching of 4 bytes and more, with tables large enough for a whole dictionary.
ENCODER = {"window_log": 19, "hash_log": 17, "chain_log": 18, "search_log": 2, "min_match": 4, "strategy": 3, "write_content_size": False}
#: Nats that one byte more costs in the score.
NATS = 0.5

_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32) for c in range(256))


def letters(text: str) -> bytes:
    """The text in lower case with all but letters (and what lies beyond ASCII) turned into single spaces."""
    return b" ".join((" " + text.lower() + " ").encode("utf-8", "replace").translate(_LETTERS).split())


def written(encoder, raw: bytes) -> int:
    """Bytes that the encoder needs for all pieces of a text together."""
    return sum(len(encoder.compress(raw[at:at + PIECE_BYTES])) for at in range(0, len(raw), PIECE_BYTES))


def dictionaries(docs: DataFrame, folds: int = 3, fold: int = 1, documents: int = SAMPLE_DOCUMENTS, characters: int = SAMPLE_CHARACTERS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The dictionary of every language: training documents one after the other, until ``size`` bytes are full.

    Documents are taken in a hash order of their ids, ``documents`` for each language at most, by a limit that is applied inside every task before the
    ids are shuffled; a passage of each, from a place that the hash of its id tells, goes to the driver: a bounded sample of labelled rows. Copies count once.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id", folds, fold))
    picked = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    for by in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):  # first inside parts of a language, so that a hot one is spread
        first = W.partitionBy(*by).orderBy("h", "doc_id")
        picked = picked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= documents).drop("n")
    picked = picked.select("doc_id").distinct()
    rows = (known.join(F.broadcast(picked), "doc_id").select("lang", "doc_id", F.expr(f"substring(text, CAST(1 + pmod(xxhash64(doc_id, 1), greatest(char_length(text) - {characters}, 0) + 1) AS INT), {characters})").alias("text"))  # ``documents`` ids a language
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect())
    texts: dict[str, dict[str, None]] = {}
    for lang, _, text in rows:
        texts.setdefault(lang, {})[text] = None
    return {lang: b" ".join(letters(t) for t in texts[lang])[:size] for lang in sorted(texts)}


def identify(docs: DataFrame, known: dict[str, bytes], text: str = "text", doc_id: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """The language whose dictionary lets the whole text be written in the fewest bytes, piece by piece, so that every part of a long text counts alike.

    Returns doc_id, lang_pred, score (0 to 1: how much shorter the best is than the others), rejected (the margin is too narrow to trust it).

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is everything if no language was learned. Ties go to the first language
    by name and are rejected. Equal rows get equal rows; null ids stay null; an empty table gives no row. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(known)  # one dictionary of bounded size for each language

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        parameters = zstandard.ZstdCompressionParameters(**ENCODER)
        encoders = []
        for lang, raw in shipped.value.items():
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            encoders.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)))
        for texts in batches:
            out = []
            for t in texts:
                if t is None or not encoders or not any(map(str.isalpha, t)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                raw = letters(t)
                sizes = sorted((written(e, raw), lang) for lang, e in encoders)
                least = sizes[0][0]
                score = 1.0 / sum(math.exp(-NATS * min(s - least, 200)) for s, _ in sizes)
                out.append((sizes[0][1], score, len(sizes) > 1 and sizes[1][0] - least < margin * least))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    decide = F.pandas_udf(predict, "lang_pred string, score double, rejected boolean")
    return docs.select(F.col(doc_id).alias("doc_id"), decide(F.col(text)).alias("d")).select("doc_id", "d.lang_pred", "d.score", "d.rejected")
