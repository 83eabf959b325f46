"""Quality rules whose thresholds are learned per language and source from quantile sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import word_array

#: Fixed limits of the base rule.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Signals with learned upper limits, and the distance over the middle that is always allowed. Limit: middle + SPREAD * (high - middle) + slack.
SLACK = {"mean_word": 2.0, "symbol_rate": 0.1, "dup_line_rate": 0.1, "repeat_rate": 0.25}
#: High is the upper quartile, which less than a quarter of bad rows cannot move.
MIDDLE, HIGH, SPREAD = 0.5, 0.75, 6.0
#: Rows of the wider group (the language, all rows) that every group's own limit is averaged with.
PRIOR = 200
#: Entries of a sketch: quantiles are off by at most 1 / ACCURACY of the rows.
ACCURACY = 2000


def word_signals(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, after the columns ``keep``.

    n_repeat_words counts the words inside three-word windows that occur twice or more in the text. The windows are 64-bit hashes in an array of the row: only
    rows with an equal pair sort them, nothing is exploded or shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(*keep, word_array(F.col(text)).alias("_words"), (F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"), lines.alias("_lines"))
    hashed = counted.select(*keep, "n_symbols", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    numbers = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    windows = F.expr("CASE WHEN size(_hashes) > 2 THEN transform(slice(_hashes, 1, size(_hashes) - 2), (h, i) -> xxhash64(h, _hashes[i + 1], _hashes[i + 2])) ELSE array() END")
    windowed = hashed.select(*numbers, windows.alias("_windows"))
    ordered = F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) ELSE array() END")
    sorted_ = windowed.select(*numbers, ordered.alias("_sorted"))
    places = F.expr("transform(filter(_sorted, (w, i) -> coalesce(w.h = get(_sorted, i - 1).h, false) OR coalesce(w.h = get(_sorted, i + 1).h, false)), w -> array(w.i, w.i + 1, w.i + 2))")
    return sorted_.select(*numbers, F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_repeat_words"))


def adaptive_limits(signals: DataFrame, rates: list[str], by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Upper limit of each rate for each group: middle plus spread to the upper quartile, from quantile sketches, drawn towards the wider groups.

    All levels (all columns of ``by``, all but the last ... none) come from one rollup, whose sketches are built inside every partition and merged after the shuffle: a group with a third of
    all rows sends one small sketch from each task. A group of n rows has its own limit with weight n and that of the next wider level with weight PRIOR, so a few rows
    do not judge themselves.
    """
    levels = cut_lineage(signals.rollup(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
                                                 *[F.percentile_approx(c, F.array(F.lit(MIDDLE), F.lit(HIGH)), ACCURACY).alias(c) for c in rates]))
    raw = {c: F.col(c)[0] + SPREAD * (F.col(c)[1] - F.col(c)[0]) + SLACK[c] for c in rates}
    out = levels.where(F.col("level") == 2 ** len(by) - 1).select(*[raw[c].alias(f"{c}_limit") for c in rates])
    for k in range(1, len(by) + 1):
        own = levels.where(F.col("level") == 2 ** (len(by) - k) - 1).select(*by[:k], "n", *[raw[c].alias(f"_{c}") for c in rates]).alias("g")
        wider = F.broadcast(out).alias("w") if k == 1 else out.alias("w")  # one row
        on = F.lit(True)
        for c in by[:k - 1]:
            on = on & F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}"))
        out = own.join(wider, on).select(*[F.col(f"g.{c}") for c in by[:k]], *[((F.col("n") * F.col(f"_{c}") + PRIOR * F.col(f"{c}_limit")) / (F.col("n") + PRIOR)).alias(f"{c}_limit") for c in rates])
    return out


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Judges every document by the base rule and by limits learned for its language and source.

    A document fails the base rule with fewer than 50 words or with more than half of its words in repeated three-word windows. Of the others, those are kept
    whose mean word length, symbols a word, share of repeated lines and share of repeated words are all within the limits of their group. Limits
    are learned from the documents that pass the base rule.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed (names of the limits exceeded). Null and empty texts
    have no words and fail; a null language or source is a group of its own; equal rows get equal rows; an empty table gives no row. Other columns
    are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(text).alias("_text"))
    groups = [f"_by{i}" for i in range(len(by))]
    counted = word_signals(own, "_text", ("doc_id", *groups))
    words = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    signals = cut_lineage(counted.withColumns({"base_failed": failed, "mean_word": F.col("word_chars") / words, "symbol_rate": F.col("n_symbols") / words,
                                               "dup_line_rate": F.col("n_dup_lines") / words, "repeat_rate": F.col("n_repeat_words") / words}))
    rates = list(SLACK)
    limits = adaptive_limits(signals.where("NOT base_failed"), rates, tuple(groups))
    on = [F.col(f"s.{g}").eqNullSafe(F.col(f"l.{g}")) for g in groups]
    joined = signals.alias("s").join(limits.alias("l"), on, "left")
    over = F.filter(F.array(*[F.when(F.col(f"s.{c}") > F.col(f"l.{c}_limit"), F.lit(c)) for c in rates]), lambda x: x.isNotNull())
    return (joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", over.alias("failed"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed"))
