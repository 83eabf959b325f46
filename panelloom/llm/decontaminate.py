"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import free_names

#: Words in a row that count as taken from an item; shorter items count as a whole.
WINDOW = 13
#: Share of hit words, as one in so many, from which a document is contaminated.
COVERAGE = 20
#: Words of items in one automaton; larger benchmarks are cut into several, which the documents pass one after the other.
BLOCK_WORDS = 200_000

#: Bytes that separate words become blanks, A-Z become lower case; all bytes beyond ASCII belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences, with the items that hold each window.

    A state stands for the sequences that end at the same places of the items; ``link`` leads to the state of the longest shorter suffix that ends at more
    places, ``length`` is the longest sequence of the state.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for own in ids:
            last = 0
            for word in own:
                last = self._extend(last, word)
        # what an occurrence says: a window's state names its items; a short item's state names the item
        self.names: dict[int, set[str]] = {}
        #: short items: their length and names, one entry for each distinct sequence of words
        self.short: list[tuple[int, set[str]]] = []
        at: dict[tuple[int, int], int] = {}
        for (name, words), own in zip(items, ids):
            if not words:
                continue
            if len(words) < window:
                state = 0
                for word in own:
                    state = self.step[state][word]
                entry = at.setdefault((state, len(words)), len(at))
                if entry == len(self.short):
                    self.short.append((len(words), set()))
                self.short[entry][1].update([] if name is None else [name])
                continue
            state, size = 0, 0
            for word in own:
                state, size = self.step[state][word], size + 1
                if size >= window and name is not None:
                    self.names.setdefault(self._window_state(state), set()).add(name)
        # short items at or above each state, found by going up the links: one for each length at most, as they are suffixes of one sequence
        here: dict[int, tuple[int, ...]] = {}
        for (state, _), entry in at.items():
            here[state] = (*here.get(state, ()), entry)
        self.above: list[tuple] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[state] = self.above[self.link[state]] + here.get(state, ())

    @classmethod
    def of(cls, parts: dict) -> Automaton:
        """The automaton with the attributes of another one."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _new(self, step: dict[int, int], length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The target cut at one more than the state's length: the shorter suffixes become a state of their own."""
        size = self.length[state] + 1
        if self.length[target] == size:
            return target
        copy = self._new(dict(self.step[target]), size, self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        new, state = self._new({}, self.length[last] + 1, 0), last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.step[state][word])
        return new

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans [first, end) of hit words, in order and apart, and the items met. One pass: the longest match is tracked word by word."""
        step, link, length, above, short, window = self.step, self.link, self.length, self.above, self.short, self.window
        get = self.vocabulary.get
        state = size = 0
        spans: list[list[int]] = []
        met: set[int] = set()
        met_short: set[int] = set()
        items: set[str] = set()
        for i, w in enumerate(words):
            word = get(w)
            if word is None:
                state = size = 0
                continue
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(word)
            if to is None:
                size = 0
                continue
            state, size, reach = to, size + 1, 0
            if size >= window:
                reach = window
                met.add(state)
            for entry in above[state]:
                n = short[entry][0]
                if n <= size:
                    reach = max(reach, n)
                    met_short.add(entry)
            if reach:
                first = i + 1 - reach
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first:
                    spans[-1][1] = i + 1
                else:
                    spans.append([first, i + 1])
        for s in met:
            items |= self.names.get(self._window_state(s), set())
        for entry in met_short:
            items |= short[entry][1]
        return spans, items


def without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and the blanks after them."""
    inside = [False] * (spans[-1][1] + 1) if spans else []
    for a, b in spans:
        inside[a:b] = [True] * (b - a)
    out, at = [], 0
    for n, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)):
        if n >= len(inside):
            break
        if inside[n]:
            out.append(text[at:m.start()])
            at = m.end()
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
    return "".join(out) + text[at:]


def _cut(text: str | None, spans: list, least: int) -> str | None:
    """The text without its spans of at least ``least`` words."""
    long = [[a, b] for a, b in spans if b - a >= least]
    return without(text, long) if long else text


def _cleaned(automaton: Automaton, text: str | None, spans: list, least: int) -> str | None:
    """The text cut until no span of at least ``least`` words is left: what stood on both sides of a cut may make a window together."""
    while text and any(b - a >= least for a, b in spans):
        text = _cut(text, spans, least)
        spans, _ = automaton.hits(normal_words(text))
    return text


def _cutter(least: int):
    def cut(texts: pd.Series, every: pd.Series) -> pd.Series:
        return pd.Series([t if own is None else _cut(t, [[s["first"], s["stop"]] for s in own], least) for t, own in zip(texts, every)], dtype=object)

    return F.pandas_udf(cut, "string")


def _finder(spark: SparkSession, automaton: Automaton, clean: bool, least: int = 1):
    shipped = spark.sparkContext.broadcast(vars(automaton))  # at most BLOCK_WORDS words of items, as plain lists and dicts: workers need not import this package

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Automaton.of(shipped.value)
        for texts in batches:
            rows = []
            for t in texts:
                words = normal_words(t)
                spans, items = own.hits(words)
                hit = sum(b - a for a, b in spans)
                rows.append((len(words), hit, [{"first": a, "stop": b} for a, b in spans], sorted(items), _cleaned(own, t, spans, least) if clean else None))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items", "clean_text"])

    return F.pandas_udf(find, "n_words long, n_hit long, spans array<struct<first: int, stop: int>>, items array<string>, clean_text string")


def _found(docs: DataFrame, automaton: Automaton, keys: list[str], clean: bool) -> DataFrame:
    find = _finder(docs.sparkSession, automaton, clean)
    return docs.select(*keys, find("text").alias("f")).select(*keys, "f.*")


class Items:
    """Normalised items, read from their table block by block."""

    def __init__(self, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> None:
        words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _SPLIT), ""))
        self.known = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
        total = self.known.agg(F.coalesce(F.sum(words), F.lit(0)).alias("n")).first()["n"]
        self.blocks, self.window = max(1, math.ceil(total / block_words)), window

    def automaton(self, k: int) -> Automaton:
        rows = self.known.where(F.pmod(F.xxhash64("text"), F.lit(self.blocks)) == k).orderBy("item_id", "text").collect()  # one block
        return Automaton([(r["item_id"], normal_words(r["text"])) for r in rows], self.window)


def _over(coverage: int, found: str = "") -> Column:
    return (F.col(f"{found}n_hit") > 0) & (F.col(f"{found}n_hit") * coverage >= F.col(f"{found}n_words"))


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, coverage: int = COVERAGE, clean: bool = False, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """Words of every whole text that lie inside an occurrence of a window of an item.

    The words of each text stream through the automaton, which keeps the length of the longest sequence of item words that ends here: from ``window`` words on
    the last ``window`` of them are hit, and a shorter item is hit where it occurs whole. Items are dealt by digest into blocks of about ``block_words``
    words; with several blocks each has an automaton of its own and a pass of its own, and the spans are joined afterwards, so neither the driver nor a task
    holds more than one block.

    Returns doc_id, n_words, n_hit, spans (first and stop word), items (their ids as text, sorted), contaminated (n_hit > 0 and coverage * n_hit >= n_words), and with
    ``clean`` also clean_text, the text without its hit words.

    Null and empty texts have no words and no hit; items without words are never met; an item with a null id hits words but is not listed; items with the
    same id count once; equal rows get equal rows; without items nothing is hit; an empty table gives no row. Other columns are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = Items(items, window, block_words)
    if known.blocks == 1:
        found = _found(own, known.automaton(0), ["doc_id"], clean)
    else:
        keyed = own.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
        texts = keyed.select("key", "text").dropDuplicates(["key"])
        part = [cut_lineage(_found(texts, known.automaton(k), ["key"], False).where("n_hit > 0" if k else "true")) for k in range(known.blocks)]
        every = part[0]
        for p in part[1:]:
            every = every.unionByName(p)
        joined = (every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                           F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))  # of one text
                  .withColumn("hit", F.expr("array_sort(array_distinct(flatten(transform(all, s -> sequence(s.first, s.stop - 1)))))"))
                  .withColumn("n_hit", F.size("hit").cast("long"))
                  .withColumn("spans", F.expr("zip_with(filter(hit, (w, i) -> i = 0 OR w > get(hit, i - 1) + 1), filter(hit, (w, i) -> i = size(hit) - 1 OR w + 1 < get(hit, i + 1)), (a, b) -> struct(a AS first, b + 1 AS stop))")))
        found = keyed.select("doc_id", "key", *["text"] * clean).join(joined, "key")
        if clean:
            found = found.withColumn("clean_text", _cutter(1)("text", "spans"))
    out = ["doc_id", "n_words", "n_hit", "spans", "items"] + ["clean_text"] * clean
    return found.withColumn("contaminated", _over(coverage)).select(*out, "contaminated")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, coverage: int = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, without their hit spans of at least ``window`` words; each row is judged by its own text.

    A cut joins the words on its two sides, which may make a window together, so cutting goes on until none is left. Texts without such a span and all other
    columns stay as they are. A shorter span, which is a short item that occurs whole, stays if the document does.

    Null and empty texts, and rows with null ids, stay; repeated rows are judged alike; without items every row stays; an empty table gives no row. Further columns
    may have any name.
    """
    known = Items(items, window, block_words)
    found_name, key, new = free_names(docs, "found", "text_key", "new_text")
    if known.blocks == 1:
        find = _finder(docs.sparkSession, known.automaton(0), True, window).asNondeterministic()  # else the filter would run it a second time
        judged = docs.withColumn(found_name, find("text")).where(~_over(coverage, f"{found_name}."))
        return judged.select(*[F.col(f"{found_name}.clean_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = keyed.select(F.col(key).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    first = cut_lineage(find_items(texts, items, window, block_words, coverage).where("n_hit > 0").select("doc_id", "spans", "contaminated"))
    out = keyed.join(first.where("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti")
    hit, rounds = first.where("NOT contaminated").select("doc_id", "spans"), []
    while True:  # each round holds only the texts that the round before has cut
        cut = cut_lineage(texts.join(hit.where(F.exists("spans", lambda s: s["stop"] - s["first"] >= window)), "doc_id").select("doc_id", _cutter(window)("text", "spans").alias("text")))
        if cut.isEmpty():
            break
        rounds.append(cut)
        texts, hit = cut, find_items(cut, items, window, block_words, coverage).where("n_hit > 0").select("doc_id", "spans")
    for cut in rounds:
        out = out.join(cut.toDF(key, new), key, "left").withColumn("text", F.coalesce(new, "text")).drop(new)
    return out.select(*docs.columns)
