"""Degenerate input of every llm operator and pipeline stage: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm import chunks, common, decontaminate, langid, mixing, near_dedup, quality_classifier, quality_rules, sharding, token_counts, toxicity

LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, shard string, node string, digest string, component string, key string, block string, "
          "score string, n_words string, copies string, words string, item_id string, start string, y string, h string")
CLASH = ["_id", "_copies", "_size", "_source", "_copy", "_found", "_key", "_spans", "_bad", "_cuts", "_range", "own_id", "own_source", "OWN_SIZE", "copy", "found", "text_key", "text_key_", "new_text", "cuts", "kept_id"]
SCHEMA += "".join(f", {c} string" for c in CLASH)
TEXTS = [(1, "one two three four. five six", "en", "a"), (1, "one two three four. five six", "en", "a"), (2, "One two three FOUR. five six", "en", None), (3, None, "en", "a"), (4, "", None, "b"), (5, "  \n\t ", "de", "b"),
         (None, "no id at all here", None, None), (6, LONG, "en", "c"), (7, "!!! ??? ...", "de", "c"), (8, "word", None, None), (9, f"before {PASSAGE} after", "de", "a"), (10, f"other {PASSAGE} words", "en", "b"),
         (11, "\x00 nul \x01", "en", "b"), (1, "one id with another text entirely", "de", "a"), (12, "ééé ñ ß 中文 😀", "fr", "a"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["x"] * (15 + len(CLASH))
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None, *clash) for i, t, g, s in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    """A table folder for stages: one class of labels only, a benchmark with null and empty items."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (9, 1, None), (None, 1, 1), (12, None, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "nul"), (4, "four five"), (1, PASSAGE)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).fillna(-1, [c for c in columns if c != "spans"]).collect())


def test_sharding(docs, none):
    rows = sharding.byte_shards(docs, 3).collect()
    assert len(rows) == len(TEXTS) and sum(r["size"] for r in rows) == sum(len(t.encode()) if t else 0 for _, t, _, _ in TEXTS) + 8 * len(TEXTS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.text_crc32 is None) == (r["size"] == 8 and r.text_crc32 != zlib.crc32(b"")) and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.byte_shards(none, 3).count() == 0 and sharding.byte_shards(docs, 1).select("shard").distinct().count() == 1


def test_sharding_splits_a_hot_group_and_keeps_small_ones(spark):
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, F.lit("hot text")).otherwise(F.concat(F.lit("text "), (F.col("id") / 2).cast("long").cast("string"))).alias("text"))
    rows = sharding.byte_shards(hot, 8).collect()
    sizes, held = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        sizes[r.shard] += r["size"]
        held[r.text_crc32].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 8
    assert len(held.pop(zlib.crc32(b"hot text"))) >= 3 and all(len(s) == 1 for s in held.values())


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    target, taken = {}, collections.Counter()
    for r in rows:
        target[r.source] = r.target
        taken[r.source] += r.taken
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert all(abs(taken[s] - t) <= 3 for s, t in target.items()), (taken, target)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(none).count() == 0 and mixing.mix(docs.where("text IS NULL OR text = ''")).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(none).count() == 0


def test_small_sources_are_settled_to_the_word(spark):
    """Slots of 114 words: sources of less than one slot and of a few slots reach their targets, beside large ones."""
    small = {"tiny": [30], "less": [40, 60], "some": [1000], "few": [4000, 1000], None: [7, 0, 3]}
    rows = [(i, s, n) for i, (s, n) in enumerate([(s, 50_000) for s in ("x", "y", "z")] * 100 + [(s, n) for s, own in small.items() for n in own])]
    mixed = spark.createDataFrame(rows, "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    target, taken = {}, collections.Counter()
    for r in mixing.mix(mixed).collect():
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(taken[s] == round(target[s]) == 3 * sum(own) for s, own in small.items()), (taken, target)
    assert all(abs(taken[s] - target[s]) < 0.002 * target[s] for s in "xyz")
    copies = collections.Counter(r.doc_id for r in mixing.mixed_documents(mixed).select("doc_id").collect())
    assert [copies[i] for i, s, n in rows if s in small] == [3 if n else 0 for _, s, n in rows if s in small]


def test_targets_against_rounds_of_resharing(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 100000]) for i in range(7)} | {None: 50}
        order = sorted((s for s in sizes if s), ) + [None]
        weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
        got = {r.source: r.target for r in mixing.target_weights(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [1, 2, 3]).collect()}
        left, open_, want = float(sum(sizes.values())), set(sizes), {}
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
            if not over:
                break
            for s in over:
                want[s] = 3.0 * sizes[s]
            left, open_ = left - sum(want[s] for s in over), open_ - over
        assert got == pytest.approx(want | share)


def test_schedule_prefixes_are_balanced(spark):
    targets = spark.createDataFrame([("a", 10, 1.0), ("b", 10, 2.0), ("c", 10, 5.0)], "source string, source_size long, target double")
    rows = sorted((r.slot, r.source, r["rank"]) for r in mixing.schedule(targets, 10).collect())
    assert [r[0] for r in rows] == list(range(1024))
    seen = collections.Counter()
    for k, (_, s, rank) in enumerate(rows, 1):
        assert rank == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - k * w / 8) <= 5 for x, w in (("a", 1), ("b", 2), ("c", 5)))


def test_quality_rules(docs, none):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.kept in (True, False) and (not r.kept or not r.base_failed)
    by = {r.doc_id: r for r in rows}
    assert (by[3].n_words, by[4].n_words, by[5].n_words, by[6].n_words, by[8].word_chars, by[12].word_chars) == (0, 0, 0, 60_000, 4, 8)
    assert by[6].kept and by[9].kept and by[3].base_failed and quality_rules.quality_rules(none).count() == 0


def test_repeated_words_against_loops(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) + rng.choice(["", "\n", "\nx\nx\n \n"]) for _ in range(200)]
    rows = quality_rules.word_signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=("doc_id",)).collect()
    for r in rows:
        w = texts[r.doc_id].split()
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in texts[r.doc_id].split("\n") if x.strip()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines)))


def test_decontamination(spark, docs, none, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontaminate.find_items(docs, items, clean=True)
    by = {(r.doc_id, r.n_words): r for r in found.collect()}
    assert found.count() == len(TEXTS) and by[9, 62].n_hit == 60 and by[9, 62]["items"] == ["1"] and by[9, 62].contaminated and by[9, 62].clean_text == "before after"
    assert by[2, 6].n_hit == 2 and by[11, 1].n_hit == 1 and by[11, 1]["items"] == [] and by[3, 0].n_hit == 0
    blocks = decontaminate.find_items(docs, items, block_words=5)
    columns = ["doc_id", "n_words", "n_hit", "contaminated", "spans", "items"]
    assert sorted(map(str, blocks.select(columns).collect())) == sorted(map(str, found.select(columns).collect()))
    kept = [decontaminate.clean_documents(docs, items, block_words=n).select("doc_id", "text").collect() for n in (5, 1000)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) and {r.doc_id for r in kept[0]} & {9, 10, 11} == set() and len(kept[0]) == len(TEXTS) - sum(r.contaminated for r in found.collect())
    assert decontaminate.find_items(none, items).count() == 0 and decontaminate.find_items(docs, items.where("false")).where("n_hit > 0").count() == 0


def test_passages_below_the_coverage_limit_are_cut(spark):
    """A long document stays, but the benchmark passages leave its text; however many blocks the benchmark has."""
    other = " ".join(f"second{i}" for i in range(20))
    items = spark.createDataFrame([(1, PASSAGE), (2, other), (3, "four five")], "item_id long, text string")
    head, mid, tail = (" ".join(f"{w}{i}" for i in range(900)) for w in ("head", "mid", "tail"))
    texts = {1: f"{head}. {PASSAGE.upper()}, {mid} {other} {tail}", 2: f"{head} four five {mid}", 3: f"{head} {other}", 4: f"{mid} {PASSAGE}", 5: None}
    docs = spark.createDataFrame([(i, t, "keep") for i, t in texts.items()], "doc_id long, text string, lang string")
    want = {1: f"{head}. , {mid} {tail}", 2: texts[2], 3: f"{head} ", 5: None}
    for block_words in (1000, 30):
        rows = decontaminate.clean_documents(docs, items, block_words=block_words).collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == 4 and all(r.lang == "keep" for r in rows)
        clean = {r.doc_id: r.clean_text for r in decontaminate.find_items(docs, items, clean=True, block_words=block_words).collect()}
        assert clean == want | {2: f"{head} {mid}", 4: f"{mid} "}


def test_automaton_against_loops():
    rng = random.Random(1)
    for _ in range(800):
        window = rng.choice([2, 3, 4, 5])
        items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(10))]) for k in range(rng.randrange(6))]
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(40))]
        hit, met = set(), set()
        for name, item in items:
            n = min(window, len(item))
            for part in [item[i:i + n] for i in range(len(item) - n + 1)] if n else []:
                for i in range(len(words) - n + 1):
                    if words[i:i + n] == part:
                        hit.update(range(i, i + n))
                        met.add(name)
        spans, names = decontaminate.Automaton(items, window).hits(words)
        assert {i for a, b in spans for i in range(a, b)} == hit and names == met


def test_language(docs, none):
    known = langid.dictionaries(docs)
    rows = langid.identify(docs, known).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (3, 4, 5, 7)) and set(known) <= {"en", "de", "fr"}
    assert by[6].lang_pred in known and langid.identify(none, known).count() == 0
    assert langid.dictionaries(none) == {} and langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_language_of_long_texts(spark):
    """All parts of a long text count, and the margin of a pure text does not fall with its length."""
    rng = random.Random(12)
    words = {g: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(1500)] for g in "AB"}
    prose = lambda g, size: " ".join(rng.choice(words[g]) for _ in range(size // 6))[:size]
    known = {g: langid.letters(prose(g, 100_000)) for g in "AB"}
    texts = [("B", prose("A", 300_000) + " " + prose("B", 700_000)), ("A", prose("A", 700_000) + " " + prose("B", 300_000)), ("B", prose("A", 600_000) + " " + prose("B", 3_000_000)),
             ("A", prose("A", 2_000)), ("A", prose("A", 400_000)), ("B", prose("B", 3_000_000)), ("A", prose("A", 2_000) * 200), ("A", "ab" * 400_000 + " " + prose("A", 100_000))]
    rows = langid.identify(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"), known).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.rejected) for r in rows[:7]] == [(g, False) for g, _ in texts[:7]], rows
    assert rows[7].lang_pred == "A"


def test_substrings(docs, none):
    spans = chunks.repeated_spans(docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in spans} == {(10, 9)}
    text = TEXTS[11][1].encode()
    assert all(text[r.start:r.stop].decode() in PASSAGE for r in spans) and sum(r.stop - r.start for r in spans) > 0.6 * len(PASSAGE)
    cut = chunks.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS) and cut.select(*CLASH).distinct().count() == 1
    rows = {r.doc_id: r.text for r in cut.collect()}
    assert rows[9] == TEXTS[10][1] and rows[10].startswith("other ") and rows[10].endswith(" words") and len(rows[10]) < 0.5 * len(TEXTS[11][1])
    assert chunks.repeated_spans(none).count() == 0


def test_chunks_are_whole_and_resist_insertions():
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice("abc defghé中\x00") for _ in range(rng.randrange(3000))).encode()
        ends = chunks.cut_points([b"xx", text, b""])[1]
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(parts) == text and all(chunks.SMALLEST <= len(p) <= chunks.LARGEST + 3 for p in parts[:-1]) and [p.decode() for p in parts] is not None
        moved = b"some bytes before " + text
        other = chunks.cut_points([moved])[0]
        if len(parts) > 12:
            assert len(set(parts) & {moved[a:b] for a, b in zip([0, *other], other)}) >= len(set(parts)) - 8


def test_near_duplicates(docs, none):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert got[1, 5, 1, True] == 3 and got[2, 5, 1, False] == 1 and got[3, 0, 3, True] == 1 and got[8, 1, 8, True] == 1 and got[None, 4, None, True] == 1 and got[None, 0, None, True] == 1
    assert got[9, 61, 9, True] == 1 and got[10, 61, 9, False] == 1
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_in_blocks_against_loops(spark, monkeypatch):
    """Chains and crowds, with blocks of a few documents, against all pairs."""
    from test_llm_queries import near_components

    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(160):
        own = list(base) if d % 4 else [f"v{d}_{i}" for i in range(30)]
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((d * 3 + 1, " ".join(own)))
    want = near_components(rows)
    for most in (1024, 20):
        monkeypatch.setattr(near_dedup, "BLOCK_DOCUMENTS", most)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_components_against_loops(spark):
    rng = random.Random(6)
    for edges in ([(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], []):
        least = {}
        for a, b in edges:
            if a != b:
                for x in (a, b):
                    least.setdefault(x, x)
                x, y = a, b
                while least[x] != x:
                    x = least[x]
                while least[y] != y:
                    y = least[y]
                least[max(x, y)] = min(x, y)
        want = {}
        for x in least:
            y = x
            while least[y] != y:
                y = least[y]
            want[x] = y
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_token_counts(spark, docs, none, tmp_path):
    import public_tokenizers

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    first = token_counts.count_tokens(docs, path, cache)
    rows = table(first, "doc_id", "n_bytes", "n_tokens")
    assert len(rows) == len(TEXTS) and (3, 0, 0) in rows and (4, 0, 0) in rows and first.where("over_limit").count() == 1
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, _, _ in TEXTS})
    again = token_counts.count_tokens(docs, path, cache)
    assert table(again, "doc_id", "n_bytes", "n_tokens") == rows and spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(none, path, cache).count() == 0


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers(spark, docs, none, folder, module, column):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    score = module.detect if module is toxicity else module.classify
    for model in (module.train(docs, labels, column), module.train(docs, labels.where("false"), column), module.fit(["good text", "bad text"] * 5, [1, 0] * 5)):
        rows = score(docs, model).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(none, model).count() == 0
    assert module.train(none, labels, column) is not None


def test_toxic_sentences_are_located():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    texts, labels = [], []
    for k in range(300):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        if k % 3 == 0:
            sentences[rng.randrange(6)] += " vile"
        texts.append(". ".join(sentences) + ".")
        labels.append(int(k % 3 == 0))
    p, text, start = (model := toxicity.fit(texts, labels)).sentences(["All good w1 w2. This is vile w3! fine w4"])
    assert [x > 0.5 for x in p] == [False, True, False] and start.tolist() == [0, 16, 33] and text.tolist() == [0, 0, 0]
    assert model.documents(p, text, 1)[0] > 0.7


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    if k < 4:
        assert out.columns == docs.columns
        assert out.select("digest", "copies", *CLASH).distinct().collect() == [("x",) * (2 + len(CLASH))]
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {i for i, *_ in TEXTS} and 6 in ids
        if name == "near-duplicates":
            assert 2 not in ids and 10 not in ids and out.where("doc_id IS NULL").count() == 2 and out.where("doc_id = 1").count() == 1
        if name == "decontamination":
            assert 9 not in ids and 3 in ids and None in ids
    else:
        assert out.count() == len(TEXTS)
    assert stage(spark, none, folder).count() == 0


def test_a_cut_makes_no_new_window(spark):
    """The words on both sides of a cut passage are an item themselves; so are those around that one."""
    a, b, c = ([f"{x}{i}" for i in range(13)] for x in "abc")
    fill = [f"fill{i}" for i in range(700)]
    text = " ".join(fill + c[:3] + a[:6] + b + a[6:] + c[3:] + ["end"])
    for block_words in (1000, 20):
        items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "item_id long, text string")
        one = spark.createDataFrame([(1, text), (2, "clean"), (2, None)], "doc_id long, text string")
        rows = decontaminate.clean_documents(one, items, block_words=block_words).collect()
        assert sorted((r.doc_id, r.text or "") for r in rows) == [(1, " ".join(fill + ["end"])), (2, ""), (2, "clean")]


def test_many_equal_short_items():
    words = decontaminate.normal_words("so " * 3000)
    automaton = decontaminate.Automaton([(str(k), [b"so"]) for k in range(5000)] + [("two", [b"so", b"so"])])
    spans, items = automaton.hits(words)
    assert spans == [[0, 3000]] and len(items) == 5001
    assert decontaminate.Automaton.of(vars(automaton)).hits(words) == (spans, items)


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
for name, fn in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert fn(spark, sys.argv[3]).count() >= 0, name
        print(name, flush=True)
"""


def test_workers_need_no_copy_of_the_package(folder, tmp_path):
    """All llm queries from an empty folder, so that no worker finds the package by its path."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != repo)
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, repo, str(tmp_path / "shared"), "/root/testdata/sf0.001"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert "pipeline" in done.stdout


def test_spam_and_few_rows_do_not_move_the_limits(spark):
    """A fifth of a hot group and half of a group of four are full of symbols; so is the only row of a group."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for k in range(600):
        lang, source = ("en", "hot") if k < 500 else ("en", "few") if k < 504 else ("de", "one") if k == 504 else ("de", "other")
        spam = k % 5 == 0 if k < 500 else k % 2 == 0 if k < 504 else k == 504
        own = [rng.choice(words) for _ in range(80)]
        rows.append((k, " ".join(w + " ##" if spam and i % 2 else w for i, w in enumerate(own)), lang, source, spam))
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spam boolean")).collect()}
    assert all(kept[k] != spam for k, *_, spam in rows)


def test_slots_follow_the_schedule(spark):
    """Sorted by slot, every stretch of the copies holds the sources near their shares; each slot of a source takes equally many of its words."""
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 30)] * 400 + [("b", 10)] * 1200 + [("c", 50)] * 300 + [("tiny", 1)] * 2)]
    table = spark.createDataFrame(rows, "doc_id long, source string, n int").select("doc_id", "source", F.expr("repeat('w ', n)").alias("text"))
    mixed = mixing.mixed_documents(table, bits=12, slot="slot")
    assert mixed.columns == ["doc_id", "source", "text", "slot"]
    size = {i: n for i, _, n in rows}
    copies = sorted((r.slot, r.source, size[r.doc_id]) for r in mixed.collect())
    total = collections.Counter()
    for _, s, n in copies:
        total[s] += n
    assert total["tiny"] == 6 and all(slot is not None for slot, *_ in copies)
    for at in (len(copies) // 7, len(copies) // 3, len(copies) // 2):
        part = collections.Counter()
        for _, s, n in copies[:at]:
            part[s] += n
        assert all(abs(part[s] / sum(part.values()) - total[s] / sum(total.values())) < 0.03 for s in "abc")
    for r in mixing.mix(table, bits=12).collect():
        assert (r.first_slot is None) == (r.taken == 0) and (r.taken == 0 or r.first_slot <= r.last_slot)
