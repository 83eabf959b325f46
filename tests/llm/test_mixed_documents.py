"""Whole documents of the mix: training order, rows with like or null ids, sources of long documents."""

import collections
import random

import pyarrow.dataset as ds
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm import mixing


def texts(spark, rows):
    """Documents (doc_id, source, n, mark) of n words, which name the mark."""
    return spark.createDataFrame(rows, "doc_id long, source string, n int, mark string").select("doc_id", "source", F.expr("trim(repeat(concat(mark, ' '), n))").alias("text"))


def test_rows_are_in_training_order(spark):
    rows = [(i, s, n, "w") for i, (s, n) in enumerate([("a", 30)] * 400 + [("b", 10)] * 1200 + [(None, 50)] * 300 + [("tiny", 1)] * 2)]
    size = {i: n for i, _, n, _ in rows}
    docs = texts(spark, rows)
    with_slot = [(r.slot, r.doc_id) for r in mixing.mixed_documents(docs, bits=12, slot="slot").collect()]
    assert [s for s, _ in with_slot] == sorted(s for s, _ in with_slot) and len({s for s, _ in with_slot}) > 2000
    mixed = mixing.mixed_documents(docs.repartition(7), bits=12).collect()
    assert [r.doc_id for r in mixed] == [d for _, d in with_slot]
    # all copies of a pass stand before those of the next one, in the same order
    seen, passes = collections.Counter(), collections.defaultdict(list)
    for r in mixed:
        seen[r.doc_id] += 1
        passes[r.source, seen[r.doc_id]].append(r.doc_id)
    for (s, k), own in passes.items():
        assert own == passes[s, 1][:len(own)]
        assert k == 1 or len(passes[s, k - 1]) == sum(s == x for _, x, _, _ in rows)
    total = collections.Counter()
    for r in mixed:
        total[r.source] += size[r.doc_id]
    for at in range(100, len(mixed), 97):
        part = collections.Counter()
        for r in mixed[:at]:
            part[r.source] += size[r.doc_id]
        assert all(abs(part[s] / sum(part.values()) - total[s] / sum(total.values())) < 0.05 for s in ("a", "b", None))


def test_the_stage_writes_its_files_in_training_order(spark, tmp_path):
    rows = [(i, s, n, f"{s}{i}") for i, (s, n) in enumerate([("a", 30)] * 900 + [("b", 20)] * 900 + [("c", 10)] * 900)]
    docs = texts(spark, rows)
    corpus_pipeline.mixture(spark, docs, None).write.parquet(f"{tmp_path}/mixed")
    found = ds.dataset(sorted(str(p) for p in (tmp_path / "mixed").glob("*.parquet"))).to_table().to_pylist()
    assert list(found[0]) == docs.columns
    assert [r["doc_id"] for r in found] == [r.doc_id for r in mixing.mixed_documents(docs, slot="slot").orderBy("slot", "source").collect()]
    words, total = lambda own: collections.Counter({s: sum(len(r["text"].split()) for r in own if r["source"] == s) for s in "abc"}), len(found)
    every = words(found)
    for k in range(8):
        part = words(found[k * total // 8:(k + 1) * total // 8])
        assert all(abs(part[s] / sum(part.values()) - every[s] / sum(every.values())) < 0.05 for s in "abc")


def test_rows_without_ids_or_with_like_ids_count_each(spark):
    """In every source all rows look alike by id, source and number of words: none with ids, one id for all, equal rows."""
    rows = [(None, "a", 5, f"a{i}") for i in range(200)] + [(7, "b", 5, f"b{i}") for i in range(200)] + [(8, "c", 5, "c") for _ in range(200)] + [(i, "d", 5, f"d{i}") for i in range(100, 300)]
    random.Random(3).shuffle(rows)
    docs = texts(spark, rows)
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    mixed = mixing.mixed_documents(docs, slot="slot").collect()
    words, copies = collections.Counter(), collections.Counter()
    for r in mixed:
        words[r.source] += len(r.text.split())
        copies[r.source, r.text] += 1
    assert all(abs(words[s] - t) < 5 for s, t in target.items()), (words, target)
    for s in "abd":  # no text is taken twice more than another one
        own = [copies[s, " ".join([f"{s}{i}"] * 5)] for i in (range(100, 300) if s == "d" else range(200))]
        assert max(own) - min(own) <= 1
    assert [tuple(r) for r in mixing.mixed_documents(docs.repartition(6), slot="slot").collect()] == [tuple(r) for r in mixed]


def test_no_source_is_lost_to_rounding(spark):
    """The mix takes less than half of the only document of a source."""
    docs = texts(spark, [(1, "a", 1000, "a"), *[(k, s, 10, s) for k, s in enumerate(["b", "c"] * 60, 2)]])
    taken = {r.source: r.taken for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert 0 < taken["a"] < 500
    mixed = collections.Counter(r.source for r in mixing.mixed_documents(docs).collect())
    assert mixed["a"] == 1 and all(abs(10 * mixed[s] - taken[s]) < 10 for s in "bc")


def test_columns_of_any_kind_are_carried(spark):
    rows = [(1, "a", "one two", {"k": 1}, [1, None]), (1, "a", "one two", {"k": 2}, None), (None, "a", "three", None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, row map<string,int>, tie array<int>").withColumn("place", F.lit(None))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
