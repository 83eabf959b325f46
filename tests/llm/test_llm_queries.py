"""The registered llm queries against SQL twins, the library, brute force or held-out labels, over whole small tables."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import oracle
import pytest

import corpus_pipeline
from panelloom.llm import chunks, decontaminate, near_dedup, token_counts
from panelloom.llm.oracles import ORACLES
from panelloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith(("op11", "op12", "op13"))))
def test_against_sql(spark, name):
    _, rows, problem = oracle.check(name, spark, oracle.connect(SF), SF, QUERIES[name], ORACLES[name])
    assert problem is None and rows == 200


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def rates(rows, labels, column):
    """Recall and specificity over held-out labelled rows."""
    known = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{labels}'").fetchall())
    own = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    good = [p == 1 for p, y in own if y == 1]
    bad = [p == 0 for p, y in own if y == 0]
    return sum(good) / len(good), sum(bad) / len(bad)


def test_toxicity_on_held_out_labels(spark):
    rows = QUERIES["op1_toxicity"](spark, LARGER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    recall, specificity = rates(rows, f"{LARGER}/labels.parquet", "toxic")
    assert recall > 0.7 and specificity > 0.97


def test_quality_on_held_out_labels(spark):
    rows = QUERIES["op7_quality_classifier"](spark, LARGER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    recall, specificity = rates(rows, f"{LARGER}/labels.parquet", "quality")
    assert recall > 0.97 and specificity > 0.7


def test_language_on_held_out_documents(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet'").fetchall())
    rows = QUERIES["op5_language_id"](spark, LARGER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    own = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert sum(own) > 0.98 * len(own)


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    rows = QUERIES["op10_token_counts"](spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        n = len(encoder.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def serial_chunks(text):
    """Chunks by the recurrence itself, byte by byte."""
    out, last, i, h, seen = [], 0, 0, 0, []
    while i < len(text):
        h = ((h << 1) + int(chunks._GEAR[text[i]])) & 0xFFFFFFFF
        i += 1
        seen.append(h)
        whole = i == len(text) or text[i] & 0xC0 != 0x80
        if i == len(text) or (i - last >= chunks.SMALLEST and whole and h >> (32 - chunks.CUT_BITS) == 0 and i - last <= chunks.LARGEST):
            out.append((last, i))
            last = i
        elif i - last == chunks.LARGEST and i < len(text):
            ends = [e for e in range(last + chunks.SMALLEST, i + 1) if text[e] & 0xC0 != 0x80]
            cut = min(ends, key=lambda e: (seen[e - 1], e))
            out.append((last, cut))
            last = i = cut
            h = seen[cut - 1]
            del seen[cut:]
    return out


def step_code(part):
    """The code of a step from the array function on these bytes alone."""
    return int(chunks.step_codes(np.frombuffer(part, np.uint8))[0])


def reach(mine, other, at, place, side):
    """Bytes to one side of two places at which the codes agree step by step, ended at a whole character."""
    far = 0
    for k in range(1, chunks.STEPS + 1):
        if side < 0:
            a, b = (t[p - chunks.STEP * k:p - chunks.STEP * (k - 1)] if p >= chunks.STEP * k else b"" for t, p in ((mine, at), (other, place)))
        else:
            a, b = (t[p + chunks.STEP * (k - 1):p + chunks.STEP * k] for t, p in ((mine, at), (other, place)))
        if len(a) < chunks.STEP or len(b) < chunks.STEP or step_code(a) != step_code(b):
            break
        far = chunks.STEP * k
    while far and at + side * far < len(mine) and mine[at + side * far] & 0xC0 == 0x80:
        far -= 1
    return far


def brute_spans(docs):
    owners = {}
    for d, t in sorted(docs):
        for a, b in serial_chunks(t):
            owners.setdefault(t[a:b], (d, t, a, b))
    out = set()
    for d, t in docs:
        runs = []
        for a, b in serial_chunks(t):
            first, other, c, e = owners[t[a:b]]
            if first != d:
                left, right = a - reach(t, other, a, c, -1), b + reach(t, other, b, e, 1)
                if runs and runs[-1][4] == a:
                    runs[-1] = (runs[-1][0], runs[-1][1], min(runs[-1][2], first), right, b)
                else:
                    runs.append((d, left, first, right, b))
        wide = []
        for _, left, first, right, _ in sorted(runs, key=lambda r: r[1]):
            if wide and wide[-1][1] >= left:
                wide[-1] = (wide[-1][0], max(wide[-1][1], right), min(wide[-1][2], first))
            else:
                wide.append((left, right, first))
        out.update((d, first, left, right) for left, right, first in wide if right - left >= chunks.LEAST_SPAN)
    return out


def test_planted_passages_are_found_and_covered(spark):
    """Passages of 51 words of real texts, each planted into two documents, and the clean documents around them."""
    import random

    rng = random.Random(7)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{LARGER}/documents.parquet' WHERE length(text) BETWEEN 900 AND 6000 AND lang = 'en' ORDER BY doc_id").fetchall()]
    texts = [t for t in texts if len(set(t.split())) > 60][:400]
    rows, planted = [], {}
    for k in range(0, 200, 2):
        source = texts[200 + k // 2].split()
        at = rng.randrange(len(source) - 51)
        passage = " ".join(source[at:at + 51])
        for d in (k, k + 1):
            words = texts[d].split()
            cut = rng.randrange(1, len(words))
            head = " ".join(words[:cut]) + " "
            rows.append((d, head + passage + " " + " ".join(words[cut:])))
            planted[d] = (len(head.encode()), len((head + passage).encode()))
    found = {}
    for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.stop))
    whole = [planted[d] for d in range(1, 200, 2)]
    covered = [sum(max(0, min(b, y) - max(a, x)) for x, y in found.get(d, [])) for d, (a, b) in zip(range(1, 200, 2), whole)]
    assert sum(c > 0 for c in covered) >= 99
    assert sum(covered) > 0.9 * sum(b - a for a, b in whole)


def test_repeated_passages_against_brute_force(spark):
    docs = [(d, t.encode()) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE text <> ''").fetchall()]
    got = {tuple(r) for r in QUERIES["op6_substring_dedup"](spark, SF).collect()}
    assert got == brute_spans(docs) and got


def near_components(docs):
    sets = {}
    for d, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        sets[d] = set(zip(w, w[1:])) if len(w) > 1 else set(w)
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: root(d) for d in sets}


def test_pipeline_against_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs, folder = spark.read.parquet(f"{SF}/documents.parquet"), {}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder[name] = at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns
    good = [(r.doc_id, r.text) for r in folder["quality classifier"].collect()]
    first = near_components(good)
    assert sorted(r.doc_id for r in folder["near-duplicates"].collect()) == sorted(d for d in first if first[d] == d)
    items = [decontaminate.normal_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    clean = {r.doc_id: r.text for r in folder["near-duplicates"].collect() if not brute_contaminated(decontaminate.normal_words(r.text), items)}
    assert sorted(clean) == sorted(r.doc_id for r in folder["decontamination"].collect())
    mixed = collections.Counter(r.doc_id for r in folder["mixing"].collect())
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    total = sum(len(clean[d].split()) * n for d, n in mixed.items())
    assert abs(total - sum(len(t.split()) for t in clean.values())) < 0.1 * total
    assert collections.Counter(r.doc_id for r in rows) == mixed
    by_shard = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(clean[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(clean[r.doc_id].encode())
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def brute_contaminated(words, items, window=13):
    hit = set()
    for item in items:
        n = min(window, len(item))
        parts = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in parts:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_signatures_find_links_near_the_limit():
    """Pairs just over the similarity limit share a table nearly always."""
    import random

    rng, met = random.Random(5), 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(201)]
        other = words[:181] + [f"w{rng.randrange(10**6)}" for _ in range(20)]  # 180 of 220 shingles in common
        table = near_dedup.collections(near_dedup.minhashes(near_dedup.shingle_sets([" ".join(words), " ".join(other)])))
        met += bool((table[0, :near_dedup.SIDE] == table[1, :near_dedup.SIDE]).any() and (table[0, near_dedup.SIDE:] == table[1, near_dedup.SIDE:]).any())
    assert met >= 299


def test_counter_by_word_is_the_library():
    import random

    import public_tokenizers

    rng = random.Random(3)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        counter = token_counts.Counter(f.read())
    assert counter.by_word
    parts = [" ", "  ", "a", "b", "\n", "\t", "▁", "é", "<s>", "</s>", "中", "　", "ﬁ", ".", "1", "\x00", "😀", "<unk>", "x" * 90]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    want = [len(x) for x in counter.encoder.encode(texts, num_threads=1)]
    assert counter.count(texts) == want and counter.count(texts) == want
