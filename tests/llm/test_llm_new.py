"""Fingerprints, conversation trie and Merkle manifest: brute force, degenerate input, hot groups."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from panelloom.llm import merkle, prefix_trie, syncmers
from panelloom.llm.oracles import ORACLES
from panelloom.llm.queries import QUERIES
from test_llm_edges import LONG, TEXTS, docs, none  # noqa: F401  (fixtures)

SF = "/root/testdata/sf0.001"


# ---- closed syncmers

def serial_syncmers(text, k=syncmers.K, s=syncmers.S):
    """Closed syncmers by the definition, each k-mer on its own: those whose smallest s-mer stands at an edge."""
    def inner(part):
        h = [int(x) for x in syncmers.mixed(np.array([ord(c) for c in part], np.uint64) + np.uint64(1))]
        size, turn = 1, 0
        while size < len(part):
            odd = int(syncmers.TWO_TABLES[0][turn])
            h = [(h[i] + h[i + size] * odd) % 2**64 for i in range(len(h) - size)]
            size, turn = size * 2, turn + 1
        return h[0]

    out = []
    for i in range(len(text) - k + 1):
        hashes = [inner(text[j:j + s]) for j in range(i, i + k - s + 1)]
        if min(hashes) in (hashes[0], hashes[-1]):
            out.append((i, inner(text[i:i + k]) >> 40))
    return out


def random_text(rng, n):
    return "".join(rng.choice("abc defghé中😀\n") for _ in range(n))


def test_anchors_against_the_definition(monkeypatch):
    rng = random.Random(1)
    texts = [random_text(rng, n) for n in (0, 1, 15, 16, 17, 40, 300, 0, 90)] + ["a" * 50, "ab" * 40]
    for piece in (syncmers.PIECE, 37):
        monkeypatch.setattr(syncmers, "PIECE", piece)
        for text, (place, code) in zip(texts, syncmers.anchors(texts)):
            want = serial_syncmers(text)
            if text and not want:
                assert place.tolist() == [0] and len(code) == 1
            else:
                assert list(zip(place.tolist(), code.tolist())) == want
            assert (np.diff(place) <= syncmers.K - syncmers.S).all()
            again = syncmers.read(syncmers.written((place, code)))
            assert (again[0] == place).all() and (again[1] == code).all()


def test_likeness_is_the_longest_common_chain():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([(i, rng.randrange(200)) for i in range(rng.randrange(1, 60))] for _ in "ab")
        nth_a, nth_b = {}, {}
        for nth, own in ((nth_a, a), (nth_b, b)):
            seen = collections.Counter()
            for i, c in own:
                nth[i] = (c, seen[c])
                seen[c] += 1
        n, m = len(a), len(b)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (nth_a[i] == nth_b[j]))
        got = syncmers.likeness(*[(np.array([i for i, _ in x]), np.array([c for _, c in x])) for x in (a, b)])
        assert got == pytest.approx(2 * best[n][m] / (n + m))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert syncmers.likeness(none, none) == 1 and syncmers.likeness(none, (np.zeros(1), np.zeros(1, np.int64))) == 0


def brute_fingerprints(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half]
        own, other, after = syncmers.anchors([t]) + syncmers.anchors([changed]) + syncmers.anchors([following])
        out.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), syncmers.written(own), syncmers.written(other), syncmers.likeness(own, other), syncmers.likeness(own, after)))
    return sorted(out)


def test_fingerprints_of_the_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = QUERIES["op11_document_fingerprints"](spark, SF).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_fingerprints(rows)
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprints_of_degenerate_rows(docs, none, ranges):  # noqa: F811
    got = syncmers.fingerprints(docs, ranges).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_fingerprints([(i, t) for i, t, _, _ in TEXTS])
    assert syncmers.fingerprints(none, ranges).count() == 0
    one = syncmers.fingerprints(docs.where("doc_id = 6"), ranges).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].n_chars == len(LONG)


def test_fingerprints_of_many_null_ids(spark):
    """Null ids fill many ranges."""
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text of row "), F.col("id").cast("string")).alias("text"))
    want = brute_fingerprints([(r.doc_id, r.text) for r in rows.collect()])
    assert sorted((str(r[0]), *r[1:]) for r in syncmers.fingerprints(rows, 10).collect()) == want
    assert syncmers.neighbours(rows, 10).where("NOT guest AND doc_id IS NULL").groupBy("part").count().count() == 10


# ---- prefix trie

def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    for turns in own.values():
        turns.sort()
    nodes, built = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        built[c] = [t[3:] for t in own.get(base, [])[:h] + own[c][h:]]
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) > len(p) for q in below)]
        ends = sorted(c for c in members if len(built[c]) == len(path))
        words = lambda p: len([w for w in __import__("re").split("[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves),
                    sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, low string, shard string, own string, t string"


def trie(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONVERSATIONS).repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(table)).collect()), key=repr)


@pytest.mark.parametrize("piece", [500, 2])
def test_trie_against_loops(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "ENDS_A_ROW", piece)
    rng = random.Random(piece)
    rows = []
    for c in range(-30, 130):
        kind = rng.randrange(4)
        for t in range(rng.choice((0, 1, 2, 3, 5, 9))):
            said = "same words for all" if kind == 0 else rng.choice(("a", "b c", "", "d e f"))
            rows.append((c, rng.choice((t, t, None, 1)), rng.choice(("user", None, "")) if kind == 3 else "user", rng.choice((said, said, None))))
    rows += [(None, 1, "user", "no conversation"), (5, 0, "user", " x "), (5, 0, "user", " x ")]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "a", "b")]) == []
    for rows in ([(0, 0, None, None)], [(7, None, "a", "b c"), (7, None, "a", "b c")], [(c, t, "u", f"t{t}") for c in range(60) for t in range(c % 5)], [(3, t, "u", "again") for t in range(150)]):
        assert trie(spark, rows) == brute_trie(rows)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 30_000):
        low, high = rng.integers(-2**63, 2**63, n), rng.integers(-2**63, 2**63, n)
        low[: n // 2] = 5  # halves may repeat
        table = prefix_trie.SlotTable(low, high)
        assert sorted(table.slots(low, high).tolist()) == list(range(n))
        assert (table.slots(low + 1, high) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


# ---- Merkle manifest

def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves, fanout):
    """Root and, for each leaf, the siblings left and right of its way up."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, n in enumerate(at):
            first = n - n % fanout
            ways[k].append(("".join(level[first:n]), "".join(level[n + 1:first + fanout])))
            at[k] = n // fanout
        level = [digest("".join(level[k:k + fanout])) for k in range(0, len(level), fanout)]
    return level[0], ways


def brute_manifest(rows, fanout=16):
    fields = lambda r, t: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], len(r[1]) if r[1] else None, t))
    lower = str.maketrans(merkle._UPPER, merkle._LOWER)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, digest(fields(r, r[1])), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = brute_tree([x[2] for x in groups[name]], fanout)
    root, tops = brute_tree([trees[n][0] for n in names], fanout)
    out = []
    for name, top in zip(names, tops):
        for (known, _, leaf, r), way in zip(groups[name], trees[name][1]):
            at = digest(fields(r, r[1] and r[1].translate(lower))) if known and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
            for left, right in way + top:
                at = digest(left + at + right)
            out.append((str(r[0]), leaf, trees[name][0], root, digest("".join(x + y for x, y in way + top)), at, at == root))
    return sorted(out)


@pytest.mark.parametrize("fanout, levels", [(16, 2), (2, 1), (3, 1)])
def test_manifest_of_degenerate_rows(docs, none, fanout, levels):  # noqa: F811
    got = merkle.manifest(docs, fanout=fanout, levels=levels).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_manifest(TEXTS, fanout)
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("fanout, levels, n", [(2, 1, 137), (3, 1, 85), (2, 2, 67)])
def test_butterfly_rounds_against_loops(spark, fanout, levels, n):
    """A source of many blocks, the last groups of which are ragged, beside small sources."""
    rows = [(i, f"Text {i}", None if i % 7 else "en", "hot" if i < n else f"s{i}") for i in range(n + 12)]
    table = spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(table, fanout=fanout, levels=levels).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_manifest(rows, fanout)


def test_every_block_hears_every_sibling_once(spark):
    roots = [(0, b, 23, digest(str(b))) for b in range(23)] + [(1, 0, 1, "alone")]
    got = {(r.tree, r.block): r for r in merkle.butterfly(spark.createDataFrame(roots, "tree long, block long, blocks long, node string"), 3).collect()}
    root, ways = brute_tree([digest(str(b)) for b in range(23)], 3)
    assert len(got) == 24 and got[1, 0].root == "alone" and got[1, 0].upper == []
    assert all(got[0, b].root == root and [tuple(x) for x in got[0, b].upper] == ways[b] for b in range(23))


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_merkle_manifest"])
def test_against_sql(spark, name):
    _, rows, problem = oracle.check(name, spark, oracle.connect(SF), SF, QUERIES[name], ORACLES[name])
    assert problem is None and rows > 50
