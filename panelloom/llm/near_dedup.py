"""MinHash near-duplicates with tensored banding: table keys are pairs from two small hash collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import components, free_names
from panelloom.llm.textnum import mixed, word_hashes

#: Minimum similarity of linked documents, in per cent.
SIMILARITY = 80
#: Entries of each of the two collections, and minhashes in an entry. The tables are all pairs of entries: SIDE * SIDE of them from 2 * SIDE * DEPTH minhashes.
#: Two sets of similarity s share a table with probability (1 - (1 - s ** DEPTH) ** SIDE) ** 2, which is 0.99993 at 0.8 and 0.999995 at 0.85.
SIDE, DEPTH = 10, 2
#: Documents and bytes of text that are compared inside one task at a time (two blocks of them); larger groups are cut into blocks.
BLOCK_DOCUMENTS, BLOCK_BYTES = 1024, 16_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(9).integers(0, 2**63, 2 * SIDE * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(10).integers(0, 2**63, 2 * SIDE * DEPTH, dtype=np.uint64)
_GROUP_BYTES = 200_000


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct two-word shingles of each text as sorted 64-bit hashes; one word is a shingle of its own; no words, an empty set."""
    out: list[np.ndarray] = []
    at = 0
    raw = [t.encode("utf-8", "replace").translate(_LOWER) if t else b"" for t in texts]
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= _GROUP_BYTES):
            size += len(raw[stop]) + 1
            stop += 1
        own = raw[at:stop]
        points = np.frombuffer(b"\n" + b"\n".join(own) + b"\n", dtype=np.uint8)
        starts, words = word_hashes(points, (points == 32) | ((points >= 9) & (points <= 13)))
        firsts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in own]))
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[1:]))
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a > 1:
                s = np.sort(pairs[a:b - 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            else:
                out.append(mixed(words[a:b] ^ np.uint64(0x5851F42D4C957F2D)))
        at = stop
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes of the sets, none of them empty: a row a set, 2 * SIDE * DEPTH columns."""
    every = np.concatenate(sets)
    firsts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(mixed(every * m + a), firsts) for m, a in zip(_ODD, _ADD)], axis=1)


def collections(mins: np.ndarray) -> np.ndarray:
    """Entries of the two collections: SIDE hashes for the first, then SIDE for the second, each of DEPTH minhashes."""
    h = np.zeros((len(mins), 2 * SIDE), np.uint64)
    for k in range(DEPTH):
        h = mixed(h + mins[:, k::DEPTH])
    return mixed(h + np.arange(2 * SIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_shingles, digest of the set (null if empty), first and second collection."""

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib

        for texts in batches:
            rows = []
            for at in range(0, len(texts), 64):
                sets = shingle_sets(list(texts.iloc[at:at + 64]))
                full = [s for s in sets if len(s)]
                entries = iter(collections(minhashes(full)).view(np.int64)) if full else iter(())
                for s in sets:
                    row = next(entries) if len(s) else None
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, None if row is None else row[:SIDE], None if row is None else row[SIDE:]))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "first", "second"])

    udf = F.pandas_udf(sign, "n_shingles long, digest binary, first array<long>, second array<long>")
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), udf("text").alias("s")).select("doc_id", "n_bytes", "s.*")


def links_of(nodes: list, blocks: np.ndarray, texts: list[str], entry: int, similarity: int = SIMILARITY) -> list[tuple]:
    """Verified links among the texts of a cell, as few as connect the same nodes: (smaller node, larger node).

    Pairs are candidates if they share a table; with an ``entry`` only if it is the first entry of the first collection that they share, so that each pair is
    looked at in one cell; if the cell holds two blocks, only pairs across. Likely pairs come first; pairs already connected need no look. A link is
    confirmed on the full sets.
    """
    sets = shingle_sets(texts)
    mins = minhashes(sets)
    table = collections(mins)
    sizes = np.array([len(s) for s in sets])
    lead, second = np.full((len(sets), len(sets)), SIDE, np.int8), np.zeros((len(sets), len(sets)), bool)
    for k in reversed(range(SIDE)):
        lead[table[:, None, k] == table[None, :, k]] = k
        second |= table[:, None, SIDE + k] == table[None, :, SIDE + k]
    wanted = np.triu(second & (lead == entry if entry >= 0 else lead < SIDE), 1)
    if len(np.unique(blocks)) > 1:
        wanted &= blocks[:, None] != blocks[None, :]
    left, right = np.nonzero(wanted)
    names = np.array(nodes)
    near = (100 * np.minimum(sizes[left], sizes[right]) >= similarity * np.maximum(sizes[left], sizes[right])) & (names[left] != names[right])
    left, right = left[near], right[near]
    agree = np.zeros(len(left), np.int64)
    for k in range(mins.shape[1]):
        agree += mins[left, k] == mins[right, k]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for n in np.argsort(-agree, kind="stable").tolist():
        a, b = left[n], right[n]
        ra, rb = root(a), root(b)
        if ra == rb:
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            parent[rb] = ra
            out.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
    return out


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``similarity`` per cent of their sets of two-word shingles.

    1. Signatures: minhashes of every whole text in one pass, and a digest of the set. Texts with equal sets are one node, the smallest id among them.
    2. Tables: nodes that share a table key are tied to the smallest of them, which takes rows in proportion to the nodes, never pairs; the tied nodes form
       clusters inside which all candidate pairs lie.
    3. Cells: the texts of a small cluster meet in one task. A large cluster is cut into blocks, each pair of blocks a task of bounded size: see ``_cells``. No
       pair is dropped: see ``links_of``.
    4. Links that tie each cell together are joined into components.

    Returns doc_id, n_shingles, component_id (the smallest id reached), kept (doc_id = component_id). Null and empty texts have no shingle and are linked with
    nothing; so is a row with a null id: its component is null, and it is kept. Rows with the same id are one document with the links of all its texts. An
    empty table gives no row. Other columns are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(signatures(own))
    linkable = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = linkable.groupBy("digest").agg(F.min("doc_id").alias("node"))
    member = cut_lineage(linkable.join(least, "digest"))
    nodes = member.where("doc_id = node").dropDuplicates(["node", "digest"]).select("node", "n_bytes", "first", "second")
    nodes = cut_lineage(nodes)
    keys = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    tables = nodes.select("node", F.explode(keys).alias("key"))
    shared = tables.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    ties = tables.join(shared.hint("shuffle_hash"), "key").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    clusters = cut_lineage(components(ties).withColumnRenamed("component", "cluster").join(nodes, "node").select("node", "cluster", "n_bytes", "first"))
    cells = cut_lineage(_cells(clusters))
    kind = own.schema["doc_id"].dataType.simpleString()

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        rows = cell.drop_duplicates(["doc_id", "text"])
        found = links_of(rows["doc_id"].tolist(), rows["block"].to_numpy(), rows["text"].tolist(), int(rows["entry"].iloc[0]), similarity)
        return pd.DataFrame(found, columns=["a", "b"])

    # the texts are dealt by id at every size: a broadcast of small cells would only hide what large ones cost
    placed = own.where(F.col("text").isNotNull()).join(cells.hint("shuffle_merge"), own["doc_id"] == cells["node"]).select("doc_id", "text", "cell", "entry", "block", "one", "two")
    links = placed.groupBy("cell", "entry", "one", "two").applyInPandas(verify, f"a {kind}, b {kind}")
    sets = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("doc_id", "a")  # ids with several texts
    links = links.unionByName(member.join(sets, "doc_id").select("a", F.col("node").alias("b")))
    reached = components(links)
    of_set = member.select("digest", "node").distinct().join(reached, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    by_id = member.select("doc_id", "digest").distinct().join(of_set, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    joined = signed.alias("s").join(by_id.alias("c"), F.col("s.doc_id") == F.col("c.doc_id"), "left").select("s.doc_id", "s.n_shingles", F.coalesce("c.component_id", "s.doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _cells(clusters: DataFrame) -> DataFrame:
    """Where the texts of clusters meet: node, cell, entry (-1: any), block (of the node), one and two (the blocks that meet).

    A cluster of one block is one cell. A larger one is cut into blocks, all pairs of which meet, either as a whole or inside each entry of the first
    collection, whichever moves fewer texts: a crowd of copies shares all entries, a loose cluster hardly any. Both ways look at every candidate pair.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCUMENTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    totals = [F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")]
    sizes = clusters.groupBy("cluster").agg(*totals).withColumn("blocks", blocks)
    large = clusters.join(sizes.where("blocks > 1").select("cluster"), "cluster", "left_semi").select("cluster", "node", "n_bytes", F.posexplode("first").alias("entry", "hash"))
    entries = large.groupBy("cluster", "entry", "hash").agg(*totals).where("n > 1").withColumn("blocks", blocks)
    by_entry = entries.groupBy("cluster").agg(F.sum(F.col("n") * F.col("blocks")).alias("moved"))
    plan = sizes.join(by_entry, "cluster", "left").withColumn("loose", F.coalesce(F.col("moved"), F.lit(0)) < F.col("n") * F.col("blocks")).withColumn("loose", F.col("loose") & (F.col("blocks") > 1))
    name = F.col("cluster").cast("string")
    whole = clusters.join(plan.where("NOT loose").select("cluster", "blocks"), "cluster").select("node", name.alias("cell"), F.lit(-1).alias("entry"), "blocks")
    split = (large.join(plan.where("loose").select("cluster"), "cluster", "left_semi").join(entries.select("cluster", "entry", "hash", "blocks"), ["cluster", "entry", "hash"])
             .select("node", F.concat_ws(" ", name, "hash").alias("cell"), "entry", "blocks"))
    dealt = whole.unionByName(split).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select("node", "cell", "entry", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def first_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept, the one with the smallest id, all columns as they are.

    Of rows with the same id one stays (any one, if they differ); rows with a null id all stay, so do null and empty texts, which are like nothing. An empty
    table gives no row. Further columns may have any name.
    """
    (name,) = free_names(docs, "kept_id")
    kept = near_duplicates(docs, similarity).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.where(F.col("doc_id").isNull()))
