"""Merkle manifest of a dataset: a hash tree over its rows whose proofs are built by a butterfly exchange of subtree roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import running_totals

#: Children of a node, and levels of the tree that lie inside one block of consecutive leaves.
FANOUT, BLOCK_LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One row in so many, by the CRC-32 of its id, is altered in a trial.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text, or as a dash if it is null."""
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def node_digest(children: Column) -> Column:
    """Digest of an array of digests, joined as text."""
    return F.sha2(F.array_join(children, "").cast("binary"), 256)


def _run(nodes: Column, place: Column, fanout: int) -> Column:
    """The siblings of the node at ``place`` of an array: their digests joined, those to its left and those to its right."""
    first = place - place % fanout
    return F.struct(F.array_join(F.slice(nodes, first + 1, place % fanout), "").alias("left"), F.array_join(F.slice(nodes, place + 2, first + fanout - place - 1), "").alias("right"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way up lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "").cast("binary"), 256)


def butterfly(roots: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Gives every block of a tree the proof from its own subtree root up to the root of the tree.

    ``roots`` holds tree, block (0, 1, 2 ...), blocks (of the tree) and node (root of the block's subtree). In round r the nodes are those of ``fanout ** r`` blocks each, and every block
    knows the node it lies in. Aligned groups of ``fanout`` nodes swap: a block sends its node to one block of each sibling node, the one with its own offset, so that every block hears
    of each sibling once, hashes their parent itself and goes on with it. The same ancestor is so hashed by all blocks under it, and none needs an answer from above. If the last
    sibling has fewer blocks, its blocks serve several offsets in turn. A round moves at most ``fanout`` rows a block, and there are log(blocks) rounds.

    Returns tree, block, upper (array of the siblings left and right, level by level), root.
    """
    most = roots.agg(F.max("blocks").alias("m")).first()["m"] or 0
    state = roots.withColumn("upper", F.expr("CAST(array() AS array<struct<left: string, right: string>>)"))
    span = 1
    while span < most:
        active, done = state.where(F.col("blocks") > span), state.where(F.col("blocks") <= span)
        me = F.expr(f"block div {span}")
        group = F.expr(f"block div {span * fanout} * {fanout}")
        last = F.least(group + fanout - 1, F.expr(f"(blocks - 1) div {span}"))
        sent = (active.select("tree", "blocks", "node", me.alias("me"), (F.col("block") % span).alias("offset"), F.explode(F.sequence(group, last)).alias("to"))
                .withColumn("held", F.least(F.lit(span).cast("long"), F.col("blocks") - F.col("me") * span))  # blocks of the sender's node
                .withColumn("served", F.least(F.lit(span).cast("long"), F.col("blocks") - F.col("to") * span))  # and of the receivers'
                .where("offset < served")
                .select("tree", "me", "node", F.explode(F.expr(f"transform(sequence(offset, served - 1, held), o -> to * {span} + o)")).alias("block")))
        heard = sent.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("me", "node"))).alias("run"))  # at most ``fanout`` nodes
        nodes = F.transform("run", lambda n: n["node"])
        met = active.join(heard, ["tree", "block"])
        up = met.select("tree", "block", "blocks", node_digest(nodes).alias("node"), F.concat("upper", F.array(_run(nodes, (me % fanout).cast("int"), fanout))).alias("upper"))
        state = cut_lineage(up.unionByName(done.select(*up.columns)))
        span *= fanout
    return state.select("tree", "block", "upper", F.col("node").alias("root"))


def _parents(below: Column, alone: Column, fanout: int) -> Column:
    """The next level of a block's subtree; a block that is a tree of its own ends where one node is left."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(below) / fanout).cast("int") - 1)
    return F.when(alone & (F.size(below) == 1), below).otherwise(F.transform(runs, lambda k: node_digest(F.slice(below, k * fanout + 1, fanout))))


def proofs(leaves: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Root and proof of every leaf of many trees: ``leaves`` (tree, index from 0 without gap, leaf, and any further columns) in, ``proof`` and ``root`` added.

    Every ``fanout`` consecutive nodes become one (the last run may be shorter, even a single node) until one is left. ``fanout ** levels`` consecutive leaves are a block; its subtree is
    built in one row, the roots of the blocks go through ``butterfly``, and the leaves meet the levels of their block once more. A large tree is many blocks and never in one task.
    """
    size = fanout ** levels
    counts = leaves.groupBy("tree").agg(F.count("*").alias("leaves"))
    placed = leaves.withColumn("block", F.expr(f"index div {size}"))
    whole = placed.groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("index", "leaf"))).alias("own"))  # ``size`` leaves
    whole = whole.join(counts, "tree").select("tree", "block", F.expr(f"(leaves + {size - 1}) div {size}").alias("blocks"), F.transform("own", lambda n: n["leaf"]).alias("n0"))
    alone = F.col("blocks") == 1
    for k in range(levels):
        whole = whole.withColumn(f"n{k + 1}", _parents(F.col(f"n{k}"), alone, fanout))
    whole = cut_lineage(whole)
    upper = butterfly(whole.select("tree", "block", "blocks", F.element_at(f"n{levels}", 1).alias("node")), fanout)
    known = whole.join(upper, ["tree", "block"])
    place = [F.expr(f"CAST(index % {size} div {fanout ** k} AS INT)") for k in range(levels)]
    steps = [F.when((F.col("blocks") > 1) | (F.size(f"n{k}") > 1), F.array(_run(F.col(f"n{k}"), place[k], fanout)))
             .otherwise(F.expr("CAST(array() AS array<struct<left: string, right: string>>)")) for k in range(levels)]
    return placed.join(known, ["tree", "block"]).select(*leaves.columns, F.concat(*steps, F.col("upper")).alias("proof"), "root")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, levels: int = BLOCK_LEVELS, tampered: int = TAMPERED, source: str = "source", doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """A tree for each source over its rows by ascending id, and one over the roots of the sources by name; with every row's proof, folded from an altered row in a trial.

    Only ids, sources and digests move, never texts. Places inside a source come from totals of ranges, so a source that holds a third of all rows is spread over many tasks.

    Returns doc_id, leaf, subroot (of its source), root, proof_sha256 (digest of all siblings on the way to the root), folded_root (recomputed with the row's text in lower case (A-Z only)
    where the CRC-32 of the id is divisible by ``tampered``, else from the row as it is) and verified (folded_root = root).

    Null values are dashes in the digest; a null source is a tree of its own, the first; null ids come first in their source and are not altered; rows with the same id follow each
    other by digest, and equal rows are leaves of their own. An empty text is not a null one. An empty table gives no row. Columns that are not among ``fields`` are not read.
    """
    values = lambda altered: [F.translate(text, _UPPER, _LOWER) if altered and f == text else F.col(f) for f in fields]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), leaf_digest(values(False)).alias("leaf"),
                       F.when(F.crc32(F.col(doc_id).cast("string")) % tampered == 0, leaf_digest(values(True))).alias("altered"), F.lit(1).cast("long").alias("one"))
    placed = cut_lineage(running_totals(rows, ["doc_id", "leaf"], {"index": "one"}, ["source"]))
    sources = cut_lineage(running_totals(placed.groupBy("source").agg(F.lit(1).cast("long").alias("one")), ["source"], {"tree": "one"}))
    known = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("doc_id", "tree", "index", "leaf", "altered")
    low = proofs(cut_lineage(known), fanout, levels).withColumnRenamed("root", "subroot")
    subroots = low.where("index = 0").select("tree", "subroot")
    top = proofs(cut_lineage(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("subroot").alias("leaf"))), fanout, levels)
    top = cut_lineage(top.select(F.col("index").alias("tree"), F.col("proof").alias("top"), "root"))
    every = low.join(top, "tree").withColumn("proof", F.concat("proof", "top"))
    fold = folded(F.coalesce("altered", "leaf"), F.col("proof"))
    return (every.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
