"""Prefix trie of conversations: shards of conversations with a minimal perfect hash of their prefixes, counts in flat arrays, sums along parent slots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import word_array
from panelloom.llm.textnum import mixed

#: Conversations whose ids make one row when the ends of a node are hashed.
ENDS_A_ROW = 500
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys (two arrays of halves): n keys have the slots 0 to n - 1.

    Each level hashes the keys that are left into two places a key; keys alone in their place stay there, the others go on to the next level. The slot is the number of taken places
    before. The keys are kept by slot, so that every look-up is verified on all 128 bits; a key that is not in the table has slot -1.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # places, taken, taken places before (in all levels)
        self.low, self.high = np.empty_like(low), np.empty_like(high)
        left, used = np.arange(len(low)), 0
        while len(left):
            if len(self.levels) == 200:
                raise ValueError("keys are not distinct")
            size = max(64, 2 * len(left))
            place = self._place(low[left], high[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            taken = np.zeros(size, bool)
            taken[place[alone]] = True
            before = used + np.cumsum(taken) - taken
            self.levels.append((size, taken, before))
            at = before[place[alone]]
            self.low[at], self.high[at] = low[left[alone]], high[left[alone]]
            used += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _place(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(low.view(np.uint64) + mixed(high.view(np.uint64) + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, left = np.full(len(low), -1), np.arange(len(low))
        for level, (size, taken, before) in enumerate(self.levels):
            place = self._place(low[left], high[left], level, size)
            hit = taken[place]
            own, at = left[hit], before[place[hit]]
            out[own] = np.where((self.low[at] == low[own]) & (self.high[at] == high[own]), at, -1)
            left = left[~hit]
        return out


def summed_up(parent: np.ndarray, depth: np.ndarray, values: list[np.ndarray]) -> None:
    """Adds every slot's values to its parent's, deepest slots first, so that each slot holds the sum of its subtree. In place."""
    order = np.argsort(-depth, kind="stable")
    borders = np.flatnonzero(np.diff(depth[order])) + 1
    for own in np.split(order, borders):
        if len(own) and depth[own[0]] > 0:
            for v in values:
                np.add.at(v, parent[own], v[own])


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin like others of their block of ``every`` ids: conv_id, turns (array of digest and words, in order).

    The first h turns, h being the CRC-32 of the id modulo ``heads``, are those of the block's first id (all if it has fewer, none if there is no such conversation); the own turns after the
    first h follow. Turns stand by number, nulls first, those with the same number by the digest of role and text; null roles and texts count as empty. Rows without a conversation id
    belong to none. A conversation is held by one task, like a text; texts do not move, only 16 bytes of each turn's digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.size(word_array(text)).cast("long").alias("words")).alias("t"))
    own = (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
           .select("conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own")))
    own = cut_lineage(own)
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    known = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
    begun = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    return known.select("conv_id", F.concat(begun, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns"))


_NODES = "shard int, low long, high long, up_low long, up_high long, depth long, words long, n long, n_ends long, least long, ends array<string>"


def _distinct(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of one row for each distinct key."""
    order = np.lexsort((low, high))
    new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))[:len(order)]
    return order[new]


def shard_nodes(conversations: DataFrame) -> DataFrame:
    """The prefixes of every shard of conversations, each once: digest, parent's digest, depth, words of the last turn, conversations, those that end there, and the ids of these."""

    def enumerate_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, ends, digests, ups, depths, words = [], [], [], [], [], []
        for batch in batches:
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                ids.append(conv)
                at = _ROOT
                digests.append(at)
                ups.append(at)
                depths.append(0)
                words.append(0)
                for d, t in enumerate(turns, 1):
                    ups.append(at)
                    at = hashlib.blake2b(at + t["digest"], digest_size=16).digest()
                    digests.append(at)
                    depths.append(d)
                    words.append(t["words"])
                ends.append(len(digests) - 1)
        if not ids:
            return
        halves, up = (np.frombuffer(b"".join(x), dtype=np.int64).reshape(-1, 2) for x in (digests, ups))
        low, high = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        one = _distinct(low, high)
        table = SlotTable(low[one], high[one])
        at = table.slots(low, high)
        if (at < 0).any() or len(np.unique(at[one])) != len(one):
            raise ValueError("two prefixes share a slot")
        by_slot = np.empty(len(one), np.int64)
        by_slot[at[one]] = one
        depth = np.array(depths)[by_slot]
        parent = at[np.maximum(by_slot - 1, 0)]  # the prefix before stands one place before, but for the root
        n_ends = np.bincount(at[ends], minlength=len(one))
        n = n_ends.copy()
        summed_up(parent, depth, [n])
        first, last = np.searchsorted(ends, np.arange(len(digests)), "left"), np.array(ids)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, at, last[first])
        own = np.array(ids)
        order = np.lexsort((own, at[ends]))
        ended, own = at[ends][order], own[order].tolist()
        begins = np.searchsorted(ended, np.arange(len(one) + 1))
        packed = [[",".join(map(str, own[k:min(k + ENDS_A_ROW, b)])) for k in range(a, b, ENDS_A_ROW)] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        shard = TaskContext.get().partitionId()
        for a in range(0, len(one), 10_000):
            s = slice(a, a + 10_000)
            rows = by_slot[s]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), shard, np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in (table.low[s], table.high[s], up[rows, 0], up[rows, 1])], pa.array(depth[s]),
                pa.array(np.array(words)[rows]), pa.array(n[s]), pa.array(n_ends[s]), pa.array(least[s]), pa.array(packed[s], pa.list_(pa.string()))],
                names=[c.split()[0] for c in _NODES.split(", ")])

    # conversations that begin alike lie side by side, and a beginning that very many share is cut into several ranges by the ids
    keys = [F.get("turns", k)["digest"] for k in (0, 1, 2)]
    return conversations.select("conv_id", "turns").repartitionByRange(*keys, "conv_id").mapInArrow(enumerate_prefixes, _NODES)


def ends_digests(nodes: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, ascending and joined by commas: low, high, ends_sha256.

    The ids of a shard come sorted, in rows of ENDS_A_ROW, and those of one node ascend from shard to shard. A node in one row is hashed at once; the rows of others stream in order through
    one digest, so a node at which a third of all conversations end is never held as a whole.
    """
    rows = nodes.where("n_ends > 0").select("low", "high", "shard", F.posexplode("ends").alias("piece", "ids"))
    counts = rows.groupBy("low", "high").agg(F.count("*").alias("pieces"), F.min("ids").alias("ids"))
    alone = counts.where("pieces = 1").select("low", "high", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for low, high, ids in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "ids"))):
                if key != (low, high):
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (low, high), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["low", "high", "ends_sha256"])
                done = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["low", "high", "ends_sha256"])

    many = rows.join(counts.where("pieces > 1").select("low", "high"), ["low", "high"], "left_semi")
    streamed = many.repartition("low", "high").sortWithinPartitions("low", "high", "shard", "piece").select("low", "high", "ids").mapInArrow(stream, "low long, high long, ends_sha256 string")
    return alone.unionByName(streamed)


_SUMS = "low long, high long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the conversations (conv_id, turns): the nodes of their trie, the textless root included.

    1. Conversations are dealt into shards by range of their first turns and id; a shard lists its distinct prefixes, gives each a slot of a minimal perfect hash, scatters the conversations that
       end there into a flat array and sums it up along the parents' slots, deepest first (``shard_nodes``).
    2. Prefixes that several shards hold are added up: members, ends, smallest member. One of the shards is the prefix's owner.
    3. Every shard, which holds all ancestors of its prefixes, sums up what its own prefixes save, their leaves and children along the parents' slots; the shards' parts are added up again.

    No step follows a parent across shards, so the work takes two rounds however deep the trie is, and neither a common first turn nor a crowd of equal conversations meets in one task.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree: (members - 1) times
    words of the last turn), ends_sha256 (of the ids that end there, ascending, joined by commas).

    Conversations without turns end at the root. Equal conversations share all nodes. Without conversations there is no row, not even a root. Ids are distinct and not null (see ``rebuilt``).
    """
    nodes = cut_lineage(shard_nodes(conversations))
    key = ["low", "high"]
    merged = nodes.groupBy(*key).agg(F.sum("n").alias("n_convs"), F.sum("n_ends").alias("all_ends"), F.min("least").alias("conv_id"), F.min("shard").alias("owner"))
    local = nodes.select("shard", *key, "up_low", "up_high", "depth", "words").join(merged, key).withColumn("own", (F.col("shard") == F.col("owner")).cast("long"))
    own = local.select("shard", *key, "up_low", "up_high", "depth", "conv_id", "n_convs", "own", (F.col("own") * (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                       (F.col("own") * (F.col("n_convs") == F.col("all_ends")).cast("long")).alias("leaf"))

    def sum_up(shard: pa.Table) -> pa.Table:
        col = {c: shard.column(c).to_numpy() for c in ("low", "high", "up_low", "up_high", "depth", "conv_id", "n_convs", "own", "saved", "leaf")}
        table = SlotTable(col["low"], col["high"])
        at = table.slots(col["low"], col["high"])
        row = np.empty(len(at), np.int64)
        row[at] = np.arange(len(at))
        by = {c: v[row] for c, v in col.items()}
        parent = table.slots(by["up_low"], by["up_high"])
        if (at < 0).any() or (parent < 0).any():
            raise ValueError("a prefix has no slot")
        saved, leaves, children, inner = by["saved"].copy(), by["leaf"].copy(), np.zeros(len(at), np.int64), by["depth"] > 0
        summed_up(parent, by["depth"], [saved, leaves])
        np.add.at(children, parent[inner], by["own"][inner])
        above = pa.array(by["conv_id"][parent], mask=~inner)
        return pa.Table.from_arrays([*[pa.array(by[c]) for c in ("low", "high", "depth", "conv_id")], above, *[pa.array(x) for x in (by["n_convs"], children, leaves, saved)]],
                                    names=[c.split()[0] for c in _SUMS.split(", ")])

    parts = own.groupBy("shard").applyInArrow(sum_up, _SUMS)
    same = ["depth", "conv_id", "parent_conv_id", "n_convs"]
    total = parts.groupBy(*key).agg(*[F.max(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return (total.join(ends_digests(nodes), key, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")))
