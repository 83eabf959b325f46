"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.llm.common import free_names

#: Bytes of the smallest and the largest chunk, and the bits of the rolling hash that must be 0 at a cut: chunks have about 50 bytes on average.
SMALLEST, LARGEST, CUT_BITS = 24, 96, 5
#: Bytes of a repeated passage, after its repeated chunks have been extended at both ends.
LEAST_SPAN = 140
#: Bytes of a step by which a run of repeated chunks is extended to one side, and most steps: together as far as the largest chunk.
STEP, STEPS = 12, 8
_WINDOW = 32
_GEAR = np.random.default_rng(6).integers(0, 2**32, 256, dtype=np.uint32)
_GEAR[0] = 0  # the bytes between two texts leave the hash alone
_MIX = np.random.default_rng(16).integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes worked on at a time; a longer text is worked on alone.
_GROUP_BYTES = 200_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the last 32 bytes' table entries, each shifted left once for every byte that came after it.

    The recurrence ``h = (h << 1) + gear[byte]`` forgets a byte after 32 steps, so sums over 1, 2, 4 .. 32 bytes give it for all places at once.
    """
    h, span = _GEAR[data], 1
    while span < _WINDOW:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, 2 * span
    return h


def cut_points(texts: list[bytes], smallest: int = SMALLEST, largest: int = LARGEST, bits: int = CUT_BITS) -> list[list[int]]:
    """Ends of the chunks of each text. A cut depends on the 32 bytes before it (and on the last cut if that is nearer than ``smallest`` or
    farther than ``largest``), so an insertion moves only the cuts near it.

    Chunks never split a character; the last one of a text may be smaller. An empty text has no chunk.
    """
    gap = b"\0" * _WINDOW
    data = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8)
    hashes, whole = gear_hashes(data)[:-1], (data[1:] & 0xC0) != 0x80
    marks = np.flatnonzero((hashes >> np.uint32(32 - bits) == 0) & whole) + 1
    out, at = [], 0
    for t in texts:
        size, ends, last = len(t), [], 0
        lo, hi = np.searchsorted(marks, [at + smallest, at + size])
        for c in [*(marks[lo:hi] - at).tolist(), size]:
            while c - last > largest:  # no mark: the smallest hash, the first of equal ones, so that texts of one repeated word fall in step too
                window = slice(at + last + smallest - 1, at + last + largest)
                last += smallest + int(np.argmin(np.where(whole[window], hashes[window].astype(np.int64), 1 << 32)))
                ends.append(last)
            if c - last >= smallest or c == size > last:
                ends.append(c)
                last = c
        out.append(ends)
        at += size + _WINDOW
    return out


def step_codes(data: np.ndarray) -> np.ndarray:
    """A code from 1 to 255 of the STEP bytes that begin at each place."""
    value = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    value ^= value >> np.uint64(29)
    pair = value[:-1] + value[1:] * _MIX[1]
    four = pair[:-2] + pair[2:] * _MIX[2]
    twelve = four[:-8] + (four[4:-4] + four[8:] * _MIX[1]) * _MIX[0]
    return ((twelve >> np.uint64(40)) % np.uint64(255)).astype(np.int64) + 1


def surroundings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands around chunks [begins, ends) of texts [first, last): codes of the steps before and after, one a byte, nearest lowest, 0 beyond the text; and shifts.

    A step that would end inside a character ends up to three bytes nearer; ``shift`` has two bits for each step, those before in the lower half.
    """
    codes, inside = step_codes(data), (data & 0xC0) == 0x80
    left, right, shift = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
    for k in range(STEPS):
        for at, into, forward, low in ((begins - STEP * (k + 1), left, 1, 0), (ends + STEP * k, right, -1, 16)):
            edge = at if forward > 0 else at + STEP
            known = (edge >= first) & (edge <= last)
            into |= np.where(known, codes[np.where(known, at, 0)], 0) << (8 * k)
            moved = np.zeros(len(at), np.int64)
            for _ in range(3):
                moved += inside[np.where(known, edge + forward * moved, 0)]
            shift |= np.where(known, moved, 0) << (low + 2 * k)
    return left, right, np.where(shift >= 1 << 31, shift - (1 << 32), shift)


def chunk_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a chunk: doc_id, key (of the text), low and high half of the chunk's 128-bit digest, start and size in bytes, whether it is the text's first with this digest, and its
    surroundings (left, right, shift)."""
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    schema = f"doc_id {kind.simpleString()}, key long, low long, high long, start int, size int, fresh boolean, left long, right long, shift int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, keys, texts = (batch.column(k) for k in range(3))
            raw = [t.encode() if t else b"" for t in texts.to_pylist()]
            at = 0
            while at < len(raw):
                stop, size = at, 0
                while stop < len(raw) and (stop == at or size + len(raw[stop]) <= _GROUP_BYTES):
                    size += len(raw[stop]) + _WINDOW
                    stop += 1
                owner, starts, sizes, digests, fresh, bases, limits, base = [], [], [], [], [], [], [], 0
                for k, (t, ends) in enumerate(zip(raw[at:stop], cut_points(raw[at:stop]))):
                    begins, seen = [0, *ends[:-1]] if ends else [], set()
                    starts.extend(begins)
                    sizes.extend(e - b for b, e in zip(begins, ends))
                    for b, e in zip(begins, ends):
                        d = xxhash.xxh3_128_digest(t[b:e])
                        fresh.append(d not in seen)
                        seen.add(d)
                        digests.append(d)
                    owner.extend([at + k] * len(ends))
                    bases.extend([base] * len(ends))
                    limits.extend([base + len(t)] * len(ends))
                    base += len(t) + _WINDOW
                halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                gap = b"\0" * _WINDOW
                data, first = np.frombuffer(gap.join(raw[at:stop]) + gap, dtype=np.uint8), np.array(bases, dtype=np.int64)
                begin = first + np.array(starts, dtype=np.int64)
                around = surroundings(data, begin, begin + np.array(sizes, dtype=np.int64), first, np.array(limits, dtype=np.int64))
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(starts, pa.int32()),
                                                  pa.array(sizes, pa.int32()), pa.array(fresh, pa.bool_()), pa.array(around[0]), pa.array(around[1]), pa.array(around[2].astype(np.int32))],
                                                 names=["doc_id", "key", "low", "high", "start", "size", "fresh", "left", "right", "shift"])
                at = stop

    return own.mapInArrow(split, schema)


def _reach(mine: str, other: str, low: int) -> Column:
    """Bytes by which a chunk and its owner's agree beyond its edge: whole steps from the nearest on, less the shift of the last one."""
    out = F.lit(0)
    agree = F.lit(True)
    for k in range(STEPS):
        code = lambda c, k=k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(255)
        agree = agree & (code(mine) == code(other)) & (code(mine) != 0)
        out = F.when(agree, STEP * (k + 1) - F.shiftright("shift", low + 2 * k).bitwiseAND(3)).otherwise(out)
    return out


def repeated_spans(docs: DataFrame, least_span: int = LEAST_SPAN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Passages that an earlier document (smaller id) holds as well: one row each, with doc_id, first_doc_id, start, stop (bytes of the UTF-8 text).

    Every whole text is cut into chunks; a chunk belongs to the smallest id that holds it and is repeated in all others. A repeated chunk is an anchor: its passage goes on into the chunks before and
    after, which hold something else too. So each chunk carries short codes of the bytes around it in steps, and where a run of repeated chunks ends it is extended as far as the codes agree
    with those of the owner's chunk (one step in 255 agrees by chance). Passages that touch are joined, and those of at least ``least_span`` bytes are returned; first_doc_id is the smallest id
    that owns one of the chunks.

    First the owner of each digest is found by an aggregate that also runs inside every task, then only digests with two owners or more are joined back; a chunk that a third
    of the documents share is one row of that side. The chunks are cut once for each of the two and not stored in between.

    Passages that repeat only inside one document stay. Null and empty texts have no chunk; rows with a null id own nothing and lose nothing; equal rows, and
    rows with the same id and text, count once. An empty table gives no row. Other columns are not read.
    """
    pieces = chunk_table(docs.where(F.col(doc_id).isNotNull() & (F.octet_length(text) > 0)), text, doc_id)
    first = F.when(F.col("fresh"), F.col("doc_id"))
    owners = (pieces.groupBy("low", "high").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by("left", first).alias("own_left"), F.min_by("right", first).alias("own_right"))
              .where("owner <> last").select("low", "high", "owner", "own_left", "own_right"))
    again = (pieces.join(owners.hint("shuffle_hash"), ["low", "high"]).where("doc_id <> owner")
             .select("doc_id", "key", "start", "size", "owner", _reach("left", "own_left", 0).alias("before"), _reach("right", "own_right", 16).alias("after")).distinct())
    order = W.partitionBy("doc_id", "key").orderBy("start")  # of one text
    up_to = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    begins = again.withColumn("begins", F.coalesce(F.lag(F.col("start") + F.col("size")).over(order) < F.col("start"), F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("begins").over(up_to))
    spans = runs.groupBy("doc_id", "key", "run").agg(F.min("owner").alias("owner"), F.min("start").alias("from"), F.max(F.col("start") + F.col("size")).alias("to"),
                                                     F.min_by("before", "start").alias("before"), F.max_by("after", "start").alias("after"))
    wide = spans.select("doc_id", "key", "owner", (F.col("from") - F.col("before")).alias("start"), (F.col("to") + F.col("after")).alias("stop"))
    apart = wide.withColumn("begins", F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)) < F.col("start"), F.lit(True)).cast("int"))
    joined = apart.withColumn("run", F.sum("begins").over(up_to)).groupBy("doc_id", "key", "run").agg(F.min("owner").alias("first_doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.where(F.col("stop") - F.col("start") >= least_span).select("doc_id", "first_doc_id", "start", "stop", "key")


def without_repeats(docs: DataFrame, least_span: int = LEAST_SPAN) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``; other columns stay as they are.

    Every row stays, also one that loses its whole text and is empty then; a text without a repeated passage is not touched, nor is a null or empty text or a row with a
    null id. Repeated rows are cut alike, an empty table gives no row, and further columns may have any name.
    """
    own_id, key, cuts = free_names(docs, "own_id", "text_key", "cuts")
    spans = (repeated_spans(docs, least_span).groupBy(F.col("doc_id").alias(own_id), F.col("key").alias(key))
             .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts)))  # of one text

    @F.pandas_udf("string")
    def cut(texts: pd.Series, every: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, every):
            if t is not None and own is not None:
                raw, at, parts = t.encode(), 0, []
                for s in own:
                    parts.append(raw[at:s["start"]])
                    at = s["stop"]
                t = (b"".join(parts) + raw[at:]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(key)), "left")
    return joined.select(*[F.when(F.col(cuts).isNotNull(), cut("text", cuts)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
