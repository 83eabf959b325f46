"""Document fingerprints of closed syncmers, matched by position, and the fingerprints of texts joined from neighbouring documents."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelloom.llm.textnum import TWO_TABLES, groups, mixed

#: Characters of a k-mer and of the inner substrings whose smallest must lie at one of its edges.
K, S = 16, 4
#: Characters of one anchor in a fingerprint: its distance from the last anchor, then its code.
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype=np.uint8)
_CODE_DIGITS = 4
#: Characters that are worked on at a time in a text; as anchors depend on K characters only, pieces that overlap by K - 1 give the anchors of the whole.
PIECE = 1_000_000
#: Ranges of ids for each shuffle partition of the session.
RANGES_A_PARTITION = 4


def _anchors(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the closed syncmers of the code points, without regard to borders between texts, and their 24-bit codes."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = whole = mixed(points.astype(np.uint64) + np.uint64(1))
    size, turn = 1, 0
    while size < k:  # hashes of 2, 4, 8 ... characters from two of half the size, or of k from two that overlap
        step = min(size, k - size)
        whole = whole[:-step] + whole[step:] * TWO_TABLES[0][turn]
        size, turn = size + step, turn + 1
        if size == s:
            inner = whole
    n, span = len(points) - k + 1, k - s
    least, width = inner[:n + span], 1
    while width < span + 1:  # smallest of the last 1, 2, 4 ... inner hashes
        step = min(width, span + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero((least == inner[:n]) | (least == inner[span:span + n]))
    return at, (whole[at] >> np.uint64(64 - 6 * _CODE_DIGITS)).astype(np.int64)


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Anchors of each text: where its closed syncmers start (in characters), ascending, and their codes.

    A k-mer is a closed syncmer if the smallest hash of its s-mers is that of the first or of the last one. That depends on its k characters alone, so a passage has the same anchors
    in every text, and two neighbours are at most k - s characters apart. A text with no syncmer has one anchor for the whole of it; an empty text has none.
    """
    if not 0 < s < k < s + 64 or s & (s - 1):
        raise ValueError("s must be a power of two under k, and the distance k - s of anchors under 64")
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for own in groups(texts):
        lengths = np.array([len(t) for t in own])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        joined, total = "".join(own), int(lengths.sum())
        found = []
        for at in range(0, max(total - k + 1, 1), PIECE):
            points = np.frombuffer(joined[at:at + PIECE + k - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            places, codes = _anchors(points, k, s)
            found.append((places + at, codes))
        place, code = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
        text = np.searchsorted(starts, place, "right") - 1
        inside = place + k <= starts[text] + lengths[text]
        place, code, text = place[inside], code[inside], text[inside]
        first = np.searchsorted(text, np.arange(len(own) + 1))
        for n, t in enumerate(own):
            p, c = place[first[n]:first[n + 1]] - starts[n], code[first[n]:first[n + 1]]
            if t and not len(p):
                p, c = np.zeros(1, np.int64), np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=3).digest())])
            out.append((p, c))
    return out


def written(anchor: tuple[np.ndarray, np.ndarray]) -> str:
    """The anchors as text, five characters each: distance from the anchor before, code."""
    place, code = anchor
    rows = np.empty((len(place), 1 + _CODE_DIGITS), np.uint8)
    rows[:, 0] = _DIGITS[np.diff(place, prepend=0)]
    for d in range(_CODE_DIGITS):
        rows[:, 1 + d] = _DIGITS[(code >> (6 * (_CODE_DIGITS - 1 - d))) & 63]
    return rows.tobytes().decode("ascii")


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Anchors from their text."""
    value = np.zeros(128, np.int64)
    value[_DIGITS] = np.arange(64)
    rows = value[np.frombuffer(fingerprint.encode("ascii"), dtype=np.uint8).reshape(-1, 1 + _CODE_DIGITS)]
    code = np.zeros(len(rows), np.int64)
    for d in range(_CODE_DIGITS):
        code = (code << 6) | rows[:, 1 + d]
    return np.cumsum(rows[:, 0]), code


def _turns(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (code, n-th time that it occurs) as one number, and the anchor of each."""
    order = np.argsort(code, kind="stable")
    own = code[order]
    new = np.append(True, own[1:] != own[:-1])
    nth = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return (own << 32) | nth, order


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of anchors, of both texts together, that have a partner at the matching place of the other text.

    The n-th anchor with a code is the partner of the n-th one with this code in the other text; the longest chain of partners that come in the same order in both counts. Moved
    passages so count once, inserted ones not at all. Two texts without anchors are alike.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (left, of_a), (right, of_b) = _turns(a[1]), _turns(b[1])
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    i, j = of_a[i], of_b[j]
    partner = j[np.argsort(i)]
    if len(partner) > 1 and (np.diff(partner) < 0).any():
        ends: list[int] = []  # smallest last partner of a chain of each length
        for x in partner.tolist():
            at = bisect_left(ends, x)
            if at == len(ends):
                ends.append(x)
            else:
                ends[at] = x
        chain = len(ends)
    else:
        chain = len(partner)
    return 2.0 * chain / (len(a[0]) + len(b[0]))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def neighbours(docs: DataFrame, ranges: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows in ranges of ids, each range in one partition and in order, with the first row of the next range behind it.

    Columns: part (number of the range), guest (true for the row of the next range; the last range is followed by the first row of all), doc_id, digest (of the text), text (null: empty).
    Rows are ordered by (doc_id, digest of the text), null ids first. Bounds are quantiles of the ids; rows with null ids are dealt by their digest, so that many of them fill many ranges. Each
    text moves once, but for one guest a range; of the rows themselves only one (id, digest) a range is looked at together.
    """
    spark = docs.sparkSession
    n = ranges or RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    bounds = own.agg(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n - 1)], 10 * n).alias("b")).first()["b"] if n > 1 else []
    bounds = sorted(set(bounds or []))  # n numbers at most
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    by_digest = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * n / 2 ** 32).cast("long")
    if runs:  # two short searches: which run of bounds, then the place in it
        firsts, table = F.array(*[F.lit(r[0]) for r in runs]), F.array(*[F.array(*[F.lit(b) for b in r]) for r in runs])
        run = F.size(F.filter(firsts, lambda b: b <= F.col("doc_id")))
        place = F.when(run == 0, 0).otherwise((run - 1) * step + F.size(F.filter(F.get(table, run - 1), lambda b: b <= F.col("doc_id"))))
    else:
        place = F.lit(0)
    placed = own.withColumn("part", F.when(F.col("doc_id").isNull(), by_digest).otherwise(n + place))
    key = F.struct("doc_id", "digest")
    ordered = W.orderBy("part")  # one row a range
    firsts = placed.select("part", key.alias("k")).groupBy("part").agg(F.min("k").alias("k"))
    before = F.coalesce(F.lag("part").over(ordered), F.max("part").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    guests = firsts.select(F.col("k.doc_id").alias("guest_id"), F.col("k.digest").alias("guest_digest"), before.alias("guest_of"))
    joined = placed.join(F.broadcast(guests), placed["doc_id"].eqNullSafe(F.col("guest_id")) & (placed["digest"] == F.col("guest_digest")), "left")  # at most 2 * n rows
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("part"), F.lit(True).alias("guest")))
    every = joined.select(F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("p"), "doc_id", "digest", "text").select("p.part", "p.guest", "doc_id", "digest", "text")
    return every.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "digest")


def fingerprints(docs: DataFrame, ranges: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last half (rounded down) is replaced by as many first characters of the next document.

    The documents are put into ranges of ids (see ``neighbours``); a task passes through a range in order and holds a row until it has seen the next one, so no row is looked up
    elsewhere. A fingerprint is the positions and codes of all closed syncmers of a text (see ``anchors``, ``written``); ``likeness`` matches two of them by position.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness of the text to its edited text and to the next document's text).

    Ids are numbers. Null texts count as empty: no anchor, an empty fingerprint, like other empty texts only. Rows with the same id follow each other by the digest of their texts, rows with null ids come first by
    that digest; the last row is followed by the first, a single row by itself. Equal texts have equal fingerprints. An empty table gives no row. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range whose successor is not worked on yet: (part, id, text, anchors or None)
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            part, guest, ids, texts = batch.column("part").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id"), batch.column("text").to_pylist()
            at = 0
            while at < len(part):
                stop, size = at, 0
                while stop < len(part) and (stop == at or size + len(texts[stop]) <= 300_000):
                    size += len(texts[stop])
                    stop += 1
                rows = held + [(part[k], guest[k], ids[k], texts[k], None) for k in range(at, stop)]
                fresh = iter(anchors([r[3] for r in rows[len(held):]]))
                own = [r[4] or next(fresh) for r in rows]
                ready = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
                changed = [edited(rows[k][3], rows[k + 1][3]) for k in ready]
                other = anchors(changed)
                if ready:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rows[k][2].as_py() for k in ready], id_type), pa.array([len(rows[k][3]) for k in ready], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()), pa.array([written(own[k]) for k in ready], pa.string()),
                        pa.array([written(x) for x in other], pa.string()), pa.array([likeness(own[k], x) for k, x in zip(ready, other)], pa.float64()),
                        pa.array([likeness(own[k], own[k + 1]) for k in ready], pa.float64())],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                held = [(*rows[-1][:4], own[-1])]
                at = stop

    return neighbours(docs, ranges, text, doc_id).select("part", "guest", "doc_id", "text").mapInArrow(mark, schema)
