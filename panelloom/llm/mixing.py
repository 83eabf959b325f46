"""Mixing sources to target weights along a van der Corput schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import free_names, running_totals, word_array

#: The schedule has 2 ** SLOT_BITS slots, whatever the input: one slot is less than 0.001 % of the mix.
SLOT_BITS = 17
#: Most times that a source, and so any of its words, is taken.
MOST_EPOCHS = 3


def target_weights(sizes: DataFrame, weights: list[int], most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources: ``sizes`` (source, source_size) in, with ``target`` out; they share the sum of all sizes by weight.

    Sources by code point, null last, take the weights in turn. No target exceeds ``most_epochs`` times the source's size; what is over is shared
    again by weight until none is above. That end state is unique: with the sources in order of cap / weight, the first ones meet their caps and
    the rest share what is left, which two running sums over the table of sources give directly.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before, rest = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = (capped.withColumn("level", level).withColumn("place", F.row_number().over(W.orderBy(*order)))
              .withColumn("first", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(every)))
    return levels.select("source", "source_size", F.when(F.col("place") >= F.col("first.place"), F.col("weight") * F.col("first.level")).otherwise(F.col("cap")).alias("target"))


def van_der_corput(index: Column, bits: int = SLOT_BITS) -> Column:
    """The index with its bits reversed, as a fraction of 2 ** bits."""
    return F.conv(F.reverse(F.lpad(F.bin(index), bits, "0")), 2, 10).cast("double") / float(2 ** bits)


def schedule(targets: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """The slots of the mix in training order: slot, source, rank (of the slot among its source's slots).

    Slot k has the k-th van der Corput point; it belongs to the source in whose stretch of the cumulative targets the point falls. The points of any
    stretch of slots are spread evenly, so every prefix of the schedule holds each source in its share, off by a few slots. A source whose stretch lies between two points shares the
    slot of the point before it.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    shares = (targets.where("target > 0").withColumn("high", F.sum("target").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) / total)
              .withColumn("low", F.lag("high", 1, 0.0).over(order)).withColumn("last", F.lead("high").over(order).isNull()))
    points = targets.sparkSession.range(2 ** bits).select(F.col("id").alias("slot"), van_der_corput(F.col("id"), bits).alias("point"))
    # a point is joined to its stretch through a grid: each stretch is listed at the cells that it touches
    cells = 1024
    cell = F.least(F.floor(F.col("point") * cells), F.lit(cells - 1))
    listed = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    placed = (points.withColumn("cell", cell).join(listed, "cell").where((F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | F.col("last")))
              .select("slot", "source"))
    own = cut_lineage(placed.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1))
    met = own.where("rank = 0").select(F.col("source").alias("met"))
    before = F.least(F.floor(F.col("low") * 2 ** bits), F.lit(2 ** bits - 1)).cast("long")
    between = shares.join(met, F.col("source").eqNullSafe(F.col("met")), "left_anti").select((van_der_corput(before, bits) * 2 ** bits).cast("long").alias("slot"), "source", F.lit(0).alias("rank"))
    return own.unionByName(between)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = MOST_EPOCHS, bits: int = SLOT_BITS, text: str = "text", doc_id: str = "doc_id",
        source: str = "source") -> DataFrame:
    """How many words of every document the mix takes, repeats counted, and where in the schedule it takes them first.

    Each source's documents, shuffled by a digest of their ids, form one long sequence of words, which is repeated until it fills the source's rounded target. The ranked slots of the source
    share these words equally: slot number r of n takes the r-th of n blocks of equal size, from the start again after the end. A block is a stretch of the sequence and not a list of
    documents: a long document spans many blocks, many short ones share one. A slot stands for (all words / 2 ** bits) words in every source, off by the rounding of its number
    of slots. The words taken of a document are those before its end less those before its start.

    Returns doc_id, source, size (words), source_size, target, taken, first_slot and last_slot (of the schedule, at which the first pass through the source takes the document's first and last
    words; null if it takes none). Null texts and texts without words have size 0 and are never taken; a null source is a source of its own, the last; null ids are ordered first; equal
    rows follow one another and count each on its own. An empty table gives no row. The same input gives the same mix, whatever its partitions. Other columns are not read.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"))
    known, slots = _places(sized, weights, most_epochs, bits)
    last = F.least(F.col("start") + F.col("size"), F.col("all_taken")) - 1
    ends = known.withColumn("r0", _rank(F.col("start"))).withColumn("r1", F.when(F.col("taken") > 0, _rank(last)))
    for at, name in (("r0", "first_slot"), ("r1", "last_slot")):
        ends = ends.alias("k").join(slots.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col(f"k.{at}") == F.col("s.rank")), "left").select("k.*", F.col("s.slot").alias(name))
    return ends.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def _places(sized: DataFrame, weights: tuple[int, ...], most_epochs: int, bits: int, ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, source, size, ...) place in its source's sequence with the words that the mix takes of it, and the slots (source, rank, slot). ``ties`` order rows of like id and size."""
    shuffled = sized.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    placed = running_totals(shuffled, ["order", "doc_id", "size", *ties], {"start": "size"}, ["source"])
    targets = cut_lineage(target_weights(placed.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), most_epochs))
    slots = cut_lineage(schedule(targets, bits))
    counts = slots.groupBy("source").agg(F.count("*").alias("slots"))
    sources = cut_lineage(targets.alias("t").join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
                          .select("t.*", F.coalesce("slots", F.lit(0)).alias("slots"), F.round("target").cast("long").alias("all_taken")))
    known = placed.alias("p").join(sources.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target", "slots", "all_taken")
    epochs, rest = (F.expr(f"CASE WHEN source_size > 0 THEN all_taken {op} source_size END") for op in ("div", "%"))
    before = lambda at: at * epochs + F.least(at, rest)
    taken = F.when(F.col("size") > 0, before(F.col("start") + F.col("size")) - before(F.col("start"))).otherwise(F.lit(0)).cast("long")
    return known.withColumn("taken", taken), slots


def _rank(place: Column) -> Column:
    """The slot, among its source's, that takes a place of the source's repeated sequence; null for places that are not taken."""
    return F.when((F.col("all_taken") > 0) & (place < F.col("all_taken")), F.call_function("div", place * F.col("slots"), F.col("all_taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = MOST_EPOCHS, bits: int = SLOT_BITS, slot: str | None = None) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes its words, rounded to whole documents; all columns stay as they are.

    A copy stands at the slot of the schedule at which it begins: the rows are sorted by slot and, inside a slot, along the source's sequence, so every stretch of them holds the sources
    near their shares. With ``slot`` a column of that name says the slot too. Only the document at the last cut of a source is taken in part, so rounding moves a source by less than one of
    its documents; a source's first document is taken once at least, so that no source with a target of a word or more is lost. Documents without words are never taken. Each of several rows with like ids, null
    ones too, counts on its own; rows of like id, source and size follow one another by a hash of all their columns. A null source is a source of its own; an empty table gives no row;
    further columns may have any name. The same input gives the same rows in the same order, whatever its partitions.
    """
    row, size, tie, copied, at, place = free_names(docs, "row", "words", "tie", "copied_row", "at_slot", "place")
    void = {c for c, kind in docs.dtypes if kind == "void"}  # files hold no such columns
    # no hash function takes maps and variants
    hashed = [F.col(c).cast("string") if "map<" in kind or "variant" in kind else F.col(c) for c, kind in docs.dtypes if c not in void]
    # written, so that a row's number is a fact: rows are found again by it and not by ids, which may repeat or be null
    held = cut_lineage(docs.drop(*void).select("*", F.monotonically_increasing_id().alias(row), F.size(word_array(F.col("text"))).cast("long").alias(size), F.xxhash64(*hashed).alias(tie)))
    sized = held.select("doc_id", "source", F.col(size).alias("size"), F.col(tie).alias("tie"), F.col(row).alias("row"))
    known, slots = _places(sized, weights, most_epochs, bits, ("tie",))
    copies = F.greatest(F.round(F.col("taken") / F.col("size")), F.when(F.col("start") == 0, F.lit(1.0))).cast("int")
    each = (known.where("taken > 0").withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .withColumn("place", F.col("start") + (F.col("copy") - 1) * F.col("source_size")).withColumn("r", _rank(F.least(F.col("place"), F.col("all_taken") - 1))))
    passes = (each.alias("e").join(slots.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")) & (F.col("e.r") == F.col("s.rank")), "left")
              .select(F.col("e.row").alias(copied), F.col("s.slot").alias(at), F.col("e.place").alias(place)))
    mixed = held.join(passes, F.col(row) == F.col(copied)).orderBy(at, F.col("source").asc_nulls_last(), place)
    extra = [] if slot is None else [F.col(at).alias(slot)]
    return mixed.select(*[F.lit(None).alias(c) if c in void else F.col(c) for c in docs.columns], *extra)
