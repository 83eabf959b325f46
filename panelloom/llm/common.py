"""Shared pieces of the llm operators: reading tables, bounded training samples, running totals, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelloom.functions.session import cut_lineage, run_folder

#: Words are runs of anything but these (space and the controls tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{run_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to differ from all columns of ``docs`` (letter case aside)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id, folds: int, fold: int) -> Column:
    """True for documents whose crc32 of the id as text falls in the fold kept out of training; ids that are null count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(True))


def word_array(text) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> tuple[list[str], list[int]]:
    """At most ``per_class`` training texts of each label value, for fitting on the driver.

    The documents are picked from the labels alone, by a hash order of their ids, so the texts of all others are never moved.
    Ids labelled both ways, held-out ids, null ids and null labels are left out; null texts count as empty. Ids that occur with several
    texts give each distinct text once, and the bound holds for the texts too.
    """
    own = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", folds, fold)).groupBy("doc_id")
           .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("most")).where("y = most").select("doc_id", "y"))
    order = F.xxhash64("doc_id")
    picked = [own.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids
            .dropDuplicates(["doc_id", "text"]).orderBy(order, "doc_id", "text").limit(2 * per_class).select("text", "y").collect())
    return [r[0] for r in rows], [r[1] for r in rows]


def running_totals(df: DataFrame, order: list[str], sizes: dict[str, str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds, for each ``name: column`` of ``sizes``, the exact sum of the column over all rows before this one in ``order`` (inside ``by``).

    Rows are dealt into ranges of (by, order); the ranges are written, so that a row's range is a fact which no retry changes. Each range
    is totalled, the totals (one row a range and group) are summed up, and only the rest of the sum is a window inside a range. A hot group
    is spread over many ranges.
    """
    keys = [*by, *order]
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sizes.items()])
    up_to = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select("_range", *by, *[F.coalesce(F.sum(f"_sum_{n}").over(up_to), zero).alias(f"_off_{n}") for n in sizes])
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    on = F.col("l._range") == F.col("r._range")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"_in_{n}") for n, c in sizes.items()])
    return (local.alias("l").join(offsets.alias("r"), on)
            .select(*[F.col(f"l.{c}") for c in df.columns], *[(F.col(f"r._off_{n}") + F.col(f"l._in_{n}")).alias(n) for n in sizes]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) for each node of an edge, component the smallest node reached.

    Contraction: every node takes its first neighbour (or itself) as parent and then the parent's parent, edges are rewritten to parents and
    loops vanish; the rounds go on until no edge is left, then the parents are followed back. "First" is the smallest id for two rounds, in which
    stars fall together, and then a hash order for one, in which a long chain loses a fixed share of its nodes. Each round is a written table and
    smaller than the one before; neither edges nor labels come to the driver.
    """
    live = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps, turn = [], 0
    while not live.isEmpty():
        both = live.union(live.select("b", "a")).toDF("node", "other")
        if turn % 3 < 2:
            first = F.least(F.col("node"), F.min("other"))
        else:
            mark = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))
            first = F.least(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("node")), F.min(mark("other")))["node"]
        near = both.groupBy("node").agg(first.alias("parent"))
        above = near.toDF("parent", "further")
        parent = cut_lineage(near.join(above, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent")))
        steps.append(parent)
        moved = (live.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b").where("pa <> pb")
                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        live, turn = cut_lineage(moved), turn + 1
    if not steps:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    root = steps[-1].toDF("node", "root")
    for parent in reversed(steps[:-1]):
        root = parent.toDF("node", "root").join(root.toDF("root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    root = cut_lineage(root)
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")
