"""Contiguous shards of equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.llm.common import running_totals

#: Bytes that every row adds to its text.
ROW_BYTES = 8
#: Share of a shard by which a cut may move so that equal texts stay in one shard.
TOLERANCE = 0.01


def byte_shards(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Puts every row into one of ``shards`` contiguous shards whose byte sizes are equal up to one row, and numbers its slots.

    Rows stand in the order of (md5 of the text, id): copies of a text are neighbours. Sizes are summed inside ranges of that order and
    the totals of the ranges are summed up, which gives every row the bytes before it; the row belongs to shard
    ``floor(shards * bytes before / all bytes)``. Each cut moves to the nearer edge of the group of equal texts that it would split if that edge
    is at most ``tolerance`` of a shard away; larger groups are split at the cut, so one hot group fills as many shards as it needs.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null: the law is not ``key``).

    Null texts have the size of the row bytes and no digest, and stand first; null ids stand first inside their group; equal rows are placed one
    after the other, each in a slot of its own. An empty table gives no row. Other columns are not read.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                        F.crc32(F.col(text).cast("binary")).alias("text_crc32"), F.md5(F.col(text).cast("binary")).alias("digest"))
    placed = cut_lineage(running_totals(sized.withColumn("one", F.lit(1).cast("long")), ["digest", "doc_id"], {"before": "size", "index": "one"}))
    total = placed.agg(F.sum("size").alias("total"))
    # one row a cut: where it falls, and the group that it would split
    cuts = total.where("total > 0").select(F.explode(F.sequence(F.lit(1), F.lit(shards - 1))).alias("cut"), "total") if shards > 1 else total.where("false").select(F.lit(1).alias("cut"), "total")
    cuts = cuts.select("cut", (F.col("total") * F.col("cut") / F.lit(float(shards))).alias("at"), (F.lit(tolerance) * F.col("total") / shards).alias("slack"))
    split = (placed.join(F.broadcast(cuts), (F.col("before") < F.col("at")) & (F.col("at") < F.col("before") + F.col("size")), "inner")
             .select("cut", "digest"))
    edge_at = (placed.join(F.broadcast(split.select("digest").distinct()), "digest")  # at most one group a cut
               .groupBy("digest").agg(F.min("before").alias("start"), F.max(F.col("before") + F.col("size")).alias("stop")))
    near = F.when(F.col("at") - F.col("start") <= F.col("stop") - F.col("at"), F.col("start")).otherwise(F.col("stop"))
    moved = (cuts.join(split, "cut", "left").join(edge_at, "digest", "left")
             .select("cut", F.when(F.abs(near - F.col("at")) <= F.col("slack"), near.cast("double")).otherwise(F.col("at")).alias("at")))
    bounds = moved.agg(F.sort_array(F.collect_list("at")).alias("bounds"))  # shards - 1 numbers
    sharded = placed.crossJoin(F.broadcast(bounds)).withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("before"))))
    first = sharded.groupBy("shard").agg(F.min("index").alias("first"))
    return (sharded.join(F.broadcast(first), "shard")  # one row a shard
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
