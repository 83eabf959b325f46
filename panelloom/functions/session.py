"""Session helpers: lineage cuts and size-checked broadcast."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster session without it is refused, because
    other executors could not read a local path.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="panelloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_RUNS: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This session's own folder inside the shared one; intermediate tables and files go there until ``release``."""
    name = _RUNS.setdefault(spark.sparkContext.applicationId, f"run-{uuid.uuid4().hex}")
    return f"{shared_folder(spark)}/{name}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session. Results that were not written or collected yet still need them."""
    if spark.sparkContext.applicationId in _RUNS:
        path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _RUNS[spark.sparkContext.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files.

    Later steps neither plan nor recompute what came before, a lost executor loses nothing, only the columns used are read
    back, and the optimizer knows the real size of the table when it picks a join.
    """
    path = f"{run_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part that ``dealt`` makes.
PART_ROWS = 250_000


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A table read from files, dealt by ``keys`` into as many parts as its rows need.

    Partitions left to Spark are merged by compressed size, which says little about rows where values repeat; a task that sorts
    or joins its part then needs memory by the size of the table. Rows are counted from the files' footers.
    """
    return table.repartition(max(1, math.ceil(table.count() / PART_ROWS)), *keys)


def calendar_side(df: DataFrame, roles_by: tuple[str, ...] | list[str]) -> DataFrame:
    """Broadcast a one-row-per-period table when nothing but the calendar multiplies it.

    Without ``by`` columns the table holds one row per year, so the hint is safe at any scale. With them its size depends on
    the data, and the join strategy is left to the optimizer, which checks the size at run time.
    """
    return F.broadcast(df) if not roles_by else df


def with_row(df: DataFrame, row: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the columns of a one-row aggregate (or a definition-sized table) to every row by an equi-join on a constant.

    ``row`` comes from an aggregate without keys, or holds one row per year, indicator or scenario definition: its size does not
    grow with the data, so it is broadcast.
    """
    one = F.lit(1)
    return df.withColumn("_one", one).join(F.broadcast(row.withColumn("_one", one)), "_one", how).drop("_one")
