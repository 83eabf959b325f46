"""Monthly series written once and dealt by key: parts bounded in rows, history and later months as joined before, one sum of line items a query."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelloom.functions import session
from panelloom.operators import ensemble as en, forecast as fc
from panelloom.plans import base, q_j_regimes, q_k_forecast as qk, q_l_ensemble as ql  # noqa: F401


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


@pytest.fixture
def series(spark):
    """Key 1 whole, key 2 with gaps around its origin, key 3 shorter than the held months, key 4 with null values; rows without key or month."""
    rows = [(1, month(i), 10.0 + i + i % 3) for i in range(30)] + [(2, month(i), 50.0 - i) for i in range(30) if i not in (21, 22, 23, 26)]
    rows += [(3, month(i), 5.0) for i in range(3)] + [(4, month(i), None if i % 4 == 0 else 7.0 + i) for i in range(20)]
    rows += [(None, month(i), 3.0) for i in range(20)] + [(1, None, 9.0), (None, None, 1.0)]
    return spark.createDataFrame(rows, "key long, date date, value double")


def joined(series):
    """The history as it was joined to the origin of each key."""
    return series.join(series.groupBy("key").agg(F.add_months(F.max("date"), -qk.H).alias("origin")), "key").where("date <= origin").drop("origin")


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_parts_are_bounded_in_rows(spark, monkeypatch):
    """Repeated values compress to next to nothing, so that partitions merged by size would be one."""
    monkeypatch.setattr(session, "PART_ROWS", 2000)
    table = session.cut_lineage(spark.range(40000).select((F.col("id") % 4000).alias("key"), F.lit(1.0).alias("value")))
    part = session.dealt(table, "key").groupBy("key").agg(F.sum("value").alias("n")).withColumn("part", F.spark_partition_id())
    sizes = [r.n for r in part.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 20 and sum(sizes) == 40000 and max(sizes) <= 4000
    assert session.dealt(session.cut_lineage(table.limit(0)), "key").count() == 0


def test_history_and_later_months_as_joined(series):
    history, later = qk.held(series)
    assert rows(history.select("key", "date", "value")) == rows(joined(series).select("key", "date", "value"))
    known = rows(series.where("key is not null and date is not null"))
    assert rows(history.unionByName(later).select("key", "date", "value")) == known


def test_scores_on_later_months_equal_scores_on_all_months(series):
    history, later = qk.held(series)
    now = en.performance(fc.forecast_many(history, ql.MODELS, qk.H), later)
    old = en.performance(fc.forecast_many(joined(series), ql.MODELS, qk.H), series)
    assert rows(now) == rows(old.select(*now.columns)) and now.count() > 0


@pytest.mark.parametrize("name", ["j13_weight_tilt", "l02_ensemble_weights"])
def test_line_items_are_summed_once(spark, tmp_path, monkeypatch, name):
    """What is fitted and joined reads the written months; the rows of the result come from bounded parts."""
    monkeypatch.setattr(session, "PART_ROWS", 100)
    items = spark.range(2400).select((F.col("id") % 20).alias("l_suppkey"), F.add_months(F.lit(dt.date(2000, 1, 1)), (F.col("id") / 20 % 40).cast("int")).cast("timestamp").alias("l_shipdate"),
                                     (100 + F.col("id") % 97 + F.col("id") / 50).alias("l_extendedprice"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = base.QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "RepartitionByExpression" in plan
    weight = "tilted" if name.startswith("j13") else "weight"
    by = ["key"] if name.startswith("j13") else ["key", "method"]
    assert out.select("key").distinct().count() == 20
    assert all(abs(r.s - 1) < 1e-5 for r in out.groupBy(*by).agg(F.sum(weight).alias("s")).collect())
