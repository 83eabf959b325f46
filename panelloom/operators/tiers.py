"""Tier classification with MLlib clusters, and tier statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import gram, stats
from panelloom.functions.session import cut_lineage
from panelloom.sources.readers import latest_slice
from panelloom.roles import DEFAULT, Roles


def pipeline(features: list[str], k: int, weights: dict[str, float] | None = None, method: str = "kmeans", dimensions: int | None = None, seed: int = 7) -> Pipeline:
    from pyspark.ml.feature import SQLTransformer
    weighted = ", ".join(f"`{f}` * {float((weights or {}).get(f, 1.0))}D AS `_w_{f}`" for f in features)
    stages = [SQLTransformer(statement=f"SELECT *, {weighted} FROM __THIS__"), VectorAssembler(inputCols=[f"_w_{f}" for f in features], outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_std", withMean=True)]
    used = "_std"
    if dimensions is not None and dimensions < len(features):
        stages.append(PCA(k=dimensions, inputCol="_std", outputCol="_pc"))
        used = "_pc"
    model = GaussianMixture if method == "mixture" else KMeans
    stages.append(model(featuresCol=used, predictionCol="cluster", k=k, seed=seed, maxIter=30))
    return Pipeline(stages=stages)


def choose_k(df: DataFrame, features: list[str], ks: range = range(3, 9), **options) -> tuple[int, DataFrame]:
    """Best silhouette over ``ks`` and the table of scores. One distributed fit and score per k on a cut table."""
    rows = cut_lineage(df.select(*features).dropna())
    ks = [k for k in ks if k <= rows.limit(max(ks) + 1).count()] or [1]
    if ks == [1]:
        return 1, df.sparkSession.createDataFrame([(1, None)], "k int, silhouette double")
    scores = []
    for k in ks:
        scored = pipeline(features, k, **options).fit(rows).transform(rows)
        found = scored.select("cluster").distinct().count()
        scores.append((k, float(ClusteringEvaluator(featuresCol="_std", predictionCol="cluster").evaluate(scored)) if found > 1 else -1.0))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    return best, df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def fit(df: DataFrame, features: list[str], k: int | None = None, order_by: str = "market_share", **options) -> tuple[PipelineModel, DataFrame]:
    """Fitted pipeline and (cluster, tier): clusters numbered from 1 by falling mean of ``order_by``."""
    rows = cut_lineage(df.dropna(subset=features))
    k = choose_k(rows, features, **options)[0] if k is None else k
    model = pipeline(features, max(k, 2), **options).fit(rows)
    means = model.transform(rows).groupBy("cluster").agg(F.avg(order_by).alias("_m"))
    return model, means.select("cluster", F.row_number().over(W.orderBy(F.desc("_m"), "cluster")).alias("tier"))


def predict(model: PipelineModel, numbering: DataFrame, df: DataFrame) -> DataFrame:
    """Tier of every row with the fitted scaler and centres (nothing is refitted)."""
    scored = model.transform(df).join(F.broadcast(numbering), "cluster")
    return scored.select(*df.columns, "tier")


def share_tiers(shares: DataFrame, latest_year: int | None = None, k: int | None = None, roles: Roles = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(tiered latest shares, thresholds): clusters of the shares of ``latest_year``, or of each market's last one, thresholds from the edges of the clusters.

    First tier: its lowest share. Middle tiers: root of own lowest times next tier's highest. Last tier: 0.3 of its lowest, at
    least 0.01.
    """
    latest = cut_lineage(latest_slice(shares, roles) if latest_year is None else shares.where(F.col(roles.year) == latest_year))
    model, numbering = fit(latest, ["market_share"], k)
    tiered = cut_lineage(predict(model, numbering, latest))
    edges = tiered.groupBy("tier").agg(F.min("market_share").alias("low"), F.max("market_share").alias("high"), F.count(F.lit(1)).alias("entities"))
    w = W.orderBy("tier")
    last = F.col("tier") == F.max("tier").over(W.partitionBy())
    threshold = F.when(F.col("tier") == 1, F.col("low")).when(last, F.greatest(F.col("low") * 0.3, F.lit(0.01))).otherwise(F.sqrt(F.col("low") * F.lead("high").over(w)))
    return tiered, edges.withColumn("threshold", threshold)


#: Shares (in percent) are told apart to this fraction. Distinct shares of a market add up to at most 100, so a market has at most about 1,400 of them.
RESOLUTION = 1e-4


def _partitions(u: np.ndarray, n: np.ndarray, most: int) -> list[list[int]]:
    """Cuts of the sorted distinct values into 1, 2 … ``most`` runs with the least sum of squared distances from the run's mean (exact, all numbers of runs in one pass)."""
    m = len(u)
    count, total, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * u, n * u * u))
    best = np.full((most + 1, m + 1), np.inf)
    came = np.zeros((most + 1, m + 1), int)
    best[0, 0] = 0.0
    for j in range(1, m + 1):
        sums = total[j] - total[:j]
        cost = np.maximum(squares[j] - squares[:j] - sums * sums / (count[j] - count[:j]), 0.0)
        through = best[:-1, :j] + cost
        came[1:, j] = np.argmin(through, axis=1)
        best[1:, j] = through[np.arange(most), came[1:, j]]
    out = []
    for k in range(1, most + 1):
        cuts, j = [m], m
        for left in range(k, 0, -1):
            j = int(came[left, j])
            cuts.append(j)
        out.append(cuts[::-1])
    return out


def _scores(u: np.ndarray, n: np.ndarray, cuts: list[int]) -> tuple[float, float | None]:
    """Sum of squared distances and mean silhouette (squared distances, a value alone in its run counts 0) of one partition."""
    label = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    count, total, squares = (np.bincount(label, x) for x in (n, n * u, n * u * u))
    error = float(np.maximum(squares - total * total / count, 0.0).sum())
    if len(count) == 1:
        return error, None
    apart = np.maximum(count[None] * (u * u)[:, None] - 2 * u[:, None] * total[None] + squares[None], 0.0)
    own = np.arange(len(u)), label
    inner = apart[own] / np.maximum(count[label] - 1, 1)
    mean = apart / count[None]
    mean[own] = np.inf
    outer = mean.min(axis=1)
    s = np.where(count[label] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
    return error, float((s * n).sum() / n.sum())


def exact_partitions(shares: DataFrame, ks: range = range(3, 9), share: str = "market_share", roles: Roles = DEFAULT) -> DataFrame:
    """(by…, k, error, silhouette, tiers) of each market's shares for every k in ``ks``: the partition into k tiers of least squared error, found exactly.

    ``tiers`` is an array of (tier, low, high, entities), tier 1 the highest. Shares are rounded to ``RESOLUTION`` and counted first (inside tasks, before the shuffle), so a market
    is one row of its distinct shares however many entities it has. ``k`` above the number of distinct shares is left out; a market with fewer than the least k has one row with k = 1.
    Null, NaN and negative shares are left out.
    """
    by = list(roles.by)
    keys = by or ["_all"]
    v = F.col(share).cast("double")
    rows = shares.where(v.isNotNull() & ~F.isnan(v) & (v >= 0)).select(*by, *([] if by else [F.lit(0).alias("_all")]), F.round(v / RESOLUTION).cast("long").alias("_u"))
    cells = rows.groupBy(*keys, "_u").agg(F.count(F.lit(1)).alias("_n"))
    markets = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_u", "_n"))).alias("_c"))
    wanted = sorted(set(ks))

    def solve(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for cells_ in batch.column("_c").to_pylist():
            u, n = (np.array([c[f] for c in cells_], dtype=float) for f in ("_u", "_n"))
            own = [k for k in wanted if k <= len(u)] or [1]
            parts, fits = _partitions(u, n, max(own)), []
            for k in own:
                cuts = parts[k - 1]
                error, silhouette = _scores(u, n, cuts)
                tiers = [{"tier": k - i, "low": float(u[a]) * RESOLUTION, "high": float(u[b - 1]) * RESOLUTION, "entities": int(n[a:b].sum())} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                fits.append({"k": k, "error": error * RESOLUTION * RESOLUTION, "silhouette": silhouette, "tiers": tiers[::-1]})
            out.append(fits)
        tier = pa.struct([("tier", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("entities", pa.int64())])
        return {"_f": pa.array(out, pa.list_(pa.struct([("k", pa.int32()), ("error", pa.float64()), ("silhouette", pa.float64()), ("tiers", pa.list_(tier))])))}

    fits = gram.solved(markets, solve, keys, "_f array<struct<k:int,error:double,silhouette:double,tiers:array<struct<tier:int,low:double,high:double,entities:long>>>>")
    return fits.select(*by, F.inline("_f"))


def exact_tiers(shares: DataFrame, ks: range = range(3, 9), share: str = "market_share", roles: Roles = DEFAULT) -> DataFrame:
    """(by…, k, tier, low, high, entities, threshold): tiers of the k of best silhouette (the lowest such k), thresholds from their edges as in ``share_tiers``."""
    by = list(roles.by)
    fits = exact_partitions(shares, ks, share, roles)
    best = fits.groupBy(*by).agg(F.max_by(F.struct("k", "tiers"), F.struct(F.coalesce("silhouette", F.lit(-2.0)), -F.col("k"))).alias("_b"))
    rows = best.where("_b is not null").select(*by, F.col("_b.k").alias("k"), F.col("_b.tiers").alias("_t"), F.inline("_b.tiers"))
    below = F.try_element_at("_t", F.col("tier") + 1)["high"]
    threshold = F.when(F.col("tier") == 1, F.col("low")).when(F.col("tier") == F.col("k"), F.greatest(F.col("low") * 0.3, F.lit(0.01))).otherwise(F.sqrt(F.col("low") * below))
    return rows.select(*by, "k", "tier", "low", "high", "entities", threshold.alias("threshold"))


def importance(df: DataFrame, features: list[str], label: str = "tier", bins: int = 10) -> DataFrame:
    """(feature, importance): mutual information between the binned feature and the label over the entropy of the bins."""
    long = df.unpivot([label], features, "feature", "v").where(F.col("v").isNotNull())
    edges = long.groupBy("feature").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    binned = long.join(edges, "feature").select("feature", label, stats.histogram_bin(F.col("v"), F.col("_a"), F.col("_b"), bins).alias("_bin"), F.lit(1).alias("_n"))
    mi = stats.mutual_information(binned, ["feature"], "_bin", label)
    counts = binned.groupBy("feature", "_bin").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    total = counts.groupBy("feature").agg(F.sum("_c").alias("_t"))
    entropy = counts.join(total, "feature").groupBy("feature").agg((-F.sum(F.col("_c") / F.col("_t") * F.log(F.col("_c") / F.col("_t")))).alias("_h"))
    return mi.join(entropy, "feature").select("feature", F.coalesce(F.when(F.col("_h") > 0, F.col("mutual_information") / F.col("_h")), F.lit(0.0)).alias("importance"))


def profile(df: DataFrame, features: list[str], label: str = "tier") -> DataFrame:
    """(feature, tier, low, mean, high, entities)."""
    return (df.unpivot([label], features, "feature", "v").groupBy("feature", label)
            .agg(F.min("v").alias("low"), F.avg("v").alias("mean"), F.max("v").alias("high"), F.count("v").alias("entities")))


def transition_matrix(df: DataFrame, label: str = "tier", roles: Roles = DEFAULT) -> DataFrame:
    """(from_tier, to_tier, n, probability) between consecutive years of an entity; probabilities of a row sum to 1."""
    w = W.partitionBy(*roles.entity).orderBy(roles.year)
    steps = df.withColumn("_to", F.when(F.lead(roles.year).over(w) == F.col(roles.year) + 1, F.lead(label).over(w))).where(F.col("_to").isNotNull())
    counts = steps.groupBy(F.col(label).alias("from_tier"), F.col("_to").alias("to_tier")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy("from_tier")))


def wide_matrix(cells: DataFrame, tiers: list[int]) -> DataFrame:
    return cells.groupBy("from_tier").pivot("to_tier", tiers).agg(F.first("probability")).fillna(0.0)


def tier_label(tier: Column | str) -> Column:
    return F.concat(F.lit("Tier "), (F.col(tier) if isinstance(tier, str) else tier).cast("string"))
