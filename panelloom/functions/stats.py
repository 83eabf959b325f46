"""Significance of correlations and slopes, and rank measures that never form pairs of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions import order, scalars as S
from panelloom.functions.session import with_row


def _beta_tail(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (x below (a + 1) / (a + b + 2) is the fast side)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log_front = np.array([math.lgamma(i + j) - math.lgamma(i) - math.lgamma(j) for i, j in zip(p.ravel(), q.ravel())]).reshape(p.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_front + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return _beta_tail(df / 2, 0.5, df / (df + t * t))


def p_value(t: Column, df: Column) -> Column:
    """Arrow-batched p-value for result-sized tables (one row per fit), never for raw rows."""
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=t.index)
        ok = t.notna() & df.notna() & (df > 0)
        if ok.any():
            out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
        return out.where(out.notna(), None)
    return p(t, df.cast("double"))


def critical_t(level: float, df: int) -> float:
    """t with two-sided p-value ``level``."""
    low, high = 0.0, 1e4
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(np.array([middle]), np.array([df]))[0] > level else (low, middle)
    return high


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation over n rows, very large for a perfect one."""
    return F.when(n > 2, r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300))))


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Correlation of average ranks per group; ranks come from exact distributed positions."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = order.with_ranks(order.with_ranks(rows, by, F.col("_x"), average="_rx"), by, F.col("_y"), average="_ry")
    return ranked.groupBy(*by).agg(S.corr("_rx", "_ry").alias(out))


def kendall(df: DataFrame, by: list[str], x: str, y: str, out: str = "kendall") -> DataFrame:
    """Tau-b per group without forming pairs of rows.

    Ranks are written in base 16. Two rows differ first at exactly one digit of x and at one digit of y, so counting rows per
    (digit place of x, digit place of y, common prefixes, digits) holds every pair once. Each row adds (digits of x) times
    (digits of y) partial counts, which the map-side aggregation merges before the shuffle; cells of a hot group spread
    over the cluster because the prefixes are part of the key, and a cell group has at most 256 counts.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))

    def dense(side: str) -> DataFrame:
        d = rows.groupBy(*by, side).agg(F.sum("_w").alias("_c"))
        p = order.positions(d.select(*by, side), by, F.col(side))
        return p.select(*by, F.col("_key").alias(side), F.col("_below").alias(f"{side}_r"), F.col("_total").alias(f"{side}_n"))

    ranked = rows.join(dense("_x"), [*by, "_x"]).join(dense("_y"), [*by, "_y"])
    digits = lambda n: F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")) / 4).cast("int"), F.lit(1))
    cells = (ranked.withColumn("_lx", F.explode(F.sequence(F.lit(0), digits(F.col("_x_n")) - 1)))
             .withColumn("_ly", F.explode(F.sequence(F.lit(0), digits(F.col("_y_n")) - 1))))
    right = lambda c, n: F.call_function("shiftright", c, n)
    sx, sy = (right(F.col(f"_{c}_r").cast("bigint"), F.col(f"_l{c}") * 4) for c in ("x", "y"))
    cells = cells.select(*by, "_lx", "_ly", right(sx, F.lit(4)).alias("_px"), right(sy, F.lit(4)).alias("_py"), (sx % 16).alias("_dx"), (sy % 16).alias("_dy"), "_w")
    counted = cells.groupBy(*by, "_lx", "_ly", "_px", "_py", "_dx", "_dy").agg(F.sum("_w").cast("double").alias("_c"))
    squares = (counted.groupBy(*by, "_lx", "_ly", "_px", "_py").agg(F.collect_list(F.struct("_dx", "_dy", "_c")).alias("_m"))
               .where(F.size("_m") > 1))

    def left_of(a: Column) -> Column:
        """Rows left of and under a cell minus rows left of and over it."""
        def signed(b: Column) -> Column:
            side = F.when(b["_dy"] < a["_dy"], b["_c"]).when(b["_dy"] > a["_dy"], -b["_c"]).otherwise(F.lit(0.0))
            return F.when(b["_dx"] < a["_dx"], side).otherwise(F.lit(0.0))
        return F.aggregate("_m", F.lit(0.0), lambda t, b: t + signed(b))

    score = squares.groupBy(*by).agg(F.sum(F.aggregate("_m", F.lit(0.0), lambda t, a: t + a["_c"] * left_of(a))).alias("_s"))

    def ties(side: str) -> DataFrame:
        d = rows.groupBy(*by, side).agg(F.sum("_w").cast("double").alias("_c"))
        return d.groupBy(*by).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias(f"{side}_t"), F.sum("_c").alias(f"{side}_all"))

    # A group without a pair that differs in both columns has no square left: its score is 0.
    joined = ties("_x").join(ties("_y"), by).join(score, by, "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    pairs = F.col("_x_all") * (F.col("_x_all") - 1) / 2
    return joined.select(*by, F.try_divide("_s", F.sqrt((pairs - F.col("_x_t")) * (pairs - F.col("_y_t")))).alias(out))


def histogram_bin(c: Column, low: Column, high: Column, bins: Column | int) -> Column:
    """Bin 0..bins-1 of equal width; the top edge belongs to the last bin, a flat range to bin 0."""
    bins = bins if isinstance(bins, Column) else F.lit(bins)
    return F.when(high > low, F.least(F.floor((c - low) / (high - low) * bins), bins - 1)).when(c.isNotNull(), F.lit(0)).cast("int")


def mutual_information(df: DataFrame, by: list[str], x: str, y: str, n: str = "_n", out: str = "mutual_information") -> DataFrame:
    """Mutual information (nats) per group between two discrete columns; ``n`` holds row counts."""
    cells = df.groupBy(*by, x, y).agg(F.sum(n).cast("double").alias("_c"))
    total = cells.groupBy(*by).agg(F.sum("_c").alias("_t"))
    px, py = (cells.groupBy(*by, c).agg(F.sum("_c").alias(f"_{k}")) for k, c in (("px", x), ("py", y)))
    joined = cells.join(px, [*by, x]).join(py, [*by, y]).join(total, by) if by else cells.join(px, x).join(py, y).transform(with_row, total)
    c, t = F.col("_c"), F.col("_t")
    return joined.groupBy(*by).agg(F.sum(c / t * F.log(c * t / (F.col("_px") * F.col("_py")))).alias(out))
