"""Column expressions for guarded scalar measures. Nothing here starts a job."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low, high) -> Column:
    """Null stays null (``greatest``/``least`` alone would skip it)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def safe_divide(num, den, default: float = 0.0, min_denominator: float = 1e-10) -> Column:
    num, den = col(num), col(den)
    return F.when(F.abs(den) >= min_denominator, F.try_divide(num, den)).otherwise(F.lit(default))


def ratio(num, den) -> Column:
    """Quotient, null where the denominator is zero or null."""
    return F.try_divide(col(num), col(den))


def finite(c) -> Column:
    """NaN and infinities become null, which Spark aggregates skip."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def corr(x, y, over=None) -> Column:
    """Pearson correlation over rows where both sides are known; null where a side does not vary.

    The built-in aggregate divides by zero on a constant side and fails in ANSI mode, so it is written from moments here.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    parts = [F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)]
    c, vx, vy = parts if over is None else [p.over(over) for p in parts]
    return F.when((vx > 0) & (vy > 0), F.try_divide(c, F.sqrt(vx) * F.sqrt(vy)))


def growth_rate(current, previous, annualize: bool = False, periods=1.0, high: float = 500.0, low: float = -99.0) -> Column:
    """Growth in %, 0 for missing input, ``high`` (or 0) where the base is not positive."""
    current, previous = col(current), col(previous)
    raw = (F.try_divide(current, previous) - 1) * 100
    if annualize:
        periods = periods if isinstance(periods, Column) else F.lit(float(periods))
        yearly = (F.pow(1 + raw / 100, F.try_divide(F.lit(1.0), periods)) - 1) * 100
        raw = (F.when((periods <= 0) | (periods == 1), raw).when(raw > -100, yearly).otherwise(F.lit(low)))
    return (F.when(current.isNull() | previous.isNull(), F.lit(0.0))
            .when(previous <= 0, F.when(current > 0, F.lit(high)).otherwise(F.lit(0.0)))
            .otherwise(clip(raw, low, high)))


def cagr_percent(start, end, years, handle_negative: str = "geometric_mean", low: float = -50.0, high: float = 200.0) -> Column:
    """Compound annual growth in %, clipped to [low, high]; null for missing input or a span that is not positive."""
    start, end = col(start), col(end)
    years = years if isinstance(years, Column) else F.lit(float(years))
    exponent = F.try_divide(F.lit(1.0), years)

    def grown(a, b):
        return (F.pow(F.try_divide(b, a), exponent) - 1) * 100

    if handle_negative == "zero":
        negative = F.lit(0.0)
    elif handle_negative == "error":
        negative = F.raise_error(F.lit("growth is undefined for negative values")).cast("double")
    else:
        negative = (F.when((start < 0) & (end < 0), -grown(F.abs(start), F.abs(end)))
                    .when((start < 0) & (end > 0), F.lit(high)).otherwise(F.lit(low)))
    return (F.when(start.isNull() | end.isNull() | years.isNull() | (years <= 0), F.lit(None).cast("double"))
            .when((start < 0) | (end < 0), negative)
            .when(start == 0, F.when(end > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
            .otherwise(clip(grown(start, end), low, high)))


def cagr_fraction(start, end, years) -> Column:
    """Unclipped compound growth as a fraction; -1 when the end is 0, null for bad input."""
    start, end = col(start), col(end)
    years = years if isinstance(years, Column) else F.lit(float(years))
    return (F.when((years > 0) & (start > 0) & (end == 0), F.lit(-1.0))
            .when((years > 0) & (start > 0) & (end > 0),
                  F.pow(F.try_divide(end, start), F.try_divide(F.lit(1.0), years)) - 1))


def z_value(level: float) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def horizon_scale(horizon, method: str = "sqrt_time") -> Column:
    h = col(horizon).cast("double")
    if method == "sqrt_time":
        return F.sqrt(h)
    if method == "linear":
        return h
    if method == "log":
        return F.log(1 + h)
    raise ValueError(f"unknown scaling {method}")


def interval(forecast, horizon, std, level: float = 0.95, method: str = "sqrt_time") -> tuple[Column, Column]:
    """Lower and upper bound; the lower one never drops below 0 for a forecast that is not negative."""
    forecast = col(forecast)
    margin = F.lit(z_value(level)) * col(std) * horizon_scale(horizon, method)
    lower = F.when(forecast >= 0, F.greatest(F.lit(0.0), forecast - margin)).otherwise(forecast - margin)
    return lower, forecast + margin


def currency_label(value, precision: int = 1) -> Column:
    """$ label in billions, millions, thousands or plain. Rounds half up."""
    value = col(value)
    size = F.abs(value)

    def scaled(by: float, unit: str):
        return F.concat(F.lit("$"), F.format_string(f"%.{precision}f", value / by), F.lit(unit))

    return (F.when(value.isNull() | F.isnan(value) | (value == 0), F.lit("$0"))
            .when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K"))
            .otherwise(F.concat(F.lit("$"), F.format_number(value, precision))))


def key_uniform(*parts) -> Column:
    """Reproducible number in [0, 1) from the row's own keys, the same on every run and partitioning."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bands(value, cuts: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """Label of the first cut at or below ``value`` (above it when ``strict``)."""
    value = col(value)
    out = None
    for cut, label in cuts:
        hit = value > cut if strict else value >= cut
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)
