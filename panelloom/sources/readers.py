"""Sources: CSV with a named encoding, Parquet, and the schema steps that bring a table to the long panel form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from panelloom.roles import DEFAULT, Roles, setting

# Names that are taken for a role when matched exactly, and the fragment that matches anywhere.
SYNONYMS = {
    "year": (["year", "yr", "date", "time_period", "period"], "year"),
    "value": (["value", "amount", "total", "market_size", "revenue", "sales"], "value"),
    "type": (["type", "category", "forecast_type", "data_type"], "type"),
    "name": (["country", "nation", "country_name", "region"], "country"),
    "id": (["id", "country_id", "geo_id", "code", "country_code"], "id"),
}
TABLE_ROLES = {
    "global": ("year", "value", "type"),
    "panel": ("year", "value", "name", "id"),
    "indicator": ("year", "value", "name", "id"),
}
YEAR_COLUMNS = range(1900, 2101)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_csv_any(spark: SparkSession, path: str | list[str], fallback: str = "ISO-8859-1", schema=None) -> DataFrame:
    """CSV files of mixed encodings: each file that is not valid UTF-8 is read in the fallback encoding, which takes every byte.

    One text scan marks the files that are not valid; the driver gets their names only.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("broken"))
    files = lines.groupBy("file").agg(F.max("broken").alias("broken")).collect()
    groups = [(encoding, [r["file"] for r in files if r["broken"] == broken]) for encoding, broken in (("UTF-8", False), (fallback, True))]
    frames = [read_csv(spark, own, encoding, schema) for encoding, own in groups if own]
    if not frames:
        return read_csv(spark, path, "UTF-8", schema)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def standard_names(columns: list[str], kind: str, roles: Roles = DEFAULT) -> dict[str, str]:
    """Old name to role name. The first matching column wins a role, and a column is given at most one role."""
    names, taken = {}, set()
    for role in TABLE_ROLES[kind]:
        exact, fragment = SYNONYMS[role]
        for c in columns:
            if c not in taken and (c.lower() in exact or fragment in c.lower()):
                names[c] = getattr(roles, role)
                taken.add(c)
                break
    return names


def standardize(df: DataFrame, kind: str, roles: Roles = DEFAULT) -> DataFrame:
    """Rename by synonym. Looks at the schema only and starts no job."""
    names = standard_names(df.columns, kind, roles)
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def year_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.strip().isdigit() and int(c) in YEAR_COLUMNS]


def is_wide(df: DataFrame) -> bool:
    return bool(year_columns(df.columns))


def wide_to_long(df: DataFrame, roles: Roles = DEFAULT, drop_nulls: bool = False) -> DataFrame:
    years = year_columns(df.columns)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in years]
    long = df.unpivot(keep, [F.col(f"`{y}`") for y in years], roles.year, roles.value)
    long = long.withColumn(roles.year, F.col(roles.year).cast("int"))
    return long.dropna(subset=[roles.value]) if drop_nulls else long


def to_long(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return wide_to_long(df, roles) if is_wide(df) else df


def long_to_wide(df: DataFrame, years: list[int] | None = None, how: str = "sum", roles: Roles = DEFAULT, keys: list[str] | None = None) -> DataFrame:
    """Years as columns: all that the rows hold (one small aggregate), or those of a list, which leaves the others out.

    A mean is the sum as a decimal over the count, so it does not depend on the order of rows.
    """
    keys = keys or [*roles.by, roles.id, roles.name]
    if years is None:
        years = [r[0] for r in df.select(roles.year).where(F.col(roles.year).isNotNull()).distinct().orderBy(roles.year).collect()]  # a calendar
    measure = F.sum(roles.value) if how == "sum" else F.sum(F.col(roles.value).cast("decimal(28,6)")).cast("double") / F.count(roles.value)
    return df.groupBy(*keys).pivot(roles.year, years).agg(measure)


def coerce_numbers(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Lenient casts. Bad text becomes null and the row is dropped; ``strict`` makes the row raise instead."""
    for c, t in types.items():
        number = F.col(c).try_cast(t)
        if strict:
            broken = F.col(c).isNotNull() & number.isNull()
            number = F.when(broken, F.raise_error(F.concat(F.lit(f"{c} is not {t}: "), F.col(c).cast("string"))).cast(t)).otherwise(number)
        df = df.withColumn(c, number)
    return df if strict else df.dropna(subset=list(types))


def label_type(df: DataFrame, horizon: int, roles: Roles = DEFAULT) -> DataFrame:
    return df.withColumn(roles.type, F.when(F.col(roles.year) < horizon, "Historical").otherwise("Forecast"))


def with_growth(df: DataFrame, out: str = "growth_rate", roles: Roles = DEFAULT) -> DataFrame:
    """Growth in % against the previous row of the total series, 0 where there is none or it was 0."""
    before = F.lag(roles.value).over(W.partitionBy(*roles.by).orderBy(roles.year))
    return df.withColumn(out, F.coalesce((F.try_divide(F.col(roles.value), before) - 1) * 100, F.lit(0.0)))


def tag_indicators(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of indicator tables in long form with an ``indicator`` column."""
    tagged = [df.withColumn("indicator", F.lit(name)) for name, df in tables.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def years_of(df: DataFrame, kind: str | None = None, roles: Roles = DEFAULT) -> DataFrame:
    """Distinct years, of one type if named."""
    if kind is not None:
        df = df.where(F.col(roles.type) == kind)
    return df.select(*roles.by, roles.year).distinct()


def entities_of(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return df.select(roles.id, roles.name).distinct()


def latest_slice(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows of the latest year of each market, found by an aggregate of one row per market."""
    last = df.groupBy(*roles.by).agg(F.max(roles.year).alias(roles.year))
    if not roles.by:
        last = F.broadcast(last)
    return df.join(last, [*roles.by, roles.year], "left_semi")


def mapped(df: DataFrame, config: dict, source: str) -> DataFrame:
    """The table with its columns renamed by ``column_mapping.<source>`` (logical to actual name, found at any letter case); the others keep their names.

    Only renames, so no column is read that the query does not use. A logical column whose actual one is missing raises, with the names that the table has; so does a
    column that is mapped twice, or a logical name that an unmapped column already has.
    """
    found = {c.lower(): c for c in df.columns}
    names = {k: v for k, v in setting(config, f"column_mapping.{source}", {}).items() if isinstance(v, str)}
    missing = [f"{k}: {v}" for k, v in names.items() if v.lower() not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}; the table has {', '.join(df.columns)}")
    logical = {found[v.lower()]: k for k, v in names.items()}
    renamed = [logical.get(c, c) for c in df.columns]
    if len(logical) < len(names) or len({c.lower() for c in renamed}) < len(renamed):
        raise ValueError(f"{source}: two columns for one name in {', '.join(renamed)}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, renamed)])
