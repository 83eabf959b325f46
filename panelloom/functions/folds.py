"""Sequential recurrences over one entity's ordered history as a single array fold inside the JVM.

An entity has one row per period, so its array is bounded by the calendar whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Step = Callable[[Column, Column], dict[str, Column]]


def scan(rows: Column, init: dict[str, Column], step: Step, emit: Step, out_type: str) -> Column:
    """Running fold: ``step`` maps (state, row) to the next state, ``emit`` maps (next state, row) to one output struct."""
    def struct(fields: dict[str, Column]) -> Column:
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def advance(acc: Column, row: Column) -> Column:
        after = struct(step(acc["s"], row))
        # The next state is bound once through a one-element array, so its expression is not repeated in the output.
        return F.element_at(F.transform(F.array(after), lambda s: F.struct(
            s.alias("s"), F.concat(acc["o"], F.array(struct(emit(s, row)))).alias("o"))), 1)

    empty = F.from_json(F.lit("[]"), f"array<struct<{out_type}>>")
    return F.aggregate(rows, F.struct(struct(init).alias("s"), empty.alias("o")), advance, lambda acc: acc["o"])


def ordered_rows(df: DataFrame, key: Sequence[str], order: str, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per key with ``_rows``: an array of row structs sorted by ``order``."""
    fields = [c for c in (fields or df.columns) if c not in key and c != order]
    picked = F.struct(F.col(order), *[F.col(f"`{f}`") for f in fields])
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(picked)).alias("_rows"))


def scan_rows(df: DataFrame, key: Sequence[str], order: str, init: dict[str, Column], step: Step, emit: Step, out_type: str) -> DataFrame:
    """Every input row with all its columns, plus the emitted ones: one shuffle by key, no join back."""
    rows = ordered_rows(df, key, order)
    outs = scan(F.col("_rows"), init, step, emit, out_type)
    done = rows.select(*key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), outs.alias("o"))).alias("_e"))
    return done.select(*key, "_e.r.*", "_e.o.*")


def fold(rows: Column, init: dict[str, Column], step: Step, finish: Callable[[Column], Column]) -> Column:
    """Final value only."""
    start = F.struct(*[v.alias(k) for k, v in init.items()])
    return F.aggregate(rows, start, lambda s, x: F.struct(*[v.alias(k) for k, v in step(s, x).items()]), finish)
