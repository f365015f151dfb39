"""Exact ordering work (ordinals, running totals) without one-task groups.

A plain ``Window.partitionBy(key).orderBy(...)`` sends all rows of a key to one
task, so a key holding a third of the table stalls the job.  Here the order axis
is cut into slices; work inside a slice is a small window, and what carries over
between slices is one row per (key, slice).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SLICES = 64
# Longer inputs are cut finer: a slice for so many rows, up to MAX_SLICES.
SLICE_ROWS = 100_000
MAX_SLICES = 4096


def order_bounds(df: DataFrame, order: str, slices: int = DEFAULT_SLICES) -> list:
    """Ascending cut points, about evenly filled; more than ``slices`` parts only for
    inputs of more than ``slices * SLICE_ROWS`` rows.

    Runs one aggregate job.  The bounds are literals afterwards, so every branch
    of a plan (and every recomputation after a lost executor) slices alike.
    """
    if slices <= 1:
        return []
    finest = max(slices, MAX_SLICES)
    shares = F.array(*[F.lit(i / finest) for i in range(1, finest)])
    row = df.agg(F.percentile_approx(F.col(order), shares, 10_000).alias("b"), F.count("*").alias("n")).first()
    parts = min(finest, max(slices, row["n"] // SLICE_ROWS))
    fine = row["b"] or []
    return sorted({fine[finest * i // parts - 1] for i in range(1, parts)}) if fine else []


def slice_of(order: Column, bounds: Sequence) -> Column:
    """Number of bounds not above ``order``: a balanced decision tree, so a row
    costs log2(slices) comparisons inside codegen."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def order_micros(df: DataFrame, name: str) -> Column:
    """A timestamp column as microseconds that sort like the column.

    A timestamp without zone is read field by field: casting it to one with a
    zone would not keep the order where clocks are set back."""
    ts = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(ts)
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return seconds * 1_000_000 + micros


def slice_number(value, bounds: Sequence) -> int:
    """Driver-side twin of :func:`slice_of`, used by the tests."""
    return bisect_right(list(bounds), value)


def hash_slice(*columns: Column, bits: int = 12) -> Column:
    """Slice of an md5-ordered axis: its first ``bits`` bits, uniform by design."""
    digest = F.md5(F.concat_ws("|", *columns))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("int")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``totals`` per ``keys`` in ``order``.

    ``slice_col`` must not decrease along ``order``.  The carried-over part is
    one row per (keys, slice); its window holds at most the number of slices.
    """
    keys = list(keys)
    names = list(totals)
    measured = df.select("*", *[c.alias(f"_m_{n}") for n, c in totals.items()])
    per_slice = measured.groupBy(*keys, slice_col).agg(
        *[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names]
    )
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = per_slice.select(
        *keys,
        slice_col,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names],
    )
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        measured.select(
            "*", *[F.sum(f"_m_{n}").over(inside).alias(f"_i_{n}") for n in names]
        )
        .join(carried, [*keys, slice_col])
        .select(
            *df.columns,
            *[(F.col(f"_i_{n}") + F.col(f"_c_{n}")).alias(n) for n in names],
        )
    )
