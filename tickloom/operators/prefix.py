"""Running sums of a key's rows in slices, so that one long key is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: list[str], at: str, order: list[str], sums: dict[str, Column], slice_width: int) -> DataFrame:
    """df with a running sum for each of sums, over the rows of the same keys up to each row in the given order, which begins with at.

    Rows are dealt by keys and slice_width of at, and summed in each slice; the slices' totals, one row a slice, are summed over the slices; each slice
    then adds what came before it. Null keys are keys, null summands count nothing, rows without at come first. Doubles may differ in their last places
    from a sum row by row.
    """
    add = {f"_add {n}": c for n, c in sums.items()}
    own = df.withColumns(add | {"_own slice": F.coalesce(F.floor(F.col(at) / slice_width), F.lit(-(2**62)))})
    inside = Window.partitionBy(*keys, "`_own slice`").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = own.groupBy(*(F.col(k).alias(f"_key {k}") for k in keys), F.col("`_own slice`").alias("_key and slice")).agg(*(F.sum(f"`_add {n}`").alias(f"_all {n}") for n in sums))
    earlier = Window.partitionBy(*(F.col(f"`_key {k}`") for k in keys)).orderBy("`_key and slice`").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(*(F.col(f"`_key {k}`") for k in keys), "`_key and slice`", *(F.coalesce(F.sum(f"`_all {n}`").over(earlier), F.lit(0)).alias(f"_before {n}") for n in sums))
    same = F.col("`_own slice`") == F.col("`_key and slice`")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"`_key {k}`"))
    here = own.withColumns({n: F.sum(f"`_add {n}`").over(inside) for n in sums}).join(handed, same)
    return here.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"`_before {n}`") for n in sums}).select(*df.columns, *sums)
