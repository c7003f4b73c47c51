"""Exact ranks and running totals within groups of any size, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: list[Column], rows: Column, weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows that come before a row in its group of ``keys``.

    ``rows`` says about how many rows the group has. A group is dealt over about
    the square root of that by a hash of ``order``, which gives the sequence of
    the bins; within a bin, ``order`` does. Sums within a bin and the bins' sums
    are added up, so that no task gets a large group whole. Rows equal in
    ``order`` get any of their places.
    """
    bins = F.greatest(F.ceil(F.sqrt(rows / F.lit(4.0))).cast("long"), F.lit(1).cast("long"))
    binned = df.withColumns({"_bin": F.pmod(F.xxhash64(F.lit(7), *order), bins), "_weight": weight.cast("long")})
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_at_{k}") for k in keys], F.col("_bin").alias("_at_bin"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys] + [F.col("_bin") == F.col("_at_bin")]
    return placed.join(sums, same, "inner").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def group_ranks(df: DataFrame, keys: list[str], order: list[Column], rows: Column, name: str = "rank") -> DataFrame:
    """Add ``name``: each row's place from 0, without gaps, in its group of ``keys``."""
    return running_total(df, keys, order, rows, F.lit(1), name)
