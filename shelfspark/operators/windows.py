"""Indexes, draws, samples and bins over ordered rows, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage


def dense_index(df: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """0..n-1 in each group of ``by``, ordered by ``order`` and then all columns.

    Rows are dealt by range of (by, order) and numbered within a partition; the
    counts of the partitions before a row's are added. Rows equal in all columns
    are interchangeable. The dealt rows are written once, as both passes must
    see the same partitions.
    """
    sort = [*by, *order, *[c for c in df.columns if c not in [*by, *order]]]
    dealt = df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    one = Window.partitionBy("_part", *by).orderBy(*sort)
    counts = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    placed = dealt.withColumn("_row", F.row_number().over(one) - 1)
    keys = ["_part", *by]
    starts = starts.select(*[F.col(k).alias(f"s{k}") for k in keys], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]
    return placed.join(F.broadcast(starts) if not by else starts, same).select(*df.columns, (F.col("_row") + F.col("_start")).alias(name))


def md5_number(*parts: Column | str) -> Column:
    """A number of 32 bits from strings, the same in SQL: the first 8 hexadecimal digits of the md5 of parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def consecutive_pairs(inter: DataFrame, min_gap_ms: int) -> DataFrame:
    """Each user's neighbouring purchases in a segment, by time and item, with at least the gap between them."""
    w = Window.partitionBy("segment", "user_id").orderBy("ts", "item_id")
    nexts = inter.select("segment", "user_id", F.col("item_id").alias("first"), F.lead("item_id").over(w).alias("second"), (F.lead("ts").over(w) - F.col("ts")).alias("gap_ms"))
    return nexts.filter(F.col("gap_ms") >= min_gap_ms)


def popularity_draw(pairs: DataFrame, inter: DataFrame, seed: int = 42) -> DataFrame:
    """For each pair an item at random, in proportion to purchases in the segment, with replacement: ``rand``.

    Purchases are indexed by (ts, user, item); a pair draws an index by the md5
    of (seed, user, first, second).
    """
    index = dense_index(inter.select("segment", "ts", "user_id", "item_id"), ["segment"], ["ts", "user_id", "item_id"])
    sizes = inter.groupBy("segment").agg(F.count(F.lit(1)).alias("size"))
    draw = md5_number(F.lit(str(seed)), *[F.col(c).cast("string") for c in ("user_id", "first", "second")])
    drawn = pairs.join(F.broadcast(sizes), "segment").withColumn("idx", F.pmod(draw, F.col("size"))).drop("size")
    return drawn.join(index.select("segment", "idx", F.col("item_id").alias("rand")), ["segment", "idx"]).drop("idx")


def quantile_bins(df: DataFrame, column: str, bins: int, tie: str, name: str = "bin") -> DataFrame:
    """1..bins by rank of ``column`` (ties by ``tie``), in equal widths of rank with interpolated edges."""
    n = df.count()
    ranked = dense_index(df, [], [column, tie], "_rank")
    return ranked.withColumn(name, F.greatest(F.lit(1), F.ceil(F.col("_rank") * bins / F.lit(max(n - 1, 1)))).cast("int")).drop("_rank")


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all of a smaller one), first by the md5 of (seed, key)."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).filter(F.col("_r") <= n).drop("_r")


def head_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``name`` keeps their place from 1."""
    ranked = df.withColumn(name or "_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name or "_r") <= n)
    return ranked if name else ranked.drop("_r")
