"""Joins on keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage, spread

#: A key is hot with more rows than this part (a quarter) of what a shuffle partition holds on average; so there are at most 4 for each partition.
HOT_SHARE = 4


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on the columns ``on``, the rows of hot keys dealt over several tasks.

    A key that has more than its share of ``left``'s rows gets as many salts as
    a partition's share goes into its rows; ``spread`` (of ``left``'s columns,
    the same on a rerun) deals its rows over them and ``right``'s rows of that
    key are there once for each. Only the hot keys are broadcast: at most
    HOT_SHARE for each shuffle partition, whatever the data. ``counts``
    (``on``, n) saves the count of left's keys where it is known. ``how`` is
    inner or left. Null keys match nothing, as in any join.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    spark = left.sparkSession
    shares = HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*on, "n")
    total = held.agg(F.sum("n")).first()[0] or 0
    free = _free_name([*left.columns, *right.columns])
    salts = F.ceil(F.col("n") * shares / F.lit(max(1, total))).cast("int")
    hot = held.filter(F.col("n") * shares > F.lit(total)).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).select(*on, salts.alias(free))
    hot = F.broadcast(hot)
    dealt = left.join(hot, on, "left").withColumn(free, F.coalesce(F.pmod(spread, F.col(free)), F.lit(0)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(free), F.lit(1)) - 1))
    spread_out = right.join(hot, on, "left").withColumn(free, copies)
    return dealt.join(spread_out, [*on, free], how).drop(free)


#: Rows that are broadcast after they were counted.
MOST_BROADCAST = 1 << 16


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "left", most: int = MOST_BROADCAST, counts: DataFrame | None = None) -> DataFrame:
    """``left`` with what ``right`` says of its keys: broadcast where ``right`` has at most ``most`` rows by count, else a salted_join.

    That one counts left's keys, and has left's plan in its own three times;
    where ``left`` is a join itself, give it the ``counts``.
    """
    return left.join(F.broadcast(right), on, how) if right.count() <= most else salted_join(left, right, on, spread, how, counts)


#: Bytes of keys, by their mean, that are broadcast with what is known of them.
MOST_BYTES = 1 << 25


def once_each(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with the columns that ``work`` adds, which follow from the strings ``keys`` alone.

    Values and texts that many rows share are worked on once, written and
    broadcast, where one pass over the keys estimates at most ``most`` different
    ones of ``most_bytes``, and on average two rows or more for each; else
    ``work`` sees every row. Null keys are a value like any other.
    """
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in keys])
    found = df.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n"), F.avg(size).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    if not found["rows"] or found["n"] > most or found["n"] * found["size"] > most_bytes or found["n"] * 2 > found["rows"]:
        return work(df)
    each = cut_lineage(work(spread(df.select(*keys).distinct())))
    added = [c for c in each.columns if c not in keys]
    left = df.drop(*added)
    names = []
    for _ in keys:
        names.append(_free_name([*left.columns, *added, *names], "key"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return left.join(F.broadcast(each.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *added)), same, "left").drop(*names)


def _free_name(taken: list[str], name: str = "salt") -> str:
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name
