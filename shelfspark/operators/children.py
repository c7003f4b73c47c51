"""Child rows (images, lines, turns) and their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import trimmed


def source_text(df: DataFrame, key: str, order: str, lines: str, sep: str = " | ", clip: int = 1500) -> DataFrame:
    """Each parent's lines from all children in order, repeats removed keeping the first, joined and clipped."""
    whole = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, lines))).alias("all"))
    flat = F.filter(F.flatten(F.transform("all", lambda s: s[lines])), lambda x: trimmed(x) != "")
    return whole.select(key, F.substring(F.array_join(F.array_distinct(flat), sep), 1, clip).alias("source"))


def complete_parents(done: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Parents of which every child in ``index`` is in ``done``."""
    want = index.groupBy(key).agg(F.count(F.lit(1)).alias("want"))
    have = done.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    return want.join(have, key).filter("want = have").select(key)


def image_stats(index: DataFrame, key: str) -> DataFrame:
    """Images of each parent, how many are high-resolution, whether any and all are."""
    return index.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_hires").alias("n_hires"), F.bool_or("is_hires").alias("any_hires"), F.bool_and("is_hires").alias("all_hires"))


def evidence_by_parent(df: DataFrame, key: str, order: str, evidence: str) -> DataFrame:
    """Each parent's evidence texts in order, as '[order] text' joined by ' | '."""
    whole = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, evidence))).alias("all"))
    return whole.select(key, F.array_join(F.transform("all", lambda s: F.concat(F.lit("["), s[order].cast("string"), F.lit("] "), F.coalesce(s[evidence], F.lit("")))), " | ").alias("evidence"))


def extra_info_share(df: DataFrame, key: str, order: str, labels: list[str]) -> DataFrame:
    """Of the parents with any label, the share in which other children add labels that the main one (order 0) lacks."""
    def tagged(c: str):
        return F.transform(c, lambda x: F.concat(F.lit(f"{c}="), x))

    own = F.concat(*[tagged(c) for c in labels])
    flat, main = F.flatten(F.collect_list(own)), F.flatten(F.collect_list(F.when(F.col(order) == 0, own)))
    each = df.groupBy(key).agg(F.array_distinct(flat).alias("all"), F.coalesce(main, F.array().cast("array<string>")).alias("main"))
    return each.filter(F.size("all") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.size(F.array_except("all", "main")) > 0, 1.0).otherwise(0.0)).alias("share"))
