"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.ranks import group_ranks
from shelfspark.operators.windows import dense_index
from shelfspark.session import cut_lineage, ship_package, table

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
#: Sources (a row each) that are broadcast; more are joined.
BROADCAST_SOURCES = 1 << 16
CYCLE = (1, 2, 3)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size): the words each source shall give.

    Shares of the total by weight, none above MOST_REPEATS times its own.
    Sources come by code point, null last, and weigh 1, 2, 3, repeating. What a
    stopped source leaves is shared again by weight until none is above. The
    driver gets a row of sums in each turn.
    """
    placed = dense_index(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in CYCLE]), (F.col("place") % len(CYCLE) + 1).cast("int"))
    placed = cut_lineage(placed.select("source", "source_size", weight.cast("decimal(38,0)").alias("weight"), (F.col("source_size").cast("decimal(38,0)") * MOST_REPEATS).cast("decimal(38,0)").alias("most")))
    sums = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, weights, stopped = int(sums[0] or 0), int(sums[1] or 0), None
    while True:
        each = Fraction(rest, weights or 1)
        above = F.lit(each.numerator).cast("decimal(38,0)") * F.col("weight") > F.lit(each.denominator).cast("decimal(38,0)") * F.col("most")
        above = above if stopped is None else stopped | above
        sums = placed.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count(F.when(above, 1))).first()
        n = int(sums[3])
        if stopped is not None and n == was:
            break
        if stopped is None and not n:
            stopped = F.lit(False)
            break
        stopped, was = above, n
        rest, weights = int(sums[0] or 0) - int(sums[1]), int(sums[2])
    share = F.col("weight").cast("double") * F.lit(float(each))
    return placed.select("source", "source_size", F.when(stopped, F.col("most").cast("double")).otherwise(share).alias("target"))


def fitted_counts(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be found.

    Every length first gives its proportional share, rounded down, so that the
    mix keeps the source's lengths. Of what is left of the budget, long lengths
    give until less than a few of the longest remain; the last stretch is a
    bounded knapsack: the sets of reachable sums are bit sets, a length with c
    documents enters as about log2(c) doubled items, and the reachable sum
    nearest to the rest is traced back. Never more than ``count`` of a length.
    """
    have = int((length * count).sum())
    if budget >= have:
        return count.copy()
    taken = np.array([int(c) * budget // have if have else 0 for c in count], dtype=np.int64)
    spare, rest = count - taken, int(budget - (length * taken).sum())
    longest = int(length.max()) if len(length) else 0
    stretch = 4 * longest
    for i in np.argsort(-length, kind="stable"):
        if rest <= stretch or not length[i]:
            break
        n = min(int(spare[i]), (rest - stretch) // int(length[i]))
        taken[i], spare[i], rest = taken[i] + n, spare[i] - n, rest - n * int(length[i])
    top = rest + longest
    reach, mask = 1, (1 << (top + 1)) - 1
    steps: list[tuple[int, int]] = []
    by = np.full(top + 1, -1, np.int32)  # the step that first reaches each sum
    for i in range(len(length)):
        if not length[i] or reach & (1 << rest):
            continue
        left, k = min(int(spare[i]), top // int(length[i])), 1
        while left > 0:
            n = min(k, left)
            more = (reach << (n * int(length[i]))) & mask & ~reach
            by[_places(more)] = len(steps)
            steps.append((i, n))
            reach, left, k = reach | more, left - n, 2 * k
    low, high = reach & ((1 << (rest + 1)) - 1), reach >> (rest + 1)
    below = low.bit_length() - 1
    above = rest + 1 + ((high & -high).bit_length() - 1) if high else None
    at = above if above is not None and above - rest < rest - below else below
    while by[at] >= 0:  # what a step adds to was reached by an earlier one
        i, n = steps[by[at]]
        at -= n * int(length[i])
        taken[i] += n
    return taken


def _places(bits: int) -> np.ndarray:
    """Where the ones of a bit set are."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8 or 1, "little"), np.uint8), bitorder="little"))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source's histogram: full passes over it, and how many documents of each length come once more."""
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = min(int(target // size), MOST_REPEATS) if size else 0
    budget = int(round(target - passes * size)) if passes < MOST_REPEATS else 0
    pdf["passes"] = passes
    pdf["extra"] = fitted_counts(pdf["size"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64), budget)
    return pdf[["source", "size", "source_size", "target", "docs", "passes", "extra"]]


def _times(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (row, doc_id, source, text) without texts, and size, source_size, target, copy_key and times: how often the mix takes the row."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = cut_lineage(docs.select("row", "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("copy_key")))
    counts = cut_lineage(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")))
    goals = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")))
    goals = cut_lineage(goals.withColumnRenamed("source", "name"))
    few = F.broadcast if goals.count() <= BROADCAST_SOURCES else (lambda df: df)
    histogram = counts.join(few(goals), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    plan = cut_lineage(histogram.groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, docs long, passes long, extra long"))
    plan = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), *plan.columns[2:])
    joined = slim.join(plan, slim["source"].eqNullSafe(plan["p_source"]) & (slim["size"] == plan["p_size"])).drop("p_source", "p_size")
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("docs"))
    settled = joined.filter(~some).withColumn("more", F.when(F.col("extra") > 0, 1).otherwise(0))
    order = [F.xxhash64(F.lit(seed), "doc_id", "copy_key"), F.col("doc_id"), F.col("copy_key")]
    ranked = group_ranks(joined.filter(some), ["source", "size"], order, F.col("docs"), "place")
    ranked = ranked.withColumn("more", F.when(F.col("place") < F.col("extra"), 1).otherwise(0)).drop("place")
    times = F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0).cast("long")
    return settled.unionByName(ranked).select("row", "doc_id", "source", "size", "source_size", "target", "copy_key", times.alias("times"))


def mixed_sources(docs: DataFrame, seed: int = 20) -> DataFrame:
    """Say of each row of ``docs`` (doc_id, text, source, ...) what the mix takes.

    Columns: those of ``docs`` except its text and columns named like the new
    ones (whatever their case; other names may be anything), then size (words; null text: 0), source_size, target, taken (words,
    repeats counted: a multiple of size, up to MOST_REPEATS times it). Documents
    are counted by source and exact length; each source's counts are one group
    of a knapsack plan; the rows of a source and length are ranked by a seeded
    hash of doc_id and the first ones come once more. Null sources are one
    source. Rows without words are never taken. Repeated rows count each, and are
    ranked apart in any order. Ties between sums go to the smaller one. A text of
    any length is one length. An empty table gives an empty result. Sources may
    be any number.
    """
    kept = [c for c in docs.columns if c.lower() not in ("text", "size", "source_size", "target", "taken")]
    packed = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), "doc_id", docs["source"].cast("string").alias("source"), "text")
    return _times(packed, seed).select("row.*", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The mix itself: rows of ``docs``, with its columns, as often as the mix takes them.

    Rows equal in doc_id, source and text share what the mix takes of them.
    """
    keys = ["doc_id", "source", "copy_key"]
    source = docs["source"].cast("string").alias("source")
    times = _times(docs.select(F.lit(0).alias("row"), "doc_id", source, "text"), seed)
    times = times.groupBy(*keys).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows")).filter("times > 0")
    times = times.select(*[F.col(k).alias(f"m_{k}") for k in keys], "times", "rows")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", source, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("copy_key"))
    found = keyed.join(times, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("copy_key") == F.col("m_copy_key")))
    even = F.col("times") % F.col("rows") == 0
    turn = Window.partitionBy("doc_id", "source", "copy_key").orderBy(F.lit(1))
    each = F.floor(F.col("times") / F.col("rows")).cast("int")
    odd = found.filter(~even).withColumn("turn", F.row_number().over(turn) - 1)
    odd = odd.select("row", (each + F.when(F.col("turn") < F.col("times") % F.col("rows"), 1).otherwise(0)).alias("copies"))
    both = found.filter(even).select("row", each.alias("copies")).unionByName(odd)
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
