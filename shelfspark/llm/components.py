"""Connected components of links: contraction within tasks, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage, drop_folder, scratch_folder

#: Links that a task contracts at a time.
CHUNK = 1 << 20
#: So few links (16 bytes each) one task contracts to the end, in place of further rounds.
FEW = 1 << 16


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by a link from each node to the least one that these links lead to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        while (label[label] != label).any():
            label = label[label]
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _starred(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``links`` (a, b): the least node that links lead to.

    Each task first puts a star in place of what its own links connect, a bounded
    number of links at a time. Then, in turns, every node hands its larger
    neighbours (large star), then its smaller ones (small star), to the least of
    them; the number of rounds grows with the logarithm of a component's size; they end early where
    few links are left, which one task contracts.
    Rounds are written to the checkpoint folder, and a round's tables are deleted
    when the next one's edges are written; nothing is collected.
    """
    spark = links.sparkSession
    held = scratch_folder(spark)
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut_lineage(ends.mapInArrow(_contract, "u long, v long").distinct(), held)
    before = None
    while (now := _state(edges)) != before:
        if now[0] <= FEW:
            edges = cut_lineage(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), scratch_folder(spark))
            drop_folder(spark, held)
            break
        before, last, held, passing = now, held, scratch_folder(spark), scratch_folder(spark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut_lineage(_starred(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), passing)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _starred(large).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u <> v").distinct(), held)
        drop_folder(spark, last)
        drop_folder(spark, passing)
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.unionByName(tops)
