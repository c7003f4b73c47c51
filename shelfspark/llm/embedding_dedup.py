"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.components import components, contracted
from shelfspark.operators.joins import salted_join
from shelfspark.session import cut_lineage, drop_folder, scratch_folder, ship_package, table

LEAST_COSINE = 0.95
#: The index is fitted on at most so many vectors, those of least hash; every vector is in the index.
FIT_VECTORS, ROUNDS, SEED = 16_384, 30, 13
#: Share of pairs at the least cosine that a table's buckets shall bring together; closer pairs meet more often.
RECALL = 0.98
#: Bits of a code (of one rotation), and of a bucket's key at least; keys grow with the logarithm of the vectors.
CODE_BITS, KEY_BITS = 64, 16
#: Vectors of a bucket that are compared at a time; a larger bucket is dealt over blocks.
BLOCK = 512


@dataclass(frozen=True)
class Index:
    """Rotations that give balanced binary codes, and how the codes are cut into table keys."""

    rotations: np.ndarray  # codes x dimensions x bits
    width: int
    most_apart: int

    @property
    def each(self) -> int:
        """Tables of one code."""
        return self.rotations.shape[2] // self.width

    @property
    def tables(self) -> int:
        return self.each * len(self.rotations)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x codes: the signs after each rotation, as the bits of one number."""
        bits = np.einsum("nd,cdb->ncb", x, self.rotations, optimize=True) > 0
        weights = np.uint64(1) << np.arange(bits.shape[2], dtype=np.uint64)
        return (bits * weights).sum(2, dtype=np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """rows x tables: each code's consecutive substrings."""
        at = np.arange(self.each, dtype=np.uint64) * np.uint64(self.width)
        mask = np.uint64((1 << self.width) - 1)
        return ((codes[:, :, None] >> at) & mask).reshape(len(codes), -1)


def table_plan(vectors: int, bits: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, codes): enough tables that pairs at ``least`` share a bucket in ``recall`` of all cases.

    A hyperplane parts two vectors with the chance angle / pi. Keys grow with
    the logarithm of the number of vectors, so that buckets do not, and the
    tables with them.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    width = min(bits, max(KEY_BITS, math.ceil(math.log2(max(2, vectors))) - 6))
    hit = agree**width
    tables = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
    return width, math.ceil(tables / (bits // width))


def fit_index(sample: np.ndarray, vectors: int, least: float = LEAST_COSINE, recall: float = RECALL) -> Index:
    """Learn a rotation for each code on ``sample`` (unit vectors), for an index of ``vectors``.

    Principal axes first; then, from a drawn rotation, in turns: the signs of
    the rotated vectors, and the rotation that brings the vectors nearest to
    these signs (a singular value decomposition). Vectors are not centred: the
    planes go through the origin, so that the chance that one parts two vectors
    follows their angle even where most of the sample is one dense group, whose
    middle would be the mean. An empty sample leaves the drawn rotations.
    """
    d = sample.shape[1]
    bits = min(d, CODE_BITS)
    width, n = table_plan(vectors, bits, least, recall)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :bits] if len(sample) else np.eye(d)[:, :bits]
    v, rng, found = sample @ axes, np.random.default_rng(SEED), []
    for _ in range(n):
        r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        found.append(axes @ r)
    agree = 1 - math.acos(least) / math.pi
    apart = bits * n * (1 - agree)
    return Index(np.stack(found), width, math.ceil(apart + 6 * math.sqrt(bits * n * (1 - agree) * agree) + 1))


def matrix(column: pa.Array, d: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles, cut or filled with zeros to ``d`` components."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    d = int(sizes.max(initial=0)) if d is None else d
    if (sizes == d).all():
        return flat.reshape(len(sizes), d).astype(np.float64)
    out, at = np.zeros((len(sizes), d)), np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(np.minimum(sizes, d)):
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled before they are squared, so that no component is too large or small for it. Rows of zeros stay."""
    scale = np.abs(x).max(1, initial=0, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


UNIT = ["t", "value", "i", "j"]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches of whole groups of ``keys`` (integers), and each row's group number; about ``rows`` of them or one group."""
    held: list[pa.RecordBatch] = []

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        return np.cumsum(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = numbered(joined)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield joined.slice(0, last), group[:last]
            held = [joined.slice(last)]
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield joined, numbered(joined)


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group, by the distance of the two; never more than a batch's rows at a time."""
    at, off = np.arange(len(group)), 1
    while len(at := at[at < len(group) - off]) and len(at := at[group[at] == group[at + off]]):
        yield at, at + off
        off += 1


def near_pairs(index: Index, batch: pa.RecordBatch, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the groups that this group's table brings together first, near enough in all codes.

    A pair that an earlier table's bucket holds is left to that one, so it comes
    once. In a group of two blocks only pairs across them count.
    """
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
    keys = index.keys(codes)
    t, side = batch.column("t").to_numpy(), batch.column("side").to_numpy()
    across = batch.column("i").to_numpy() != batch.column("j").to_numpy()
    for a, b in pairs_within(group):
        ok = (~across[a] | (side[a] != side[b])) & ((keys[a] == keys[b]).argmax(1) == t[a])
        a, b = a[ok], b[ok]
        near = np.bitwise_count(codes[a] ^ codes[b]).sum(1) <= index.most_apart
        yield a[near], b[near]


def _entries(reps: DataFrame, index: Index) -> DataFrame:
    """(t, value, node, code): every vector in every table."""
    d = index.rotations.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                codes = index.codes(unit(matrix(batch.column("vector"), d)))
                n, tables = len(codes), index.tables
                each = pa.array([c.tobytes() for c in codes], pa.binary())
                rows = np.repeat(np.arange(n), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(index.keys(codes).ravel().view(np.int64)), batch.column("node").take(pa.array(rows)), each.take(pa.array(rows))],
                    ["t", "value", "node", "code"],
                )

    return reps.select("node", "vector").mapInArrow(run, "t int, value long, node long, code binary")


def _blocked(entries: DataFrame, block: int) -> DataFrame:
    """The entries by pairs of blocks (i, j) of their bucket; a bucket of few is one block with itself, one of one is left out."""
    sizes = entries.groupBy("t", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = salted_join(entries, sizes.select("t", "value", blocks.alias("blocks")), ["t", "value"], F.xxhash64("node"), counts=sizes)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("t", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "node", "code")


def _in_groups(rows: DataFrame, run: Callable, fields: str) -> DataFrame:
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(run, fields)


def _candidates(blocked: DataFrame, index: Index) -> DataFrame:
    """Those entries that have a near partner in their group, to be compared by their vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, UNIT):
            met = np.zeros(batch.num_rows, bool)
            for a, b in near_pairs(index, batch, group):
                met[a] = met[b] = True
            yield batch.filter(pa.array(met))

    return _in_groups(blocked, run, "t int, value long, i int, j int, side int, node long, code binary")


def _links(candidates: DataFrame, reps: DataFrame, index: Index, least: float) -> DataFrame:
    """(a, b, weight): a's linked vectors in a group as a sum (b null), and links (weight null) that connect what the group's links do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, UNIT, 1 << 12):
            size = pc.list_value_length(batch.column("vector")).to_numpy()
            x = unit(matrix(batch.column("vector")))
            n, node = batch.column("n").to_numpy(), batch.column("node").to_numpy()
            weight, ends = np.zeros(len(n), np.int64), []
            for a, b in near_pairs(index, batch, group):
                ok = (size[a] == size[b]) & (np.einsum("ij,ij->i", x[a], x[b]) >= least)
                a, b = a[ok], b[ok]
                np.add.at(weight, a, n[b])
                np.add.at(weight, b, n[a])
                if len(a):
                    ends.append((node[a], node[b]))
                if len(ends) == 64:
                    ends = [contracted(*(np.concatenate(e) for e in zip(*ends, strict=True)))]
            u, v = contracted(*(np.concatenate(e) for e in zip(*ends, strict=True))) if ends else (node[:0], node[:0])
            some = np.flatnonzero(weight)
            blank = lambda k: pa.nulls(k, pa.int64())
            columns = [pa.concat_arrays([pa.array(node[some]), pa.array(u)]), pa.concat_arrays([blank(len(some)), pa.array(v)]), pa.concat_arrays([pa.array(weight[some]), blank(len(u))])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "weight"])

    joined = candidates.join(reps.select("node", "vector", "n"), "node")
    return _in_groups(joined, run, "a long, b long, weight long")


def linked_vectors(vectors: DataFrame, least: float = LEAST_COSINE, recall: float = RECALL, fit_vectors: int = FIT_VECTORS, block: int = BLOCK) -> DataFrame:
    """Add to ``vectors`` (vec_id, embedding, ...) what each is linked with by a cosine of ``least`` or more.

    Columns: those of ``vectors`` except ones named like the new ones, n_links
    (rows linked directly), component_id (least vec_id that links lead to),
    kept (vec_id is component_id). Cosines are taken in double precision from
    the original components. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing; so do vectors of unlike lengths.
    Rows of one vector are linked with each other and compared with others once,
    weighted by their number; so are rows of one vec_id. A null vec_id comes
    last. An empty table gives an empty result.

    The rotations are learned on at most ``fit_vectors`` vectors; every vector
    is in every table. A bucket's vectors are compared in blocks of about
    ``block``, each pair of blocks in its own group, so a hot bucket is dealt
    over tasks; a pair is looked at in the first table that brings it together.
    What is near by its codes is compared by its vectors. Groups hand on sums
    and connecting links, never pairs. ``recall`` is the share of pairs at
    exactly ``least`` that meet in some bucket, by expectation.
    """
    spark = vectors.sparkSession
    held = scratch_folder(spark)
    new = ("n_links", "component_id", "kept")
    others = [c for c in vectors.columns if c.lower() not in new]
    source = vectors.select(F.struct(*[vectors[c] for c in others]).alias("row"), vectors["vec_id"].alias("id"), vectors["embedding"].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    plus = F.transform("vector", lambda v: v + F.lit(0.0))  # -0.0 is 0.0
    source = source.withColumns({"h1": F.when(fine, F.xxhash64(plus)), "h2": F.when(fine, F.xxhash64(F.lit(2), F.size("vector"), plus))})
    same = source.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    reps = cut_lineage(same.withColumn("node", F.monotonically_increasing_id()), held)  # numbered when written
    count = reps.count()
    widths = reps.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = widths["d"] if widths else 1
    drawn = reps.filter(F.size("vector") == d).orderBy(F.xxhash64(F.lit(SEED), "h1", "h2"), "node").limit(fit_vectors).select("vector").toArrow().column("vector")
    index = fit_index(unit(matrix(drawn.combine_chunks(), d)), count, least, recall)
    ship_package(spark)
    entries = cut_lineage(_entries(reps, index), held)
    found = _links(cut_lineage(_candidates(_blocked(entries, block), index), held), reps, index, least)
    found = cut_lineage(found, held)
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    sums = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("weight"))
    reps = reps.drop("vector").join(sums, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    reps = cut_lineage(reps, held)
    tops = reps.groupBy("label").agg(F.min("least_id").alias("component"), F.count(F.lit(1)).alias("members"))
    sizes = tops.select("label", F.col("members").alias("n"))
    answers = salted_join(reps.drop("members"), tops.select("label", "component"), ["label"], F.col("node"), counts=sizes)
    answers = cut_lineage(answers.select("h1", "h2", "n", "component", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("links")), None)
    drop_folder(spark, held)
    rows = salted_join(source.drop("vector"), answers.select("h1", "h2", "component", "links"), ["h1", "h2"], F.xxhash64("id"), "left", answers)
    component = F.coalesce("component", "id")
    return rows.select("row.*", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's near duplicates. Odd rows are as ``linked_vectors`` says."""
    return linked_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")
