"""N-gram Jaccard join by signature trees."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.arrow_rows import text_rows, with_text_columns
from shelfspark.llm.components import components
from shelfspark.llm.signature_tree import bitmaps, exact_links, forests, similarity_codes, width_class
from shelfspark.llm.text_batches import SPACED, Words, mixed
from shelfspark.session import cut_lineage, drop_folder, scratch_folder, table

#: A token in the prefixes of more sets than this is frequent: it comes late in the order of tokens. So many may be, the most frequent ones.
FREQUENT, MOST_FREQUENT = 64, 1 << 20
#: Tokens that a task counts together, and how often one must come there to be counted beyond prefixes.
STRETCH, LOCAL = 1 << 22, 8
#: Sets that the tree of one token holds; those of a token with more are dealt over several trees.
TREE_SETS = 1000
#: Sets and tokens of a family that one task compares.
FAMILY_SETS, FAMILY_TOKENS = 512, 2 << 20
#: Rows whose trees a task grows together.
FOREST_ROWS = 1 << 14
#: Ids (8 bytes each) that are broadcast; more are joined.
BROADCAST_IDS = 1 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def token_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): each text's distinct n-word shingles as sorted 64-bit hashes; a shorter text is one shingle."""
    w = Words(column, SPACED, True)
    at, value = w.windows(n)
    text = w.text[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short.tolist()):
            for h in w.hash[w.bounds[t] : w.bounds[t + 1]]:
                extra[i : i + 1] = mixed(extra[i : i + 1] * _OTHER + h)
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        text, value = np.concatenate([text, short])[order], np.concatenate([value, extra])[order]
    bounds = np.searchsorted(text, np.arange(len(w.count) + 1))
    value = value.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[lo:hi].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(w.count) + 1))


def set_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set, as two columns."""
    out = []
    for salt in (_K, _OTHER):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens ^ salt), dtype=np.uint64)])
        out.append(mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return np.stack(out, axis=1)


def node_numbers(tokens: np.ndarray, bounds: np.ndarray, shared: np.ndarray) -> pa.Array:
    """The number of each set: its first hash, or its second if other sets have the first one too."""
    keys = set_keys(tokens, bounds)
    return pa.array(np.where(np.isin(keys[:, 0], shared), keys[:, 1], keys[:, 0]).view(np.int64))


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of this size has with a similar one."""
    return -(-percent * size // 100)


def asked(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of this size has with a similar one that is not smaller."""
    return -(-2 * percent * size // (100 + percent))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The values of each of n owners."""
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values[order].view(np.int64)))


class Frequent:
    """The frequent tokens and how many prefixes have them, with a bitmap before the search."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], numbers[order]
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def among(self, tokens: np.ndarray) -> np.ndarray:
        """The number of each token; 0 if it is not frequent."""
        out = np.zeros(len(tokens), np.int64)
        near = np.flatnonzero(self.gate[(tokens >> np.uint64(42)).astype(np.int64)])
        if len(near):
            at = np.minimum(np.searchsorted(self.keys, tokens[near]), len(self.keys) - 1)
            out[near] = np.where(self.keys[at] == tokens[near], self.numbers[at], 0)
        return out


def prefixes(tokens: np.ndarray, bounds: np.ndarray, percent: int, frequent: Frequent | None = None, stretch: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sets, number if frequent, inner) of the sets' prefixes: so many first tokens that two similar sets share one of them.

    All sets order their tokens alike: by the number's power of two if frequent,
    then by hash. The first token that two similar sets share is an inner one of
    the smaller set, whose overlap is at least ``asked``: so sets that have a
    frequent token only behind more rare ones than they may differ in do not
    meet by it.
    """
    size = np.diff(bounds)
    length = np.where(size > 0, size - needed(size, percent) + 1, 0)
    length = np.minimum(size, np.ceil(length * stretch).astype(np.int64))
    text = np.repeat(np.arange(len(size)), size)
    number = np.zeros(len(tokens), np.int64) if frequent is None else frequent.among(tokens)
    if number.any():
        order = np.lexsort((np.log2(number + 1).astype(np.int64), text))
        tokens, number = tokens[order], number[order]
    place = np.arange(len(tokens)) - bounds[:-1][text]
    taken = place < length[text]
    inner = place < (size - asked(size, percent) + 1)[text]
    return tokens[taken], text[taken], number[taken], inner[taken]


def tree_keys(tokens: np.ndarray, sets: np.ndarray, number: np.ndarray, inner: np.ndarray, size: np.ndarray, codes: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, set) of the trees of prefix tokens, and of those (without regard to the part) that are dealt over several.

    A token has a tree for each width of bitmap. A set is in those of all widths
    that smaller similar sets may have, so two similar sets meet in the tree of
    the narrower one's width. A token of more than ``most`` sets has parts by
    min-hash. A key's lowest bit says whether the token is an inner one of the set.
    """
    flagged = lambda key, on: (key & ~np.uint64(1)) | inner[on].astype(np.uint64)
    high, low = width_class(size)[sets], width_class(needed(size, percent))[sets]
    keys, owners, hot, hot_owners = [], [], [], []
    for down in range(int((high - low).max(initial=0)) + 1):
        on = np.flatnonzero(high - down >= low)
        key = mixed(tokens[on] ^ ((high[on] - down).astype(np.uint64) * _K))
        many = number[on] > most
        hot.append(flagged(key, on)[many])
        hot_owners.append(sets[on][many])
        parts = np.where(many, -(-number[on] // most), 1).astype(np.uint64)
        keys.append(flagged(mixed(key + codes[sets[on]] % parts * _OTHER), on))
        owners.append(sets[on])
    return tuple(np.concatenate(x) for x in (keys, owners, hot, hot_owners))


def _whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 1) -> Iterator[pa.Table]:
    """Batches that are sorted by ``key`` as tables of whole groups, each of at least ``rows`` rows but the last one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[not held or held[-1].column(key)[-1].as_py() != column[0]], column[1:] != column[:-1]]))
        at = 0
        for cut in cuts.tolist():
            if n + cut - at >= rows and (n or cut > at):
                yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
                held, n, at = [], 0, cut
        if at < batch.num_rows:
            held.append(batch.slice(at))
            n += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _by_key(rows: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], fields: str, together: int = 1) -> DataFrame:
    """``work`` on whole groups of ``key``, ``together`` rows or more at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in _whole_groups(batches, key, together):
            for out in work(group):
                held.append(out)
                n += out.num_rows
            if n >= 4096:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, fields)


def _ints(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy().astype(np.int64)


def shared_trees(rows: DataFrame) -> DataFrame:
    """(tree, node, inner, hot) for the trees (key, node, inner) of two nodes or more, of which one has the token as an inner one; trees of the same nodes get one number.

    A key that has far more nodes than were counted is dealt over several trees;
    ``hot`` is the key then, else null.
    """

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, inner = _ints(group, "key"), _ints(group, "node"), group.column("inner").to_numpy()
        order = np.lexsort((~inner, node, key))
        key, node, inner = key[order], node[order], inner[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, inner = key[once], node[once], inner[once]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        several = np.repeat((count > 1) & np.logical_or.reduceat(inner, start), count)
        if not several.any():
            return
        large = np.repeat(count > 4 * TREE_SETS, count)[several]
        key, node, inner = key[several], node[several], inner[several]
        place = np.arange(len(key))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place -= np.maximum.accumulate(np.where(new, place, 0))
        new |= large & (place % TREE_SETS == 0)
        start = np.flatnonzero(new)
        members = np.add.reduceat(mixed(node.view(np.uint64) ^ _K), start)
        tree = np.repeat(mixed(members), np.diff(np.append(start, len(key)))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(node), pa.array(inner), pa.array(key, mask=~large)], ["tree", "node", "inner", "hot"])

    return _by_key(rows, "key", work, "tree long, node long, inner boolean, hot long", 1 << 16)


def possible_links(trees: DataFrame, percent: int) -> DataFrame:
    """(a, b) that the bitmaps of ``trees`` (tree, node, inner, size, code, bits) leave, as a spanning set of each tree's."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        group = group.combine_chunks()
        tree, node = _ints(group, "tree"), group.column("node").to_numpy()
        bits = group.column("bits").chunk(0).cast(pa.large_binary())
        bounds = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1]
        words = np.frombuffer(bits.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].copy().view(np.uint64)
        x, y = forests(tree, _ints(group, "size"), words, (bounds - bounds[0]) >> 3, group.column("code").to_numpy(), percent, group.column("inner").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    return _by_key(trees, "tree", work, "a long, b long", FOREST_ROWS)


def sure_links(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """(a, b): links among the whole sets of each ``key``, as a spanning set; ``rows``: key, node, tokens, and label (sets of one label are joined)."""
    labelled = "label" in rows.columns

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        group = group.take(pa.array(np.unique(group.column("node").to_numpy(), return_index=True)[1]))
        node = group.column("node").to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) for x in group.column("tokens")]
        x, y, _ = exact_links(sets, percent, group.column("label").to_numpy() if labelled else None)
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    return _by_key(rows, key, work, "a long, b long")


class _Nodes:
    """The distinct sets of one join, and what is looked up about them."""

    def __init__(self, texts: DataFrame, n: int, percent: int, shared: np.ndarray):
        self.texts, self.n, self.percent, self.shared = texts, n, percent, shared
        self.spark = texts.sparkSession
        self.folder = scratch_folder(self.spark)

    def cut(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df, self.folder)

    def frequent(self):
        """A broadcast of the frequent tokens: MOST_FREQUENT at most.

        Counted are the tokens of all prefixes (by hash alone, a little longer
        than they will be) and, as a template's tokens stand behind those too,
        the tokens of whole sets that come LOCAL times or more in a stretch of
        STRETCH tokens of a task. Neither changes what is found, only what meets.
        """
        n, percent = self.n, self.percent

        def make():
            held: list[np.ndarray] = []

            def often() -> pa.RecordBatch:
                found, count = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                many = count >= LOCAL
                return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(np.zeros(int(many.sum()), np.int64)), pa.array(count[many])], ["key", "n", "whole"])

            def work(batch):
                if batch is None:
                    if held:
                        yield often()
                    return
                tokens, bounds = token_sets(batch.column("_text"), n)
                held.append(tokens)
                got, *_ = prefixes(tokens, bounds, percent, None, 1.25)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(np.ones(len(got), np.int64)), pa.array(np.zeros(len(got), np.int64))], ["key", "n", "whole"])
                if sum(map(len, held)) >= STRETCH:
                    yield often()

            return work

        rows = text_rows(self.texts, "key long, n long, whole long", make, [])
        counts = rows.groupBy("key").agg(F.greatest(F.sum("n"), F.sum("whole")).alias("n")).filter(F.col("n") > FREQUENT)
        found = counts.orderBy(F.col("n").desc(), "key").limit(MOST_FREQUENT).toArrow()
        return self.spark.sparkContext.broadcast((found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy().astype(np.int64)))

    def describe(self) -> None:
        """Write the nodes: size, min-hash, bitmap and keys of trees for each distinct set, and the least doc_id that has it."""
        n, percent, shared, often = self.n, self.percent, self.shared, self.frequent()

        def make():
            frequent = Frequent(*often.value)

            def work(batch):
                if batch is None:
                    return
                tokens, bounds = token_sets(batch.column("_text"), n)
                size, codes = np.diff(bounds), similarity_codes(tokens, bounds)
                keys, owner, hot, hot_owner = tree_keys(*prefixes(tokens, bounds, percent, frequent), size, codes, percent, TREE_SETS)
                words, at = bitmaps(tokens, bounds)
                held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(words)])
                columns = [node_numbers(tokens, bounds, shared), batch.column("doc_id"), pa.array(size), pa.array(codes.view(np.int64)), held.cast(pa.binary()), _lists(keys, owner, len(size)), _lists(hot, hot_owner, len(size))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "giver", "size", "code", "bits", "keys", "hot"]).filter(pa.array(size > 0))

            return work

        kind = self.texts.schema["doc_id"].dataType.simpleString()
        sets = text_rows(self.texts, f"node long, giver {kind}, size long, code long, bits binary, keys array<long>, hot array<long>", make, ["doc_id"])
        firsts = [F.first(c).alias(c) for c in ("size", "code", "bits", "keys", "hot")]
        self.table = self.cut(sets.groupBy("node").agg(F.min("giver").alias("giver"), *firsts))

    def tokens(self, wanted: DataFrame) -> DataFrame:
        """Add the whole sets to ``wanted`` (node, ...): only texts of their givers are split, once for each node."""
        n = self.n
        more = [c for c in wanted.columns if c != "node"]
        fields = ", ".join(["node long", "tokens array<long>", *[f"{c} {wanted.schema[c].dataType.simpleString()}" for c in more]])
        known = self.table.select("node", "giver").withColumnRenamed("node", "w_node")
        wanted = wanted.groupBy("node").agg(F.collect_list(F.struct(*more)).alias("uses")) if more else wanted.distinct()
        wanted = self.cut(wanted.join(known, F.col("node") == F.col("w_node")).drop("w_node"))
        few = wanted.count() <= BROADCAST_IDS // 4
        own = self.texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("giver")))
        shared = self.shared

        def make():
            def work(batch):
                if batch is None:
                    return
                tokens, bounds = token_sets(batch.column("_text"), n)
                node = node_numbers(tokens, bounds, shared)
                held = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
                out = pa.RecordBatch.from_arrays([node, held, batch.column("uses")], ["node", "tokens", "uses"])
                yield out.filter(pc.and_(pc.equal(node, batch.column("node")), pa.array(np.diff(bounds) > 0)))

            return work

        uses = own.schema["uses"].dataType.simpleString()
        held = text_rows(own, f"node long, tokens array<long>, uses {uses}", make, ["node", "uses"])
        return held.select("node", "tokens", F.explode("uses").alias("use")).select("node", "tokens", *[F.col(f"use.{c}").alias(c) for c in more])


def _large(sets: str, total: str) -> Column:
    return (F.col(sets) > FAMILY_SETS) | (F.col(total) > FAMILY_TOKENS)


def _parts(sets: str, total: str) -> Column:
    """Parts of bounded size that so many sets and tokens make."""
    return F.ceil(F.greatest(F.col(sets) / FAMILY_SETS, F.col(total) / FAMILY_TOKENS, F.lit(1))).cast("long")


def dealt_families(members: DataFrame) -> Iterator[DataFrame]:
    """(block, node) twice: ``members`` (family, node, size, code) by min-hash, so that alike sets meet, and at random."""
    whole = members.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total")).select(F.col("family").alias("f"), _parts("sets", "total").alias("blocks"))
    alike = members.groupBy("family", "code").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total"))
    alike = alike.select(F.col("family").alias("c_family"), F.col("code").alias("c_code"), _parts("sets", "total").alias("parts"))
    rows = members.join(whole, F.col("family") == F.col("f")).join(alike, (F.col("family") == F.col("c_family")) & (F.col("code") == F.col("c_code")))
    at_random = F.xxhash64(F.lit(1), "node")
    by_code = F.when(F.col("parts") > 1, F.xxhash64("family", "code", F.pmod(at_random, "parts"))).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("code"), "blocks")))
    yield rows.select("node", by_code.alias("block"))
    yield rows.select("node", F.xxhash64("family", F.pmod(at_random, "blocks")).alias("block"))


def meetings(nodes: _Nodes, rows: DataFrame) -> DataFrame:
    """(pair, node, label) for what is left to compare in groups of any size (group, node, size, label, inner).

    A group that one task can compare is one pair. The sets of a larger one are
    dealt to blocks of one range of sizes each, those of a label with many sets
    to blocks of their own; two blocks meet unless they have one label or no
    sizes that go together, or neither has a set with the token as an inner one
    that is not larger than some of the other's. Only numbers are joined here.
    """
    whole = rows.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total")).select(F.col("group").alias("g"), _large("sets", "total").alias("large"))
    of_label = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("same")).filter(F.col("same") * 2 > FAMILY_SETS).select(F.col("group").alias("l_group"), F.col("label").alias("pool"))
    marked = rows.join(whole, F.col("group") == F.col("g")).join(of_label, (F.col("group") == F.col("l_group")) & (F.col("label") == F.col("pool")), "left")
    range_ = F.when(F.col("large"), F.floor(F.log("size") / F.log(F.lit(1.1)))).otherwise(0)
    marked = marked.select("group", "node", "size", "label", "inner", F.when(F.col("large"), F.col("pool")).alias("pool"), range_.alias("range"))
    of_range = marked.groupBy("group", "pool", "range").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total"))
    of_range = of_range.select(F.col("group").alias("r_group"), F.col("pool").alias("r_pool"), F.col("range").alias("r_range"), _parts("sets", "total").alias("parts"))
    same = (F.col("group") == F.col("r_group")) & F.col("pool").eqNullSafe(F.col("r_pool")) & (F.col("range") == F.col("r_range"))
    block = F.xxhash64("group", "pool", "range", F.pmod(F.xxhash64(F.lit(2), "node"), "parts"))
    marked = nodes.cut(marked.join(of_range, same).select("group", block.alias("block"), "pool", "node", "size", "label", "inner"))
    least = F.coalesce(F.min(F.when(F.col("inner"), F.col("size"))), F.lit(1 << 62)).alias("least")
    each = nodes.cut(marked.groupBy("group", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.first("pool").alias("pool"), least))
    other = each.select(*[F.col(c).alias(f"o_{c}") for c in each.columns])
    meet = each.join(other, (F.col("group") == F.col("o_group")) & (F.col("block") <= F.col("o_block")))
    meet = meet.filter((100 * F.col("high") >= nodes.percent * F.col("o_low")) & (100 * F.col("o_high") >= nodes.percent * F.col("low")))
    meet = meet.filter((F.col("least") <= F.col("o_high")) | (F.col("o_least") <= F.col("high")))
    meet = meet.filter(F.col("pool").isNull() | ~F.col("pool").eqNullSafe(F.col("o_pool")))
    meet = meet.select("block", "o_block", F.xxhash64("block", "o_block").alias("pair"))
    sides = meet.select("pair", "block").unionByName(meet.select("pair", F.col("o_block").alias("block"))).distinct()
    return marked.join(sides, "block").select("pair", "node", "label")


def similar_sets(docs: DataFrame, n: int = 3, percent: int = 90, keep: list[str] | None = None) -> DataFrame:
    """Classes of ``docs`` whose sets of ``n``-word shingles link them.

    Columns: ``keep`` of ``docs`` (doc_id by default; doc_id must be among
    them), n_shingles, component_id (smallest doc_id that links lead to), which
    take the place of columns with these names. Other names may be anything.
    Texts are lower-cased (A-Z) and split at ASCII white space; a shorter text is
    one shingle; two sets link when 100 * intersection >= percent * union. Null
    and empty texts have empty sets and link with nothing: component_id is their
    own doc_id. A null doc_id is never a component_id while another is in its
    component. Repeated rows are equal sets. Texts of any length are one set
    each. An empty table gives an empty result. Ties cannot arise.

    1. Every text gives a 128-bit key of its set; equal sets are one node.
    2. Two similar sets share a token of their prefixes (frequent tokens come
       last in the order of all tokens); it is among the smaller set's inner
       ones, as it has few tokens that a similar larger one lacks. Each such token has a
       signature tree, whose nodes hold OR-combined bitmaps and size ranges. A
       traversal of the tree against itself prunes pairs of branches by their
       largest possible overlap, and gives possible links, as a spanning set of
       each tree's.
    3. What possible links connect is a family. A family's whole sets are
       compared in one task, by a tree over wide bitmaps and then token by token.
    4. A family that is too large for that is dealt to blocks by min-hash, then
       at random. In the trees of its tokens, sets that are not joined by then
       are compared in blocks that meet. So are the sets of a token whose sets
       one tree could not hold.
    """
    spark = docs.sparkSession
    kept = [c for c in (keep or ["doc_id"]) if c.lower() not in ("n_shingles", "component_id")]
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in kept]).alias("kept"))

    def describing():
        def work(batch):
            tokens, bounds = token_sets(batch.column("_text"), n)
            keys, size = set_keys(tokens, bounds).view(np.int64), np.diff(bounds)
            return [size.astype(np.int64), pa.array(keys[:, 0], mask=size == 0), pa.array(keys[:, 1], mask=size == 0)]

        return work

    described = cut_lineage(with_text_columns(packed, "n_shingles long, key_1 long, key_2 long", describing, ["doc_id", "kept"]))
    # sets that differ but have one first hash: about one pair in 2^64
    sets = described.filter("n_shingles > 0").groupBy("key_1").agg(F.min("key_2").alias("low"), F.max("key_2").alias("high"))
    shared = [r["key_1"] for r in sets.filter("low <> high").select("key_1").collect()]
    number = F.when(F.col("key_1").isin(shared), F.col("key_2")).otherwise(F.col("key_1")) if shared else F.col("key_1")
    rows = described.select("doc_id", "kept", "n_shingles", number.alias("node"))

    nodes = _Nodes(packed.select("doc_id", "text"), n, percent, np.array(shared, np.int64).view(np.uint64))
    labels = cut_lineage(components(joined_nodes(nodes)))
    drop_folder(spark, nodes.folder)
    known = rows.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").withColumn("class", F.coalesce("label", "node"))
    least = known.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id")).select(F.col("class").alias("c_class"), "component_id")
    out = known.join(least, F.col("class") == F.col("c_class"), "left")
    return out.select("kept.*", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def joined_nodes(nodes: _Nodes) -> DataFrame:
    """Links (a, b) that join what is similar among ``nodes``; steps 2 to 4 of similar_sets."""
    percent = nodes.percent
    nodes.describe()
    bare, inner = F.shiftright("key", 1).alias("key"), (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("inner")
    found = nodes.cut(shared_trees(nodes.table.select("node", F.explode("keys").alias("key")).select("node", bare, inner)))
    bits = nodes.table.select(F.col("node").alias("b_node"), "size", "code", "bits")
    trees = found.groupBy("tree", "node").agg(F.max("inner").alias("inner")).join(bits, F.col("node") == F.col("b_node")).drop("b_node")
    possible = nodes.cut(possible_links(trees, percent))
    family = components(possible).select(F.col("node").alias("f_node"), F.col("label").alias("family"))
    members = nodes.cut(nodes.table.select("node", "size", "code").join(family, F.col("node") == F.col("f_node")).drop("f_node"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total")).select(F.col("family").alias("s_family"), _large("sets", "total").alias("large"))
    members = nodes.cut(members.join(sizes, F.col("family") == F.col("s_family")).drop("s_family"))
    links = nodes.cut(sure_links(nodes.tokens(members.filter("NOT large").select("node", "family")), "family", percent))
    large = members.filter("large").drop("large")
    some = bool(large.limit(1).count())
    for block in dealt_families(large) if some else ():
        links = links.unionByName(nodes.cut(sure_links(nodes.tokens(block), "block", percent)))
    # what may be similar and is not yet joined: in the trees of large families, and across the trees of one token
    hot = nodes.table.select("node", F.explode("hot").alias("key")).select("node", bare.alias("group"), inner).unionByName(found.filter("hot IS NOT NULL").select("node", F.col("hot").alias("group"), "inner"))
    inside = found.select("tree", "node", "inner").join(large.select(F.col("node").alias("i_node"), "family"), F.col("node") == F.col("i_node")).select("node", F.xxhash64("tree", "family").alias("group"), "inner")
    groups = nodes.cut((hot.unionByName(inside) if some else hot).groupBy("node", "group").agg(F.max("inner").alias("inner")))
    if not groups.limit(1).count():
        return links
    labels = components(links).select(F.col("node").alias("l_node"), "label")
    sizes = nodes.table.select(F.col("node").alias("s_node"), "size")
    groups = nodes.cut(groups.join(sizes, F.col("node") == F.col("s_node")).join(labels, F.col("node") == F.col("l_node"), "left").select("group", "node", "size", "inner", F.coalesce("label", "node").alias("label")))
    open_ = groups.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("inner").alias("some")).filter("low <> high AND some").select("group")
    paired = meetings(nodes, groups.join(open_, "group"))
    return links.unionByName(nodes.cut(sure_links(nodes.tokens(paired), "pair", percent)))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but one document of each group that similar_sets finds: the one with the smallest doc_id.

    Documents without words stay. Rows that share a doc_id stand or fall
    together, except that of rows with equal id and text one stays. Only ids are
    shuffled, unless more than BROADCAST_IDS of them go.
    """
    found = similar_sets(docs.select("doc_id", "text"), n, percent)
    best = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = cut_lineage(found.groupBy("doc_id").agg(F.max(best).alias("stays"), F.count(F.lit(1)).alias("rows")).filter(~F.col("stays") | (F.col("rows") > 1)).withColumnRenamed("doc_id", "d_id"))
    hint = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda df: df)
    same = docs["doc_id"].eqNullSafe(ids["d_id"])
    single = docs.join(hint(ids), same, "left_anti")
    repeated = docs.join(hint(ids.filter("stays")), same, "left_semi")
    repeated = repeated.select("doc_id", F.xxhash64("text").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]).select("row.*"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))
