"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.arrow_rows import text_rows, with_text_columns
from shelfspark.llm.text_batches import ALNUM, Words, mixed
from shelfspark.operators.joins import salted_join
from shelfspark.session import cut_lineage, table

WINDOW = 10
#: Bytes of item texts and ids that each process compiles whole; of more, tasks hold tables of a fixed size, and windows are compared in a join.
BLOCK_BYTES = 8 << 20
#: Bits of the filter of window hashes beyond that: 16 for each window within these bounds.
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 27
#: Windows of an item in one batch of rows.
WINDOW_ROWS = 1 << 14
#: Window ends that one lane of the search covers.
LANE = 256
_SHIFT_BITS = 20
_K = np.uint64(0x9E3779B97F4A7C15)


def _blocks(first: np.ndarray | None, second: np.ndarray) -> np.ndarray:
    return second if first is None else mixed(first * _K + second)


def _slot(block: np.ndarray) -> np.ndarray:
    return (block >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)


def _block_at(hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    return _blocks(hashes[at - 1] if block == 2 else None, hashes[at])


def no_shifts(m: int) -> np.ndarray:
    """The shift table of no pattern: any block moves the window past itself."""
    return np.full(1 << _SHIFT_BITS, m - min(2, m) + 1, np.uint8)


def shifts(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(slots, shift) of the blocks at each place of the patterns, whose word hashes are rows."""
    m = hashes.shape[1]
    block = min(2, m)
    for end in range(block - 1, m):
        yield _slot(_blocks(hashes[:, end - 1] if block == 2 else None, hashes[:, end])), m - 1 - end


def possible_ends(shift: np.ndarray, m: int, w: Words) -> np.ndarray:
    """The last words of all places where the shift table allows a pattern of m words, in order."""
    first, stop, block, found = w.bounds[:-1] + m - 1, w.bounds[1:], min(2, m), []
    lanes = np.maximum(0, -(-(stop - first) // LANE))
    begin = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    at, end = begin, np.minimum(begin + LANE, np.repeat(stop, lanes))
    while len(at):
        step = shift[_slot(_block_at(w.hash, at, block))]
        hit = step == 0
        if hit.any():
            found.append(at[hit])
        at = at + np.maximum(step, 1)
        on = at < end
        at, end = at[on], end[on]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class WuManber:
    """Patterns of one length m, in words. Blocks are two words (one if m is 1).

    ``shift`` has for each block's hash how far the end of the search window may
    move without missing a pattern; 0: a pattern may end here. ``suffix`` sorts
    the patterns by the hash of their last block. ``texts`` are the patterns'
    words joined by blanks; ``owners`` (pattern, place in ``names``), sorted, says
    whose they are.
    """

    def __init__(self, hashes: np.ndarray, texts: list[bytes], owners: np.ndarray, names: list[str]):
        self.m = m = hashes.shape[1]
        self.block = min(2, m)
        self.shift = no_shifts(m)
        for slot, far in shifts(hashes):
            np.minimum.at(self.shift, slot, np.uint8(far))
        last = _blocks(hashes[:, m - 2] if self.block == 2 else None, hashes[:, m - 1])
        order = np.argsort(last, kind="stable")
        self.suffix, self.hashes = last[order], hashes[order]
        self.texts, self.order, self.names = texts, order, names
        self.owner = owners[:, 1]
        self.owned = np.searchsorted(owners[:, 0], np.arange(len(texts) + 1))

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence; all lanes step through their words together."""
        m, ends = self.m, possible_ends(self.shift, self.m, w)
        if not len(ends):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = _block_at(w.hash, ends, self.block)
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        some = high > low
        ends, low, n = ends[some], low[some], (high - low)[some]
        pattern = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(ends, n) - m + 1
        for j in range(m):
            same = w.hash[start + j] == self.hashes[pattern, j]
            start, pattern = start[same], pattern[same]
        pattern = self.order[pattern]
        sure = np.array([joined(w, s, m) == self.texts[p] for s, p in zip(start.tolist(), pattern.tolist(), strict=True)], bool)
        return start[sure], pattern[sure]

    def items(self, pattern: int) -> list[str]:
        return [self.names[j] for j in self.owner[self.owned[pattern] : self.owned[pattern + 1]].tolist()]


def joined(w: Words, first: int, n: int) -> bytes:
    """The words from ``first`` on, which hold no blank, as one string."""
    return b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(first, first + n))


def compiled(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """Search tables for the windows of (item id, text) pairs, one for each length of window. A null id is not listed."""
    w = Words(pa.array([t for _, t in items], pa.string()), ALNUM, True)
    names = sorted({item for item, _ in items if item is not None})
    number = {item: j for j, item in enumerate(names)}
    tables: dict[int, tuple[dict[bytes, int], array, array]] = {}
    for i, (item, _) in enumerate(items):
        lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
        k = min(window, hi - lo)
        if not k:
            continue
        pattern, first, owners = tables.setdefault(k, ({}, array("q"), array("q")))
        whole, edge = joined(w, lo, hi - lo), [0, *np.cumsum(w.end[lo:hi] - w.start[lo:hi] + 1).tolist()]
        for at in range(hi - lo - k + 1):
            p = pattern.setdefault(whole[edge[at] : edge[at + k] - 1], len(first))
            if p == len(first):
                first.append(lo + at)
            if item is not None:
                owners.append(p * len(names) + number[item])
    made = []
    for k in sorted(tables):
        pattern, first, owners = tables.pop(k)
        own = np.unique(np.array(owners, np.int64))
        made.append(WuManber(w.hash[np.array(first, np.int64)[:, None] + np.arange(k)], list(pattern), np.stack([own // max(1, len(names)), own % max(1, len(names))], 1), names))
    return made


#: What this process compiled last, so that its tasks compile an item block once.
_LAST: dict[str, list[WuManber]] = {}


def compiled_once(key: str, items: list[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = compiled(items, window)
    return _LAST[key]


def _matched(batch: pa.RecordBatch, tables: list[WuManber], column: str = "_text") -> tuple[Words, np.ndarray, list[set[str]]]:
    w = Words(batch.column(column), ALNUM, True)
    edge = np.zeros(len(w.hash) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(batch.num_rows)]
    for t in tables:
        start, pattern = t.search(w)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + t.m, -1)
        for row, p in set(zip(w.text[start].tolist(), pattern.tolist(), strict=True)):
            found[row].update(t.items(p))
    return w, np.cumsum(edge[:-1]) > 0, found


def window_texts(w: Words, first: int, n: int, k: int) -> list[str]:
    """The texts of ``n`` windows of ``k`` words from word ``first`` on."""
    stop = first + n + k - 1
    whole, edge = joined(w, first, stop - first), [0, *np.cumsum(w.end[first:stop] - w.start[first:stop] + 1).tolist()]
    return [whole[edge[i] : edge[i + k] - 1].decode() for i in range(n)]


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, k, body): the windows of ``items`` (item, text), k words each, joined by blanks; a window once for each item."""

    def make():
        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            w = Words(batch.column("_text"), ALNUM, True)
            for i in range(batch.num_rows):
                lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
                k = min(window, hi - lo)
                for at in range(lo, hi - k + 1, WINDOW_ROWS) if k else ():
                    bodies = window_texts(w, at, min(WINDOW_ROWS, hi - k + 1 - at), k)
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column("item").take(pa.array([i] * len(bodies)))), pa.array([k] * len(bodies), pa.int32()), pa.array(bodies)], ["item", "k", "body"])

        return work

    return text_rows(items, "item string, k int, body string", make, ["item"]).distinct()


def _window_hashes(hashes: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes."""
    value = np.zeros(len(hashes), np.uint64)
    for j in range(hashes.shape[1]):
        value = mixed(value * _K + hashes[:, j])
    return value


def _filter_bits(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of ``bits`` (a power of two) that a window's hash sets."""
    mask = np.uint64(bits - 1)
    return (value & mask).astype(np.int64), ((value >> np.uint64(32)) & mask).astype(np.int64)


def scan_tables(windows: DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Shift tables by window length and a filter of window hashes, for ``windows`` (k, body) of any number.

    Tasks mark slots, which are merged by slot before the driver fills the
    tables: at most 2**20 slots for each length and MOST_FILTER / 64 words.
    """
    n = windows.count()
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * max(1, n) - 1).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, length = Words(batch.column("body"), ALNUM, False), batch.column("k").to_numpy()
            for k in np.unique(length).tolist():
                hashes = w.hash[w.bounds[:-1][length == k][:, None] + np.arange(k)]
                marks = [(k, slot, np.full(len(slot), far, np.int64)) for slot, far in shifts(hashes)]
                marks += [(0, bit >> 6, np.left_shift(np.int64(1), bit & 63)) for bit in _filter_bits(_window_hashes(hashes), bits)]
                for kind, slot, value in marks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot), pa.array(value)], ["kind", "slot", "value"])

    marks = windows.select("k", "body").mapInArrow(run, "kind int, slot long, value long")
    merged = marks.groupBy("kind", "slot").agg(F.min("value").alias("low"), F.bit_or("value").alias("all")).toArrow()
    kind, slot, low, every = (merged.column(c).to_numpy() for c in ("kind", "slot", "low", "all"))
    tables = {}
    for k in np.unique(kind[kind > 0]).tolist():
        tables[k] = no_shifts(k)
        tables[k][slot[kind == k]] = low[kind == k]
    seen = np.zeros(bits // 64, np.int64)
    seen[slot[kind == 0]] = every[kind == 0]
    return tables, seen


NEAR = pa.list_(pa.struct([("k", pa.int32()), ("body", pa.string()), ("at", pa.list_(pa.int64()))]))


def possible_windows(w: Words, tables: dict[int, np.ndarray], seen: np.ndarray) -> list[list[dict]]:
    """For each text the windows that the tables allow: length, text, and the places in the text where it begins."""
    near: list[dict[tuple[int, str], list[int]]] = [{} for _ in w.count]
    for k, shift in tables.items():
        start = possible_ends(shift, k, w) - k + 1
        kept = np.ones(len(start), bool)
        for bit in _filter_bits(_window_hashes(w.hash[start[:, None] + np.arange(k)]), len(seen) * 64):
            kept &= (seen[bit >> 6] >> (bit & 63)) & 1 == 1
        for at in start[kept].tolist():
            row = int(w.text[at])
            near[row].setdefault((k, joined(w, at, k).decode()), []).append(at - int(w.bounds[row]))
    return [[{"k": k, "body": body, "at": at} for (k, body), at in own.items()] for own in near]


def _hits_by_join(state: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """benchmark_hits' result for ``state`` (row, body) and ``parts`` (item, text) of any size, in one pass over the texts.

    Tasks hold shift tables and a filter of a fixed size. Windows that these
    allow go on with their place, and are compared as texts in a join with the
    items' windows, in which windows that many documents share are dealt over
    tasks. Documents without such a window are not shuffled.
    """
    windows = cut_lineage(item_windows(parts, window))
    tables, seen = scan_tables(windows)
    shared = state.sparkSession.sparkContext.broadcast((tables, seen))

    def make():
        def work(batch: pa.RecordBatch) -> list:
            w = Words(batch.column("_text"), ALNUM, True)
            return [w.count.astype(np.int64), pa.array(possible_windows(w, *shared.value), NEAR)]

        return work

    scanned = with_text_columns(state, "n_words long, near array<struct<k: int, body: string, at: array<long>>>", make, ["row"], "body")
    scanned = cut_lineage(scanned.withColumn("id", F.monotonically_increasing_id()))  # written, so that ids stay
    near = scanned.filter(F.size("near") > 0)
    asked = near.select("id", F.explode("near").alias("x")).select("id", "x.*")
    listed = windows.groupBy("k", "body").agg(F.collect_set("item").alias("items"))
    met = cut_lineage(salted_join(asked, listed, ["k", "body"], F.xxhash64("id")))
    spans = met.select("id", F.explode("at").alias("at"), "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "k"))).alias("spans"))  # of one text
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["at"] + x["k"] - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], x["at"] + x["k"]).alias("end"))
    zero = F.lit(0).cast("long")
    hit = spans.select("id", F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("end")), step, lambda a: a["n"]).alias("n_hit"))
    found = met.select("id", F.explode("items").alias("item")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    some = near.join(hit, "id", "left").join(found, "id", "left").select("row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"))
    whole = some.unionByName(scanned.filter(F.size("near") == 0).select("row", "n_words", zero.alias("n_hit"), none.alias("items")))
    return whole.select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add to ``docs`` what its texts share with ``benchmark`` (item_id, text).

    Columns: ``keep`` of ``docs`` (all by default), n_words, n_hit (words inside
    an occurrence of a window of an item), n_items and items (ids of the items
    with an occurring window, as sorted strings), contaminated. A window is
    ``window`` consecutive words of an item, or all words of a shorter item.
    Null and empty texts have no words; so have items without text, which are
    never found. Items with text but a null id count in n_hit and contaminated,
    and are left out of n_items and items. Repeated rows and items get the same result each. An empty
    benchmark finds nothing; empty documents give an empty result. Up to
    ``block_bytes`` of items are compiled whole in each process; of more, tasks
    hold tables of a fixed size, and what these allow is compared in a join. Texts
    are read once either way.
    """
    parts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.octet_length("text") > 0)
    size = parts.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    state = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("body"))
    if size > block_bytes:
        return _hits_by_join(state, parts, window).select("row.*", *new)
    rows = [(r["item"], r["text"]) for r in parts.collect()]  # block_bytes
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def make():
        tables = compiled_once(key, shared.value, window)

        def work(batch: pa.RecordBatch) -> list:
            w, hit, found = _matched(batch, tables)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = (total[w.bounds[1:]] - total[w.bounds[:-1]]).astype(np.int64)
            return [w.count.astype(np.int64), n_hit, np.array([len(x) for x in found], np.int64), pa.array([sorted(x) for x in found], pa.list_(pa.string())), n_hit > 0]

        return work

    fields = "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"
    return with_text_columns(state, fields, make, ["row"], "body").select("row.*", *new)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = benchmark_hits(docs, items, keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
