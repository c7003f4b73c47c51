"""Sharding by balanced label propagation over links between equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.ranks import group_ranks, running_total
from shelfspark.session import cut_lineage, table

SHARDS, ROUNDS = 40, 6
#: A text with more than one part in so many of all rows has its rows dealt apart from the others: fewer texts than this can.
HOT_PARTS = 1000


def lookup(values: list[int], at: Column) -> Column:
    """values[at], for a short list that is known when the plan is made."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at.cast("int") + 1)


def range_of(uppers: list[int], value: Column) -> Column:
    """How many of the rising ``uppers`` are at most ``value``: the number of its range."""
    return F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in uppers]), lambda u: u <= value))


def slim_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a 128-bit key of the text, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text).alias("k2"),
    )


def balanced_shards(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, ...) into one of ``n_shards`` shards.

    Rows with equal texts are linked. All rows get a shard at random, in counts
    that differ by one at most. Then, for some rounds, linked rows ask to move to
    the shard in which most of their neighbours are, among those with room for
    all of them if there are any; ties go to one by a hash that changes with the
    round. A move from a to b is
    granted against one from b to a, or against rows without links that make
    room in b; so no shard ever has more linked rows than its quota. Rows
    without links fill what is left. The state is a count for each text and
    shard, so that a text with any number of copies is a few rows.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law ('rows': counts of
    rows differ by one at most), shard, slot (gapless from 0 in its shard) and
    grown_shard (null under this law). A null text counts as an empty one; empty
    texts are equal to each other. Repeated rows and null ids are rows like any
    other. Texts of any length are one row. An empty table gives an empty result.
    Other columns, whatever their names, are left out.
    """
    slim = cut_lineage(slim_documents(docs))
    total = slim.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    keys = ["k1", "k2"]
    order = [F.xxhash64("doc_id", "k1"), F.col("doc_id"), F.col("k1"), F.col("size"), F.col("text_crc32")]
    groups = cut_lineage(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    is_hot = F.col("copies") > total / HOT_PARTS
    hot = F.broadcast(groups.filter(is_hot))  # HOT_PARTS at most
    rows = slim.join(hot, keys, "left_anti").join(groups.filter(~is_hot), keys, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    ranked = lambda df: group_ranks(df, keys, order, F.col("copies"), "place")
    linked = cut_lineage(ranked(rows.filter("copies > 1")).unionByName(ranked(slim.join(hot, keys))))
    single = rows.filter("copies = 1").drop("copies")

    start = F.pmod(F.xxhash64(F.lit(11), "place", "k1", "k2"), F.lit(n_shards))
    cells = linked.groupBy(*keys, start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut_lineage(within_quota(cells, quotas))
    for k in range(rounds):
        moved = propagate(cells, quotas, k)
        if moved is None:
            break
        cells = cut_lineage(moved)

    # the rows of a text go to its cells in turn
    ranges = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    upto = F.transform("cells", lambda c, i: F.struct(c["shard"].alias("shard"), F.aggregate(F.slice("cells", 1, i + 1), F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("upto")))
    ranges = ranges.select(*keys, upto.alias("cells"))
    ranges = cut_lineage(ranges)
    few = F.broadcast(ranges.join(hot, keys, "left_semi"))
    placed = linked.filter(~is_hot).join(ranges, keys, "inner").unionByName(linked.filter(is_hot).join(few, keys, "inner"))
    placed = placed.withColumn("shard", F.filter("cells", lambda c: c["upto"] > F.col("place"))[0]["shard"]).select(*slim.columns, "shard")

    taken = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    uppers, at = [], 0
    for s in range(n_shards):
        at += quotas[s] - taken.get(s, 0)
        uppers.append(at)
    filler = group_ranks(single.withColumn("all", F.lit(0)), ["all"], order, F.lit(max(at, 1)), "place")
    filler = filler.withColumn("shard", range_of(uppers, F.col("place")).cast("long")).select(*slim.columns, "shard")

    both = placed.unionByName(filler)
    slots = group_ranks(both, ["shard"], order, F.lit(max(quotas[0], 1)), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def within_quota(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """Random cells may exceed a quota; what is over goes to the room that other shards have."""
    spare = running_total(cells, ["shard"], [F.xxhash64("k1", "k2"), F.col("k1"), F.col("k2")], F.lit(max(quotas[0], 1)), F.col("n"), "ahead")
    spare = spare.withColumn("stays", F.greatest(F.least(F.col("n"), lookup(quotas, F.col("shard")) - F.col("ahead")), F.lit(0)))
    spare = cut_lineage(spare)
    kept = spare.select("k1", "k2", "shard", F.col("stays").alias("n")).filter("n > 0")
    over = spare.select("k1", "k2", F.lit(0).alias("all"), "shard", (F.col("n") - F.col("stays")).alias("n")).filter("n > 0")
    loads = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    lowers, at = [], 0
    for s, q in enumerate(quotas):
        lowers.append(at)
        at += q - loads.get(s, 0)
    uppers = [*lowers[1:], at]
    over = running_total(over, ["all"], [F.xxhash64("k1", "k2", "shard"), F.col("k1"), F.col("k2"), F.col("shard")], F.lit(max(quotas[0], 1)), F.col("n"), "ahead")
    # a cell that is over lies on the rooms' line from ahead to ahead + n, perhaps across several rooms
    rooms = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("shard"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for s, (lo, hi) in enumerate(zip(lowers, uppers, strict=True))]))
    moved = over.select("k1", "k2", "ahead", "n", rooms.alias("room"))
    moved = moved.select("k1", "k2", F.col("room.shard").alias("shard"), (F.least(F.col("ahead") + F.col("n"), F.col("room.hi")) - F.greatest("ahead", "room.lo")).alias("n")).filter("n > 0")
    return merged(kept.unionByName(moved))


def merged(cells: DataFrame) -> DataFrame:
    return cells.filter("n > 0").groupBy("k1", "k2", "shard").agg(F.sum("n").cast("long").alias("n"))


def propagate(cells: DataFrame, quotas: list[int], turn: int = 0) -> DataFrame | None:
    """One round: each text's rows ask for one of its shards; see balanced_shards. None: no row asks, or none may move."""
    n_shards = len(quotas)
    loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    rooms = [q - loads.get(s, 0) for s, q in enumerate(quotas)]
    copies = cells.groupBy("k1", "k2").agg(F.sum("n").alias("copies"))
    fits = lookup(rooms, F.col("shard")) >= F.col("copies") - F.col("n")
    tie = F.xxhash64(F.lit(turn), "k1", "k2", "shard")
    best = cells.join(copies, ["k1", "k2"]).groupBy("k1", "k2").agg(F.max(F.struct(fits.alias("fits"), "n", tie.alias("tie"), "shard")).alias("best")).select("k1", "k2", F.col("best.shard").alias("to"))
    wishes = cut_lineage(cells.join(best, ["k1", "k2"], "inner"))
    asked = wishes.filter("shard <> to").groupBy("shard", "to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).collect()  # n_shards² rows at most
    if not asked:
        return None
    demand = {(r["shard"], r["to"]): r["n"] for r in asked}
    granted = {(a, b): min(n, demand.get((b, a), 0)) for (a, b), n in demand.items()}
    for b in range(n_shards):
        left = {a: demand[a, b] - granted[a, b] for a in range(n_shards) if (a, b) in demand}
        room, all_ = min(rooms[b], sum(left.values())), max(1, sum(left.values()))
        share = {a: room * n // all_ for a, n in left.items()}
        over = room - sum(share.values())  # what rounding leaves, one row each in turn
        for i, a in enumerate(sorted(left, key=lambda a: ((a + turn) % n_shards))):
            granted[a, b] += share[a] + (i < over)
    if not any(granted.values()):
        return None
    flat = [granted.get((a, b), 0) for a in range(n_shards) for b in range(n_shards)]
    most = max([r["cells"] for r in asked], default=1)
    movers = running_total(wishes.filter("shard <> to"), ["shard", "to"], [F.xxhash64("k2", "k1"), F.col("k1"), F.col("k2")], F.lit(most), F.col("n"), "ahead")
    limit = lookup(flat, F.col("shard") * n_shards + F.col("to"))
    moves = F.greatest(F.least(F.col("n"), limit - F.col("ahead")), F.lit(0))
    movers = movers.withColumn("moves", moves)
    parts = F.explode(F.array(F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("moves")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moves").alias("n"))))
    moved = movers.select("k1", "k2", parts.alias("part")).select("k1", "k2", "part.shard", "part.n")
    return merged(wishes.filter("shard = to").select("k1", "k2", "shard", "n").unionByName(moved))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))
