"""Repeat attributes in consecutive purchases, against a popularity-matched baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.labels import no_labels
from shelfspark.operators.joins import MOST_BROADCAST, lookup_join
from shelfspark.session import cut_lineage

ATTRIBUTES = ["form", "skin", "benefit", "benefit_main", "active", "active_main", "store"]


def item_labels(attrs: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """item_id, brand, and a map from attribute to labels. 'store' is the brand and not in the map."""
    brand = F.nullif(F.lower(F.regexp_replace("store", r"(?U)^\s+|\s+$", "")), F.lit(""))
    named = [a for a in attributes if a != "store"]
    arrays = F.array(*[F.coalesce(F.col(a), no_labels()) for a in named]) if named else F.array().cast("array<array<string>>")
    return attrs.select("item_id", brand.alias("brand"), F.map_from_arrays(F.array(*map(F.lit, named)).cast("array<string>"), arrays).alias("labels"))


def labels_of(attribute: str, side: str | None = None) -> Column:
    """The labels that an item (of a pair: its ``side``'s) has of an attribute; none is an empty array."""
    at = f"{side}_" if side else ""
    if attribute == "store":
        return F.when(F.col(f"{at}brand").isNotNull(), F.array(f"{at}brand")).otherwise(no_labels())
    return F.coalesce(F.col(f"{at}labels")[attribute], no_labels())


def attach_pair_attributes(pairs: DataFrame, labels: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Brands and labels of the first, second and random item of each pair.

    Few items sell most, so no side is joined by a plain shuffle on items: a
    catalogue of at most ``most`` items is broadcast, a larger one meets the
    pairs of popular items in several tasks. There a pair takes each item's
    brand and the number of its labels along, and the labels themselves are
    broadcast last, where at most ``most`` different ones are; a pair with all
    its labels would be shuffled for every further side.
    """
    labels, sides = cut_lineage(labels), [c for c in ("first", "second", "rand") if c in pairs.columns]
    out = pairs = cut_lineage(pairs)  # read again for the counts of each side
    deal, what = F.xxhash64(*[c for c in ("user_id", "first", "second") if c in pairs.columns]), "labels"
    if labels.count() > most:
        entries = F.map_entries("labels")
        sets = cut_lineage(labels.groupBy(entries.alias("entries")).agg(F.first("labels").alias("labels")).withColumn("set", F.monotonically_increasing_id()))
        if sets.count() <= most:
            labels, what = cut_lineage(labels.select("item_id", "brand", entries.alias("entries")).join(F.broadcast(sets.select("entries", "set")), "entries", "left").drop("entries")), "set"
    for side in sides:
        own = labels.select(F.col("item_id").alias(side), F.col("brand").alias(f"{side}_brand"), F.col(what).alias(f"{side}_{what}"))
        out = lookup_join(out, own, [side], deal, most=most, counts=pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")))
    for side in sides if what == "set" else ():
        out = out.join(F.broadcast(sets.select(F.col("set").alias(f"{side}_set"), F.col("labels").alias(f"{side}_labels"))), f"{side}_set", "left")
    return out.select(*pairs.columns, *[f"{side}_{c}" for side in sides for c in ("brand", "labels")])


def _overlaps(pairs: DataFrame, others: dict[str, tuple[str, str]], attributes: list[str], other_brand: bool = False) -> DataFrame:
    """For each segment and attribute and each item that the first one is held against: how many pairs have labels on both sides, and which share of them has one in common.

    ``others`` names the count and the share for each; 'all' is no skin label.
    Given ``other_brand``, only pairs of two known, different brands count. One
    pass over the pairs for all attributes and sides, a row each.
    """

    def labels(side: str, a: str) -> Column:
        return F.array_remove(labels_of(a, side), "all") if a == "skin" else labels_of(a, side)

    # each list is a column before it is held against others, else it is looked up for every use
    lists = [labels(side, a).alias(f"{side}_{i}") for i, a in enumerate(attributes) for side in ("first", *others)]
    known = [(F.col("first_brand") != F.col(f"{o}_brand") if other_brand else F.lit(True)).alias(f"{o}_counts") for o in others]
    flags, found, entries = [], [], []
    for i, a in enumerate(attributes):
        fields = [F.lit(a).alias("attribute")]
        for o, (n, p) in others.items():
            flag = f"{o}_{i}"
            both = F.col(f"{o}_counts") & (F.size(f"first_{i}") > 0) & (F.size(flag) > 0)
            flags.append(F.when(both, F.arrays_overlap(f"first_{i}", flag)).alias(flag))
            found += [F.count(flag).alias(f"n_{flag}"), F.avg(F.col(flag).cast("double")).alias(f"p_{flag}")]
            fields += [F.col(f"n_{flag}").alias(n), F.col(f"p_{flag}").alias(p)]
        entries.append(F.struct(*fields))
    rows = pairs.select("segment", *known, *lists).select("segment", *flags)
    return rows.groupBy("segment").agg(*found).select("segment", F.explode(F.array(*entries)).alias("e")).select("segment", "e.*")


def pair_overlap(pairs: DataFrame, other: str, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Of the pairs in which both items have an attribute, how many share a label; 'all' is no skin label."""
    return _overlaps(pairs, {other: ("n", "p")}, attributes).filter("n > 0")


def consistency_table(pairs: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Overlap of real and random pairs, and their ratio, for each segment and attribute."""
    both = _overlaps(pairs, {"second": ("n", "p"), "rand": ("n_base", "base")}, attributes).filter("n > 0")
    return both.select("segment", "attribute", "n", "p", "base", F.when(F.col("base") > 0, F.col("p") / F.col("base")).alias("lift"))


def label_lift(pairs: DataFrame, attribute: str, min_pairs: int = 300) -> DataFrame:
    """For each label of the first item: how often the second and the random item have it, and the ratio.

    Pairs in which the second or the random item has no label are skipped."""
    x, y, z = (labels_of(attribute, side) for side in ("first", "second", "rand"))
    rows = pairs.select("segment", x.alias("x"), y.alias("y"), z.alias("z")).filter((F.size("y") > 0) & (F.size("z") > 0))
    each = rows.select("segment", F.explode(F.array_distinct("x")).alias("label"), "y", "z")
    has = lambda c: F.avg(F.when(F.expr(f"array_contains({c}, label)"), 1.0).otherwise(0.0))
    out = each.groupBy("segment", "label").agg(F.count(F.lit(1)).alias("n"), has("y").alias("p"), has("z").alias("base"))
    return out.filter((F.col("n") >= min_pairs) & (F.col("base") > 0)).withColumn("lift", F.col("p") / F.col("base"))


def cross_brand_consistency(pairs: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """As consistency_table, for real and for random pairs of two known, different brands, each on its own."""
    both = _overlaps(pairs, {"second": ("n", "p"), "rand": ("n_base", "base")}, attributes, other_brand=True).filter("n > 0 AND n_base > 0")
    return both.select("segment", "attribute", "n", "n_base", "p", "base", F.when(F.col("base") > 0, F.col("p") / F.col("base")).alias("lift"))


def cross_brand_label_lift(pairs: DataFrame, attribute: str, min_pairs: int = 200) -> DataFrame:
    """For each label of the first item: how often an item of another known brand has it, bought next against drawn at random.

    Real and random pairs are each on their own; items without labels are
    skipped, and both sides need ``min_pairs`` pairs and a hit. One pass.
    """
    others = {"second": ("n", "p"), "rand": ("n_base", "base")}
    known = [((F.col("first_brand") != F.col(f"{o}_brand")) & (F.size(labels_of(attribute, o)) > 0)).alias(f"{o}_counts") for o in others]
    each = pairs.select("segment", F.explode(F.array_distinct(labels_of(attribute, "first"))).alias("label"), *[labels_of(attribute, o).alias(o) for o in others], *known)
    found = []
    for o, (n, p) in others.items():
        found += [F.count_if(f"{o}_counts").alias(n), F.avg(F.when(F.col(f"{o}_counts"), F.expr(f"array_contains({o}, label)").cast("double"))).alias(p)]
    both = each.groupBy("segment", "label").agg(*found).filter(" AND ".join(f"{n} >= {int(min_pairs)} AND {p} > 0" for n, p in others.values()))
    return both.withColumn("lift", F.col("p") / F.col("base"))


def brand_attr_synergy(pairs: DataFrame, attribute: str, min_pairs: int = 500) -> DataFrame:
    """Same brand and same attribute, real against random, and whether both together lift more than each alone. One pass over the pairs."""
    first, flags, found = labels_of(attribute, "first"), [], []
    for o, t in (("second", "r"), ("rand", "b")):
        other = labels_of(attribute, o)
        known = F.col("first_brand").isNotNull() & F.col(f"{o}_brand").isNotNull() & (F.size(first) > 0) & (F.size(other) > 0)
        flags += [F.when(known, F.col("first_brand") == F.col(f"{o}_brand")).alias(f"{t}_brand"), F.when(known, F.arrays_overlap(first, other)).alias(f"{t}_attr")]
        p = lambda brand, attr, t=t: F.avg(F.when(F.col(f"{t}_brand").isNotNull(), F.when((F.col(f"{t}_brand") == brand) & (F.col(f"{t}_attr") == attr), 1.0).otherwise(0.0))).alias(f"{t}{int(brand)}{int(attr)}")
        found += [F.count(f"{t}_brand").alias(f"n_{t}"), p(True, True), p(True, False), p(False, True), p(False, False)]
    j = pairs.select("segment", *flags).groupBy("segment").agg(*found).filter((F.col("n_r") >= max(1, min_pairs)) & (F.col("n_b") >= max(1, min_pairs)))
    ratio = lambda x, y: x / F.greatest(y, F.lit(1e-12))
    c = F.col
    j = j.withColumns({"lift11": F.when(c("b11") > 0, c("r11") / F.nullif(c("b11"), F.lit(0.0))), "lift_brand": ratio(c("r11") + c("r10"), c("b11") + c("b10")), "lift_attr": ratio(c("r11") + c("r01"), c("b11") + c("b01"))})
    return j.withColumns({
        "synergy": F.when(c("lift_brand") * c("lift_attr") > 0, c("lift11") / F.nullif(c("lift_brand") * c("lift_attr"), F.lit(0.0))),
        "attr_same_brand": ratio(c("r11"), c("r11") + c("r10")),
        "attr_other_brand": ratio(c("r01"), c("r01") + c("r00")),
    })


def popularity_expected(pairs: DataFrame, inter: DataFrame, labels: DataFrame, attribute: str) -> DataFrame:
    """The expected overlap of a pair's first item with an item drawn by popularity, without drawing.

    Label sets are weighed by purchases and by pairs; an item's labels are those
    of a set, so the two weighed lists meet label by label, and sets that share
    several labels are counted once.
    """
    names = lambda: F.array_join(F.array_sort(F.filter(labels_of(attribute), lambda v: (v != "all") if attribute == "skin" else F.lit(True))), ",")
    sets = labels.select("item_id", names().alias("s")).filter("s <> ''")
    weight = inter.join(sets, "item_id").groupBy("segment", "s").agg(F.count(F.lit(1)).alias("w"))
    firsts = pairs.join(sets.withColumnRenamed("item_id", "first"), "first").groupBy("segment", F.col("s").alias("f")).agg(F.count(F.lit(1)).alias("k"))
    each = lambda df, c: df.withColumn("label", F.explode(F.split(c, ",")))
    meet = each(firsts, "f").join(each(weight, "s"), ["segment", "label"]).select("segment", "f", "s", "k", "w").distinct()
    hit = meet.groupBy("segment").agg(F.sum(F.col("k") * F.col("w")).alias("hit"))
    total = firsts.groupBy("segment").agg(F.sum("k").alias("k")).join(weight.groupBy("segment").agg(F.sum("w").alias("w")), "segment")
    return total.join(hit, "segment", "left").select("segment", F.col("k").alias("n"), (F.coalesce("hit", F.lit(0)) / (F.col("k") * F.col("w"))).alias("expected"))
