"""Splits, features, baselines, scoring and evaluation of recommenders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import labels as L
from shelfspark.operators.joins import salted_join
from shelfspark.operators.retrieval import embedding_profile as embedding_profile
from shelfspark.operators.windows import dense_index, md5_number
from shelfspark.session import cut_lineage

#: Popular items that are broadcast; longer shelves are joined.
SHELF = 1 << 16
#: Buckets of items by their purchases in training.
POP_BUCKETS = ("0", "1-4", "5-19", "20+")


def time_cut(inter: DataFrame, test_share: float) -> float:
    """The interpolated quantile of the time stamps at 1 - test_share, exact.

    Counts by day tell the day in which it lies, counts of that day's seconds the
    second, and so on; a cell with one stamp ends the search. The driver gets a
    row for each day, 86,400 and 1,000 at most after that.
    """
    rows, place, k, following, cell = inter, 0.0, None, None, None
    for width in (86_400_000, 1_000, 1):
        of = F.floor(F.col("ts") / width)
        cells = rows.groupBy(of.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("cell").collect()
        if k is None:
            if not cells:
                return 0.0
            place = (1 - test_share) * (sum(r["n"] for r in cells) - 1)
            k = int(place)
        for i, cell in enumerate(cells):
            if k < cell["n"]:
                following = cells[i + 1]["low"] if i + 1 < len(cells) else following
                break
            k -= cell["n"]
        if cell["low"] == cell["high"]:
            break
        rows = rows.filter(of == cell["cell"])
    upper = cell["low"] if k + 1 < cell["n"] or following is None else following
    return cell["low"] + (upper - cell["low"]) * (place - int(place))


def time_split(inter: DataFrame, test_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut, and later rows of users who have earlier ones."""
    cut = time_cut(inter, test_share)
    train = inter.filter(F.col("ts") < cut)
    return train, known_users_only(inter.filter(F.col("ts") >= cut), train)


def known_users_only(test: DataFrame, train: DataFrame) -> DataFrame:
    return test.join(train.select("user_id").distinct(), "user_id", "left_semi")


def item_universe(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("item_id").union(test.select("item_id")).distinct()


def item_train_counts(universe: DataFrame, train: DataFrame) -> DataFrame:
    """item_id, n: purchases in the training period, 0 if none."""
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return universe.join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


def new_item_share(test: DataFrame, counts: DataFrame) -> DataFrame:
    joined = test.join(counts, "item_id")
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)).alias("new_share"))


def pop_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").otherwise("20+")


def item_tokens(attrs: DataFrame, variant: str = "filled", drop: tuple[str, ...] = (), active_mode: str = "all") -> DataFrame:
    """(item_id, field, token) of each item: brand, segment and the attributes that a variant uses.

    Variants: 'brand', 'seller', 'filled' and 'attr_only'; 'all' is no skin
    token; described benefits exclude those of the title; actives are 'all',
    'main' (the title's) or 'split'.
    """
    none = L.no_labels()
    brand = F.lower(F.regexp_replace("store", r"(?U)^\s+|\s+$", ""))
    fields = {"brand": F.when((F.coalesce("store", F.lit("")) != "") & (F.col("store") != "None"), F.array(F.concat(F.lit("brand="), brand))).otherwise(none), "seg": F.array(F.concat(F.lit("seg="), F.col("segment")))}
    informed = lambda c: F.filter(c, lambda x: x != "all")

    def named(prefix: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.concat(F.lit(prefix), x))

    if variant == "seller":
        fields |= {k: named(f"{k}=", informed(F.col(f"{k}_seller")) if k == "skin" else F.col(f"{k}_seller")) for k in ("form", "skin", "benefit", "active")}
    if variant in ("filled", "attr_only"):
        own = {"form": F.col("form"), "skin": informed(F.col("skin")), "benefit_main": F.col("benefit_main"), "benefit_desc": F.array_except("benefit", "benefit_main")}
        if active_mode == "all":
            own["active"] = F.col("active")
        else:
            own["active_main"] = F.col("active_main")
            if active_mode == "split":
                own["active_desc"] = F.array_except("active", "active_main")
        fields |= {k: named(f"{k}:{k.split('_')[0] if k.startswith(('benefit', 'active')) else k}=", c) for k, c in own.items()}
    entries = [_field(k, c) for k, c in fields.items() if k not in drop]
    return attrs.select("item_id", F.explode(F.concat(*entries)).alias("e")).select("item_id", "e.field", "e.token")


def _field(name: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(name).alias("field"), t.alias("token")))


def token_weights(tokens: DataFrame, n_items: int, idf: bool = True) -> DataFrame:
    """Add a weight to each token: 1 / tokens of the item's field, times the token's rarity within its field (at least 0.05).

    Brands of one item are removed; a field's rarest token is found before that."""
    df = tokens.groupBy("field", "token").agg(F.countDistinct("item_id").alias("df")).withColumn("idf", F.log(F.lit(float(n_items)) / F.col("df")))
    most = df.groupBy("field").agg(F.max("idf").alias("top"))
    known = df.join(F.broadcast(most), "field").filter((F.col("field") != "brand") | (F.col("df") >= 2))
    rows = tokens.join(known, ["field", "token"])
    size = F.count(F.lit(1)).over(Window.partitionBy("item_id", "field"))
    rare = F.when(F.lit(idf) & ~F.col("field").isin("brand", "seg") & (F.col("top") > 0), F.greatest(F.lit(0.05), F.col("idf") / F.col("top"))).otherwise(1.0)
    return rows.select("item_id", "field", "token", (rare / size).alias("weight"))


def exclude_seen(candidates: DataFrame, train: DataFrame) -> DataFrame:
    return candidates.join(train.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def popularity_recs(train: DataFrame, users: DataFrame, k: int, pool: DataFrame | None = None, shelf: int = SHELF) -> DataFrame:
    """Each user's ``k`` most sold items that they don't have; ties by item.

    Items are ranked once. A user's list ends at the rank above which k items
    are not theirs: of their own items' ranks r0 < r1 < ... those with
    r_j - j < k push the end by one. The items up to the largest end are
    broadcast where there are at most ``shelf`` of them; else the ranks, which
    all users share, are dealt over tasks.
    """
    bought = train.select("user_id", "item_id")
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    if pool is not None:
        counts = pool.select("item_id").distinct().join(counts, "item_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ranked = dense_index(counts.withColumn("less", -F.col("score")), [], ["less", "item_id"], "place").drop("less")
    ranked = cut_lineage(ranked)
    asked = users.select("user_id").distinct()
    # an item pushes the end only if fewer than k of the ranks before it aren't the user's, so not beyond k and all that a user has
    near = k + (train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    places, mine = ranked.filter(F.col("place") < near).select("item_id", "place"), bought.join(asked, "user_id", "left_semi")
    own = mine.join(F.broadcast(places), "item_id").distinct() if near <= shelf else salted_join(mine.distinct(), places, ["item_id"], F.xxhash64("user_id"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("place")) - 1
    pushed = own.withColumn("turn", turn).filter(F.col("place") - F.col("turn") < k).groupBy("user_id").agg(F.collect_list("place").alias("taken"))
    each = cut_lineage(asked.join(pushed, "user_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>"))))
    last = k + (each.agg(F.max(F.size("taken"))).first()[0] or 0)
    free = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("taken") + F.lit(k - 1).cast("long")), "taken")
    rows = each.select("user_id", F.posexplode(free).alias("at", "place")).select("user_id", "place", (F.col("at") + 1).alias("rank"))
    best = ranked.filter(F.col("place") < last)
    joined = rows.join(F.broadcast(best), "place") if last <= shelf else salted_join(rows, best, ["place"], F.xxhash64("user_id"))
    return joined.select("user_id", "item_id", "score", "rank")


def text_vectors(items: DataFrame, text: str, dim: int = 256, wanted: DataFrame | None = None) -> DataFrame:
    """(item_id, embedding): a unit vector for each item from its words: hashed counts weighed by rarity. Items without words get zeros.

    A word's place is its md5 number modulo ``dim``; a place that df of N items
    have weighs ln((N + 1) / (df + 1)). Given ``wanted`` (item_id), those items
    get a vector; of one that ``items`` lacks it is zeros.
    """
    words = items.select("item_id", F.explode(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")).alias("word"))
    counts = cut_lineage(words.groupBy("item_id", F.pmod(md5_number("word"), F.lit(dim)).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("tf")))
    n = items.count()
    rare = counts.groupBy("place").agg(F.log(F.lit(float(n + 1)) / (F.count(F.lit(1)) + 1)).alias("idf"))  # dim rows
    weights = counts.join(F.broadcast(rare), "place").select("item_id", "place", (F.col("tf") * F.col("idf")).alias("x"))
    held = weights.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("at"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))  # dim entries at most
    whole = (items if wanted is None else wanted).select("item_id").distinct().join(held, "item_id", "left")
    # vectors are made dense last: a join would sort them, dim numbers an item
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.col("at")[i], F.lit(0.0)) / F.col("norm")).otherwise(0.0))
    return whole.select("item_id", dense.alias("embedding"))


def negative_samples(train: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """For each positive an item at random from the trained ones, all alike: ``negative``."""
    index = dense_index(train.select("item_id").distinct(), [], ["item_id"])
    n = index.count()
    draw = md5_number(F.lit(f"{seed}:{epoch}"), F.col("user_id").cast("string"), F.col("item_id").cast("string"))
    drawn = train.select("user_id", "item_id", F.pmod(draw, F.lit(max(n, 1))).alias("idx"))
    return drawn.join(index.withColumnRenamed("item_id", "negative"), "idx").drop("idx")


def rank_eval(recs: DataFrame, truth: DataFrame, counts: DataFrame, k: int, by: DataFrame | None = None) -> DataFrame:
    """(metric, value): mean recall and NDCG at ``k`` over users with truth, users, and recall and rows of each popularity bucket.

    Given ``by``, a table of the models (a row each, with their key columns),
    ``recs`` hold these columns too, and so does the result: one pass for all
    models and metrics. Buckets without truth are left out.
    """
    keys = by.columns if by is not None else []
    gain = 1 / F.log2(F.col("rank") + 1)
    wanted = truth.select("user_id", "item_id").distinct().join(counts, "item_id", "left")
    wanted = wanted.crossJoin(F.broadcast(by)) if by is not None else wanted  # models
    rows = wanted.join(recs.select(*keys, "user_id", "item_id", "rank"), [*keys, "user_id", "item_id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count(F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    bucket = pop_bucket(F.coalesce("n", F.lit(0)))
    each = [(b, F.count(F.when(bucket == b, 1)).alias(f"m{i}"), F.count(F.when(bucket == b, F.col("rank"))).alias(f"h{i}")) for i, b in enumerate(POP_BUCKETS)]
    users = rows.groupBy(*keys, "user_id").agg(
        (F.count("rank") / F.count(F.lit(1))).alias("recall"), (F.coalesce(F.sum(gain), F.lit(0.0)) / ideal).alias("ndcg"), *[c for _, *both in each for c in both]
    )
    sums = [F.sum(c).cast("double").alias(c) for i in range(len(each)) for c in (f"m{i}", f"h{i}")]
    whole = users.groupBy(*keys).agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).cast("double").alias("users"), *sums)
    entry = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    held = [F.when(F.col(f"m{i}") > 0, F.array(entry(f"R_{b}", F.try_divide(f"h{i}", f"m{i}")), entry(f"N_{b}", F.col(f"m{i}")))).otherwise(F.array()) for i, b in enumerate(POP_BUCKETS)]
    return whole.select(*keys, F.explode(F.concat(F.array(*[entry(c, F.col(c)) for c in ("recall", "ndcg", "users")]), *held)).alias("e")).select(*keys, "e.*")


def cold_pool(counts: DataFrame, cold_max: int = 5) -> DataFrame:
    """Items with fewer than ``cold_max`` purchases in training: candidates and truth of the cold evaluation."""
    return counts.filter(F.col("n") < cold_max)


def early_stop(fit: Callable[[int], float], most: int, patience: int = 2) -> int:
    """The number of epochs with the best validation score; stops after ``patience`` without a better one."""
    best, at, since = -1.0, 0, 0
    for epochs in range(1, most + 1):
        score = fit(epochs)
        best, at, since = (score, epochs, 0) if score > best else (best, at, since + 1)
        if since >= patience:
            break
    return at


def seed_summary(results: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation over seeds; nulls are left out."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("seeds"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_sd") for m in metrics])
