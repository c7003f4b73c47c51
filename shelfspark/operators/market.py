"""Profiles, sales concentration, cold starts and sellers' data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.rules import COMPLAINTS, SELF_TYPES
from shelfspark.functions.text import nonempty_text
from shelfspark.operators.windows import quantile_bins


def share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def fill_rates(df: DataFrame, cols: dict[str, Column], by: str) -> DataFrame:
    """Rows and shares of filled values, overall ('ALL') and for each ``by``, in one pass."""
    flagged = df.select(F.col(by), *[F.when(c, 1.0).otherwise(0.0).alias(n) for n, c in cols.items()])
    out = flagged.rollup(by).agg(F.grouping(by).alias("g"), F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in cols])
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "n", *cols)


def value_counts(df: DataFrame, column: Column, top: int | None = None) -> DataFrame:
    """Frequencies of a value (of an array's elements too, if it is exploded before), the most frequent first."""
    counts = df.groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "value").limit(top)


def capped_histogram(df: DataFrame, column: Column, cap: int = 10) -> DataFrame:
    return df.groupBy(F.least(column, F.lit(cap)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def profile_catalog(items: DataFrame, filled: dict[str, Column]) -> DataFrame:
    """(metric, value, n) of a catalogue: filled columns, segments, images a product; one pass over an exploded list."""
    entries = [F.struct(F.lit("filled").alias("metric"), F.lit(n).alias("value"), c.cast("int").alias("n")) for n, c in filled.items()]
    entries += [F.struct(F.lit("segment").alias("metric"), F.col("segment").alias("value"), F.lit(1).alias("n"))]
    entries += [F.struct(F.lit("images").alias("metric"), F.least("n_images", F.lit(10)).cast("string").alias("value"), F.lit(1).alias("n"))]
    return items.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.metric", "e.value").agg(F.sum("e.n").alias("n"))


def example_rows(items: DataFrame, key: str, columns: list[str], n: int = 2, width: int = 300) -> DataFrame:
    """The first ``n`` rows by key that have all ``columns``, each clipped to ``width`` characters."""
    whole = items
    for c in columns:
        whole = whole.filter(nonempty_text(F.col(c)))
    return whole.select(key, *[F.substring(c, 1, width).alias(c) for c in columns]).orderBy(key).limit(n)


def profile_reviews(reviews: DataFrame, inter: DataFrame, ks: list[int]) -> DataFrame:
    """(metric, value) of reviews: totals, verified share, time range, users, and users and rows kept at each k."""
    all_ = reviews.agg(
        F.count(F.lit(1)).cast("double").alias("reviews"), share(F.col("verified")).alias("verified_share"), F.min("ts").cast("double").alias("first_ts"), F.max("ts").cast("double").alias("last_ts"),
        F.countDistinct("user_id").cast("double").alias("users"), F.countDistinct(F.when(F.col("verified"), F.col("user_id"))).cast("double").alias("verified_users"),
    )
    per_user = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    kept = per_user.agg(*[F.sum(F.when(F.col("n") >= k, 1).otherwise(0)).cast("double").alias(f"users_{k}") for k in ks], *[F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)).cast("double").alias(f"rows_{k}") for k in ks])
    both = all_.crossJoin(kept)  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in both.columns])).alias("e")).select("e.*")


def sales_concentration(inter: DataFrame, by: str = "segment") -> DataFrame:
    """Items, purchases, share of the top 1 % and 10 % of items, share of items with fewer than 5, and Gini; for all and each ``by``.

    From the histogram of counts: v purchases, m items with so many, r items
    with fewer. The window runs over distinct counts, not over items.
    """
    per_item = inter.groupBy("item_id", by).agg(F.count(F.lit(1)).alias("v"))
    both = per_item.select(F.explode(F.array(F.lit("ALL"), F.col(by))).alias(by), "v")
    hist = both.groupBy(by, "v").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(by)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumns({"n": F.sum("m").over(w), "total": F.sum(F.col("v") * F.col("m")).over(w), "r": F.coalesce(F.sum("m").over(up), F.lit(0))})
    n, m, r, v = (F.col(c) for c in "nmrv")

    def top(divisor: int) -> Column:
        k = F.greatest(F.lit(1), F.floor(n / divisor))
        above = n - r - m  # items with more purchases
        return F.sum(v * F.least(m, F.greatest(k - above, F.lit(0)))) / F.first("total")

    cumulated = F.sum((v * (m * n - (m * r + m * (m + 1) / 2) + m)).cast("double"))
    count = F.first("n")
    return hist.groupBy(by).agg(
        count.alias("items"), F.first("total").alias("purchases"), top(100).alias("top1"), top(10).alias("top10"),
        (F.sum(F.when(v < 5, m).otherwise(0)) / count).alias("under5"), (1 - 2 * cumulated / (F.first("total") * count) + 1 / count).alias("gini"),
    )


def cold_start_pressure(inter: DataFrame, days: int = 365, limits: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Of the purchases in the last ``days``, the shares whose item had none, and fewer than each limit, before."""
    cut = inter.agg((F.max("ts") - days * 86_400_000).alias("cut"))
    marked = inter.crossJoin(F.broadcast(cut))  # one row
    before = marked.filter("ts < cut").groupBy("item_id").agg(F.count(F.lit(1)).alias("prev"))
    recent = marked.filter("ts >= cut").join(before, "item_id", "left").withColumn("prev", F.coalesce("prev", F.lit(0)))
    return recent.agg(F.count(F.lit(1)).alias("n"), share(F.col("prev") == 0).alias("none"), *[share(F.col("prev") < k).alias(f"under{k}") for k in limits])


def norm_report(norm: DataFrame, attributes: dict[str, str], top: int = 15) -> DataFrame:
    """(attribute, kind, value, n): filled and mapped rows, labels, and the most frequent raw values that map to nothing.

    ``attributes``: normalised column -> raw column; a string is one label, an array several."""
    parts = []
    for name, raw in attributes.items():
        c = F.col(name)
        single = norm.schema[name].dataType.simpleString() == "string"
        labels = F.when(c.isNotNull(), F.array(c)) if single else c
        mapped = F.coalesce((c != "other") if single else F.size(c) > 0, F.lit(False))
        known = norm.select(labels.alias("labels"), mapped.alias("mapped"), c.isNotNull().alias("filled"), F.col(raw).alias("raw"))
        entry = lambda kind, value: F.struct(F.lit(name).alias("attribute"), F.lit(kind).alias("kind"), value.alias("value"))  # noqa: B023, E731
        flags = F.array_compact(F.array(F.when(F.col("filled"), entry("filled", F.lit(""))), F.when(F.col("mapped"), entry("mapped", F.lit("")))))
        every = F.concat(flags, F.coalesce(F.transform("labels", lambda x: entry("label", x)), F.array().cast("array<struct<attribute:string,kind:string,value:string>>")))  # noqa: B023
        counted = known.select(F.explode(every).alias("e")).select("e.*").groupBy("attribute", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
        missed = known.filter("filled AND NOT mapped").groupBy(F.lit(name).alias("attribute"), F.lit("unmapped").alias("kind"), F.col("raw").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        parts += [counted, missed.orderBy(F.desc("n"), "value").limit(top)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seller_quality(attrs: DataFrame, inter: DataFrame) -> DataFrame:
    """(metric, value): fill rates of sellers' values, skin filled with exactly 'all', benefits filled by popularity fifth, and form agreement with the text."""
    counts = inter.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    fifths = quantile_bins(attrs.join(counts, "item_id"), "n", 5, "item_id")
    filled = {k: F.size(f"{k}_seller") > 0 for k in ("form", "skin", "benefit", "active")}
    one = attrs.agg(
        *[share(c).alias(f"filled_{k}") for k, c in filled.items()],
        F.avg(F.when(filled["skin"], F.when(F.array_join("skin_seller", ",") == "all", 1.0).otherwise(0.0))).alias("skin_only_all"),
        F.avg(F.when(filled["form"] & (F.size("form_text") > 0), F.when(F.arrays_overlap("form_seller", "form_text"), 1.0).otherwise(0.0))).alias("form_agreement"),
    )
    flat = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("e")).select("e.*")
    by_fifth = fifths.groupBy("bin").agg(share(filled["benefit"]).alias("value")).select(F.concat(F.lit("benefit_fifth_"), F.col("bin").cast("string")).alias("metric"), "value")
    return flat.unionByName(by_fifth)


def review_terms(reviews: DataFrame, text: str, rating: str, rules: list[tuple[str, str]] = COMPLAINTS, self_rules: list[tuple[str, str]] = SELF_TYPES, min_low: int = 30) -> tuple[DataFrame, DataFrame]:
    """Rates of each complaint by rating bucket (low <= 2, high >= 4; a null rating is low), and the same by the type that
    reviewers name as their own, where a type has at least ``min_low`` low reviews."""
    r = F.coalesce(F.col(rating), F.lit(0.0))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = {n: low.rlike("(?U)" + rx) for n, rx in rules}
    base = reviews.select(F.when(r <= 2, "low").when(r >= 4, "high").otherwise("mid").alias("bucket"), *[F.when(c, 1.0).otherwise(0.0).alias(n) for n, c in flags.items()], F.array_compact(F.array(*[F.when(low.rlike("(?U)" + rx), F.lit(n)) for n, rx in self_rules])).alias("types"))
    names = [n for n, _ in rules]
    rates = base.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names])
    typed = base.withColumn("type", F.explode("types")).groupBy("type", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names])
    known = F.max(F.when(F.col("bucket") == "low", F.col("n"))).over(Window.partitionBy("type"))  # 3 rows for each type, so the reviews are read once
    return rates, typed.withColumn("_low", known).filter(F.col("_low") >= min_low).drop("_low")


def term_ratios(rates: DataFrame) -> DataFrame:
    """(term, low, high, ratio) of review_terms' rates: how often low reviews have a complaint, high ones, and the quotient (null if no high one has it)."""
    names = [c for c in rates.columns if c not in ("bucket", "n")]
    flat = rates.select("bucket", F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("rate")) for c in names])).alias("e")).select("bucket", "e.*")
    both = flat.groupBy("term").agg(*[F.max(F.when(F.col("bucket") == b, F.col("rate"))).alias(b) for b in ("low", "high")])
    return both.withColumn("ratio", F.when(F.col("high") > 0, F.col("low") / F.col("high")))
