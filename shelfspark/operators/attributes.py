"""Item attributes from sellers' values and from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import labels as L
from shelfspark.functions import rules as R
from shelfspark.functions import text as T
from shelfspark.operators.joins import once_each


def normalize_items(items: DataFrame) -> DataFrame:
    """Add form, skin, benefit, active from the raw values: null is blank, [] and 'other' are outside the vocabulary. Values that many items share are looked up once."""
    rules = {
        "form": L.norm_single(F.col("raw_form"), R.FORMS),
        "skin": L.norm_multi(F.col("raw_skin"), R.SKIN_TYPES),
        "benefit": L.norm_multi(F.col("raw_benefit"), R.BENEFITS),
        "active": L.norm_multi(F.col("raw_active"), R.ACTIVES),
    }
    for name, rule in rules.items():
        items = once_each(items, [f"raw_{name}"], lambda own, name=name, rule=rule: own.withColumn(name, rule))
    return items


def _title_labels(df: DataFrame) -> DataFrame:
    """Add what the title says of form and skin, and the benefits and actives that it claims."""
    low = F.lower(F.coalesce("title", F.lit("")))
    own = df.withColumns({"_free": T.strip_free(low), "_own": T.strip_negation(low)}).withColumn("_compact", F.regexp_replace("_own", r"(?U)\s+", ""))
    return own.withColumns({
        "_title_form": L.first_label(F.col("_free"), R.FORMS_V2),
        "_title_skin": L.all_labels(F.col("_free"), L.SKIN_IN_CONTEXT),
        "benefit_main": L.sorted_labels(F.col("_own"), R.BENEFITS_V2),
        "active_main": L.active_labels(F.col("_own"), F.col("_compact")),
    }).drop("_free", "_own", "_compact")


def fill_attributes(norm: DataFrame, inter: DataFrame) -> DataFrame:
    """Seller, text and merged labels of items with a purchase.

    One form, the seller's before the text's; the other attributes are unions.
    benefit_main and active_main are what the title claims.
    """
    v2 = L.with_text_labels(norm, T.tagged_text(F.col("title"), F.col("features"), F.col("description")))
    v2 = once_each(v2, ["title"], _title_labels).join(inter.select("item_id").distinct(), "item_id", "left_semi")
    v2 = v2.withColumns({"_form": F.coalesce("_title_form", "text_form"), "_skin": F.array_union("text_skin", "_title_skin"), "_seller_skin": L.labels_or_none(F.col("skin"))})
    found = v2.select(
        "item_id", "segment", "store", "price",
        L.as_label_array(F.col("form")).alias("form_seller"),
        L.canonical_skin(F.col("_seller_skin")).alias("skin_seller"),
        L.labels_or_none(F.col("benefit")).alias("benefit_seller"),
        L.labels_or_none(F.col("active")).alias("active_seller"),
        L.as_label_array(F.col("_form")).alias("form_text"),
        L.canonical_skin(F.col("_skin")).alias("skin_text"),
        F.col("text_benefit").alias("benefit_text"),
        F.col("text_active").alias("active_text"),
        "benefit_main", "active_main",
    )
    union = lambda k: F.array_sort(F.array_union(f"{k}_seller", f"{k}_text"))
    return found.withColumns({
        "form": F.when(F.size("form_seller") > 0, F.col("form_seller")).otherwise(F.col("form_text")),
        "skin": L.canonical_skin(F.array_union("skin_seller", "skin_text")),
        "benefit": union("benefit"),
        "active": union("active"),
    })


def aggregate_labels(df: DataFrame, key: str, order: str, single: str, multi: list[str]) -> DataFrame:
    """Child rows to their parent: sorted unions of the arrays ``multi``; the most frequent ``single``, of ties the first seen."""
    unions = df.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in multi])
    votes = df.filter(F.col(single).isNotNull()).groupBy(key, single).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    best = votes.groupBy(key).agg(F.max(F.struct("n", (-F.col("at")).alias("early"), single)).alias("best")).select(key, F.col(f"best.{single}").alias(single))
    return unions.join(best, key, "left")


def image_subset(df: DataFrame, key: str, order: str, which: str, hires: str = "is_hires", others: int = 2, seed: int = 42) -> DataFrame:
    """Child images: 'main', 'main_plus' (and some others at random), 'hires' or 'all'."""
    if which == "main":
        return df.filter(F.col(order) == 0)
    if which == "hires":
        return df.filter(F.col(hires))
    if which == "all":
        return df
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col(order).cast("string")))
    place = F.row_number().over(Window.partitionBy(key, F.col(order) == 0).orderBy(draw, order))
    return df.withColumn("_place", place).filter((F.col(order) == 0) | (F.col("_place") <= others)).drop("_place")


def assemble_lines(lines: DataFrame, keys: list[str], min_score: float = 0.5) -> DataFrame:
    """Recognised lines (text, score, x1, y1, x2, y2) of each image as text in reading order.

    A gap of more than a quarter of the width between left edges starts a
    column; rows are heights in median line heights; tall lines are '[BIG]'. All
    windows share one key, so there is one shuffle.
    """
    one, by = Window.partitionBy(*keys), Window.partitionBy(*keys)
    good = lines.filter((F.col("score") >= min_score) & (T.trimmed(F.col("text")) != ""))
    h = F.col("y2") - F.col("y1")
    good = good.withColumns({"med": F.greatest(F.percentile(h, 0.5).over(one), F.lit(1.0)), "width": F.max("x2").over(one)})
    left = by.orderBy("x1", "y1", "text")
    jump = F.when(F.col("x1") - F.lag("x1").over(left) > 0.25 * F.col("width"), 1).otherwise(0)
    good = good.withColumn("jump", jump).withColumn("column", F.sum("jump").over(left.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.bround((F.col("y1") + F.col("y2")) / 2 / F.col("med"))
    tagged = F.concat(F.when(h >= 1.5 * F.col("med"), "[BIG] ").otherwise(""), F.col("text"))
    entry = F.struct("column", row.alias("row"), "x1", "text", tagged.alias("tagged"))
    whole = good.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    plain = F.regexp_replace(F.array_join(F.transform("all", lambda e: e["text"]), "\n"), r"-\s+(?=[a-z])", "")
    return whole.select(*keys, plain.alias("text"), F.array_join(F.transform("all", lambda e: e["tagged"]), "\n").alias("tagged"))


def parse_model_output(raw: Column) -> Column:
    """form, skin, benefit and evidence of a model's JSON; of a cut string, the fields and list items that are whole, evidence included; truncated says so.

    Evidence is a map from field to quote; a list of quotes stays a JSON array.
    """
    schema = "form string, skin_type array<string>, benefits array<string>, evidence map<string,string>, _corrupt_record string"
    whole = F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    good = whole.isNotNull() & whole["_corrupt_record"].isNull() & raw.rlike(r"(?s)\{.*\}")
    halves = F.split(F.coalesce(raw, F.lit("")), r'"evidence"\s*:', 2)
    head, tail = F.get(halves, 0), F.coalesce(F.get(halves, 1), F.lit(""))

    inner = r'([^"\\]*+(?:\\.[^"\\]*+)*+)'  # of a JSON string, escapes included

    def plain(quoted: Column) -> Column:
        return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>"), 0), quoted)

    def listed(key: str) -> Column:
        inside = F.regexp_extract(head, rf'(?s)"{key}"\s*:\s*\[([^\]]*)', 1)
        return F.transform(F.regexp_extract_all(inside, F.lit(f'"{inner}"'), 1), plain)

    form = F.nullif(plain(F.regexp_extract(head, rf'"form"\s*:\s*"{inner}"', 1)), F.lit(""))

    def quoted(key: str) -> Column:
        quote, several = rf'"{key}"\s*:\s*"{inner}"', rf'"{key}"\s*:\s*(\[[^\]]*\])'
        cut = F.regexp_extract_all(F.regexp_extract(tail, rf'"{key}"\s*:\s*\[([^\]]*)$', 1), F.lit(f'"{inner}"'), 1)
        return (
            F.when(tail.rlike(quote), plain(F.regexp_extract(tail, quote, 1))).when(tail.rlike(several), F.regexp_extract(tail, several, 1))
            .when(F.size(cut) > 0, F.to_json(F.transform(cut, plain)))
        )

    keys = ("form", "skin_type", "benefits")
    found = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(quoted, keys))), lambda k, v: v.isNotNull())
    choose = lambda a, b: F.when(good, a).otherwise(b)
    return F.struct(
        choose(whole["form"], form).alias("form"),
        choose(F.coalesce(whole["skin_type"], L.no_labels()), listed("skin_type")).alias("skin"),
        choose(F.coalesce(whole["benefits"], L.no_labels()), listed("benefits")).alias("benefit"),
        choose(whole["evidence"], found).alias("evidence"),
        (~good).alias("truncated"),
    )


def ground_labels(df: DataFrame, source: str) -> DataFrame:
    """Raw labels (form, skin, benefit) and quotes (form_quote, ...): *_g, those that a supported quote bears out; *_q, rules on the quotes alone."""
    out = df
    for name in ("form", "skin", "benefit"):
        quote = F.when(L.evidence_supported(F.col(f"{name}_quote"), F.col(source)), F.translate(F.lower(f"{name}_quote"), "_", " ")).otherwise("")
        out = out.withColumn(f"{name}_text", quote)
    text = {n: F.col(f"{n}_text") for n in ("form", "skin", "benefit")}
    return out.withColumns({
        "form_g": F.when(F.array_contains(L.all_labels(text["form"], R.FORMS), F.col("form")), F.col("form")),
        "skin_g": F.array_sort(F.array_intersect("skin", L.all_labels(text["skin"], R.STRICT_SKIN_TYPES))),
        "benefit_g": F.array_sort(F.array_intersect("benefit", L.all_labels(text["benefit"], R.BENEFITS))),
        "form_q": L.first_label(text["form"], R.FORMS_V2),
        "skin_q": L.skin_labels(text["skin"]),
        "benefit_q": L.sorted_labels(text["benefit"], R.BENEFITS_V2),
    }).drop("form_text", "skin_text", "benefit_text")


def combine_methods(model: DataFrame, ruled: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Form, skin and benefit from a model, actives from rules; the title's form comes first, its skin types are added."""
    said = once_each(titles.select(key, "title"), ["title"], lambda own: own.withColumns({"_form": L.title_form(F.col("title")), "_skin": L.title_skin(F.col("title"))}))
    both = said.join(model.select(key, "form", "skin", "benefit"), key, "left").join(ruled.select(key, "active"), key, "left")
    return both.select(
        key,
        F.coalesce("_form", "form").alias("form"),
        F.array_sort(F.array_union(L.labels_or_none(F.col("skin")), F.col("_skin"))).alias("skin"),
        L.labels_or_none(F.col("benefit")).alias("benefit"),
        L.labels_or_none(F.col("active")).alias("active"),
    )


def find_evidence(df: DataFrame, key: str, order: str, text: str, label: str, rules: R.Rules, width: int = 60) -> DataFrame:
    """For each key, the first child text in which the rule of its ``label`` hits, with ``width`` characters around."""
    found = F.lit(None).cast("string")
    for name, regex in rules:
        found = F.when(F.col(label) == name, F.regexp_extract(F.lower(text), rf"(?s)(?U)(.{{0,{width}}}(?:{regex}).{{0,{width}}})", 1)).otherwise(found)
    hit = df.withColumn("evidence", F.nullif(found, F.lit(""))).filter("evidence IS NOT NULL")
    return hit.groupBy(key, label).agg(F.min_by("evidence", order).alias("evidence"), F.min(order).alias("first"))
