"""Labels of several methods against a truth, and sheets for a human to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.labels import canonical_skin
from shelfspark.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty b."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))


def attach_predictions(truth: DataFrame, labels: DataFrame, key: str, single: str, multi: list[str]) -> DataFrame:
    """Predicted products only, with pred_* and gt_*; a truth of 'other' is none."""
    renamed = labels.select(key, *[F.col(c).alias(f"pred_{c}") for c in [single, *multi]])
    own = truth.select(key, "segment", F.when(F.col(single) != "other", F.col(single)).alias(f"gt_{single}"), *[F.coalesce(F.filter(c, lambda x: x != "other"), F.array().cast("array<string>")).alias(f"gt_{c}") for c in multi])
    return own.join(renamed, key)


def score_multilabel(df: DataFrame, attribute: str, by: str = "segment") -> DataFrame:
    """Rows with truth: n, answered share, micro precision and recall; overall ('ALL') and for each ``by``."""
    gt, pred = F.col(f"gt_{attribute}"), F.coalesce(F.col(f"pred_{attribute}"), F.array().cast("array<string>"))
    rows = df.filter(F.size(gt) > 0).select(F.col(by).alias("_by"), F.size(F.array_intersect(gt, pred)).alias("hit"), F.size(gt).alias("t"), F.size(pred).alias("p"))
    out = rows.rollup("_by").agg(F.grouping("_by").alias("g"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("p") > 0, 1.0).otherwise(0.0)).alias("answered"), ratio(F.sum("hit"), F.sum("p")).alias("precision"), ratio(F.sum("hit"), F.sum("t")).alias("recall"))
    return out.filter("n > 0").select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("_by")).alias(by), F.lit(attribute).alias("attribute"), "n", "answered", "precision", "recall")


def score_single(df: DataFrame, attribute: str, by: str = "segment") -> DataFrame:
    """Rows with truth: n, answered share, accuracy among the answered."""
    gt, pred = F.col(f"gt_{attribute}"), F.col(f"pred_{attribute}")
    rows = df.filter(gt.isNotNull()).select(F.col(by).alias("_by"), pred.isNotNull().alias("a"), (pred == gt).alias("ok"))
    out = rows.rollup("_by").agg(F.grouping("_by").alias("g"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("a"), 1.0).otherwise(0.0)).alias("answered"), ratio(F.count_if(F.col("ok")), F.count_if("a")).alias("accuracy"))
    return out.filter("n > 0").select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("_by")).alias(by), F.lit(attribute).alias("attribute"), "n", "answered", "accuracy")


def score_table(both: DataFrame, single: str, multi: list[str], by: str = "segment", vague: dict[str, str] | None = None) -> DataFrame:
    """All attributes of attach_predictions' rows: (by, attribute, n, answered, precision, recall).

    A single label's accuracy stands as precision; its recall is null. For each
    attribute of ``vague`` there are further rows, '<attribute>_not_<label>',
    without products whose only true label is that one.
    """
    out = score_single(both, single, by).select(by, "attribute", "n", "answered", F.col("accuracy").alias("precision"), F.lit(None).cast("double").alias("recall"))
    for a in multi:
        out = out.unionByName(score_multilabel(both, a, by))
    for a, label in (vague or {}).items():
        rest = both.filter(F.col(f"gt_{a}") != F.array(F.lit(label)))
        out = out.unionByName(score_multilabel(rest, a, by).withColumn("attribute", F.lit(f"{a}_not_{label}")))
    return out


def with_resolution(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Add resolution: 'high' where image_stats counted only high-resolution images, else 'low', also without images."""
    own = stats.select(key, F.when(F.col("all_hires"), "high").otherwise("low").alias("resolution"))
    return df.join(own, key, "left").withColumn("resolution", F.coalesce("resolution", F.lit("low")))


def score_methods(truth: DataFrame, methods: dict[str, DataFrame], key: str, single: str, multi: list[str], by: str = "segment", vague: dict[str, str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """score_table of several methods, side by side, with a column method; given image_stats, ``by`` may be 'resolution'."""
    out = None
    for name, labels in methods.items():
        both = attach_predictions(truth, labels, key, single, multi)
        both = cut_lineage(both if stats is None else with_resolution(both, stats, key))  # for a pass by attribute each
        rows = score_table(both, single, multi, by, vague).select(F.lit(name).alias("method"), by, "attribute", "n", "answered", "precision", "recall")
        out = rows if out is None else out.unionByName(rows)
    return out


def error_candidates(df: DataFrame, key: str, single: str, multi: list[str]) -> DataFrame:
    """A row for each wrong label: predicted but not true, or a wrong single label. Rows without truth are left out."""
    gt, pred = F.col(f"gt_{single}"), F.col(f"pred_{single}")
    out = df.filter(gt.isNotNull() & (pred != gt)).select(key, F.lit(single).alias("attribute"), pred.alias("label"))
    for a in multi:
        wrong = df.filter(F.size(f"gt_{a}") > 0).select(key, F.lit(a).alias("attribute"), F.explode(F.array_except(f"pred_{a}", f"gt_{a}")).alias("label"))
        out = out.unionByName(wrong)
    return out


def corrected_precision(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Measured precision, raised by the share of errors that a reviewer found right (verdict A): attribute, n, a, b, c, measured, corrected."""
    v = F.upper(F.trim("verdict"))
    counts = verdicts.filter(v.isin("A", "B", "C")).groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v == x).alias(x.lower()) for x in "ABC"])
    return counts.join(measured.select("attribute", F.col("precision").alias("measured")), "attribute").withColumn("corrected", F.col("measured") + (1 - F.col("measured")) * F.col("a") / F.col("n"))


def review_notes(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent notes on labels that a reviewer found wrong (verdict B), of ties the first by text."""
    wrong = verdicts.filter(F.upper(F.trim("verdict")) == "B").select(F.trim("note").alias("note")).filter("note IS NOT NULL")
    return wrong.groupBy("note").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "note").limit(n)


def audit_matrix(methods: dict[str, DataFrame], truth: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """A row for each product, attribute and label that any method or the truth gives, with a flag for each."""
    def stacked(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.array().cast("array<string>")).alias("labels")) for a in attributes])
        return df.select(key, F.explode(entries).alias("e")).select(key, "e.attribute", F.explode("e.labels").alias("label"), F.lit(name).alias("method"))

    rows = stacked(truth, "in_truth")
    for name, df in methods.items():
        rows = rows.unionByName(stacked(df, name))
    return rows.groupBy(key, "attribute", "label").agg(*[F.coalesce(F.bool_or(F.col("method") == n), F.lit(False)).alias(n) for n in [*methods, "in_truth"]])


def _judged(sheet: DataFrame, methods: list[str], verdict: str, *columns: Column) -> DataFrame:
    """A row for each label that a human marked right (O) or wrong (X) and each method that gave it."""
    mark = F.upper(F.trim(verdict))
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("on")) for m in methods])
    return sheet.filter(mark.isin("O", "X")).select(*columns, (mark == "O").alias("right"), F.explode(entries).alias("e")).filter("e.on")


def _share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def audit_score(sheet: DataFrame, methods: list[str], verdict: str = "verdict", blank: str | None = None) -> DataFrame:
    """Of each method's judged labels, the share that a human marked right and, of products that are not ``blank``, the share in the truth, for each attribute."""
    known = F.lit(True) if blank is None else ~F.col(blank)
    rows = _judged(sheet, methods, verdict, F.col("attribute"), F.when(known, F.col("in_truth").cast("double")).alias("seller"))
    return rows.groupBy("attribute", F.col("e.method").alias("method")).agg(F.count(F.lit(1)).alias("n"), _share(F.col("right")).alias("human"), F.avg("seller").alias("seller"))


def audit_blank(sheet: DataFrame, methods: list[str], verdict: str = "verdict", blank: str = "blank") -> DataFrame:
    """Of each method's judged labels for products whose sellers gave none, the share that a human marked right."""
    rows = _judged(sheet.filter(F.col(blank)), methods, verdict)
    return rows.groupBy(F.col("e.method").alias("method")).agg(F.count(F.lit(1)).alias("n"), _share(F.col("right")).alias("human"))


def compare_sheet(truth: DataFrame, methods: dict[str, DataFrame], key: str, single: str, multi: list[str]) -> DataFrame:
    """A row for each product and attribute, for a human to correct: the seller's labels, each method's, and ``human``, which starts as the seller's.

    Labels are joined by ', '; a product without any seller's label is blank;
    confirmed and note are left empty.
    """
    names = [single, *multi]

    def listed(df: DataFrame, name: str, *more: str) -> DataFrame:
        one = F.when(F.col(single) != "other", F.array(single)).otherwise(F.array().cast("array<string>"))
        several = [F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != "other") for c in multi]
        joined = [F.array_join(c, ", ") for c in (one, *several)]
        return df.select(key, *more, F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*joined)).alias(name))

    out = listed(truth, "seller", "segment").withColumn("blank", F.array_join(F.map_values("seller"), "") == "")
    for name, df in methods.items():
        out = out.join(listed(df, name), key, "left")
    rows = out.select("*", F.explode(F.array(*map(F.lit, names))).alias("attribute"))
    at = {c: F.coalesce(F.col(c)[F.col("attribute")], F.lit("")).alias(c) for c in ("seller", *methods)}
    return rows.select(key, "segment", "blank", "attribute", *at.values(), at["seller"].alias("human"), F.lit("").alias("confirmed"), F.lit("").alias("note"))


def compare_score(sheet: DataFrame, methods: list[str], human: str = "human", blank: str = "blank", confirmed: str | None = None, seller: str | None = None, skin: str = "skin") -> DataFrame:
    """Values of several methods ('a, b') against a human's, per attribute, for all products, those with a seller's value and blank ones.

    Given ``confirmed``, only rows with a Y there count. Given ``seller``, that
    column is scored like a method, but not for blank products alone. Skin types
    are made canonical on both sides: all four basic ones are 'all'.
    """
    def labels(c: Column) -> Column:
        names = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != ""))
        return F.when(F.col("attribute") == skin, canonical_skin(names)).otherwise(names)

    rows = sheet if confirmed is None else sheet.filter(F.upper(F.trim(confirmed)) == "Y")
    entries = F.array(*[F.struct(F.lit(m).alias("method"), labels(F.col(m)).alias("pred")) for m in [*methods, *([seller] if seller else [])]])
    groups = F.array(F.lit("all"), F.when(F.col(blank), "blank").otherwise("has_truth"))
    rows = rows.select("attribute", labels(F.col(human)).alias("gt"), F.explode(entries).alias("e"), groups.alias("groups"))
    rows = rows.select("attribute", "e.method", "e.pred", "gt", F.explode("groups").alias("kind"))
    rows = rows.filter((F.col("kind") != "blank") | (F.col("method") != seller)) if seller else rows
    hit = F.sum(F.size(F.array_intersect("gt", "pred")))
    return rows.groupBy("attribute", "kind", "method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.size("pred") > 0, 1.0).otherwise(0.0)).alias("answered"), ratio(hit, F.sum(F.size("pred"))).alias("precision"), ratio(hit, F.sum(F.size("gt"))).alias("recall"))
