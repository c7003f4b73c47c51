"""Rules on the documented cases."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import labels as L
from shelfspark.functions import rules as R
from shelfspark.functions import text as T


def value(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "label"), [(None, None), ("None", None), (" ", None), ("xyz", "other"), ("Lotion, Gel", "lotion"), ("serum_drops", "serum")])
def test_norm_single(spark, raw, label):
    assert value(spark, L.norm_single(F.col("c"), R.FORMS), c=raw) == label


@pytest.mark.parametrize(("raw", "labels"), [(None, None), ("xyz", []), ("Dry, Oily & Combination", ["dry", "oily", "combination"])])
def test_norm_multi(spark, raw, labels):
    assert value(spark, L.norm_multi(F.col("c"), R.SKIN_TYPES), c=raw) == labels


def test_titles(spark):
    assert value(spark, L.title_form(F.col("c")), c="Soap-Free Cleanser") is None
    assert value(spark, L.title_form(F.col("c")), c="TURMERIC CLAY MASK") == "clay_scrub"
    assert value(spark, L.title_skin(F.col("c")), c="Advanced Dry Skin Therapy") == ["dry"]
    assert value(spark, L.title_skin(F.col("c")), c=None) == []


def test_split_values(spark):
    assert value(spark, T.split_values(F.col("c")), c="Dry, Oily & Combination and Normal;") == ["dry", "oily", "combination", "normal"]
    assert value(spark, T.split_values(F.col("c")), c=None) == []


def test_canonical_skin(spark):
    assert value(spark, L.canonical_skin(F.col("c")), c=["dry", "oily", "combination", "normal", "mature"]) == ["all", "mature"]
    assert value(spark, L.canonical_skin(F.col("c")), c=["oily", "dry"]) == ["dry", "oily"]


def test_sections(spark):
    text = "[BIG] Dry skin balm\nNo mineral oil. Soothing\nApply to clean and dry skin\nDirections: rub\nfor oily skin\nIngredients: Niacin-\namide, Coconut Oil"
    df = spark.createDataFrame([(text,)], "t string")
    r = L.with_text_labels(df, F.col("t")).first()
    assert r["text_form"] == "balm" and r["text_skin"] == ["dry"] and r["text_benefit"] == ["soothing"] and r["text_active"] == ["niacinamide"]


def test_evidence(spark):
    ok = L.evidence_supported(F.col("q"), F.col("s"))
    assert value(spark, ok, q="a b c d X", s="a b c d") is True
    assert value(spark, ok, q="a b X Y", s="a b c d") is False
    assert value(spark, ok, q="", s="a") is False


def test_sorted_labels(spark):
    assert value(spark, L.sorted_labels(F.col("c"), R.BENEFITS_V2), c="smoothing, firming and bright") == ["anti_aging", "brightening", "smoothing"]
    assert value(spark, L.sorted_labels(F.col("c"), R.BENEFITS_V2), c="") == []
    assert value(spark, L.active_labels(F.col("c")), c="hyal uronic gel with cica") == ["centella", "hyaluronic_acid"]


def test_texts_are_made_ready_once(spark):
    """No rule stands in a lambda, which Spark would not compile, and the text is cut once for all sections."""
    df = spark.createDataFrame([("[BIG] Clay mask\nfor dry skin\nIngredients: Cica", "Shea gel")], "t string, u string")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    v2, v1 = L.with_text_labels(df, F.col("t")), L.with_text_labels_v1(df, F.col("u"))
    assert plan(v2).count("split(coalesce(") == 1 and plan(v1).count("translate(") == 1
    assert "isnotnull(lambda" not in plan(v2) + plan(v1)
    got, whole = v2.first(), v1.first()
    assert (got["text_form"], got["text_skin"], got["text_active"]) == ("clay_scrub", ["dry"], ["centella"])
    assert (whole["text_form"], whole["text_active"]) == ("gel", ["shea_butter"])


def test_small_files_are_dealt_over_all_tasks(spark, tmp_path):
    from shelfspark.jobs import adapters as A

    columns = [F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_type", "p_brand")], F.lit(1.0).alias("p_retailprice"), F.lit(3).alias("p_size")]
    spark.range(100).select(*columns).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    held = A.items(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) <= 50


def test_shared_texts_are_worked_on_once(spark):
    """Where rows share their keys, work sees each different one once, nulls too; where they don't, it sees every row."""
    from pyspark.sql import functions as F

    from shelfspark.operators.joins import once_each

    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i % 5}", f"v{i % 2}", "old") for i in range(100)], "id long, k string, v string, added string")
    seen = []

    def work(own):
        seen.append(own.count())
        return own.withColumn("added", F.concat_ws("|", "k", "v"))

    want = sorted((i, "|".join([*([] if i % 5 == 0 else [f"k{i % 5}"]), f"v{i % 2}"])) for i in range(100))
    for options, n in (({}, 10), ({"most": 3}, 100), ({"most_bytes": 5}, 100)):
        out = once_each(df, ["k", "v"], work, **options)
        assert sorted((r["id"], r["added"]) for r in out.collect()) == want and sorted(out.columns) == sorted(df.columns) and seen.pop() == n
    once_each(df.limit(0), ["k"], work)
