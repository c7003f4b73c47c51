"""Every query with a SQL twin against it, and properties of the others, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    twin = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, df.collect()) == rows(twin.columns, twin.fetchall())


def test_entry(spark):
    assert {r["segment"] for r in entry.entry(spark).collect()} >= {"ALL"}


def test_early_stop():
    from shelfspark.operators.recommend import early_stop

    assert early_stop(lambda e: [0, 0.1, 0.3, 0.2, 0.2, 0.9][e], 5) == 2


def test_sheets_and_lines(spark, tmp_path):
    from shelfspark.sources import ingest as I

    df = spark.createDataFrame([("a", 'x "y", z'), ("b", None)], "product string, note string")
    I.write_sheet(df, str(tmp_path / "sheet"))
    assert I.read_sheet(spark, str(tmp_path / "sheet")).columns == ["product", "note"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert I.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long", 1).count() == 1
    for name in ("utf-8-sig", "cp949"):
        (tmp_path / f"{name}.csv").write_bytes("product,memo\na,맞음 뷁\nb,\n".encode(name))
        got = I.read_sheet(spark, str(tmp_path / f"{name}.csv"))
        assert [tuple(r) for r in got.select("product", "memo").collect()] == [("a", "맞음 뷁"), ("b", None)]


def test_report(spark, tmp_path):
    from shelfspark.sources import ingest as I

    df = spark.createDataFrame([("b", 2.5), ("a|c", None)], "name string, share double")
    I.write_report([("First", df), ("Second", df.filter("share > 9"))], str(tmp_path / "report"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text == "## First\n\n| name | share |\n|---|---|\n| a c |  |\n| b | 2.5 |\n\n## Second\n\n| name | share |\n|---|---|\n\n"


def test_text_vectors_of_missing_items(spark):
    from shelfspark.operators import recommend as R

    items = spark.createDataFrame([(1, "dry skin"), (2, None), (3, "gel")], "item_id long, t string")
    wanted = spark.createDataFrame([(1,), (2,), (9,), (9,)], "item_id long")
    got = {r["item_id"]: r["embedding"] for r in R.text_vectors(items, "t", 16, wanted).collect()}
    assert set(got) == {1, 2, 9} and got[9] == [0.0] * 16 and got[2][:0] == [] and sum(x * x for x in got[1]) == pytest.approx(1)


def test_cut_model_output(spark):
    from pyspark.sql import functions as F

    from shelfspark.operators.attributes import parse_model_output

    raw = '{"form": "balm", "benefits": ["calms"], "evidence": {"form": "a soft balm", "benefits": ["it calms", "and smoo'
    got = spark.createDataFrame([(raw,)], "raw string").select(parse_model_output(F.col("raw")).alias("p")).first()["p"]
    assert got["truncated"] and got["form"] == "balm" and got["benefit"] == ["calms"] and got["evidence"] == {"form": "a soft balm", "benefits": '["it calms"]'}


@pytest.mark.parametrize("stamps", [[5], [1, 1, 2, 2], [i * 250 for i in range(40)], [i * 86_400_000 + j for i in range(3) for j in (0, 1, 1, 999, 1000, 61_000)]])
@pytest.mark.parametrize("share", [0.1, 0.25, 0.5])
def test_time_cut(spark, stamps, share):
    import numpy as np

    from shelfspark.operators.recommend import time_cut

    df = spark.createDataFrame([(x,) for x in stamps], "ts long")
    assert time_cut(df, share) == pytest.approx(float(np.quantile(stamps, 1 - share)), abs=1e-6)
    assert time_cut(df.filter("ts < 0"), share) == 0


def test_text_vectors_join_no_whole_vector(spark):
    """Vectors are made whole after the last shuffle; repeated rows of an item are one text."""
    from shelfspark.operators.recommend import text_vectors

    items = spark.createDataFrame([(1, "soap bar soap"), (1, "bar"), (2, "bar gel"), (3, None)], "item_id long, t string")
    out = text_vectors(items, "t", 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "AS embedding" in plan.split("Join", 1)[0] and "AS embedding" not in plan.split("Join", 1)[1]
    got = {r["item_id"]: list(r["embedding"]) for r in out.collect()}
    assert got[3] == [0.0] * 8 and sum(x * x for x in got[1]) == pytest.approx(1.0)
    one = {r["item_id"]: list(r["embedding"]) for r in text_vectors(spark.createDataFrame([(1, "soap bar soap bar"), (2, "bar gel"), (3, "")], "item_id long, t string"), "t", 8).collect()}
    assert set(one) == set(got) and [x > 0 for x in one[1]] == [x > 0 for x in got[1]]


def test_reviews_are_read_once_for_types(spark):
    """Types with few low reviews are left out without a second pass over the reviews."""
    from shelfspark.operators.market import review_terms

    reviews = [("My dry skin burned", 1.0)] * 3 + [("My dry skin is fine", 5.0), ("my oily skin", 1.0), (None, None)]
    rates, typed = review_terms(spark.createDataFrame(reviews, "text string, rating double"), "text", "rating", min_low=3)
    assert "Join" not in typed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["type"], r["bucket"], r["n"], r["irritation"]) for r in typed.collect()) == [("dry", "high", 1, 0.0), ("dry", "low", 3, 1.0)]
    assert {r["bucket"]: r["n"] for r in rates.collect()} == {"low": 5, "high": 1}
