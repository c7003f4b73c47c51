"""From raw item and review records to items and interactions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """JSON lines, compressed or not, with a given schema; blank lines are none, broken ones give nulls.

    A gzip file can't be split: its lines are read by one task and dealt over
    the cores before they are parsed. With ``limit``, the first so many lines in
    the order of file names and places: each task keeps that many of its own.
    """
    lines = spark.read.text(path)
    if limit is not None:
        place = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        lines = place.filter(F.trim("value") != "").orderBy("file", "block", "row").limit(limit).select("value")
    elif any(name.endswith(".gz") for name in lines.inputFiles()):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    kind = spark.createDataFrame([], schema).schema
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", kind).alias("row"))
    return parsed.select("row.*")


def read_sheet(spark: SparkSession, path: str, encoding: str = "UTF-8", fallback: str | None = "cp949") -> DataFrame:
    """A CSV sheet with a header; a byte-order mark in it is taken off.

    A sheet that has bytes outside ``encoding`` is read byte by byte and decoded
    as ``fallback`` (any of Python's that keeps ASCII), as spreadsheet programs may
    save in another encoding; None reads it as it is.
    """
    def read(name: str) -> DataFrame:
        df = spark.read.option("header", True).option("encoding", name).option("multiLine", True).option("escape", '"').csv(path)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])

    df = read(encoding)
    if fallback is None or not df.columns:
        return df
    broken = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns]).contains("\ufffd")
    if "\ufffd" not in "".join(df.columns) and df.filter(broken).isEmpty():
        return df

    @F.pandas_udf("string")
    def decoded(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: None if c is None else c.encode("latin-1").decode(fallback, "replace"))

    raw = read("ISO-8859-1")
    return raw.select(*[decoded(F.col(f"`{c}`")).alias(c.encode("latin-1").decode(fallback, "replace")) for c in raw.columns])


def write_sheet(df: DataFrame, path: str) -> None:
    """A CSV sheet whose first header starts with a byte-order mark, for spreadsheet programs."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_report(parts: list[tuple[str, DataFrame]], path: str) -> None:
    """Summary tables, each under its title, as one Markdown text; a table's rows are sorted by its columns.

    Meant for summaries, which are small whatever they sum up: one task writes them.
    """
    out = None
    for at, (title, df) in enumerate(parts):
        cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\s*[|\r\n]+\s*", " ") for c in df.columns]
        head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
        body = df.select(F.lit(at).alias("part"), F.lit(1).alias("place"), F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"))
        top = df.sparkSession.range(1).select(F.lit(at).alias("part"), F.lit(0).alias("place"), F.lit(head).alias("line"))
        end = df.sparkSession.range(1).select(F.lit(at).alias("part"), F.lit(2).alias("place"), F.lit("").alias("line"))
        for piece in (top, body, end):
            out = piece if out is None else out.unionByName(piece)
    if out is not None:
        out.coalesce(1).sortWithinPartitions("part", "place", "line").select("line").write.mode("overwrite").text(path)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``done`` yet; ``streaming.append`` adds their results to it."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def parse_details(c: Column) -> Column:
    """A JSON object of strings as a map; null, broken or other JSON is an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    whole = F.trim(c).startswith("{") & F.get_json_object(c, "$").isNotNull()
    return F.when(whole, F.coalesce(F.from_json(c, "map<string,string>"), empty)).otherwise(empty)


def image_list(columns: Column) -> Column:
    """A struct of arrays (variant, large, hi_res) as an array of structs."""
    return F.arrays_zip(columns["variant"].alias("variant"), columns["large"].alias("large"), columns["hi_res"].alias("hi_res"))


def image_url(image: Column) -> Column:
    """The large picture; where it is missing or empty, the high-resolution one as it is."""
    return F.coalesce(F.nullif(image["large"], F.lit("")), image["hi_res"])


def main_image_url(images: Column) -> Column:
    """The first main image's address, even if it has none; without a main image the first one's."""
    return image_url(F.coalesce(F.get(F.filter(images, lambda i: i["variant"] == "MAIN"), 0), F.get(images, 0)))


def main_large_url(columns: Column) -> Column:
    """Of a struct of arrays (variant, large): the first main image's large picture that is not empty, else the first large one as it is."""
    both = F.arrays_zip(columns["variant"].alias("variant"), columns["large"].alias("large"))
    main = F.get(F.filter(both, lambda i: (i["variant"] == "MAIN") & (i["large"] != "")), 0)
    return F.coalesce(main["large"], F.get(columns["large"], 0))


def explode_images(df: DataFrame, key: str, images: str = "images") -> DataFrame:
    """A row for each image that has an address: main ones first, else in order; order from 0."""
    usable = F.filter(images, lambda i: F.coalesce(F.nullif(i["hi_res"], F.lit("")), F.nullif(i["large"], F.lit(""))).isNotNull())
    ordered = F.concat(F.filter(usable, lambda i: i["variant"] == "MAIN"), F.filter(usable, lambda i: ~i["variant"].eqNullSafe("MAIN")))
    rows = df.select(key, F.posexplode(ordered).alias("order", "image"))
    hi_res = F.nullif(F.col("image.hi_res"), F.lit(""))
    return rows.select(key, "order", F.col("image.variant").alias("variant"), F.coalesce(hi_res, F.nullif(F.col("image.large"), F.lit(""))).alias("url"), hi_res.isNotNull().alias("is_hires"))


def category_filter(df: DataFrame, value: str, column: str = "categories", depth: int | None = 1) -> DataFrame:
    """Rows with ``value`` at ``depth`` (from 0) of their categories, or anywhere if depth is None."""
    c = F.col(column)
    return df.filter(F.array_contains(c, value) if depth is None else F.get(c, depth) == value)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each ``keys``: the first by ``order``, then by all other columns. Aggregates partially before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    least = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("row"))
    return least.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def build_interactions(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """The earliest verified review of each user and known item."""
    known = reviews.filter("verified").join(items.select("item_id"), "item_id", "left_semi")
    return dedup_first(known.select("user_id", "item_id", "rating", "ts"), ["user_id", "item_id"], ["ts", "rating"])


def filter_active_users(inter: DataFrame, k: int) -> DataFrame:
    """Rows of users who have at least ``k``; items are never filtered."""
    active = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    return inter.join(active.select("user_id"), "user_id", "left_semi")


def attach_segment(inter: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    return inter.join(items.select("item_id", "segment"), "item_id", how)


def attach_counts(items: DataFrame, inter: DataFrame, name: str = "n_inter") -> DataFrame:
    """Purchases of each item, 0 if none."""
    counts = inter.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))
    return items.join(counts, "item_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
