"""The test tables in the roles of a catalogue: items, interactions, child rows. Each role has its SQL twin.

Texts come from short lists by an item's number, so that both sides build the
same ones; they hold what the rules must tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import spread, table

TITLES = ["Advanced Dry Skin Therapy Lotion", "Soap-Free Cleanser Foam", "TURMERIC CLAY MASK", "Vitamin C Brightening Serum", "Tea Tree Acne Gel for oily skin", "Collagen Sheet Mask", "Hydrating Cream with Hyaluronic Acid", None, "Shea Butter Balm", "SPF 50 Sunscreen Spray", "Gentle Wash not drying", "Retinol Night Repair Anti-Aging Cream", ""]
FEATURES = ["Moisturizes and soothes. No mineral oil; paraben-free. For all skin types.", "Deep cleansing foam! Removes dirt. Suitable for oily and combination skin.", "Exfoliating clay. Reduces redness? Calms sensitive skin.", None, "Firming peptides. Lifts and plumps mature skin.", "Contains ceramide and squalane. Does not contain retinol. Repairs the barrier.", "Brightens dark spots. Radiant glow."]
DESCRIPTIONS = ["Use daily.\nDirections: apply to clean and dry skin.\nGreat for acne prone skin\nIngredients: Water, Niacin-\namide, Coconut Oil, Glycolic Acid", "Skin type: normal, dry. Smooths texture.\nIngredients: Snail mucin, Cica", None, "Apply to dry face. A light lotion for every skin.\nWarnings: avoid eyes.\nBright and even tone", "Antioxidant rich.\nBroad spectrum UVA UVB protection."]
FORM_VALUES = [None, "Cream", "xyz", "Lotion, Gel", "None", "Bar & Liquid", "serum_drops", "", "Sheet Mask"]
SKIN_VALUES = [None, "Dry, Oily & Combination, Normal", "All", "sensitive skin", "xyz", "Dry and Oily", "Acne prone, Mature", "", "Combination / Normal"]
BENEFIT_VALUES = [None, "Moisturizing, Anti-aging", "Brightening", "Cleansing and Soothing", "xyz", "Sun protection", "Hydrating; Firming"]
ACTIVE_VALUES = [None, "Vitamin C", "Retinol, Hyaluronic acid", "xyz", "Tea Tree oil", "Shea butter & collagen"]
STORES = [None, " ", "None"]
REVIEW_TEXTS = ["I have sensitive skin and this burned; the redness stayed.", "Smells wonderful, my dry skin loves it", "Broke me out within days!! My acne-prone skin hates it", "Greasy and heavy on my oily skin.", "It didn't work. No difference, waste of money", None, "My very dry skin got flaky, too dry", "Nice texture", "My combination skin itches, an odd odour", "Drying. I have very sensitive skin", "Clogged pores and pimples", ""]
DAY_MS = 86_400_000
MILLION = 1_000_000


def pick(values: list[str | None], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values)).cast("int") + 1)


def sql_text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def sql_pick(values: list[str | None], at: str) -> str:
    return f"([{', '.join(map(sql_text, values))}])[CAST(({at}) % {len(values)} AS INTEGER) + 1]"


def interactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: user, item, rating 1 to 5, epoch milliseconds, whether verified.

    Every order line is one. Its item is drawn by numbers of the line, as the
    sixth power of a share, so that some items sell much and most little: parts
    are sold alike in the table.
    """
    lines, orders, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    n, least = parts.agg(F.count(F.lit(1)), F.min("p_partkey")).first()
    share = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 1299709) % MILLION
    cube = F.floor(F.floor(share * share / MILLION) * share / MILLION)
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.col("o_custkey").alias("user_id"),
        (F.floor(F.floor(cube * cube / MILLION) * n / MILLION) + (least or 0)).cast("long").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        (F.col("l_returnflag") != "R").alias("verified"),
    )


SQL_RAW = f"""shares AS (SELECT *, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % {MILLION} AS share FROM lineitem),
cubes AS (SELECT *, share * share // {MILLION} * share // {MILLION} AS cube FROM shares),
raw AS (SELECT o_custkey AS user_id, cube * cube // {MILLION} * (SELECT count(*) FROM part) // {MILLION} + (SELECT min(p_partkey) FROM part) AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS rating,
  CAST(epoch_ms(o_orderdate) AS BIGINT) AS ts, l_returnflag <> 'R' AS verified
  FROM cubes JOIN orders ON l_orderkey = o_orderkey)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, with what sellers entered. A part is a few bytes, its texts and their rules are not: parts are dealt over all tasks first."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    return p.select(
        k.alias("item_id"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL", "MEDIUM"), "Face").otherwise("Body").alias("segment"),
        pick(TITLES, k).alias("title"),
        pick(FEATURES, k).alias("features"),
        pick(DESCRIPTIONS, k).alias("description"),
        F.when(k % 11 == 0, pick(STORES, k)).otherwise(F.col("p_brand")).alias("store"),
        F.col("p_retailprice").alias("price"),
        pick(FORM_VALUES, k).alias("raw_form"),
        pick(SKIN_VALUES, k).alias("raw_skin"),
        pick(BENEFIT_VALUES, k).alias("raw_benefit"),
        pick(ACTIVE_VALUES, k).alias("raw_active"),
        F.col("p_size").alias("p_size"),
    )


SQL_ITEMS = f"""items AS (SELECT p_partkey AS item_id, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'MEDIUM') THEN 'Face' ELSE 'Body' END AS segment,
  {sql_pick(TITLES, "p_partkey")} AS title, {sql_pick(FEATURES, "p_partkey")} AS features, {sql_pick(DESCRIPTIONS, "p_partkey")} AS description,
  CASE WHEN p_partkey % 11 = 0 THEN {sql_pick(STORES, "p_partkey")} ELSE p_brand END AS store, p_retailprice AS price,
  {sql_pick(FORM_VALUES, "p_partkey")} AS raw_form, {sql_pick(SKIN_VALUES, "p_partkey")} AS raw_skin,
  {sql_pick(BENEFIT_VALUES, "p_partkey")} AS raw_benefit, {sql_pick(ACTIVE_VALUES, "p_partkey")} AS raw_active, p_size FROM part)"""

SQL_INTER = """inter AS (SELECT user_id, item_id, rating, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, rating) AS rn
  FROM raw WHERE verified AND item_id IN (SELECT item_id FROM items)) WHERE rn = 1)"""
SQL_BASE = f"WITH {SQL_RAW},\n{SQL_ITEMS},\n{SQL_INTER}"
SQL_SEGMENTED = "seg AS (SELECT i.*, t.segment FROM inter i JOIN items t USING (item_id))"
SQL_ACTIVE = "act AS (SELECT * FROM seg WHERE user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) >= 5))"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue images: a list of structs in which the main one may come at any place."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")

    def image(i: Column) -> Column:
        name = F.concat_ws("-", k.cast("string"), i.cast("string"))
        return F.struct(
            F.when(i == k % 3, "MAIN").otherwise(F.concat(F.lit("PT"), i.cast("string"))).alias("variant"),
            F.when((k + i) % 4 == 0, "").otherwise(F.concat(F.lit("L"), name)).alias("large"),
            F.when((k + i) % 3 != 0, F.concat(F.lit("H"), name)).alias("hi_res"),
        )

    return p.select(k.alias("item_id"), F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), image).alias("images"))


SQL_IMAGES = """imgs AS (SELECT p_partkey AS item_id, i AS pos, CASE WHEN i = p_partkey % 3 THEN 'MAIN' ELSE 'PT' || i END AS variant,
  CASE WHEN (p_partkey + i) % 4 = 0 THEN '' ELSE 'L' || p_partkey || '-' || i END AS large,
  CASE WHEN (p_partkey + i) % 3 <> 0 THEN 'H' || p_partkey || '-' || i END AS hi_res
  FROM (SELECT p_partkey, unnest(generate_series(0, p_size % 5)) AS i FROM part))"""
