"""Queries on records, texts and labels of single items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import labels as L
from shelfspark.functions import rules as R
from shelfspark.functions import text as T
from shelfspark.jobs import adapters as A
from shelfspark.jobs import sql as S
from shelfspark.jobs.registry import query
from shelfspark.operators import attributes as O
from shelfspark.session import cut_lineage, scratch_folder, table
from shelfspark.sources import ingest as I
from shelfspark.streaming.append import append_pending, appended


def joined(c) -> F.Column:
    return F.array_join(c, ",")


@query("s5_pending", "SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'click' AND d.user_id = e.user_id)")
def s5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return I.pending(e, e.filter("event_type = 'click'"), ["user_id"]).select("event_id", "user_id")


@query("s5_pending_days", "SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'click' AND d.user_id = e.user_id AND CAST(d.ts AS DATE) = CAST(e.ts AS DATE))")
def s5_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return I.pending(e, e.filter("event_type = 'click'"), ["user_id", "day"]).select("event_id", "user_id", "day")


@query("s5_append_resumed", "SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS BIGINT) AS batch FROM events")
def s5_append(spark: SparkSession, d: str) -> DataFrame:
    """A run that was stopped after the clicks, resumed over all events, and started once more with nothing left to do."""
    events, path = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), scratch_folder(spark)
    schema = "event_id long, user_id long, day date"
    dated = lambda df: df.select("event_id", "user_id", F.to_date("ts").alias("day"))
    for batch, rows in enumerate((events.filter("event_type = 'click'"), events, events)):
        append_pending(rows, path, ["event_id"], dated, schema, batch)
    return appended(spark, path, schema)


EVENT = "event_id long, user_id long, event_type string, value double"


def _as_lines(spark: SparkSession, d: str) -> str:
    """The events as gzipped JSON lines, in files by event_id."""
    path = f"{scratch_folder(spark)}/events"
    rows = table(spark, d, "events").select(*[c.split(" ")[0] for c in EVENT.split(", ")])
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").write.option("compression", "gzip").json(path)
    return path


@query("s1_read_jsonl", "SELECT event_id, user_id, event_type, value FROM events")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return I.read_jsonl(spark, _as_lines(spark, d), EVENT)


@query("s1_first_lines", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 300")
def s1_first(spark: SparkSession, d: str) -> DataFrame:
    return I.read_jsonl(spark, _as_lines(spark, d), EVENT, 300)


@query("p1_parse_details", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events")
def p1(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("event_id", I.parse_details(F.col("props")).alias("m"))
    return m.select("event_id", F.col("m")["k"].alias("k"), F.size("m").cast("long").alias("n_keys"))


URL = "coalesce(nullif(large, ''), nullif(hi_res, ''))"


MAIN_URLS = """(SELECT item_id, url FROM (SELECT item_id, coalesce(nullif(large, ''), hi_res) AS url, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN variant = 'MAIN' THEN 0 ELSE 1 END, pos) AS r FROM imgs) WHERE r = 1)"""


@query("p2_main_image_url", f"WITH {A.SQL_IMAGES} SELECT * FROM {MAIN_URLS}")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d).select("item_id", I.main_image_url(F.col("images")).alias("url"))


@query("p2_main_large_url", f"WITH {A.SQL_IMAGES} SELECT item_id, coalesce(min_by(large, pos) FILTER (variant = 'MAIN' AND large <> ''), min_by(large, pos)) AS url FROM imgs GROUP BY item_id")
def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    i = A.images(spark, d).select("item_id", F.struct(F.col("images.variant").alias("variant"), F.col("images.large").alias("large")).alias("columns"))
    return i.select("item_id", I.main_large_url(F.col("columns")).alias("url"))


EXPLODED = f"""WITH {A.SQL_IMAGES}, ex AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN variant = 'MAIN' THEN 0 ELSE 1 END, pos) - 1 AS "order",
  variant, coalesce(nullif(hi_res, ''), large) AS url, coalesce(hi_res, '') <> '' AS is_hires FROM imgs WHERE {URL} IS NOT NULL)"""


@query("p3_explode_images", f"""{EXPLODED} SELECT item_id, CAST("order" AS INTEGER) AS "order", variant, url, is_hires FROM ex""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return I.explode_images(A.images(spark, d), "item_id")


@query("p4_join_text", "SELECT p_partkey AS item_id, concat_ws(' ', nullif(p_name, ''), p_brand, p_type) AS text FROM part")
def p4(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"), T.join_text(F.array("p_name", F.lit(""), "p_brand", F.lit(None).cast("string"), "p_type")).alias("text"))


CATS = "CASE WHEN p_size % 4 = 0 THEN [p_type] WHEN p_size % 4 = 1 THEN [p_type, p_brand] ELSE [p_type, p_brand, p_name] END"


def categories(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    levels = F.array("p_type", "p_brand", "p_name")
    return p.withColumn("categories", F.slice(levels, 1, F.least(F.col("p_size") % 4 + 1, F.lit(3))))


@query("p5_category_filter", f"SELECT p_partkey AS item_id, 'level' AS kind FROM part WHERE ({CATS})[2] = (SELECT min(p_brand) FROM part) UNION ALL SELECT p_partkey, 'any' FROM part WHERE list_contains({CATS}, (SELECT min(p_brand) FROM part))")
def p5(spark: SparkSession, d: str) -> DataFrame:
    c = categories(spark, d)
    value = c.agg(F.min("p_brand")).first()[0]
    level = I.category_filter(c, value).select(F.col("p_partkey").alias("item_id"), F.lit("level").alias("kind"))
    return level.unionAll(I.category_filter(c, value, depth=None).select("p_partkey", F.lit("any")))


@query("p6_segment_of", f"SELECT p_partkey AS item_id, coalesce(({CATS})[3], 'Other') AS segment FROM part")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return categories(spark, d).select(F.col("p_partkey").alias("item_id"), T.segment_of(F.col("categories")).alias("segment"))


PRICES = ["—", "None", None, "12.99", "7", " 3.5 ", "1e2", "$5"]


@query("p7_to_number", f"SELECT p_partkey AS item_id, TRY_CAST(trim({A.sql_pick(PRICES, 'p_partkey')}) AS DOUBLE) AS price FROM part")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), T.to_number(A.pick(PRICES, F.col("p_partkey"))).alias("price"))


@query("p8_build_items", f"WITH {A.SQL_ITEMS}, {A.SQL_IMAGES} SELECT item_id, segment, coalesce(title, '') AS title, url AS image_url, price, raw_form FROM items JOIN {MAIN_URLS} USING (item_id)")
def p8(spark: SparkSession, d: str) -> DataFrame:
    raw = A.items(spark, d).join(A.images(spark, d), "item_id")
    rows = raw.unionAll(raw).select("item_id", "segment", F.coalesce("title", F.lit("")).alias("title"), I.main_image_url(F.col("images")).alias("image_url"), "price", "raw_form")
    return I.dedup_first(rows, ["item_id"], ["title"])


@query("p9_split_values", f"WITH {A.SQL_ITEMS}, v AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(raw_skin, '')), '[,/;&]|\\band\\b'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS v FROM items) SELECT item_id, {S.text('v')} AS vals FROM v")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", joined(T.split_values(F.col("raw_skin"))).alias("vals"))


@query("p10_clean_text", f"WITH {A.SQL_ITEMS} SELECT item_id, {S.clean('raw_form')} AS form, {S.clean('raw_skin')} AS skin FROM items")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", T.clean_text(F.col("raw_form")).alias("form"), T.clean_text(F.col("raw_skin")).alias("skin"))


@query("p11_clip_text", "SELECT doc_id, substr(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 120) AS clip FROM documents")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clip_text(F.col("text"), 120).alias("clip"))


@query("p12_item_text", f"WITH {A.SQL_ITEMS} SELECT item_id, substr(regexp_replace(coalesce(title, '') || '. ' || coalesce(features, '') || ' ' || coalesce(description, ''), '^\\s+|\\s+$', '', 'g'), 1, 100) AS text FROM items")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", T.item_text(F.col("title"), F.col("features"), F.col("description"), 100).alias("text"))


@query("p13_tagged_text", f"WITH {A.SQL_ITEMS}, {S.SECTIONS} SELECT item_id, tagged FROM tagged")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", T.tagged_text(F.col("title"), F.col("features"), F.col("description")).alias("tagged"))


@query("p14_nonempty", f"WITH {A.SQL_ITEMS} SELECT item_id, coalesce(raw_form NOT IN ('', 'None'), false) AS form, coalesce(title NOT IN ('', 'None'), false) AS title FROM items")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", T.nonempty_text(F.col("raw_form")).alias("form"), T.nonempty_text(F.col("title")).alias("title"))


@query("p15_source_text", """WITH t AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) AS pos FROM conversations),
f AS (SELECT conv_id, line, min(turn * 1000000 + pos) AS seen FROM t WHERE trim(line) <> '' GROUP BY 1, 2) SELECT conv_id, substr(string_agg(line, ' | ' ORDER BY seen), 1, 1500) AS source FROM f GROUP BY 1""")
def p15(spark: SparkSession, d: str) -> DataFrame:
    from shelfspark.operators.children import source_text

    return source_text(table(spark, d, "conversations").select("conv_id", "turn", F.split("text", r"\. ").alias("lines")), "conv_id", "turn", "lines")


@query("p16_ms_to_date", f"WITH {A.SQL_RAW} SELECT CAST(to_timestamp(min(ts) / 1000.0) AT TIME ZONE 'UTC' AS DATE) AS first_day, CAST(to_timestamp(max(ts) / 1000.0) AT TIME ZONE 'UTC' AS DATE) AS last_day FROM raw")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return A.interactions_raw(spark, d).agg(T.ms_to_date(F.min("ts")).alias("first_day"), T.ms_to_date(F.max("ts")).alias("last_day"))


@query("n1_norm_single", f"WITH {A.SQL_ITEMS}, {S.NORM} SELECT item_id, form FROM norm")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", L.norm_single(F.col("raw_form"), R.FORMS).alias("form"))


@query("n2_norm_multi", f"WITH {A.SQL_ITEMS}, {S.NORM} SELECT item_id, {S.text('skin')} AS skin, {S.text('benefit')} AS benefit FROM norm")
def n2(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", joined(L.norm_multi(F.col("raw_skin"), R.SKIN_TYPES)).alias("skin"), joined(L.norm_multi(F.col("raw_benefit"), R.BENEFITS)).alias("benefit"))


@query("n3_normalize_items", f"WITH {A.SQL_ITEMS}, {S.NORM} SELECT item_id, form, {S.text('skin')} AS skin, {S.text('benefit')} AS benefit, {S.text('active')} AS active FROM norm")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return O.normalize_items(A.items(spark, d)).select("item_id", "form", *[joined(c).alias(c) for c in ("skin", "benefit", "active")])


@query("n4_strip_negation", f"WITH {A.SQL_ITEMS} SELECT item_id, {S.negated('lower(features)')} AS text FROM items")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", T.strip_negation(F.lower("features")).alias("text"))


def tagged() -> F.Column:
    return T.tagged_text(F.col("title"), F.col("features"), F.col("description"))


@query("n5_split_sections", f"WITH {A.SQL_ITEMS}, {S.SECTIONS} SELECT item_id, claim, bigs, ingr FROM sections")
def n5(spark: SparkSession, d: str) -> DataFrame:
    s = A.items(spark, d).select("item_id", L.split_sections(tagged()).alias("s"))
    ingr = F.regexp_replace(F.array_join("s.ingr", " "), r"-\s+(?=[a-z])", "")
    return s.select("item_id", F.array_join("s.claim", " ").alias("claim"), F.array_join("s.big", " ").alias("bigs"), ingr.alias("ingr"))


@query("n6_skin_labels", f"WITH {A.SQL_ITEMS} SELECT item_id, {S.text(S.skin('lower(coalesce(features, description))'))} AS skin FROM items")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", joined(F.when(F.coalesce("features", "description").isNotNull(), L.skin_labels(F.lower(F.coalesce("features", "description")))).otherwise(L.no_labels())).alias("skin"))


@query("n7_label_text_v2", f"WITH {A.SQL_ITEMS}, {S.SECTIONS} SELECT item_id, form, {S.text('skin')} AS skin, {S.text('benefit')} AS benefit, {S.text('active')} AS active, {S.text('active_hero')} AS active_hero, evidence FROM v2")
def n7(spark: SparkSession, d: str) -> DataFrame:
    v = L.with_text_labels(A.items(spark, d), tagged())
    return v.select("item_id", F.col("text_form").alias("form"), *[joined(f"text_{c}").alias(c) for c in ("skin", "benefit", "active", "active_hero")], F.col("text_evidence").alias("evidence"))


LOW_BODY = f"replace(lower({S.BODY}), '_', ' ')"


@query("n8_label_text_v1", f"WITH {A.SQL_ITEMS}, t AS (SELECT item_id, {LOW_BODY} AS t FROM items), l AS (SELECT item_id, {S.first('t', R.FORMS)} AS form, list_sort({S.every('t', R.STRICT_SKIN_TYPES)}) AS skin, list_sort({S.every('t', R.BENEFITS)}) AS benefit, {S.actives('t')} AS active FROM t) SELECT item_id, form, {S.text('skin')} AS skin, {S.text('benefit')} AS benefit, {S.text('active')} AS active FROM l")
def n8(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.coalesce("features", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    v = L.with_text_labels_v1(A.items(spark, d), body)
    return v.select("item_id", F.col("text_form").alias("form"), *[joined(f"text_{c}").alias(c) for c in ("skin", "benefit", "active")])


@query("n9_title_form_skin", f"WITH {A.SQL_ITEMS}, l AS (SELECT item_id, {S.first(S.free(S.LOW_TITLE), R.FORMS_V2)} AS form, {S.skin(S.free(S.LOW_TITLE))} AS skin FROM items) SELECT item_id, form, {S.text('skin')} AS skin FROM l")
def n9(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", L.title_form(F.col("title")).alias("form"), joined(L.title_skin(F.col("title"))).alias("skin"))


@query("n10_title_main", f"WITH {A.SQL_ITEMS}, l AS (SELECT item_id, list_sort({S.every(S.negated(S.LOW_TITLE), R.BENEFITS_V2)}) AS b, {S.actives(S.negated(S.LOW_TITLE))} AS a FROM items) SELECT item_id, {S.text('b')} AS benefits, {S.text('a')} AS actives FROM l")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("item_id", joined(L.title_benefits(F.col("title"))).alias("benefits"), joined(L.title_actives(F.col("title"))).alias("actives"))


COLS = [f"{k}{x}" for k in ("form", "skin", "benefit", "active") for x in ("_seller", "_text", "")] + ["benefit_main", "active_main"]


def attrs(spark: SparkSession, d: str, interactions: DataFrame | None = None) -> DataFrame:
    it = A.items(spark, d)
    return O.fill_attributes(O.normalize_items(it), I.build_interactions(A.interactions_raw(spark, d), it) if interactions is None else interactions)


def attrs_table(spark: SparkSession, d: str, interactions: DataFrame | None = None) -> DataFrame:
    """The attributes as a written table, for jobs that look items up several times: the rules run once."""
    return cut_lineage(attrs(spark, d, interactions))


SQL_ATTRS = f"{A.SQL_BASE},\n{S.NORM},\n{S.SECTIONS},\n{S.ATTRS}"


@query("n11_fill_attributes", f"{SQL_ATTRS} SELECT item_id, segment, store, {', '.join(f'{S.text(c)} AS {c}' for c in COLS)} FROM attrs")
def n11(spark: SparkSession, d: str) -> DataFrame:
    return attrs(spark, d).select("item_id", "segment", "store", *[joined(c).alias(c) for c in COLS])
