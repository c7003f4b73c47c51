"""Queries on interactions, profiles, markets, pairs and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import text as T
from shelfspark.functions.rules import COMPLAINTS, SELF_TYPES
from shelfspark.jobs import adapters as A
from shelfspark.jobs import queries_items as Q
from shelfspark.jobs import sql as S
from shelfspark.jobs.registry import query
from shelfspark.operators import attributes as O
from shelfspark.operators import market as M
from shelfspark.operators import pairs as P
from shelfspark.operators import windows as W
from shelfspark.session import cut_lineage, table
from shelfspark.sources import ingest as I

BASE, SEG, ACT = A.SQL_BASE, A.SQL_SEGMENTED, A.SQL_ACTIVE


def inter(spark: SparkSession, d: str) -> DataFrame:
    return I.build_interactions(A.interactions_raw(spark, d), A.items(spark, d))


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return I.attach_segment(inter(spark, d), A.items(spark, d))


def active(spark: SparkSession, d: str, interactions: DataFrame | None = None) -> DataFrame:
    return I.attach_segment(I.filter_active_users(inter(spark, d) if interactions is None else interactions, 5), A.items(spark, d))


@query("w1_dedup_first", f"WITH {A.SQL_RAW} SELECT user_id, item_id, min(ts) AS ts, arg_min(rating, struct_pack(a := ts, b := rating)) AS rating FROM raw GROUP BY user_id, item_id")
def w1(spark, d):
    return I.dedup_first(A.interactions_raw(spark, d).select("user_id", "item_id", "ts", "rating"), ["user_id", "item_id"], ["ts", "rating"])


@query("j1_build_interactions", f"{BASE} SELECT * FROM inter")
def j1(spark, d):
    return inter(spark, d)


@query("j2_attach_segment", f"{BASE} SELECT user_id, i.item_id, ts, segment FROM inter i LEFT JOIN (SELECT * FROM items WHERE item_id % 3 <> 0) t ON t.item_id = i.item_id")
def j2(spark, d):
    return I.attach_segment(inter(spark, d), A.items(spark, d).filter("item_id % 3 <> 0"), "left").select("user_id", "item_id", "ts", "segment")


@query("j3_filter_active_users", f"{BASE}, {SEG}, {ACT} SELECT user_id, item_id, ts, rating, segment FROM act")
def j3(spark, d):
    return active(spark, d).select("user_id", "item_id", "ts", "rating", "segment")


@query("j9_attach_counts", f"{BASE} SELECT t.item_id, t.segment, count(i.item_id) AS n_inter FROM items t LEFT JOIN inter i ON i.item_id = t.item_id GROUP BY 1, 2")
def j9(spark, d):
    return I.attach_counts(A.items(spark, d).select("item_id", "segment"), inter(spark, d))


@query("a1_fill_rates", f"WITH {A.SQL_ITEMS} SELECT coalesce(segment, 'ALL') AS segment, count(*) AS n, avg(CASE WHEN coalesce(raw_form NOT IN ('', 'None'), false) THEN 1.0 ELSE 0 END) AS form, avg(CASE WHEN features IS NOT NULL THEN 1.0 ELSE 0 END) AS features FROM items GROUP BY GROUPING SETS ((segment), ())")
def a1(spark, d):
    return M.fill_rates(A.items(spark, d), {"form": T.nonempty_text(F.col("raw_form")), "features": F.col("features").isNotNull()}, "segment")


@query("a2_value_counts", f"WITH {A.SQL_ITEMS}, {S.NORM} SELECT value, count(*) AS n FROM (SELECT unnest(benefit) AS value FROM norm) GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def a2(spark, d):
    return M.value_counts(O.normalize_items(A.items(spark, d)).select(F.explode("benefit").alias("b")), F.col("b"), 5)


@query("a3_capped_histogram", f"{BASE}, n AS (SELECT user_id, count(*) AS c FROM inter GROUP BY 1) SELECT least(c, 10) AS value, count(*) AS n FROM n GROUP BY 1")
def a3(spark, d):
    return M.capped_histogram(inter(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("c")), F.col("c"))


@query("a4_profile_catalog", f"""WITH {A.SQL_ITEMS} SELECT 'filled' AS metric, 'title' AS value, sum(CASE WHEN coalesce(title NOT IN ('', 'None'), false) THEN 1 ELSE 0 END)::BIGINT AS n FROM items
UNION ALL SELECT 'filled', 'features', sum(CASE WHEN features IS NOT NULL THEN 1 ELSE 0 END)::BIGINT FROM items UNION ALL SELECT 'segment', segment, count(*) FROM items GROUP BY segment
UNION ALL SELECT 'images', CAST(p_size % 5 + 1 AS VARCHAR), count(*) FROM items GROUP BY p_size % 5 + 1""")
def a4(spark, d):
    it = A.items(spark, d).withColumn("n_images", F.col("p_size") % 5 + 1)
    return M.profile_catalog(it, {"title": T.nonempty_text(F.col("title")), "features": F.col("features").isNotNull()})


@query("a4_example_rows", f"WITH {A.SQL_ITEMS} SELECT item_id, substr(title, 1, 300) AS title, substr(features, 1, 300) AS features, substr(description, 1, 300) AS description FROM items WHERE title NOT IN ('', 'None') AND features NOT IN ('', 'None') AND description NOT IN ('', 'None') ORDER BY item_id LIMIT 2")
def a4_examples(spark, d):
    return M.example_rows(A.items(spark, d), "item_id", ["title", "features", "description"])


@query("a5_profile_reviews", f"""{BASE}, u AS (SELECT user_id, count(*) AS c FROM inter GROUP BY 1)
SELECT 'reviews' AS metric, count(*)::DOUBLE AS value FROM raw UNION ALL SELECT 'verified_share', avg(CASE WHEN verified THEN 1.0 ELSE 0 END) FROM raw
UNION ALL SELECT 'first_ts', min(ts)::DOUBLE FROM raw UNION ALL SELECT 'last_ts', max(ts)::DOUBLE FROM raw UNION ALL SELECT 'users', count(DISTINCT user_id)::DOUBLE FROM raw
UNION ALL SELECT 'verified_users', count(DISTINCT CASE WHEN verified THEN user_id END)::DOUBLE FROM raw
UNION ALL SELECT 'users_2', count(*)::DOUBLE FROM u WHERE c >= 2 UNION ALL SELECT 'users_5', count(*)::DOUBLE FROM u WHERE c >= 5
UNION ALL SELECT 'rows_2', sum(c)::DOUBLE FROM u WHERE c >= 2 UNION ALL SELECT 'rows_5', sum(c)::DOUBLE FROM u WHERE c >= 5""")
def a5(spark, d):
    return M.profile_reviews(A.interactions_raw(spark, d), inter(spark, d), [2, 5])


def _report_sql(name: str, raw: str, single: bool) -> str:
    labels = f"SELECT {name} AS v FROM norm WHERE {name} IS NOT NULL" if single else f"SELECT unnest({name}) AS v FROM norm"
    mapped = f"{name} <> 'other'" if single else f"len({name}) > 0"
    return f"""SELECT '{name}' AS attribute, 'filled' AS kind, '' AS value, count(*) AS n FROM norm WHERE {name} IS NOT NULL UNION ALL SELECT '{name}', 'mapped', '', count(*) FROM norm WHERE {mapped}
UNION ALL SELECT '{name}', 'label', v, count(*) FROM ({labels}) GROUP BY v UNION ALL SELECT * FROM (SELECT '{name}', 'unmapped', {raw}, count(*) AS c FROM norm WHERE {name} IS NOT NULL AND NOT ({mapped}) GROUP BY {raw} ORDER BY c DESC, {raw} LIMIT 15)"""


@query("a6_norm_report", f"WITH {A.SQL_ITEMS}, {S.NORM} {_report_sql('form', 'raw_form', True)} UNION ALL {_report_sql('skin', 'raw_skin', False)}")
def a6(spark, d):
    return M.norm_report(O.normalize_items(A.items(spark, d)), {"form": "raw_form", "skin": "raw_skin"})


@query("a7_sales_concentration", f"""{BASE}, {SEG}, both_ AS (SELECT segment, item_id FROM seg UNION ALL SELECT 'ALL', item_id FROM seg), c AS (SELECT segment, item_id, count(*) AS v FROM both_ GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY v DESC, item_id) AS down, sum(v) OVER (PARTITION BY segment ORDER BY v, item_id ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER (PARTITION BY segment) AS n, sum(v) OVER (PARTITION BY segment) AS total FROM c)
SELECT segment, any_value(n) AS items, any_value(total)::BIGINT AS purchases, sum(v) FILTER (down <= greatest(1, n // 100))::DOUBLE / any_value(total) AS top1, sum(v) FILTER (down <= greatest(1, n // 10))::DOUBLE / any_value(total) AS top10,
  avg(CASE WHEN v < 5 THEN 1.0 ELSE 0 END) AS under5, 1 - 2 * sum(cum::DOUBLE / total) / any_value(n) + 1.0 / any_value(n) AS gini FROM r GROUP BY segment""")
def a7(spark, d):
    return M.sales_concentration(segmented(spark, d))


@query("a8_cold_start_pressure", f"""{BASE}, cut AS (SELECT max(ts) - 365 * 86400000::BIGINT AS cut FROM inter), b AS (SELECT item_id, count(*) AS prev FROM inter, cut WHERE ts < cut GROUP BY 1),
r AS (SELECT coalesce(prev, 0) AS prev FROM inter i CROSS JOIN cut LEFT JOIN b ON b.item_id = i.item_id WHERE ts >= cut)
SELECT count(*) AS n, avg(CASE WHEN prev = 0 THEN 1.0 ELSE 0 END) AS none, avg(CASE WHEN prev < 5 THEN 1.0 ELSE 0 END) AS under5, avg(CASE WHEN prev < 20 THEN 1.0 ELSE 0 END) AS under20 FROM r""")
def a8(spark, d):
    return M.cold_start_pressure(inter(spark, d))


ATTRS = Q.SQL_ATTRS


@query("a15_seller_quality", f"""{ATTRS}, c AS (SELECT item_id, count(*) AS n FROM inter GROUP BY 1), r AS (SELECT a.*, row_number() OVER (ORDER BY n, a.item_id) - 1 AS rk, count(*) OVER () AS cnt FROM attrs a JOIN c USING (item_id)),
b AS (SELECT *, CAST(greatest(1, ceil(rk * 5.0 / (cnt - 1))) AS INTEGER) AS bin FROM r)
SELECT 'filled_form' AS metric, avg(CASE WHEN len(form_seller) > 0 THEN 1.0 ELSE 0 END) AS value FROM attrs UNION ALL SELECT 'filled_skin', avg(CASE WHEN len(skin_seller) > 0 THEN 1.0 ELSE 0 END) FROM attrs
UNION ALL SELECT 'filled_benefit', avg(CASE WHEN len(benefit_seller) > 0 THEN 1.0 ELSE 0 END) FROM attrs UNION ALL SELECT 'filled_active', avg(CASE WHEN len(active_seller) > 0 THEN 1.0 ELSE 0 END) FROM attrs
UNION ALL SELECT 'skin_only_all', avg(CASE WHEN skin_seller = ['all'] THEN 1.0 ELSE 0 END) FROM attrs WHERE len(skin_seller) > 0
UNION ALL SELECT 'form_agreement', avg(CASE WHEN list_has_any(form_seller, form_text) THEN 1.0 ELSE 0 END) FROM attrs WHERE len(form_seller) > 0 AND len(form_text) > 0
UNION ALL SELECT 'benefit_fifth_' || bin, avg(CASE WHEN len(benefit_seller) > 0 THEN 1.0 ELSE 0 END) FROM b GROUP BY bin""")
def a15(spark, d):
    return M.seller_quality(Q.attrs_table(spark, d), inter(spark, d))


WORDS = [("the", r"\b(the|and)\b"), ("of", r"\bof\b"), ("this", r"\bth(is|at)\b")]
SELF = [("from", r"\bfrom\b"), ("with", r"\bwith\b")]


def _hit(rx: str, text: str = "text") -> str:
    """A rule in SQL; its word boundaries are those of all scripts' letters."""
    edges = rx.replace("'", "''").replace(r"\b", "(?:^|$|[^\\p{L}\\p{M}\\p{N}_])")
    return f"regexp_matches(lower({text}), '{edges}')"


def _flags(rules, text: str = "text") -> str:
    return ", ".join(f"CASE WHEN {_hit(rx, text)} THEN 1.0 ELSE 0 END AS \"{n}\"" for n, rx in rules)


REVIEWS = f"r AS (SELECT CASE WHEN quality = 0 THEN 'low' ELSE 'high' END AS bucket, {_flags(WORDS)}, {_hit(SELF[0][1])} AS s0, {_hit(SELF[1][1])} AS s1 FROM documents JOIN labels USING (doc_id))"
RATES = ", ".join(f'avg("{n}") AS "{n}"' for n, _ in WORDS)


def labelled_texts(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").withColumn("rating", F.when(F.col("quality") == 0, 1.0).otherwise(5.0))


@query("a14_review_terms", f"WITH {REVIEWS} SELECT bucket, count(*) AS n, {RATES} FROM r GROUP BY bucket")
def a14(spark, d):
    return M.review_terms(labelled_texts(spark, d), "text", "rating", WORDS, SELF)[0]


@query("a14_term_ratios", f"""WITH {REVIEWS}, b AS (SELECT bucket, {RATES} FROM r GROUP BY bucket), t AS (SELECT bucket, unnest([{', '.join("'" + n + "'" for n, _ in WORDS)}]) AS term, unnest([{', '.join(n for n, _ in WORDS)}]) AS rate FROM b),
q AS (SELECT term, max(rate) FILTER (bucket = 'low') AS low, max(rate) FILTER (bucket = 'high') AS high FROM t GROUP BY term) SELECT term, low, high, CASE WHEN high > 0 THEN low / high END AS ratio FROM q""")
def a14c(spark, d):
    return M.term_ratios(M.review_terms(labelled_texts(spark, d), "text", "rating", WORDS, SELF)[0])


@query("a14_review_terms_by_type", f"WITH {REVIEWS}, t AS (SELECT 'from' AS type, * FROM r WHERE s0 UNION ALL SELECT 'with', * FROM r WHERE s1) SELECT type, bucket, count(*) AS n, {RATES} FROM t WHERE type IN (SELECT type FROM t WHERE bucket = 'low' GROUP BY type HAVING count(*) >= 5) GROUP BY type, bucket")
def a14b(spark, d):
    return M.review_terms(labelled_texts(spark, d), "text", "rating", WORDS, SELF, 5)[1]


REVIEWED = f"""WITH {A.SQL_RAW}, s AS (SELECT *, {A.sql_pick(A.REVIEW_TEXTS, 'user_id * 31 + item_id * 17 + ts // 86400000')} AS text FROM raw),
r AS (SELECT CASE WHEN rating <= 2 THEN 'low' WHEN rating >= 4 THEN 'high' ELSE 'mid' END AS bucket, {_flags(COMPLAINTS)}, [{', '.join(f"CASE WHEN {_hit(rx)} THEN '{n}' END" for n, rx in SELF_TYPES)}] AS types FROM s)"""
COMPLAINT_RATES = ", ".join(f'avg("{n}") AS "{n}"' for n, _ in COMPLAINTS)


def reviewed(spark, d):
    """Every order line with a review text by its numbers."""
    raw = A.interactions_raw(spark, d)
    return raw.withColumn("text", A.pick(A.REVIEW_TEXTS, F.col("user_id") * 31 + F.col("item_id") * 17 + F.floor(F.col("ts") / 86_400_000)))


@query("a14_complaints", f"{REVIEWED} SELECT bucket, count(*) AS n, {COMPLAINT_RATES} FROM r GROUP BY bucket")
def a14_complaints(spark, d):
    return M.review_terms(reviewed(spark, d), "text", "rating")[0]


@query("a14_complaints_by_type", f"{REVIEWED}, t AS (SELECT unnest(list_filter(types, lambda x: x IS NOT NULL)) AS type, * EXCLUDE (types) FROM r) SELECT type, bucket, count(*) AS n, {COMPLAINT_RATES} FROM t WHERE type IN (SELECT type FROM t WHERE bucket = 'low' GROUP BY type HAVING count(*) >= 30) GROUP BY type, bucket")
def a14_complaints_by_type(spark, d):
    return M.review_terms(reviewed(spark, d), "text", "rating")[1]


PAIRS = f"""{SEG}, {ACT}, nexts AS (SELECT segment, user_id, item_id AS first, lead(item_id) OVER w AS second, lead(ts) OVER w - ts AS gap_ms FROM act WINDOW w AS (PARTITION BY segment, user_id ORDER BY ts, item_id)),
pairs AS (SELECT * FROM nexts WHERE gap_ms >= 86400000)"""
DRAWN = """idx AS (SELECT segment, item_id, row_number() OVER (PARTITION BY segment ORDER BY ts, user_id, item_id) - 1 AS idx FROM act), sizes AS (SELECT segment, count(*) AS size FROM act GROUP BY 1),
drawn AS (SELECT p.*, i.item_id AS rand FROM pairs p JOIN sizes z USING (segment) JOIN idx i ON i.segment = p.segment AND i.idx = ('0x' || substr(md5('42|' || p.user_id || '|' || first || '|' || second), 1, 8))::BIGINT % z.size)"""


def pairs(spark, d):
    return W.consecutive_pairs(active(spark, d), A.DAY_MS)


def drawn(spark, d, interactions=None):
    a = cut_lineage(active(spark, d, interactions))  # for the pairs, the index and the sizes
    return W.popularity_draw(W.consecutive_pairs(a, A.DAY_MS), a)


@query("w2_consecutive_pairs", f"{BASE}, {PAIRS} SELECT * FROM pairs")
def w2(spark, d):
    return pairs(spark, d)


@query("g1_dense_index", f"{BASE}, {SEG}, {ACT} SELECT segment, user_id, item_id, ts, row_number() OVER (PARTITION BY segment ORDER BY ts, user_id, item_id) - 1 AS idx FROM act")
def g1(spark, d):
    return W.dense_index(active(spark, d).select("segment", "user_id", "item_id", "ts"), ["segment"], ["ts", "user_id", "item_id"])


@query("w3_popularity_draw", f"{BASE}, {PAIRS}, {DRAWN} SELECT segment, user_id, first, second, rand FROM drawn")
def w3(spark, d):
    return drawn(spark, d).select("segment", "user_id", "first", "second", "rand")


LAB = "lab AS (SELECT item_id, nullif(lower(regexp_replace(store, '^\\s+|\\s+$', '', 'g')), '') AS brand, form, skin, benefit, benefit_main, active, active_main FROM attrs)"
PAIRED = f"{ATTRS}, {PAIRS}, {DRAWN}, {LAB}"


def _overlap(a: str, other: str, where: str = "true") -> str:
    get = lambda t: f"CASE WHEN {t}.brand IS NULL THEN [] ELSE [{t}.brand] END" if a == "store" else (f"list_filter({t}.skin, lambda v: v <> 'all')" if a == "skin" else f"{t}.{a}")
    return f"SELECT p.segment, '{a}' AS attribute, {get('x')} AS x, {get('y')} AS y FROM drawn p JOIN lab x ON x.item_id = p.first JOIN lab y ON y.item_id = p.{other} WHERE {where}"


def overlaps(other: str, where: str = "true", attributes=P.ATTRIBUTES) -> str:
    inner = " UNION ALL ".join(_overlap(a, other, where) for a in attributes)
    return f"SELECT segment, attribute, count(*) AS n, avg(CASE WHEN list_has_any(x, y) THEN 1.0 ELSE 0 END) AS p FROM ({inner}) WHERE len(x) > 0 AND len(y) > 0 GROUP BY 1, 2"


def labelled(spark, d):
    """The pairs with their items' labels. Interactions are built and written once, for the pairs, the draw and the attributes."""
    i = cut_lineage(inter(spark, d))
    return P.attach_pair_attributes(drawn(spark, d, i), P.item_labels(Q.attrs_table(spark, d, i)))


@query("j8_attach_pair_attributes", f"{PAIRED} SELECT p.segment, user_id, first, second, rand, x.brand AS first_brand, y.brand AS second_brand, z.brand AS rand_brand, {S.text('x.skin')} AS first_skin, {S.text('z.active')} AS rand_active FROM drawn p LEFT JOIN lab x ON x.item_id = first LEFT JOIN lab y ON y.item_id = second LEFT JOIN lab z ON z.item_id = rand")
def j8(spark, d):
    j = labelled(spark, d)
    return j.select("segment", "user_id", "first", "second", "rand", "first_brand", "second_brand", "rand_brand", F.array_join(F.col("first_labels")["skin"], ",").alias("first_skin"), F.array_join(F.col("rand_labels")["active"], ",").alias("rand_active"))


@query("a9_pair_overlap", f"{PAIRED} {overlaps('second')}")
def a9(spark, d):
    return P.pair_overlap(labelled(spark, d), "second")


@query("a10_label_lift", f"""{PAIRED}, e AS (SELECT p.segment, unnest(x.benefit) AS label, y.benefit AS y, z.benefit AS z FROM drawn p JOIN lab x ON x.item_id = first JOIN lab y ON y.item_id = second JOIN lab z ON z.item_id = rand WHERE len(y.benefit) > 0 AND len(z.benefit) > 0),
g AS (SELECT segment, label, count(*) AS n, avg(CASE WHEN list_contains(y, label) THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN list_contains(z, label) THEN 1.0 ELSE 0 END) AS base FROM e GROUP BY 1, 2) SELECT *, p / base AS lift FROM g WHERE n >= 20 AND base > 0""")
def a10(spark, d):
    return P.label_lift(labelled(spark, d), "benefit", 20)


@query("a11_consistency_table", f"{PAIRED}, r AS ({overlaps('second')}), b AS ({overlaps('rand')}) SELECT r.segment, r.attribute, r.n, r.p, b.p AS base, CASE WHEN b.p > 0 THEN r.p / b.p END AS lift FROM r LEFT JOIN b USING (segment, attribute)")
def a11(spark, d):
    return P.consistency_table(labelled(spark, d))


@query("a12_cross_brand_consistency", f"{PAIRED}, r AS ({overlaps('second', 'x.brand <> y.brand')}), b AS ({overlaps('rand', 'x.brand <> y.brand')}) SELECT r.segment, r.attribute, r.n, b.n AS n_base, r.p, b.p AS base, CASE WHEN b.p > 0 THEN r.p / b.p END AS lift FROM r JOIN b USING (segment, attribute)")
def a12(spark, d):
    return P.cross_brand_consistency(labelled(spark, d))


def _named(other: str, n: str, p: str) -> str:
    return f"""SELECT segment, label, count(*) AS {n}, avg(CASE WHEN list_contains(y, label) THEN 1.0 ELSE 0 END) AS {p} FROM (SELECT p.segment, unnest(x.benefit) AS label, y.benefit AS y FROM drawn p JOIN lab x ON x.item_id = p.first JOIN lab y ON y.item_id = p.{other}
WHERE x.brand <> y.brand AND len(y.benefit) > 0) GROUP BY 1, 2 HAVING count(*) >= 20 AND {p} > 0"""


@query("a12_cross_brand_label_lift", f"{PAIRED}, r AS ({_named('second', 'n', 'p')}), b AS ({_named('rand', 'n_base', 'base')}) SELECT segment, label, n, p, n_base, base, p / base AS lift FROM r JOIN b USING (segment, label)")
def a12_labels(spark, d):
    return P.cross_brand_label_lift(labelled(spark, d), "benefit", 20)


def _cells(other: str, t: str) -> str:
    return f"""SELECT p.segment, count(*) AS n_{t}, avg(CASE WHEN b AND a THEN 1.0 ELSE 0 END) AS {t}11, avg(CASE WHEN b AND NOT a THEN 1.0 ELSE 0 END) AS {t}10, avg(CASE WHEN NOT b AND a THEN 1.0 ELSE 0 END) AS {t}01, avg(CASE WHEN NOT b AND NOT a THEN 1.0 ELSE 0 END) AS {t}00
FROM (SELECT p.segment, x.brand = y.brand AS b, list_has_any(x.benefit, y.benefit) AS a FROM drawn p JOIN lab x ON x.item_id = first JOIN lab y ON y.item_id = {other} WHERE x.brand IS NOT NULL AND y.brand IS NOT NULL AND len(x.benefit) > 0 AND len(y.benefit) > 0) p GROUP BY 1"""


@query("a13_brand_attr_synergy", f"""{PAIRED}, c AS (SELECT * FROM ({_cells('second', 'r')}) JOIN ({_cells('rand', 'b')}) USING (segment)),
l AS (SELECT *, CASE WHEN b11 > 0 THEN r11 / b11 END AS lift11, (r11 + r10) / greatest(b11 + b10, 1e-12) AS lift_brand, (r11 + r01) / greatest(b11 + b01, 1e-12) AS lift_attr FROM c)
SELECT *, CASE WHEN lift_brand * lift_attr > 0 THEN lift11 / (lift_brand * lift_attr) END AS synergy, r11 / greatest(r11 + r10, 1e-12) AS attr_same_brand, r01 / greatest(r01 + r00, 1e-12) AS attr_other_brand FROM l WHERE n_r >= 20 AND n_b >= 20""")
def a13(spark, d):
    return P.brand_attr_synergy(labelled(spark, d), "benefit", 20)


@query("w4_popularity_expected", f"""{PAIRED}, f AS (SELECT p.segment, x.benefit AS s FROM pairs p JOIN lab x ON x.item_id = first WHERE len(x.benefit) > 0), g AS (SELECT a.segment, x.benefit AS s FROM act a JOIN lab x USING (item_id) WHERE len(x.benefit) > 0), fk AS (SELECT segment, s, count(*)::DOUBLE AS k FROM f GROUP BY 1, 2), gw AS (SELECT segment, s, count(*)::DOUBLE AS w FROM g GROUP BY 1, 2)
SELECT segment, any_value(n) AS n, sum(CASE WHEN list_has_any(fk.s, gw.s) THEN k * w ELSE 0 END) / sum(k * w) AS expected FROM fk JOIN gw USING (segment) JOIN (SELECT segment, count(*) AS n FROM f GROUP BY 1) c USING (segment) GROUP BY segment""")
def w4(spark, d):
    return P.popularity_expected(pairs(spark, d), active(spark, d), P.item_labels(Q.attrs_table(spark, d)), "benefit")


@query("w5_quantile_bins", f"{BASE}, c AS (SELECT item_id, count(*) AS n FROM inter GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, item_id) - 1 AS rk, count(*) OVER () AS cnt FROM c) SELECT item_id, n, CAST(greatest(1, ceil(rk * 5.0 / (cnt - 1))) AS INTEGER) AS bin FROM r")
def w5(spark, d):
    return W.quantile_bins(inter(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "n", 5, "item_id")


@query("w6_stratified_sample", f"WITH {A.SQL_ITEMS} SELECT item_id, segment FROM (SELECT item_id, segment, row_number() OVER (PARTITION BY segment ORDER BY md5('42|' || item_id), item_id) AS r FROM items) WHERE r <= 50")
def w6(spark, d):
    return W.stratified_sample(A.items(spark, d).select("item_id", "segment"), "segment", "item_id", 50)


@query("w7_head_per_group", f"WITH {A.SQL_ITEMS} SELECT item_id, segment, store FROM (SELECT *, row_number() OVER (PARTITION BY segment, store ORDER BY item_id) AS r FROM items) WHERE r <= 3")
def w7(spark, d):
    return W.head_per_group(A.items(spark, d).select("item_id", "segment", "store"), ["segment", "store"], ["item_id"], 3)


@query("u1_union_samples", f"WITH {A.SQL_ITEMS} SELECT item_id, segment FROM items WHERE item_id % 3 = 0 OR item_id % 5 = 0")
def u1(spark, d):
    it = A.items(spark, d).select("item_id", "segment")
    return I.dedup_first(it.filter("item_id % 3 = 0").unionByName(it.filter("item_id % 5 = 0")), ["item_id"], ["segment"])


@query("u3_label_algebra", f"WITH {A.SQL_ITEMS}, {S.SECTIONS}, {S.NORM}, j AS (SELECT item_id, coalesce(n.benefit, []) AS a, v.benefit AS b FROM norm n JOIN v2 v USING (item_id)) SELECT item_id, len(list_intersect(a, b)) AS both_, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS left_, len(list_distinct(list_concat(a, b))) AS all_, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS inside FROM j")
def u3(spark, d):
    from shelfspark.functions import labels as L

    v = L.with_text_labels(A.items(spark, d), Q.tagged()).select("item_id", F.coalesce(L.norm_multi(F.col("raw_benefit"), R.BENEFITS), L.no_labels()).alias("a"), F.col("text_benefit").alias("b"))
    size = lambda c: F.size(c).cast("long")
    return v.select("item_id", size(F.array_intersect("a", "b")).alias("both_"), size(F.array_except("a", "b")).alias("left_"), size(F.array_union("a", "b")).alias("all_"), (F.size(F.array_except("a", "b")) == 0).alias("inside"))
