"""Queries on child rows, model output, methods and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import labels as L
from shelfspark.functions import rules as R
from shelfspark.jobs import adapters as A
from shelfspark.jobs import queries_items as Q
from shelfspark.jobs import sql as S
from shelfspark.jobs.registry import query
from shelfspark.operators import attributes as O
from shelfspark.operators import children as C
from shelfspark.operators import scoring as X
from shelfspark.session import cut_lineage
from shelfspark.sources import ingest as I

FORMS = ["cream", "gel", None, "lotion"]
SKINS = ["dry", "oily,all", "", "sensitive,dry", "mature"]


def kids(spark, d):
    """A row for each image, with labels that follow from its numbers."""
    e = I.explode_images(A.images(spark, d), "item_id")
    at = F.col("item_id") + F.col("order")
    return e.withColumns({"form": A.pick(FORMS, at), "skin": F.filter(F.split(A.pick(SKINS, at), ","), lambda x: x != "")})


KIDS = f"""{Q.EXPLODED}, kids AS (SELECT *, {A.sql_pick(FORMS, 'item_id + "order"')} AS form, list_filter(string_split({A.sql_pick(SKINS, 'item_id + "order"')}, ','), lambda x: x <> '') AS skin FROM ex)"""
UNIONED = """u AS (SELECT item_id, list_sort(list_distinct(flatten(list(skin)))) AS skin FROM kids GROUP BY 1), v AS (SELECT item_id, form, count(*) AS n, min("order") AS at_ FROM kids WHERE form IS NOT NULL GROUP BY 1, 2),
b AS (SELECT item_id, form FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, at_) AS r FROM v) WHERE r = 1)"""


@query("n12_aggregate_labels", f"{KIDS}, {UNIONED} SELECT u.item_id, {S.text('skin')} AS skin, form FROM u LEFT JOIN b USING (item_id)")
def n12(spark, d):
    return O.aggregate_labels(kids(spark, d), "item_id", "order", "form", ["skin"]).select("item_id", Q.joined("skin").alias("skin"), "form")


@query("n13_image_subset", f"""{KIDS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id, "order" = 0 ORDER BY md5('42|' || item_id || '|' || "order"), "order") AS r FROM kids)
SELECT 'main_plus' AS which, item_id, CAST("order" AS INTEGER) AS "order" FROM r WHERE "order" = 0 OR r <= 2 UNION ALL SELECT 'hires', item_id, CAST("order" AS INTEGER) FROM kids WHERE is_hires UNION ALL SELECT 'main', item_id, CAST("order" AS INTEGER) FROM kids WHERE "order" = 0""")
def n13(spark, d):
    k, out = kids(spark, d), None
    for which in ("main_plus", "hires", "main"):
        part = O.image_subset(k, "item_id", "order", which).select(F.lit(which).alias("which"), "item_id", "order")
        out = part if out is None else out.unionByName(part)
    return out


def ocr(spark, d):
    """Eight lines of an image of each item, with boxes and scores from its number."""
    k, i = F.col("item_id"), F.col("i")
    rows = A.items(spark, d).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    x1, y1, h = ((i % 2) * 400 + (k * 7 + i * 13) % 90).cast("double"), (F.floor(i / 2) * 30 + (k + i) % 5).cast("double"), F.when((k + i) % 7 == 0, 40.0).otherwise(20.0)
    return rows.select("item_id", F.concat(F.lit("line "), i.cast("string"), F.when(i % 3 == 0, "-").otherwise("")).alias("text"), ((k * 3 + i * 5) % 10 / 10).alias("score"), x1.alias("x1"), y1.alias("y1"), (x1 + 300).alias("x2"), (y1 + h).alias("y2"))


@query("n14_assemble_lines", f"""WITH {A.SQL_ITEMS}, o AS (SELECT item_id, i, 'line ' || i || CASE WHEN i % 3 = 0 THEN '-' ELSE '' END AS text, ((item_id * 3 + i * 5) % 10) / 10.0 AS score, ((i % 2) * 400 + (item_id * 7 + i * 13) % 90)::DOUBLE AS x1,
  ((i // 2) * 30 + (item_id + i) % 5)::DOUBLE AS y1, CASE WHEN (item_id + i) % 7 = 0 THEN 40.0 ELSE 20.0 END::DOUBLE AS h FROM (SELECT item_id, unnest(generate_series(0, 7)) AS i FROM items)),
g AS (SELECT *, greatest(quantile_cont(h, 0.5) OVER w, 1.0) AS med, max(x1 + 300) OVER w AS width FROM o WHERE score >= 0.5 WINDOW w AS (PARTITION BY item_id)),
j AS (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY item_id ORDER BY x1, y1, text) > 0.25 * width THEN 1 ELSE 0 END AS jump FROM g),
c AS (SELECT *, sum(jump) OVER (PARTITION BY item_id ORDER BY x1, y1, text ROWS UNBOUNDED PRECEDING) AS col, round_even((y1 + y1 + h) / 2 / med, 0) AS rw FROM j)
SELECT item_id, regexp_replace(string_agg(text, chr(10) ORDER BY col, rw, x1, text), '-\\s+([a-z])', '\\1', 'g') AS text, string_agg(CASE WHEN h >= 1.5 * med THEN '[BIG] ' ELSE '' END || text, chr(10) ORDER BY col, rw, x1, text) AS tagged FROM c GROUP BY item_id""")
def n14(spark, d):
    return O.assemble_lines(ocr(spark, d), ["item_id"])


RAWS = [
    '{"form": "cream", "skin_type": ["dry"], "benefits": ["hydrating", "firming"], "evidence": {"form": "a rich cream", "skin_type": "for dry skin"}}',
    '{"form": "gel", "skin_type": ["oily", "acne"], "benefits": ["bright',
    "sorry",
    None,
    'Here: {"form": "serum", "skin_type": [], "benefits": []}',
    '{"form": "balm", "skin_type": ["dry"], "benefits": ["soothing"], "evidence": {"form": "a soft balm", "skin_type": ["on dry skin", "cracked"], "benefits": ["calms", "smooth',
]


def _evidence_sql(key: str) -> str:
    cut = f"""regexp_extract_all(regexp_extract(tail, '"{key}"\\s*:\\s*\\[([^\\]]*)$', 1), '"([^"]*)"', 1)"""
    return f"""CASE WHEN ok THEN json_extract_string(j, '$.evidence.{key}') WHEN regexp_matches(tail, '"{key}"\\s*:\\s*"[^"]*"') THEN regexp_extract(tail, '"{key}"\\s*:\\s*"([^"]*)"', 1)
WHEN regexp_matches(tail, '"{key}"\\s*:\\s*\\[[^\\]]*\\]') THEN regexp_extract(tail, '"{key}"\\s*:\\s*(\\[[^\\]]*\\])', 1) WHEN len({cut}) > 0 THEN CAST(to_json({cut}) AS VARCHAR) END AS {key}_quote"""


def _list_sql(key: str) -> str:
    return f"""CASE WHEN ok THEN coalesce(CAST(json_extract(j, '$.{key}') AS VARCHAR[]), []) ELSE regexp_extract_all(regexp_extract(head, '"{key}"\\s*:\\s*\\[([^\\]]*)', 1), '"([^"]*)"', 1) END"""


MODEL_OUTPUT = f"""WITH {A.SQL_ITEMS}, raws AS (SELECT item_id, coalesce({A.sql_pick(RAWS, 'item_id')}, '') AS raw FROM items), x AS (SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS obj, regexp_split_to_array(raw, '"evidence"\\s*:') AS halves FROM raws),
y AS (SELECT *, obj <> '' AND json_valid(obj) AS ok, CASE WHEN obj <> '' AND json_valid(obj) THEN obj ELSE '{{}}' END AS j, halves[1] AS head, coalesce(halves[2], '') AS tail FROM x),
z AS (SELECT item_id, CASE WHEN ok THEN json_extract_string(j, '$.form') ELSE nullif(regexp_extract(head, '"form"\\s*:\\s*"([^"]*)"', 1), '') END AS form, {_list_sql('skin_type')} AS skin, {_list_sql('benefits')} AS benefit, NOT ok AS truncated, {', '.join(map(_evidence_sql, ('form', 'skin_type', 'benefits')))} FROM y)
SELECT item_id, form, {S.text('skin')} AS skin, {S.text('benefit')} AS benefit, truncated, form_quote, skin_type_quote, benefits_quote FROM z"""


@query("n15_parse_model_output", MODEL_OUTPUT)
def n15(spark, d):
    p = A.items(spark, d).select("item_id", O.parse_model_output(A.pick(RAWS, F.col("item_id"))).alias("p"))
    quotes = [F.col("p.evidence")[k].alias(f"{k}_quote") for k in ("form", "skin_type", "benefits")]
    return p.select("item_id", "p.form", Q.joined("p.skin").alias("skin"), Q.joined("p.benefit").alias("benefit"), "p.truncated", *quotes)


QUOTES = ["Moisturizes and soothes", "clay exfoliating mask", "firming peptides for mature skin types", "", None, "the best gold cream"]
NORMED = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _supported(q: str, s: str) -> str:
    return f"({q} <> '' AND (contains({s}, {q}) OR len(list_filter(string_split({q}, ' '), lambda w: list_contains(string_split({s}, ' '), w)))::DOUBLE / len(string_split({q}, ' ')) >= 0.8))"


QUOTED = f"WITH {A.SQL_ITEMS}, qs AS (SELECT item_id, features, {NORMED.format(A.sql_pick(QUOTES, 'item_id'))} AS q, {NORMED.format('features')} AS s, {A.sql_pick(QUOTES, 'item_id')} AS quote FROM items)"


@query("n16_evidence_supported", f"{QUOTED} SELECT item_id, {_supported('q', 's')} AS supported FROM qs")
def n16(spark, d):
    return A.items(spark, d).select("item_id", L.evidence_supported(A.pick(QUOTES, F.col("item_id")), F.col("features")).alias("supported"))


TEXT = "CASE WHEN {} THEN replace(lower(quote), '_', ' ') ELSE '' END".format(_supported("q", "s"))


@query("n17_ground_labels", f"""{QUOTED}, t AS (SELECT item_id, {TEXT} AS t FROM qs), l AS (SELECT item_id, CASE WHEN list_contains({S.every('t', R.FORMS)}, 'cream') THEN 'cream' END AS form_g, list_sort(list_filter(['mature', 'dry'], lambda x: list_contains({S.every('t', R.STRICT_SKIN_TYPES)}, x))) AS skin_g,
list_sort(list_filter(['hydrating', 'anti_aging'], lambda x: list_contains({S.every('t', R.BENEFITS)}, x))) AS benefit_g, {S.first('t', R.FORMS_V2)} AS form_q, {S.skin('t')} AS skin_q, list_sort({S.every('t', R.BENEFITS_V2)}) AS benefit_q FROM t)
SELECT item_id, form_g, form_q, {', '.join(f'{S.text(c)} AS {c}' for c in ('skin_g', 'benefit_g', 'skin_q', 'benefit_q'))} FROM l""")
def n17(spark, d):
    quote = A.pick(QUOTES, F.col("item_id"))
    raw = A.items(spark, d).select("item_id", "features", F.lit("cream").alias("form"), F.array(F.lit("mature"), F.lit("dry")).alias("skin"), F.array(F.lit("hydrating"), F.lit("anti_aging")).alias("benefit"), *[quote.alias(f"{n}_quote") for n in ("form", "skin", "benefit")])
    g = O.ground_labels(raw, "features")
    return g.select("item_id", "form_g", "form_q", *[Q.joined(c).alias(c) for c in ("skin_g", "benefit_g", "skin_q", "benefit_q")])


@query("n18_combine_methods", f"""{KIDS.replace('WITH ', f'WITH {A.SQL_ITEMS}, ')}, {UNIONED}, {S.SECTIONS}, m AS (SELECT u.item_id, skin, b.form FROM u LEFT JOIN b USING (item_id)),
o AS (SELECT t.item_id, coalesce({S.first(S.free(S.LOW_TITLE), R.FORMS_V2)}, m.form) AS form, list_sort(list_distinct(list_concat(coalesce(m.skin, []), {S.skin(S.free(S.LOW_TITLE))}))) AS skin, coalesce(v.active, []) AS active FROM items t LEFT JOIN m USING (item_id) LEFT JOIN v2 v USING (item_id))
SELECT item_id, form, {S.text('skin')} AS skin, {S.text('active')} AS active FROM o""")
def n18(spark, d):
    model = O.aggregate_labels(kids(spark, d), "item_id", "order", "form", ["skin"]).withColumn("benefit", L.no_labels())
    ruled = L.with_text_labels(A.items(spark, d), Q.tagged()).select("item_id", F.col("text_active").alias("active"))
    c = O.combine_methods(model, ruled, A.items(spark, d), "item_id")
    return c.select("item_id", "form", Q.joined("skin").alias("skin"), Q.joined("active").alias("active"))


WANTED = [label for label, _ in R.FORMS]


@query("n19_find_evidence", f"""WITH {A.SQL_ITEMS}, {S.SECTIONS}, w AS (SELECT item_id, pos - 1 AS at_, {A.sql_pick(WANTED, 'item_id')} AS label, lower(raw) AS low FROM lines),
h AS (SELECT item_id, label, at_, CASE label {' '.join(f"WHEN '{n}' THEN regexp_extract(low, {S.q(f'(?s)(.{{0,60}}(?:{rx}).{{0,60}})')}, 1)" for n, rx in R.FORMS)} END AS evidence FROM w)
SELECT item_id, label, min_by(evidence, at_) AS evidence, CAST(min(at_) AS INTEGER) AS "first" FROM h WHERE evidence <> '' GROUP BY 1, 2""")
def n19(spark, d):
    lines = A.items(spark, d).select("item_id", F.posexplode(F.split(Q.tagged(), "\n")).alias("order", "text"), A.pick(WANTED, F.col("item_id")).alias("label"))
    return O.find_evidence(lines, "item_id", "order", "text", "label", R.FORMS)


TRUTH = f"{KIDS.replace('WITH ', f'WITH {A.SQL_ITEMS}, ')}, {UNIONED}, {S.NORM}, p AS (SELECT n.item_id, n.segment, CASE WHEN n.form <> 'other' THEN n.form END AS gt_form, coalesce(n.skin, []) AS gt_skin, b.form AS pred_form, u.skin AS pred_skin FROM norm n JOIN u USING (item_id) LEFT JOIN b USING (item_id))"


def predicted(spark, d):
    labels = O.aggregate_labels(kids(spark, d), "item_id", "order", "form", ["skin"])
    return X.attach_predictions(O.normalize_items(A.items(spark, d)), labels, "item_id", "form", ["skin"])


@query("j5_attach_predictions", f"{TRUTH} SELECT item_id, segment, gt_form, {S.text('gt_skin')} AS gt_skin, pred_form, {S.text('pred_skin')} AS pred_skin FROM p")
def j5(spark, d):
    return predicted(spark, d).select("item_id", "segment", "gt_form", Q.joined("gt_skin").alias("gt_skin"), "pred_form", Q.joined("pred_skin").alias("pred_skin"))


@query("j6_complete_products", f"""{Q.EXPLODED} SELECT item_id FROM ex GROUP BY item_id HAVING count(*) = count(*) FILTER ((item_id + "order") % 5 <> 0)""")
def j6(spark, d):
    e = I.explode_images(A.images(spark, d), "item_id")
    return C.complete_parents(e.filter("(item_id + order) % 5 <> 0"), e, "item_id")


def _multi_sql(a: str) -> str:
    return f"""SELECT coalesce(segment, 'ALL') AS segment, '{a}' AS attribute, count(*) AS n, avg(CASE WHEN len(pred_{a}) > 0 THEN 1.0 ELSE 0 END) AS answered,
CASE WHEN sum(len(pred_{a})) > 0 THEN sum(len(list_intersect(gt_{a}, pred_{a})))::DOUBLE / sum(len(pred_{a})) ELSE 0 END AS precision, CASE WHEN sum(len(gt_{a})) > 0 THEN sum(len(list_intersect(gt_{a}, pred_{a})))::DOUBLE / sum(len(gt_{a})) ELSE 0 END AS recall FROM p WHERE len(gt_{a}) > 0 GROUP BY GROUPING SETS ((segment), ())"""


SINGLE = """SELECT coalesce(segment, 'ALL') AS segment, 'form' AS attribute, count(*) AS n, avg(CASE WHEN pred_form IS NOT NULL THEN 1.0 ELSE 0 END) AS answered, CASE WHEN count(pred_form) > 0 THEN count(*) FILTER (pred_form = gt_form)::DOUBLE / count(pred_form) ELSE 0 END AS accuracy FROM p WHERE gt_form IS NOT NULL GROUP BY GROUPING SETS ((segment), ())"""


@query("a16_score_multilabel", f"{TRUTH} {_multi_sql('skin')}")
def a16(spark, d):
    return X.score_multilabel(predicted(spark, d), "skin")


@query("a17_score_single", f"{TRUTH} {SINGLE}")
def a17(spark, d):
    return X.score_single(predicted(spark, d), "form")


@query("a18_score_methods", f"""{TRUTH}, sm AS ({_multi_sql('skin')}), ss AS ({SINGLE}), x AS (SELECT segment, attribute, n, answered, accuracy AS precision, NULL::DOUBLE AS recall FROM ss UNION ALL SELECT * FROM sm)
SELECT 'images' AS method, * FROM x UNION ALL SELECT 'again', * FROM x""")
def a18(spark, d):
    labels = O.aggregate_labels(kids(spark, d), "item_id", "order", "form", ["skin"])
    return X.score_methods(O.normalize_items(A.items(spark, d)), {"images": labels, "again": labels}, "item_id", "form", ["skin"])


def methods(spark, d):
    """Labels of three methods: images, rules on the text, and both with the title. Written once, as every score and sheet reads them several times."""
    images = cut_lineage(O.aggregate_labels(kids(spark, d), "item_id", "order", "form", ["skin"]))
    rules = cut_lineage(L.with_text_labels(A.items(spark, d), Q.tagged()).select("item_id", F.col("text_form").alias("form"), F.col("text_skin").alias("skin"), F.col("text_active").alias("active")))
    combined = cut_lineage(O.combine_methods(images.withColumn("benefit", L.no_labels()), rules, A.items(spark, d), "item_id"))
    return {"images": images, "rules": rules, "combined": combined}


def truth(spark, d):
    """The sellers' labels, written once as well."""
    return cut_lineage(O.normalize_items(A.items(spark, d)).select("item_id", "segment", "form", "skin"))


METHODS = f"""{TRUTH}, {S.SECTIONS}, img AS (SELECT u.item_id, b.form, u.skin FROM u LEFT JOIN b USING (item_id)), rul AS (SELECT item_id, form, skin FROM v2),
com AS (SELECT t.item_id, coalesce({S.first(S.free(S.LOW_TITLE), R.FORMS_V2)}, img.form) AS form, list_sort(list_distinct(list_concat(coalesce(img.skin, []), {S.skin(S.free(S.LOW_TITLE))}))) AS skin FROM items t LEFT JOIN img USING (item_id)),
mm AS (SELECT 'images' AS method, * FROM img UNION ALL SELECT 'rules', * FROM rul UNION ALL SELECT 'combined', * FROM com),
tr AS (SELECT item_id, segment, CASE WHEN form <> 'other' THEN form END AS gt_form, coalesce(skin, []) AS gt_skin FROM norm)"""
RESOLUTION = "hr AS (SELECT item_id, bool_and(is_hires) AS high FROM ex GROUP BY 1), pm AS (SELECT tr.*, mm.method, mm.form AS pred_form, mm.skin AS pred_skin, CASE WHEN high THEN 'high' ELSE 'low' END AS resolution FROM tr JOIN mm USING (item_id) LEFT JOIN hr USING (item_id))"


def _methods_sql(by: str) -> str:
    many = lambda name, where: f"""SELECT method, coalesce({by}, 'ALL') AS {by}, '{name}' AS attribute, count(*) AS n, avg(CASE WHEN len(pred_skin) > 0 THEN 1.0 ELSE 0 END) AS answered, coalesce(sum(len(list_intersect(gt_skin, pred_skin)))::DOUBLE / nullif(sum(len(pred_skin)), 0), 0) AS precision,
sum(len(list_intersect(gt_skin, pred_skin)))::DOUBLE / sum(len(gt_skin)) AS recall FROM pm WHERE len(gt_skin) > 0 AND {where} GROUP BY GROUPING SETS ((method, {by}), (method))"""  # noqa: E731
    return f"""SELECT method, coalesce({by}, 'ALL') AS {by}, 'form' AS attribute, count(*) AS n, avg(CASE WHEN pred_form IS NOT NULL THEN 1.0 ELSE 0 END) AS answered, coalesce(count(*) FILTER (pred_form = gt_form)::DOUBLE / nullif(count(pred_form), 0), 0) AS precision, NULL::DOUBLE AS recall FROM pm WHERE gt_form IS NOT NULL GROUP BY GROUPING SETS ((method, {by}), (method))
UNION ALL {many('skin', 'true')} UNION ALL {many('skin_not_all', "gt_skin <> ['all']")}"""


@query("a18_methods_by_segment", f"{METHODS}, {RESOLUTION} {_methods_sql('segment')}")
def a18_segment(spark, d):
    return X.score_methods(truth(spark, d), methods(spark, d), "item_id", "form", ["skin"], vague={"skin": "all"})


@query("a18_methods_by_resolution", f"{METHODS}, {RESOLUTION} {_methods_sql('resolution')}")
def a18_resolution(spark, d):
    stats = C.image_stats(I.explode_images(A.images(spark, d), "item_id"), "item_id")
    return X.score_methods(truth(spark, d), methods(spark, d), "item_id", "form", ["skin"], "resolution", {"skin": "all"}, stats)


@query("a19_extra_info_share", f"""{KIDS}, a AS (SELECT item_id, list_distinct(flatten(list(skin))) AS al, coalesce(flatten(list(skin) FILTER ("order" = 0)), []) AS mn FROM kids GROUP BY 1)
SELECT count(*) AS n, avg(CASE WHEN len(list_filter(al, lambda x: NOT list_contains(mn, x))) > 0 THEN 1.0 ELSE 0 END) AS share FROM a WHERE len(al) > 0""")
def a19(spark, d):
    return C.extra_info_share(kids(spark, d), "item_id", "order", ["skin"])


ERRORS = "SELECT item_id, 'form' AS attribute, pred_form AS label FROM p WHERE pred_form <> gt_form UNION ALL SELECT item_id, 'skin', unnest(list_filter(pred_skin, lambda x: NOT list_contains(gt_skin, x))) FROM p WHERE len(gt_skin) > 0"


@query("a20_error_candidates", f"{TRUTH} {ERRORS}")
def a20(spark, d):
    return X.error_candidates(predicted(spark, d), "item_id", "form", ["skin"])


@query("a21_corrected_precision", f"""{TRUTH}, e AS ({ERRORS}), vd AS (SELECT attribute, ['A', 'B', 'C', 'x'][item_id % 4 + 1] AS verdict FROM e), m AS (SELECT attribute, precision AS measured FROM ({_multi_sql('skin')}) WHERE segment = 'ALL')
SELECT vd.attribute, count(*) AS n, count(*) FILTER (verdict = 'A') AS a, count(*) FILTER (verdict = 'B') AS b, count(*) FILTER (verdict = 'C') AS c, any_value(measured) AS measured, any_value(measured) + (1 - any_value(measured)) * count(*) FILTER (verdict = 'A') / count(*) AS corrected FROM vd JOIN m USING (attribute) WHERE verdict <> 'x' GROUP BY vd.attribute""")
def a21(spark, d):
    p = predicted(spark, d)
    verdicts = X.error_candidates(p, "item_id", "form", ["skin"]).withColumn("verdict", A.pick(["A", "B", "C", "x"], F.col("item_id")))
    return X.corrected_precision(X.score_multilabel(p, "skin").filter("segment = 'ALL'"), verdicts)


NOTES = ["vague word", " title only", "vague word ", None, "other product"]


@query("a21_review_notes", f"{TRUTH}, e AS ({ERRORS}), vd AS (SELECT ['A', 'B', 'C', 'x'][item_id % 4 + 1] AS verdict, trim({A.sql_pick(NOTES, 'item_id')}) AS note FROM e) SELECT note, count(*) AS n FROM vd WHERE verdict = 'B' AND note IS NOT NULL GROUP BY 1 ORDER BY n DESC, note LIMIT 10")
def a21_notes(spark, d):
    wrong = X.error_candidates(predicted(spark, d), "item_id", "form", ["skin"])
    return X.review_notes(wrong.withColumns({"verdict": A.pick(["A", "B", "C", "x"], F.col("item_id")), "note": A.pick(NOTES, F.col("item_id"))}))


MATRIX = f"{TRUTH}, r AS (SELECT item_id, unnest(pred_skin) AS label, 'images' AS m FROM p UNION ALL SELECT item_id, unnest(gt_skin), 'in_truth' FROM p), x AS (SELECT item_id, 'skin' AS attribute, label, bool_or(m = 'images') AS images, bool_or(m = 'in_truth') AS in_truth FROM r GROUP BY 1, 2, 3)"


def matrix(spark, d):
    p = predicted(spark, d)
    return X.audit_matrix({"images": p.select("item_id", F.col("pred_skin").alias("skin"))}, p.select("item_id", F.col("gt_skin").alias("skin")), "item_id", ["skin"])


@query("a22_audit_matrix", f"{MATRIX} SELECT * FROM x")
def a22(spark, d):
    return matrix(spark, d)


@query("a23_audit_score", f"{MATRIX} SELECT attribute, 'images' AS method, count(*) AS n, avg(CASE WHEN item_id % 3 = 0 THEN 1.0 ELSE 0 END) AS human, avg(CASE WHEN in_truth THEN 1.0 ELSE 0 END) AS seller FROM x WHERE images GROUP BY attribute")
def a23(spark, d):
    return X.audit_score(matrix(spark, d).withColumn("verdict", F.when(F.col("item_id") % 3 == 0, "O").otherwise("X")), ["images"])


MANY = f"""{METHODS}, lab AS (SELECT method, item_id, 'form' AS attribute, form AS label FROM mm WHERE form IS NOT NULL UNION ALL SELECT method, item_id, 'skin', unnest(skin) FROM mm UNION ALL SELECT 'in_truth', item_id, 'form', gt_form FROM tr WHERE gt_form IS NOT NULL UNION ALL SELECT 'in_truth', item_id, 'skin', unnest(gt_skin) FROM tr),
mx AS (SELECT item_id, attribute, label, bool_or(method = 'images') AS images, bool_or(method = 'rules') AS rules, bool_or(method = 'combined') AS combined, bool_or(method = 'in_truth') AS in_truth FROM lab GROUP BY 1, 2, 3),
jd AS (SELECT mx.*, tr.gt_form IS NULL AND len(gt_skin) = 0 AS blank, ['O', 'x', '', 'o'][mx.item_id % 4 + 1] AS verdict FROM mx JOIN tr USING (item_id) WHERE verdict <> '')"""
EACH = "(SELECT unnest(['images', 'rules', 'combined']) AS method, unnest([images, rules, combined]) AS given, * FROM jd)"


def as_lists(df):
    return df.select("item_id", F.when(F.col("form").isNotNull(), F.array("form")).otherwise(L.no_labels()).alias("form"), "skin")


def judged(spark, d):
    """The labels of three methods and the truth, with a human's marks."""
    own = truth(spark, d).select("item_id", F.when(F.col("form") != "other", F.col("form")).alias("form"), F.coalesce("skin", L.no_labels()).alias("skin"))
    sheet = X.audit_matrix({n: as_lists(m) for n, m in methods(spark, d).items()}, as_lists(own), "item_id", ["form", "skin"])
    blank = own.select("item_id", (F.col("form").isNull() & (F.size("skin") == 0)).alias("blank"))
    return sheet.join(blank, "item_id").withColumn("verdict", A.pick(["O", "x", "", "o"], F.col("item_id")))


@query("a22_audit_methods", f"{MANY} SELECT * FROM mx")
def a22_methods(spark, d):
    return judged(spark, d).drop("blank", "verdict")


@query("a23_audit_methods", f"{MANY} SELECT attribute, method, count(*) AS n, avg(CASE WHEN upper(verdict) = 'O' THEN 1.0 ELSE 0 END) AS human, avg(CASE WHEN in_truth THEN 1.0 ELSE 0 END) FILTER (NOT blank) AS seller FROM {EACH} WHERE given GROUP BY 1, 2")
def a23_methods(spark, d):
    return X.audit_score(judged(spark, d), ["images", "rules", "combined"], blank="blank")


@query("a23_audit_blank", f"{MANY} SELECT method, count(*) AS n, avg(CASE WHEN upper(verdict) = 'O' THEN 1.0 ELSE 0 END) AS human FROM {EACH} WHERE given AND blank GROUP BY 1")
def a23_blank(spark, d):
    return X.audit_blank(judged(spark, d), ["images", "rules", "combined"])


SHEET = f"""{METHODS}, own AS (SELECT item_id, segment, gt_form IS NULL AND len(gt_skin) = 0 AS blank, coalesce(gt_form, '') AS f, gt_skin AS s FROM tr),
sh AS (SELECT own.item_id, segment, blank, unnest(['form', 'skin']) AS attribute, unnest([f, array_to_string(s, ', ')]) AS seller, {', '.join(f"unnest([coalesce({t}.form, ''), coalesce(array_to_string({t}.skin, ', '), '')]) AS {n}" for n, t in (('images', 'img'), ('rules', 'rul'), ('combined', 'com')))}
FROM own LEFT JOIN img USING (item_id) LEFT JOIN rul USING (item_id) LEFT JOIN com USING (item_id))"""


def sheet(spark, d):
    return X.compare_sheet(truth(spark, d), methods(spark, d), "item_id", "form", ["skin"])


@query("a24_compare_sheet", f"{SHEET} SELECT *, seller AS human, '' AS confirmed, '' AS note FROM sh")
def a24_sheet(spark, d):
    return sheet(spark, d)


SPLIT = "list_filter(list_transform(string_split(lower({}), ','), lambda x: trim(x)), lambda x: x <> '')"


def _canonical_sql(c: str) -> str:
    return f"CASE WHEN attribute = 'skin' THEN {S.canonical(SPLIT.format(c))} ELSE list_distinct({SPLIT.format(c)}) END"


SCORED = "SELECT attribute, kind, method, count(*) AS n, avg(CASE WHEN len(p) > 0 THEN 1.0 ELSE 0 END) AS answered, coalesce(sum(len(list_intersect(t, p)))::DOUBLE / nullif(sum(len(p)), 0), 0) AS precision, coalesce(sum(len(list_intersect(t, p)))::DOUBLE / nullif(sum(len(t)), 0), 0) AS recall"


@query("a24_compare_methods", f"""{SHEET}, hm AS (SELECT *, CASE WHEN item_id % 3 = 0 THEN combined WHEN attribute = 'skin' AND item_id % 3 = 1 THEN 'Dry, oily, normal,combination' ELSE seller END AS human FROM sh WHERE item_id % 5 <> 0),
mt AS (SELECT attribute, unnest(['all', CASE WHEN blank THEN 'blank' ELSE 'has_truth' END]) AS kind, {_canonical_sql('human')} AS t, images, rules, combined, seller FROM hm),
lg AS (SELECT attribute, kind, t, unnest(['images', 'rules', 'combined', 'seller']) AS method, unnest([images, rules, combined, seller]) AS v FROM mt),
sc AS (SELECT attribute, kind, method, t, {_canonical_sql('v')} AS p FROM lg WHERE NOT (kind = 'blank' AND method = 'seller')) {SCORED} FROM sc GROUP BY 1, 2, 3""")
def a24_methods(spark, d):
    at = F.col("item_id") % 3
    human = F.when(at == 0, F.col("combined")).when((F.col("attribute") == "skin") & (at == 1), "Dry, oily, normal,combination").otherwise(F.col("seller"))
    done = sheet(spark, d).withColumns({"human": human, "confirmed": F.when(F.col("item_id") % 5 != 0, " y").otherwise("")})
    return X.compare_score(done, ["images", "rules", "combined"], confirmed="confirmed", seller="seller")


@query("a24_compare_score", f"""{TRUTH}, h AS (SELECT *, {S.canonical('pred_skin')} AS ps, list_distinct(['dry', CASE WHEN item_id % 2 = 0 THEN 'oily' ELSE 'dry' END]) AS h, unnest(['all', CASE WHEN len(gt_skin) = 0 THEN 'blank' ELSE 'has_truth' END]) AS kind FROM p)
SELECT 'skin' AS attribute, kind, 'images' AS method, count(*) AS n, avg(CASE WHEN len(ps) > 0 THEN 1.0 ELSE 0 END) AS answered, CASE WHEN sum(len(ps)) > 0 THEN sum(len(list_intersect(h, ps)))::DOUBLE / sum(len(ps)) ELSE 0 END AS precision, sum(len(list_intersect(h, ps)))::DOUBLE / sum(len(h)) AS recall FROM h GROUP BY kind""")
def a24(spark, d):
    p = predicted(spark, d)
    human = F.when(F.col("item_id") % 2 == 0, "Dry, oily").otherwise("dry")
    return X.compare_score(p.select(F.lit("skin").alias("attribute"), human.alias("human"), Q.joined("pred_skin").alias("images"), (F.size("gt_skin") == 0).alias("blank")), ["images"])


@query("a26_image_stats", f"{Q.EXPLODED} SELECT item_id, count(*) AS n, count(*) FILTER (is_hires) AS n_hires, bool_or(is_hires) AS any_hires, bool_and(is_hires) AS all_hires FROM ex GROUP BY item_id")
def a26(spark, d):
    return C.image_stats(I.explode_images(A.images(spark, d), "item_id"), "item_id")


@query("a27_evidence_by_parent", "SELECT conv_id, string_agg('[' || turn || '] ' || coalesce(text, ''), ' | ' ORDER BY turn) AS evidence FROM conversations GROUP BY conv_id")
def a27(spark, d):
    from shelfspark.session import table

    return C.evidence_by_parent(table(spark, d, "conversations"), "conv_id", "turn", "text")
