"""Queries on the recommender data, its baselines and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.jobs import adapters as A
from shelfspark.jobs import queries_items as Q
from shelfspark.jobs.queries_market import active
from shelfspark.jobs.registry import query
from shelfspark.operators import experiments as X
from shelfspark.operators import recommend as R
from shelfspark.operators import retrieval as V
from shelfspark.operators.pairwise import Setting, fit_models
from shelfspark.session import cut_lineage, drop_folder, scratch_folder, table

K = 20
SPLIT = f"""{A.SQL_SEGMENTED}, {A.SQL_ACTIVE}, cut AS (SELECT quantile_cont(ts, 0.9) AS cut FROM act), train AS (SELECT act.* FROM act, cut WHERE ts < cut),
test AS (SELECT act.* FROM act, cut WHERE ts >= cut AND user_id IN (SELECT user_id FROM train)), universe AS (SELECT item_id FROM train UNION SELECT item_id FROM test),
counts AS (SELECT u.item_id, count(t.item_id) AS n FROM universe u LEFT JOIN train t ON t.item_id = u.item_id GROUP BY 1)"""
BASE = f"{A.SQL_BASE}, {SPLIT}"


def split(spark, d):
    train, test = R.time_split(active(spark, d), 0.1)
    return train, test, R.item_train_counts(R.item_universe(train, test), train)


def split_once(spark, d):
    """The split (user_id, item_id, ts), written once, for jobs that read it several times."""
    held = scratch_folder(spark)
    train, test = R.time_split(cut_lineage(active(spark, d).select("user_id", "item_id", "ts"), held), 0.1)
    train, test = cut_lineage(train), cut_lineage(test)
    drop_folder(spark, held)
    return train, test, cut_lineage(R.item_train_counts(R.item_universe(train, test), train))


@query("r1_time_split", f"{BASE} SELECT 'train' AS part, user_id, item_id, ts FROM train UNION ALL SELECT 'test', user_id, item_id, ts FROM test")
def r1(spark, d):
    train, test, _ = split(spark, d)
    part = lambda df, n: df.select(F.lit(n).alias("part"), "user_id", "item_id", "ts")
    return part(train, "train").unionAll(part(test, "test"))


@query("r2_item_train_counts", f"{BASE} SELECT * FROM counts")
def r2(spark, d):
    return split(spark, d)[2]


@query("r2_new_item_share", f"{BASE} SELECT count(*) AS rows, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END) AS new_share FROM test JOIN counts USING (item_id)")
def r2b(spark, d):
    _, test, counts = split(spark, d)
    return R.new_item_share(test, counts)


BUCKET = "CASE WHEN n = 0 THEN '0' WHEN n < 5 THEN '1-4' WHEN n < 20 THEN '5-19' ELSE '20+' END"


@query("r3_pop_bucket", f"{BASE} SELECT {BUCKET} AS bucket, count(*) AS items FROM counts GROUP BY 1")
def r3(spark, d):
    return split(spark, d)[2].groupBy(R.pop_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("items"))


TOKENS = """tok AS (SELECT item_id, 'brand' AS field, 'brand=' || lower(regexp_replace(store, '^\\s+|\\s+$', '', 'g')) AS token FROM attrs WHERE coalesce(store, '') <> '' AND store <> 'None'
UNION ALL SELECT item_id, 'seg', 'seg=' || segment FROM attrs UNION ALL SELECT item_id, 'form', 'form:form=' || unnest(form) FROM attrs UNION ALL SELECT item_id, 'skin', 'skin:skin=' || unnest(list_filter(skin, lambda x: x <> 'all')) FROM attrs
UNION ALL SELECT item_id, 'benefit_main', 'benefit_main:benefit=' || unnest(benefit_main) FROM attrs UNION ALL SELECT item_id, 'benefit_desc', 'benefit_desc:benefit=' || unnest(list_filter(benefit, lambda x: NOT list_contains(benefit_main, x))) FROM attrs
UNION ALL SELECT item_id, 'active', 'active:active=' || unnest(active) FROM attrs)"""


@query("r4_item_tokens", f"{Q.SQL_ATTRS}, {TOKENS} SELECT * FROM tok")
def r4(spark, d):
    return R.item_tokens(Q.attrs_table(spark, d))


SELLER_TOKENS = """SELECT item_id, 'brand' AS field, 'brand=' || lower(regexp_replace(store, '^\\s+|\\s+$', '', 'g')) AS token FROM attrs WHERE coalesce(store, '') <> '' AND store <> 'None'
UNION ALL SELECT item_id, 'seg', 'seg=' || segment FROM attrs UNION ALL SELECT item_id, 'form', 'form=' || unnest(form_seller) FROM attrs UNION ALL SELECT item_id, 'skin', 'skin=' || unnest(list_filter(skin_seller, lambda x: x <> 'all')) FROM attrs
UNION ALL SELECT item_id, 'benefit', 'benefit=' || unnest(benefit_seller) FROM attrs UNION ALL SELECT item_id, 'active', 'active=' || unnest(active_seller) FROM attrs"""


@query("r4_item_tokens_seller", f"{Q.SQL_ATTRS} {SELLER_TOKENS}")
def r4_seller(spark, d):
    return R.item_tokens(Q.attrs_table(spark, d), "seller")


@query("r5_token_weights", f"""{Q.SQL_ATTRS}, {TOKENS}, n AS (SELECT count(*) AS n FROM attrs), f AS (SELECT field, token, count(DISTINCT item_id) AS df FROM tok GROUP BY 1, 2), g AS (SELECT *, ln(n::DOUBLE / df) AS idf FROM f, n), h AS (SELECT *, max(idf) OVER (PARTITION BY field) AS top FROM g),
k AS (SELECT t.*, df, idf, top FROM tok t JOIN h USING (field, token) WHERE field <> 'brand' OR df >= 2)
SELECT item_id, field, token, CASE WHEN field NOT IN ('brand', 'seg') AND top > 0 THEN greatest(0.05, idf / top) ELSE 1.0 END / count(*) OVER (PARTITION BY item_id, field) AS weight FROM k""")
def r5(spark, d):
    attrs = Q.attrs_table(spark, d)
    return R.token_weights(R.item_tokens(attrs), attrs.count())


POPULAR = f"""c AS (SELECT item_id, count(*)::DOUBLE AS score FROM train GROUP BY 1), cand AS (SELECT u.user_id, c.item_id, c.score FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = c.item_id)),
recs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cand), top AS (SELECT * FROM recs WHERE rank <= {K})"""


def popular(spark, d):
    train, test, counts = split_once(spark, d)
    return R.popularity_recs(train, test, K), test, counts


@query("r6_popularity_recs", f"{BASE}, {POPULAR} SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM top")
def r6(spark, d):
    return popular(spark, d)[0].select("user_id", "item_id", "score", "rank")


@query("j7_exclude_seen", f"{BASE} SELECT user_id, item_id FROM test t WHERE NOT EXISTS (SELECT 1 FROM train r WHERE r.user_id = t.user_id AND r.item_id = t.item_id)")
def j7(spark, d):
    train, test, _ = split(spark, d)
    return R.exclude_seen(test.select("user_id", "item_id"), train)


@query("w8_top_k", f"{A.SQL_BASE} SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, item_id, rating AS score, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM inter) WHERE rank <= 3")
def w8(spark, d):
    from shelfspark.jobs.queries_market import inter

    return V.top_k(inter(spark, d).select("user_id", "item_id", F.col("rating").alias("score")), 3)


@query("u2_item_universe", f"{BASE} SELECT item_id FROM universe")
def u2(spark, d):
    train, test, _ = split(spark, d)
    return R.item_universe(train, test)


@query("j4_known_users_only", f"{A.SQL_BASE}, t AS (SELECT * FROM inter WHERE rating >= 4), s AS (SELECT * FROM inter WHERE rating < 3) SELECT user_id, item_id FROM t WHERE user_id IN (SELECT user_id FROM s)")
def j4(spark, d):
    from shelfspark.jobs.queries_market import inter

    i = inter(spark, d)
    return R.known_users_only(i.filter("rating >= 4"), i.filter("rating < 3")).select("user_id", "item_id")


def _metrics(truth: str, recs: str) -> str:
    ideal = f"list_sum(list_transform(generate_series(1, least(count(*), {K})), lambda i: 1 / log2(i + 1)))"
    return f"""m AS (SELECT t.user_id, t.item_id, r.rank, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT user_id, item_id FROM {truth}) t LEFT JOIN {recs} r ON r.user_id = t.user_id AND r.item_id = t.item_id LEFT JOIN counts c ON c.item_id = t.item_id),
pu AS (SELECT user_id, count(rank)::DOUBLE / count(*) AS recall, coalesce(sum(1 / log2(rank + 1)), 0) / {ideal} AS ndcg FROM m GROUP BY 1), pb AS (SELECT {BUCKET} AS b, count(rank)::DOUBLE / count(*) AS r, count(*)::DOUBLE AS c FROM m GROUP BY 1)
SELECT 'recall' AS metric, avg(recall) AS value FROM pu UNION ALL SELECT 'ndcg', avg(ndcg) FROM pu UNION ALL SELECT 'users', count(*)::DOUBLE FROM pu UNION ALL SELECT 'R_' || b, r FROM pb UNION ALL SELECT 'N_' || b, c FROM pb"""


@query("r13_rank_eval", f"{BASE}, {POPULAR}, {_metrics('test', 'top')}")
def r13(spark, d):
    recs, test, counts = popular(spark, d)
    return R.rank_eval(recs, test, counts, K)


COLD = f"""coldc AS (SELECT u.item_id, u.n::DOUBLE AS score FROM counts u WHERE n < 5), ctest AS (SELECT * FROM test WHERE item_id IN (SELECT item_id FROM coldc)),
ccand AS (SELECT u.user_id, c.item_id, c.score FROM (SELECT DISTINCT user_id FROM ctest) u CROSS JOIN coldc c WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = c.item_id)),
ctop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ccand) WHERE rank <= {K})"""


@query("r14_cold_pool_eval", f"{BASE}, {COLD}, {_metrics('ctest', 'ctop')}")
def r14(spark, d):
    train, test, counts = split_once(spark, d)
    pool = R.cold_pool(counts)
    truth = test.join(pool.select("item_id"), "item_id", "left_semi")
    return R.rank_eval(R.popularity_recs(train, truth, K, pool), truth, counts, K)


def vectors(spark, d):
    """Vectors of catalogue items, from the table of embeddings in turn."""
    e = table(spark, d, "embeddings")
    n = e.count()
    it = A.items(spark, d).select("item_id", (F.col("item_id") % n).alias("vec_id"))
    return it.join(e, "vec_id").select("item_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


VECTORS = "vec AS (SELECT p_partkey AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"
PROFILE = """px AS (SELECT t.user_id, i AS pos, sum(v[i]) AS x FROM train t JOIN vec USING (item_id), generate_series(1, 64) g(i) GROUP BY 1, 2), pn AS (SELECT user_id, greatest(sqrt(sum(x * x)), 1e-8) AS n FROM px GROUP BY 1),
prof AS (SELECT px.user_id, list(x / n ORDER BY pos) AS p FROM px JOIN pn USING (user_id) GROUP BY 1)"""


@query("r7_embedding_profile", f"{BASE}, {VECTORS}, {PROFILE} SELECT user_id, CAST(i - 1 AS INTEGER) AS place, round(p[i], 6) AS x FROM prof, generate_series(1, 64) g(i)")
def r7(spark, d):
    p = R.embedding_profile(split_once(spark, d)[0], cut_lineage(vectors(spark, d)))
    return p.select("user_id", F.posexplode("profile").alias("place", "x")).withColumn("x", F.round("x", 6))


@query("r8_embedding_recs", f"""{BASE}, {VECTORS}, {PROFILE}, sc AS (SELECT user_id, item_id, round(list_dot_product(p, v), 9) AS score FROM prof, vec WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = prof.user_id AND t.item_id = vec.item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc) SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {K}""")
def r8(spark, d):
    train = split_once(spark, d)[0]
    v = cut_lineage(vectors(spark, d))
    return V.profile_recs(train, v, K).select("user_id", "item_id", "rank")


@query("r9_text_vectors", f"""WITH {A.SQL_ITEMS}, t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, features, description)), '\\s+'), lambda w: w <> '')) AS word FROM items),
c AS (SELECT item_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS place, count(*) AS tf FROM t GROUP BY 1, 2), i AS (SELECT place, ln(((SELECT count(*) FROM items) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM c GROUP BY 1),
w AS (SELECT item_id, place, tf * idf AS x FROM c JOIN i USING (place)), n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM w GROUP BY 1)
SELECT item_id, CAST(place AS INTEGER) AS place, round(x / norm, 6) AS x FROM w JOIN n USING (item_id) WHERE x <> 0""")
def r9(spark, d):
    it = A.items(spark, d).select("item_id", F.concat_ws(" ", "title", "features", "description").alias("text"))
    v = R.text_vectors(it, "text").select("item_id", F.posexplode("embedding").alias("place", "x"))
    return v.filter("x <> 0").withColumn("x", F.round("x", 6))


@query("r10_negative_samples", f"""{BASE}, ti AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM train))
SELECT t.user_id, t.item_id, ti.item_id AS negative FROM train t JOIN ti ON ti.idx = ('0x' || substr(md5('7:0|' || t.user_id || '|' || t.item_id), 1, 8))::BIGINT % (SELECT count(*) FROM ti)""")
def r10(spark, d):
    return R.negative_samples(split(spark, d)[0], 7)


@query("r11_fit_pairwise")
def r11(spark, d):
    """Metrics of two models that are fitted at once, with tokens alone and with text vectors, and the loss of each epoch."""
    train, test, counts = split_once(spark, d)
    settings = X.settings_of(["filled+drop", "filled_emb"], [0], id_dropout=0.3)
    tokens = X.feature_sets(Q.attrs(spark, d), settings)
    models, losses = fit_models(train, counts.select("item_id"), settings, 5, tokens, cut_lineage(vectors(spark, d)))
    names = spark.createDataFrame([(s.key,) for s in settings], "model string")
    found = R.rank_eval(X.model_recs(models, train, K, test), test, counts, K, names)
    lost = [(m, f"loss_{i}", x) for m, own in losses.items() for i, x in enumerate(own)]
    return found.unionByName(spark.createDataFrame(lost, "model string, metric string, value double"))


@query("r12_early_stop")
def r12(spark, d):
    """Epochs that do best on the end of the training time, and the refitted model's metrics."""
    train, test, counts = split_once(spark, d)
    settings = [Setting("filled+drop", 0, "filled", id_dropout=0.5)]
    tokens = X.feature_sets(Q.attrs(spark, d), settings)
    models, epochs = X.fit_stopped(train, counts.select("item_id"), settings, tokens, k=K)
    found = R.rank_eval(X.model_recs(models, train, K, test), test, counts, K)
    return found.unionByName(spark.createDataFrame([("epochs", float(epochs[settings[0].key]))], "metric string, value double"))


@query("a25_seed_summary", f"{A.SQL_BASE} SELECT item_id, count(*) AS seeds, avg(rating) AS rating_mean, stddev_pop(rating) AS rating_sd FROM inter GROUP BY 1")
def a25(spark, d):
    from shelfspark.jobs.queries_market import inter

    return R.seed_summary(inter(spark, d), "item_id", ["rating"])


KNN = f"""{VECTORS}, {PROFILE}, sc AS (SELECT user_id, item_id, round(list_dot_product(p, v), 9) AS score FROM prof, vec WHERE user_id IN (SELECT user_id FROM test) AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = prof.user_id AND t.item_id = vec.item_id)),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= {K}),
cknn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE user_id IN (SELECT user_id FROM ctest) AND item_id IN (SELECT item_id FROM coldc)) WHERE rank <= {K})"""


def _variant(name: str, recs: str, cold: str) -> str:
    one = f"SELECT '{name}' AS variant, 0 AS seed, metric, value FROM (WITH {_metrics('test', recs)})"
    return f"{one} UNION ALL SELECT '{name}', 0, 'cold_' || metric, value FROM (WITH {_metrics('ctest', cold)}) WHERE metric IN ('recall', 'ndcg', 'users')"


def grid(spark, d, variants, seeds, **options):
    train, test, counts = split_once(spark, d)
    attrs = Q.attrs(spark, d) if set(variants) - set(X.FIXED) else None  # baselines use none
    return X.experiment_grid(train, test, counts, attrs, cut_lineage(vectors(spark, d)), variants, seeds, K, **options)


@query("r15_experiment_grid", f"{BASE}, {POPULAR}, {COLD}, {KNN} {_variant('pop', 'top', 'ctop')} UNION ALL {_variant('emb_knn', 'knn', 'cknn')}")
def r15(spark, d):
    return grid(spark, d, ["pop", "emb_knn"], [0])


@query("r15_experiment_variants")
def r15b(spark, d):
    """The whole grid: both baselines, nine fitted variants, the base variant without a field, two seeds."""
    return grid(spark, d, [*X.FIXED, *X.VARIANTS], [0, 1], ablation=["brand", "form"])


@query("r8_approximate_recs")
def r8_lists(spark, d):
    """Recommendations from the nearest lists of an inverted file."""
    train = split_once(spark, d)[0]
    v = cut_lineage(vectors(spark, d))
    return V.approximate_recs(None, v, train, K).select("user_id", "item_id", "rank")
