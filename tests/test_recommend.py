"""Fitted recommenders, retrieval and experiments against small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def planted(spark, users=20):
    """Users buy items of their own parity; the last item of each is not in training, and every item has its parity as a token."""
    train = spark.createDataFrame([(u, i, u * 100 + i) for u in range(users) for i in range(10) if (u + i) % 2 == 0 and i != u % 10], "user_id long, item_id long, ts long")
    test = spark.createDataFrame([(u, i, 0) for u in range(users) for i in (u % 10, 10 + u % 2)], "user_id long, item_id long, ts long")
    tokens = spark.createDataFrame([("odd", i, f"f{i % 2}", 1.0) for i in range(12)], "feature string, item_id long, token string, weight double")
    return train, test, tokens, spark.range(12).withColumnRenamed("id", "item_id")


OPTIONS = {"dim": 4, "rate": 0.1, "batch": 16}


def recalls(recs, test, counts, k=2, names=None):
    from shelfspark.operators.recommend import rank_eval

    rows = rank_eval(recs, test, counts, k, names).filter("metric = 'recall'").collect()
    return {r["model"]: r["value"] for r in rows} if names is not None else rows[0]["value"]


def test_tastes_by_tokens_and_by_text(spark):
    """Several models in one fit: with tokens, with text vectors that alone carry the taste, and with neither."""
    from shelfspark.operators import recommend as R
    from shelfspark.operators.experiments import model_recs
    from shelfspark.operators.pairwise import Setting, fit_models

    train, test, tokens, universe = planted(spark)
    rng = np.random.default_rng(1)
    text = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, *rng.normal(size=3).tolist()]) for i in range(12)], "item_id long, embedding array<double>")
    settings = [Setting("tokens", 0, "odd", id_dropout=0.3, **OPTIONS), Setting("text", 0, text=True, use_id=False, **OPTIONS), Setting("text", 1, text=True, id_dropout=0.3, **OPTIONS), Setting("id", 0, **OPTIONS)]
    models, losses = fit_models(train, universe, settings, 12, tokens, text)
    assert set(losses) == {s.key for s in settings} and all(len(x) == 12 and x[-1] < 0.8 * x[0] for x in losses.values())
    counts = R.item_train_counts(universe, train)
    names = spark.createDataFrame([(s.key,) for s in settings], "model string")
    got = recalls(model_recs(models, train, 2), test, counts, 2, names)
    pop = recalls(R.popularity_recs(train, test, 2), test, counts)
    assert all(got[m] > 1.5 * pop for m in ("tokens/0", "text/0", "text/1")), (got, pop)
    assert got["text/0"] > got["id/0"]
    # an item that nobody bought has its tokens' part alone, or its text's
    own = {(r["model"], r["item_id"]): r["embedding"] for r in models.item_vectors().collect()}
    x = {(r["model"], r["kind"], r["key"]): list(r["x"]) for r in models.vectors.collect()}
    assert own["tokens/0", 10] == pytest.approx(x["tokens/0", "t", "f0"]) and own["id/0", 10] == [0.0] * 5
    e = {r["item_id"]: np.array(r["embedding"]) for r in text.collect()}
    p = np.array([x["text/0", "p", str(i)] for i in range(4)])
    assert own["text/0", 11] == pytest.approx((e[11] @ p).tolist()) and own["text/0", 3] == pytest.approx((e[3] @ p).tolist())
    assert not [k for k in x if k[0] == "text/0" and k[1] == "i"]


def test_groups_are_merged(spark, monkeypatch):
    """Many groups, a heavy user over several of them, string ids: shared vectors are one, and the models still learn."""
    from shelfspark.operators import pairwise as P
    from shelfspark.operators import recommend as R
    from shelfspark.operators.experiments import model_recs

    monkeypatch.setattr(P, "LEAST_PAIRS", 12)
    monkeypatch.setattr(P, "GROUP_PAIRS", 12)
    train, test, tokens, universe = planted(spark, 40)
    heavy = spark.createDataFrame([(99, i, 0) for i in range(0, 60, 2)], "user_id long, item_id long, ts long")
    train = train.unionByName(heavy)
    universe = universe.unionByName(heavy.select("item_id")).distinct()
    named = lambda df: df.select(*[F.concat(F.lit("x"), c).alias(c) if c in ("user_id", "item_id") else c for c in df.columns])
    train, test, tokens, universe = map(named, (train, test, tokens, universe))
    dealt, groups = P.deal_pairs(train, 1)
    sizes = {r["grp"]: r["count"] for r in dealt.groupBy("grp").count().collect()}
    assert groups > 10 and sum(sizes.values()) == train.distinct().count() and dealt.filter("user_id = 'x99'").select("grp").distinct().count() > 1
    models, losses = P.fit_models(train, universe, [P.Setting("tokens", 0, "odd", id_dropout=0.3, **OPTIONS)], 8, tokens)
    own = losses["tokens/0"]
    assert own[-1] < 0.8 * own[0]
    assert models.vectors.count() == models.vectors.select("model", "kind", "key").distinct().count()
    assert models.vectors.filter("kind = 'u'").count() == 41
    counts = R.item_train_counts(universe, train)
    assert recalls(model_recs(models, train, 2), test, counts) > 1.3 * recalls(R.popularity_recs(train, test, 2), test, counts)


def test_merge_is_a_weighted_mean(spark):
    from shelfspark.operators import pairwise as P

    rows = [(g, "a", "i", "1", [float(g), 2.0], [0.0, g * 1.0], [1.0, 1.0], g, n) for g, n in ((0, 1), (1, 3), (2, 0))]
    rows += [(0, "a", "i", "2", [5.0, 5.0], [0.0, 0.0], [0.0, 0.0], 0, 0), (1, "a", "i", "2", [5.0, 5.0], [0.0, 0.0], [0.0, 0.0], 0, 0), (0, "a", "loss", "", [1.5, 2.0], [0.0, 0.0], [0.0, 0.0], 0, 1), (1, "a", "loss", "", [2.5, 3.0], [0.0, 0.0], [0.0, 0.0], 0, 1)]
    got = P._merged(spark.createDataFrame(rows, P.STATE)).collect()
    assert len(got) == 7 and all(r["x"] == pytest.approx([0.75, 2.0]) and r["steps"] == 2 for r in got if r["key"] == "1")
    assert all(r["x"] == [5.0, 5.0] for r in got if r["key"] == "2") and all(r["x"] == [4.0, 5.0] for r in got if r["kind"] == "loss")
    assert sorted(r["n"] for r in got) == [0, 0, 0, 0, 1, 1, 1]


def test_early_stop_refit_and_restart(spark, tmp_path):
    """A fit that was stopped after two epochs goes on to the vectors that one without a stop has."""
    from shelfspark.operators.experiments import fit_stopped
    from shelfspark.operators.pairwise import Setting, fit_models

    train, _, tokens, universe = planted(spark)
    settings = [Setting("tokens", 0, "odd", **OPTIONS), Setting("id", 0, **OPTIONS)]
    models, epochs = fit_stopped(train, universe, settings, tokens, k=2, most=3, patience=1)
    assert all(1 <= n <= 3 for n in epochs.values()) and models.profiles().count() == 40
    whole, losses = fit_models(train, universe, settings, 4, tokens)

    class Lost(Exception):
        pass

    def stop(epoch, *_):
        if epoch == 2:
            raise Lost

    folder = str(tmp_path / "fit")
    with pytest.raises(Lost):
        fit_models(train, universe, settings, 4, tokens, each=stop, folder=folder)
    resumed, again = fit_models(train, universe, settings, 4, tokens, folder=folder)
    read = lambda m: {(r["model"], r["kind"], r["key"]): tuple(r["x"]) for r in m.vectors.collect()}
    one, two = read(whole), read(resumed)
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(v, abs=1e-9) for k, v in one.items())
    assert again == {m: pytest.approx(x) for m, x in losses.items()}


def test_empty_and_repeated_pairs(spark):
    from shelfspark.operators.pairwise import Setting, fit_models

    train, _, tokens, universe = planted(spark)
    odd = train.unionByName(train.limit(5)).unionByName(spark.createDataFrame([(None, 3, 0), (3, None, 0)], train.schema))
    a, la = fit_models(train, universe, [Setting("id", 0, **OPTIONS)], 1)
    b, lb = fit_models(odd, universe, [Setting("id", 0, **OPTIONS)], 1)
    assert la == lb
    none, lost = fit_models(train.limit(0), universe, [Setting("t", 0, "odd", **OPTIONS)], 1, tokens)
    assert none.profiles().count() == 0 and none.item_vectors().count() == 12 and lost == {"t/0": []}


def brute(profiles, vectors, seen, k):
    out = []
    for u, p in profiles:
        scores = sorted((-round(float(np.dot(p, v)), 9), i) for i, v in vectors if i not in seen.get(u, ()))
        out += [(u, i, -s, r + 1) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, shard", [(1000, 1000), (9, 7)])
def test_blocks_of_items_and_shards_of_users(spark, block, shard):
    from shelfspark.operators.retrieval import embedding_recs

    rng = np.random.default_rng(4)
    profiles, vectors = [(u, rng.integers(-3, 4, 5).astype(float)) for u in range(30)], [(i, rng.integers(-3, 4, 5).astype(float)) for i in range(40)]
    seen = {u: set(rng.integers(0, 40, u).tolist()) for u in range(29)}
    seen[29] = set(range(39))
    train = spark.createDataFrame([(u, i) for u, own in seen.items() for i in own], "user_id long, item_id long")
    p = spark.createDataFrame([(m, u, (x * (1 if m == "a" else -1)).tolist()) for m in "ab" for u, x in profiles], "model string, user_id long, profile array<double>")
    v = spark.createDataFrame([(m, i, x.tolist()) for m in "ab" for i, x in vectors], "model string, item_id long, embedding array<double>")
    recs = embedding_recs(p, v, train, 4, block, ["model"], shard)
    got = recs.collect()
    for m, sign in (("a", 1), ("b", -1)):
        assert sorted((r["user_id"], r["item_id"], r["score"], r["rank"]) for r in got if r["model"] == m) == brute([(u, x * sign) for u, x in profiles], vectors, seen, 4)
    assert embedding_recs(p.filter("model = 'a'").drop("model"), v.filter("model = 'a'").drop("model").limit(0), train, 4).count() == 0


def test_ranking_is_by_the_whole_score(spark):
    from shelfspark.operators.experiments import model_recs
    from shelfspark.operators.pairwise import Models, Setting
    from pyspark.sql.types import LongType

    vectors = {i: [0.1 * i, -0.2 * i, float(b)] for i, b in enumerate([0, 0, 0, 5, 1])}
    rows = [("id/0", "u", "7", [1.0, 0.5, 9.0]), ("id/0", "u", "8", [-1.0, 0.0, 9.0])] + [("id/0", "i", str(i), x) for i, x in vectors.items()]
    universe = spark.range(6).withColumnRenamed("id", "item_id").select(F.col("item_id").cast("string").alias("item_id"))
    tokens = spark.createDataFrame([], "feature string, item_id string, token string, weight double")
    models = Models(spark.createDataFrame(rows, "model string, kind string, key string, x array<double>"), [Setting("id", dim=2)], universe, tokens, None, {"user_id": LongType(), "item_id": LongType()})
    train = spark.createDataFrame([(7, 0), (7, 1), (7, 1), (8, 2)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in model_recs(models, train, 2).collect()}
    want = {(u, i): a * vectors[i][0] + b * vectors[i][1] + vectors[i][2] for u, a, b in ((7, 1.0, 0.5), (8, -1.0, 0.0)) for i in (3, 4)}
    assert got == pytest.approx(want)


def test_inverted_file_recall(spark):
    from shelfspark.operators.retrieval import approximate_recs, embedding_recs

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 12))
    v = centres[rng.integers(0, 25, 1500)] + 0.5 * rng.normal(size=(1500, 12))
    u = centres[rng.integers(0, 25, 80)] + 0.5 * rng.normal(size=(80, 12))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))], "item_id long, embedding array<double>")
    profiles = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_id long, profile array<double>")
    train = spark.createDataFrame([(i, int(j)) for i in range(80) for j in rng.integers(0, 1500, 30)], "user_id long, item_id long")
    exact = {(r["user_id"], r["item_id"]) for r in embedding_recs(profiles, vectors, train, 20).collect()}
    near = {(r["user_id"], r["item_id"]) for r in approximate_recs(profiles, vectors, train, 20, block=100, shard=30).collect()}
    assert len(near) == len(exact) == 1600 and len(near & exact) >= 0.9 * len(exact)
    assert not near & {(r["user_id"], r["item_id"]) for r in train.collect()}
    every = {(r["user_id"], r["item_id"]) for r in approximate_recs(profiles, vectors, train, 20, probes=10_000).collect()}
    assert every == exact
    assert approximate_recs(profiles, vectors.limit(0), train, 20).count() == 0


@pytest.mark.parametrize("shelf", [1 << 16, 1])
def test_popularity_of_heavy_users(spark, shelf):
    from shelfspark.operators.recommend import popularity_recs

    rng = np.random.default_rng(7)
    rows = [(u, int(i)) for u in range(12) for i in rng.zipf(1.4, 40) if i < 60] + [(50, i) for i in range(1, 60) if i not in (17, 44)] + [(51, i) for i in range(20, 60)]
    train = spark.createDataFrame(rows, "user_id long, item_id long")
    users = spark.createDataFrame([(u,) for u in (*range(12), 50, 51, 99)], "user_id long")
    counts = {}
    for _, i in rows:
        counts[i] = counts.get(i, 0) + 1
    want = []
    for u in (*range(12), 50, 51, 99):
        own = {i for x, i in rows if x == u}
        want += [(u, i, float(-n), r + 1) for r, (n, i) in enumerate(sorted((-n, i) for i, n in counts.items() if i not in own)[:5])]
    got = popularity_recs(train, users, 5, shelf=shelf).collect()
    assert sorted((r["user_id"], r["item_id"], r["score"], r["rank"]) for r in got) == sorted(want)


def test_salted_join(spark):
    from shelfspark.operators.joins import salted_join

    left = spark.range(3000).select((F.col("id") % 1000).alias("u"), F.when(F.col("id") < 2500, 7).when(F.col("id") < 2990, F.col("id") % 50).alias("k"))
    right = spark.createDataFrame([(k, f"v{j}") for k in range(40) for j in range(1 + k % 2)], "k long, v string")
    for how in ("inner", "left"):
        got = salted_join(left, right, ["k"], F.xxhash64("u"), how)
        want = left.join(right, "k", how)
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert salted_join(left.limit(0), right, ["k"], F.xxhash64("u")).count() == 0


def test_grid(spark):
    from shelfspark.operators import recommend as R
    from shelfspark.operators.experiments import FIXED, VARIANTS, experiment_grid

    train, test, _, universe = planted(spark)
    labels = lambda i: [f"l{i % 2}"]
    rows = [(i, "Face", f"B{i % 3}", labels(i), labels(i), labels(i), labels(i), labels(i), labels(i), labels(i), labels(i), labels(i), labels(i)) for i in range(12)]
    names = [f"{c}{t}" for t in ("", "_seller") for c in ("form", "skin", "benefit", "active")] + ["benefit_main", "active_main"]
    attrs = spark.createDataFrame(rows, "item_id long, segment string, store string, " + ", ".join(f"{c} array<string>" for c in names))
    vectors = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, 0.1 * i]) for i in range(12)], "item_id long, embedding array<double>")
    counts = R.item_train_counts(universe, train)
    got = experiment_grid(train, test, counts, attrs, vectors, [*FIXED, *VARIANTS], [0, 1], 2, ablation=["form"], most=2, patience=1, **OPTIONS).collect()
    cells = {(r["variant"], r["seed"]): {} for r in got}
    for r in got:
        cells[r["variant"], r["seed"]][r["metric"]] = r["value"]
    assert set(cells) == {(v, s) for v in VARIANTS for s in (0, 1)} | {("filled+drop - form", 0), ("filled+drop - form", 1)} | {(v, 0) for v in FIXED}
    assert all({"recall", "ndcg", "cold_recall", "cold_ndcg", "users", "cold_users"} <= set(m) for m in cells.values())
    assert all("best_epoch" in m for (v, _), m in cells.items() if v not in FIXED)


@pytest.mark.parametrize("block, shard", [(1000, 1000), (3, 7)])
def test_items_of_one_vector(spark, block, shard):
    """Items that share a vector are scored once; ties among them, among other vectors and with items that a user has are as for each item alone."""
    from shelfspark.operators.retrieval import _grouped, approximate_recs, embedding_profile, embedding_recs

    rng = np.random.default_rng(11)
    kinds = rng.integers(-1, 2, (6, 3)).astype(float)
    items = [(i, kinds[rng.integers(0, 6)]) for i in range(90)]
    seen = {u: set(rng.integers(0, 90, 4 * u + 1).tolist()) for u in range(20)}
    seen[20] = set(range(88))
    train = spark.createDataFrame([(u, i) for u, own in seen.items() for i in own], "user_id long, item_id long")
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in items], "item_id long, embedding array<double>")
    assert _grouped(vectors, []).count() == len({tuple(x) for _, x in items}) <= 6
    profiles = embedding_profile(train, vectors, block)
    own = {r["user_id"]: np.array(r["profile"]) for r in profiles.collect()}
    known = dict(items)
    for u, bought in seen.items():
        total = np.sum([known[i] for i in bought], axis=0)
        assert own[u] == pytest.approx(total / max(np.linalg.norm(total), 1e-8))
    want = [(u, i, r) for u, i, _, r in brute(list(own.items()), items, seen, 5)]
    for found in (embedding_recs(profiles, vectors, train, 5, block, shard=shard), approximate_recs(profiles, vectors, train, 5, probes=10_000, block=block, shard=shard)):
        assert sorted((r["user_id"], r["item_id"], r["rank"]) for r in found.collect()) == want


def test_more_models_make_no_more_groups(spark, monkeypatch):
    """A group's vectors are there once for each model, however many models are fitted together; in parts, a model's vectors are those of a fit in one task."""
    from shelfspark.operators import pairwise as P

    monkeypatch.setattr(P, "LEAST_PAIRS", 12)
    monkeypatch.setattr(P, "GROUP_PAIRS", 40)
    train, _, tokens, universe = planted(spark)
    text = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, 0.5]) for i in range(12)], "item_id long, embedding array<double>")
    settings = [P.Setting("tokens", i, "odd", **OPTIONS) for i in range(3)] + [P.Setting("text", 0, text=True, **OPTIONS), P.Setting("id", 0, **OPTIONS), P.Setting("id", 1, **OPTIONS)]
    seen = []
    trained = P._trained
    monkeypatch.setattr(P, "_trained", lambda state, fixed, active, epoch, groups: seen.append(groups) or trained(state, fixed, active, epoch, groups))
    read = lambda m: {(r["model"], r["kind"], r["key"]): tuple(r["x"]) for r in m.vectors.collect()}
    found = []
    for least in (2, 99):
        monkeypatch.setattr(P, "MODELS_APART", least)
        models, losses = P.fit_models(train, universe, settings, 2, tokens, text)
        assert all(len(x) == 2 for x in losses.values())
        found.append(read(models))
    assert found[0].keys() == found[1].keys() and all(found[1][k] == pytest.approx(v, abs=1e-9) for k, v in found[0].items())
    P.fit_models(train, universe, settings[:1], 1, tokens)
    assert len(set(seen)) == 1 and seen[0] == 2
    monkeypatch.setattr(P, "MODELS_APART", 2)
    assert [len(p) for p in P._parts(settings, 1, 4)] == [2, 2, 2] and [len(p) for p in P._parts(settings, 9, 4)] == [6]


def test_every_known_user_validates(spark, monkeypatch):
    """The epochs are chosen on all users of the validation time, however many there are."""
    from shelfspark.operators import experiments as X
    from shelfspark.operators.pairwise import Setting

    users = 9_000
    train = spark.range(users * 10).select((F.col("id") % users).alias("user_id"), F.floor(F.col("id") / users).alias("item_id"), F.col("id").alias("ts"))
    settings, asked = [Setting("id")], []

    class Fitted:
        pass

    Fitted.settings = settings

    def recs(models, before, k, users, counted):
        asked.append((users.select("user_id").distinct().count(), counted[1]))
        return users.select(F.lit("id/0").alias("model"), "user_id", "item_id", F.lit(1).alias("rank"))

    monkeypatch.setattr(X, "model_recs", recs)
    monkeypatch.setattr(X, "fit_models", lambda before, universe, settings, most, tokens, text, each, folder: each(1, Fitted, {}))
    epochs, scores = X.best_epochs(train, spark.range(10).withColumnRenamed("id", "item_id"), settings)
    assert asked == [(users, users)] and scores == {"id/0": [1.0]} and epochs == {"id/0": 1}


@pytest.mark.parametrize("block", [1000, 3])
def test_recs_of_own_profiles(spark, monkeypatch, block):
    """From a user's items to their best others in one pass: the rows of profile and search one after the other; where the vectors are one block, no profile is written."""
    from shelfspark.operators import retrieval as V

    rng = np.random.default_rng(13)
    kinds = rng.normal(size=(7, 3))
    vectors = spark.createDataFrame([(i, kinds[i % 7].tolist()) for i in range(60)], "item_id long, embedding array<double>")
    # items bought twice, one without a vector, a user who has nothing else, one who has nearly all
    train = spark.createDataFrame([(u, int(i)) for u in range(15) for i in rng.integers(0, 60, 2 * u + 1)] + [(0, 99), (20, 99)] + [(21, i) for i in range(58)], "user_id long, item_id long")
    profiles = V.embedding_profile(train, vectors, block).localCheckpoint()
    want = sorted(map(tuple, V.embedding_recs(profiles, vectors, train, 5, block).collect()))
    every = sorted(map(tuple, V.approximate_recs(profiles, vectors, train, 5, probes=99, block=block).collect()))
    written = []
    whole = V.embedding_profile
    monkeypatch.setattr(V, "embedding_profile", lambda *a: written.append(a) or whole(*a))
    assert sorted(map(tuple, V.profile_recs(train, vectors, 5, block).collect())) == want == every
    assert sorted(map(tuple, V.approximate_recs(None, vectors, train, 5, probes=99, block=block).collect())) == want
    assert len(written) == (0 if block == 1000 else 2) and {r[0] for r in want} == {*range(15), 21}


def test_scores_near_each_other(spark):
    """Scores that differ by less than short numbers tell apart, in a block of more rows than are looked through one by one; large and small vectors, users of nothing."""
    import pyarrow as pa

    from shelfspark.operators import retrieval as V

    rng = np.random.default_rng(17)
    lists = lambda x, kind: pa.array([list(r) for r in x], pa.list_(kind))
    for scale in (1.0, 1e-7, 1e25):
        m = (1.0 + 1e-8 * rng.integers(0, 40, (3000, 2))) * scale
        x = np.vstack([rng.normal(size=(20, 2)), np.zeros((1, 2))])
        own = [sorted(set(rng.integers(0, 3000, 50).tolist())) for _ in x]
        names = rng.permutation(3000)
        items = pa.RecordBatch.from_arrays([lists(names[:, None], pa.int64()), lists(m, pa.float64()), lists([[]] * 3000, pa.int32())], ["ids", "vector", "lists"])
        users = pa.RecordBatch.from_arrays([pa.array(range(21)), lists(x, pa.float64()), lists(own, pa.int64()), lists([[]] * 21, pa.int32())], ["user_id", "vector", "seen", "lists"])
        got = [r for b in V._best(users, V._Block([items]), 7, []) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        for u in range(21):
            best = sorted((-s, int(i)) for s, i in zip(np.round((x[u] * m).sum(1), 9), names, strict=True) if i not in own[u])[:7]
            mine = [(i, s) for v, i, s in got if v == u]
            assert [s for _, s in mine] == pytest.approx([-s for s, _ in best], rel=1e-12, abs=1.1e-9)
            assert scale != 1.0 or [i for i, _ in mine] == [i for _, i in best]


def test_no_runs_of_nulls_on_the_way_to_python(spark, monkeypatch):
    """Strings and lists that a row lacks are empty where rows go to Python: Spark goes through all nulls at a column's end after each row."""
    from shelfspark.operators import pairwise as P
    from shelfspark.operators import retrieval as V

    seen = []
    packed, met = P._packed, V._met
    monkeypatch.setattr(P, "_packed", lambda rows, *a: seen.append(rows) or packed(rows, *a))
    train, _, tokens, universe = planted(spark)
    text = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(5)], "item_id long, embedding array<double>")
    models, _ = P.fit_models(train, universe, [P.Setting("all", 0, "odd", text=True, **OPTIONS)], 1, tokens, text)
    assert models.profiles().count() == 20
    monkeypatch.setattr(V, "_met", lambda users, items, *a: seen.append(V._cells(users, items, [], a[2])) or met(users, items, *a))
    assert V.profile_recs(train, text, 2).count() and V.embedding_profile(train, text).count()
    kinds = ("string", "array")
    for rows in seen[1:]:
        assert not rows.filter(" OR ".join(f"{f.name} IS NULL" for f in rows.schema if f.dataType.simpleString().startswith(kinds))).count()
    assert len(seen) == 3 and not [f.name for f in seen[0].schema if f.nullable and f.dataType.simpleString().startswith(kinds)]


def test_popular_items_near_the_top_are_broadcast(spark, monkeypatch):
    """Only ranks that a user's items can push are joined with what users have, and purchases are not dealt by item for it."""
    from shelfspark.operators import recommend as R

    train = spark.createDataFrame([(u, i) for u in range(30) for i in range(u % 7, 200, 40)] + [(7, 3), (7, 3)], "user_id long, item_id long")
    asked = train.select("user_id").distinct()
    want = sorted(map(tuple, R.popularity_recs(train, asked, 4, shelf=1).collect()))
    monkeypatch.setattr(R, "salted_join", None)
    assert sorted(map(tuple, R.popularity_recs(train, asked, 4).collect())) == want and len(want) == 120
