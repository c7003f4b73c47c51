"""Embedding near-dedup against all cosines."""

import numpy as np
import pytest


def planted(n=1500, d=64, seed=3):
    """Unrelated vectors, and for a third of them near ones at cosines from 0.93 to 1."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = list(base)
    for v in base[: n // 3]:
        side = rng.normal(size=d)
        side -= side @ v * v
        side /= np.linalg.norm(side)
        c = rng.uniform(0.93, 1)
        out.append(c * v + np.sqrt(1 - c * c) * side)
    return np.array(out)[rng.permutation(len(out))]


def brute(x, least=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True)}


def components_of(n, links):
    label = list(range(n))
    for i, j in links:
        a, b = sorted((label[i], label[j]))
        if a != b:
            label = [a if x == b else x for x in label]
    return label


def test_recall_and_components(spark):
    from shelfspark.llm import embedding_dedup as op

    x = planted()
    links = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {r["vec_id"]: r for r in op.linked_vectors(df).collect()}
    assert len(got) == len(x)
    degree = np.bincount(np.array(sorted(links)).ravel(), minlength=len(x))
    assert all(got[i]["n_links"] <= degree[i] for i in range(len(x)))
    recall = sum(r["n_links"] for r in got.values()) / degree.sum()
    assert len(links) > 300 and recall >= 0.97
    # every row's class is one of true links, and complete where all its links were found
    label = components_of(len(x), links)
    for i, r in got.items():
        assert label[r["component_id"]] == label[i] and r["kept"] == (r["component_id"] == i)
    assert sum(got[i]["component_id"] == label[i] for i in got) >= 0.99 * len(x)


@pytest.mark.parametrize("block", [7, 512])
def test_hot_buckets_and_copies(spark, block):
    """A dense group in few buckets, copies, and odd vectors; blocks change nothing."""
    from shelfspark.llm import embedding_dedup as op

    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    x = base + rng.normal(size=(150, 16)) * 0.02
    links = brute(x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0, None] + [0.0] * 14), (1004, [float("nan")] * 16), (1005, [float("inf")] + [0.0] * 15), (None, None), (1006, [1.0, 2.0]), (1007, [1e200] * 3), (1008, [2e-200] * 3), (1009, [-0.0, 3.0]), (1010, [0.0, 3.0]), (1011, [-1.0, -2.0])]
    copies = [(2000 + i, x[0].tolist()) for i in range(40)] + [(0, x[0].tolist())]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows + odd + copies], "vec_id long, embedding array<double>, Kept string, salt int").repartition(4)
    out = op.linked_vectors(df, block=block)
    assert out.columns == ["vec_id", "embedding", "salt", "n_links", "component_id", "kept"]
    got = out.collect()
    assert len(got) == len(rows + odd + copies)
    near = {j for i, j in links if i == 0} | {i for i, j in links if j == 0}
    at = {}
    for r in got:
        at.setdefault(r["vec_id"], []).append(r)
    assert {(r["n_links"], r["component_id"]) for i in (0, 2000, 2039) for r in at[i]} == {(len(near) + 41, 0)}
    degree = np.bincount(np.array(sorted(links)).ravel(), minlength=len(x)) + np.array([41 * (i in near) for i in range(len(x))])
    assert [at[i][0]["n_links"] for i in range(1, len(x))] == degree[1:].tolist()
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1011, None):
        assert (at[i][0]["n_links"], at[i][0]["component_id"], at[i][0]["kept"]) == (0, i, True)
    assert at[1007][0]["n_links"] == at[1008][0]["n_links"] == 1 and at[1008][0]["component_id"] == 1007
    assert at[1009][0]["n_links"] == 1 and at[1010][0]["component_id"] == 1009
    assert op.linked_vectors(df.limit(0)).count() == 0


def test_rotation_balances_codes():
    from shelfspark.llm import embedding_dedup as op

    rng = np.random.default_rng(1)
    x = op.unit(rng.normal(size=(4000, 24)) * np.linspace(1, 4, 24))
    index = op.fit_index(x, len(x))
    codes = index.codes(x)
    bits = (codes[:, :, None] >> np.arange(24, dtype=np.uint64)) & np.uint64(1)
    assert (np.abs(bits.mean(0) - 0.5) < 0.1).all()

    def loss(rotation):
        v = x @ rotation
        return ((np.where(v > 0, 1, -1) - v * np.sqrt(24) / np.linalg.norm(v, axis=1, keepdims=True)) ** 2).mean()

    axes = np.linalg.eigh(x.T @ x)[1]
    assert loss(index.rotations[0]) < loss(axes)
    assert op.table_plan(1 << 40, 64, 0.95)[0] == 34 and op.table_plan(1000, 64, 0.95)[0] == 16
    assert np.array_equal(index.keys(codes)[:, 0], codes[:, 0] & np.uint64((1 << index.width) - 1))
