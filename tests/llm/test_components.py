"""Components against brute force: paths, stars, rings and random links, in any order and with repeats."""

from __future__ import annotations

import random

import numpy as np
import pytest

from shelfspark.llm.components import components, contracted


def brute(links):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            s, t = sorted((top(a), top(b)))
            up[t] = s
    return {x: top(x) for x in up}


def graphs():
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(300)]
    rng.shuffle(path)
    yield "path", path
    yield "star", [(-7, i) for i in range(200)] + [(3, 3)]
    yield "ring", [(i, (i + 1) % 50) for i in range(50)] * 2
    yield "random", [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(350)]
    yield "none", []


@pytest.mark.parametrize("few", [0, 1 << 16])
@pytest.mark.parametrize(("name", "links"), list(graphs()), ids=[n for n, _ in graphs()])
def test_components(spark, name, links, few, monkeypatch):
    monkeypatch.setattr("shelfspark.llm.components.FEW", few)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["node"]: r["label"] for r in found.collect()} == brute(links)


@pytest.mark.parametrize(("name", "links"), [g for g in graphs() if g[1]], ids=[n for n, g in graphs() if g])
def test_contracted(name, links):
    pairs = np.array([(max(x), min(x)) for x in links if x[0] != x[1]])
    u, v = contracted(pairs[:, 0], pairs[:, 1])
    known = brute(links)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: t for x, t in known.items() if x != t}
