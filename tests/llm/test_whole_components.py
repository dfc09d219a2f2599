"""Components of graphs with hubs, chains and many small parts, against a plain union-find."""

import random

from discoforge.llm import common


def plain(edges):
    up = {}

    def root(k):
        up.setdefault(k, k)
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    return {k: root(k) for k in list(up)}


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_LINKS", 8)
    rng = random.Random(3)
    edges = [(5000, i) for i in range(100, 160)] + [(1, i) for i in range(200, 240)]  # a hub above its leaves, one below
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(130, 210), (1060, 5000)]  # a chain, and links between them
    edges += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(400)]
    edges += [(7000 + rng.randrange(9), 7100 + i) for i in range(200)]
    found = common.components(spark.createDataFrame(edges, "a long, b long"))
    want = {k: v for k, v in plain([e for e in edges if e[0] != e[1]]).items()}
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert found.count() == len(want)


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
