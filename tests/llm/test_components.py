"""Components of edges, and the tasks that they take."""

from __future__ import annotations

import random

from barloom.llm import simhash
from barloom.llm.common import ready

PARTS = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def smallest(edges):
    """The smallest node of each node's component, by plain union and find."""
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up if root(x) != x}


def test_rounds_write_few_files(spark, monkeypatch):
    """Chains, hubs and stray pairs in a session of many shuffle partitions."""
    rng, files = random.Random(15), []
    edges = [(i + 1, i) for i in range(300)] + [(i, 1000) for i in range(1001, 1400)]
    edges += [(b, a) for a, b in (sorted(rng.sample(range(2000, 2600), 2)) for _ in range(300))]
    was, store = {k: spark.conf.get(k) for k in PARTS}, simhash.store

    def counted(df, label):
        out = store(df, label)
        files.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(simhash, "store", counted)
    frame = ready(spark).createDataFrame(edges, "u long, v long").coalesce(1)
    try:
        for k, v in PARTS.items():
            spark.conf.set(k, v)
        rows = simhash.components(frame).collect()
        rounds = len(files)
        stars = spark.createDataFrame([(r.node, r.root) for r in rows], "u long, v long").coalesce(1)
        again = simhash.components(stars).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in rows} == smallest(edges) and len(rows) == len(smallest(edges))
    assert sorted(again) == sorted(rows)
    assert max(n for _, n in files) <= spark.sparkContext.defaultParallelism
    assert len(files) - rounds == 3  # stars take a single round
