"""Nearest neighbours among vectors whose codes are the same."""

import numpy as np

from graphloom.llm.annsearch import search, unit


def test_tight_clusters_keep_their_nearest(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.002 * rng.standard_normal((1_000, 32)) for c in rng.standard_normal((3, 32))])
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in search(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    near = unit(x)
    hits = 0
    for q in range(0, len(x), 50):
        cos = near @ near[q]
        cos[q] = -2
        hits += len(found[q] & set(np.argsort(-cos, kind="stable")[:5].tolist()))
    assert hits / (5 * len(found)) >= 0.9
