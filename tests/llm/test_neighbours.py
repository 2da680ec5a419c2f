"""Nearest neighbours against brute force: the graph, not one exact cell, gives the result."""

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import nn_descent

SCHEMA = "vec_id long, embedding array<double>, rank string"


def brute(rows, k=10):
    """{(query row): [(vec_id, score)]} over all usable rows; a row is never its own neighbour."""
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % 100 == 0:
            same = [(b, j, w) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v)]
            d = np.sqrt(((np.array([w for _, _, w in same]) - v) ** 2).sum(axis=1)) if same else np.array([])
            near = sorted(zip(d, [j for _, j, _ in same], strict=True))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nn_descent.nearest(df, F.col("vec_id") % 100 == 0).collect())


def test_recall_of_the_graph(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 5000)] + 0.6 * rng.standard_normal((5000, 24))
    x[1000:2000] = x[1000] * (1 + 1e-4 * rng.standard_normal((1000, 24)))  # copies with a slight jitter
    x[4321] = 1e7  # an outlier
    assert len(x) > 6 * nn_descent.LEAF
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows), brute(rows)
    assert len(got) == len(want) == 500 and {g[0] for g in got} == set(range(0, 5000, 100))
    right = len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want})
    assert right >= 0.9 * len(want)
    jittered = [w for w in want if 1000 <= w[0] < 2000]
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in jittered}) >= 0.9 * len(jittered)
    exact = {(int(i), int(j)): np.sqrt(((x[i] - x[j]) ** 2).sum()) for i, _, j, _ in got}
    assert all(abs(s - exact[(i, j)]) < 1e-9 * max(1, s) for i, _, j, s in got)


def test_unusable_rows_copies_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[100:160] = x[100]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (1200, [None] * 16), (None, [1.0] * 16), (1300, [1.0, 2.0]), (7, [1.0, 2.5]), (8, [3.0, 3.0])]
    rows += [(0, x[0].tolist()), (0, x[0].tolist()), (200, x[3].tolist()), (5, x[200].tolist()), (5, x[200].tolist())]  # repeated rows, and ids with two vectors
    got, want = found(spark, rows), brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])]
    assert [g[2] for g in found(spark, rows)] == [2, 1]
    assert found(spark, rows[:1]) == [] and found(spark, []) == []
