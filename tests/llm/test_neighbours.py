"""Nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, asks):
    """rows: (id, vector), those that take part."""
    found = {}
    for at, (q, x) in enumerate(rows):
        if asks(q):
            scored = [(sum_of(x, y), i) for b, (i, y) in enumerate(rows) if b != at]
            scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
            found.setdefault(q, []).append([(i, s) for s, i in scored[:k]])
    return found


def sum_of(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += float(np.float32(a)) * float(np.float32(b))
    return total


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def ask(spark, rows, asks=None, **more):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "label": F.lit(None).cast("int"), "head": F.lit(1)})
    return neighbours.nearest(docs, asks if asks is not None else F.col("vec_id") % 5 == 0, **more)


def test_hadamard_is_orthonormal():
    turned = neighbours.hadamard(np.eye(8))
    assert np.allclose(turned @ turned.T, np.eye(8)) and np.allclose(np.abs(turned), 8**-0.5)


@pytest.mark.parametrize("hashes", [1, 2, 4])
def test_first_probe_is_the_rows_own_bucket_and_probes_are_the_nearest_axes(hashes):
    x = np.random.default_rng(hashes).normal(size=(30, 13))
    hasher = neighbours.CrossPolytope(13, 3, hashes)
    most = min(200, hasher.buckets)
    probes = hasher.queries(x, most)
    assert (probes[:, :, 0] == hasher.rows(x)).all()
    for lists in probes.reshape(-1, most):
        assert len(set(lists.tolist())) == most
    units = x / np.linalg.norm(x, axis=1)[:, None]
    turned = hasher._turned(np.pad(units, ((0, 0), (0, 3))), 0)
    values = np.stack([turned, -turned], 3).reshape(30, hashes, -1)
    for row in range(3):
        sums = [0.0]
        for part in values[row]:
            sums = [a + b for a in sums for b in part]
        assert probes[row, 0, 0] == int(np.argmax(sums))


@pytest.mark.parametrize("kind", ["unit", "norms", "clusters"])
def test_recall_and_exact_scores(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    if kind == "clusters":
        x = rng.normal(size=(15, 16))[rng.integers(15, size=1500)] + x / 8
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = answers(ask(spark, rows, slice_rows=100, bucket_rows=2 if kind == "unit" else 512)), brute(rows, 20, lambda i: i % 5 == 0)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w[0]}) / 20 for q, w in want.items()]
    assert np.mean(hits) >= 0.9
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda r: (-r[1], r[0]))
        assert all(s == sum_of(rows[q][1], rows[i][1]) for i, s in near)


def test_many_copies_ties_and_repeated_ids(spark):
    rng = random.Random(2)
    points = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(6)] for _ in range(25)]
    points = [p for p in points if any(p)]
    rows = [(i, points[0] if i % 3 == 0 else rng.choice(points)) for i in range(600)] + [(5, points[1]), (5, points[0]), (None, points[0])]
    got, want = answers(ask(spark, rows, F.col("vec_id") % 10 == 0, recall=1.0)), brute(rows, 20, lambda i: i is not None and i % 10 == 0)
    assert got == {q: w[0] for q, w in want.items()}
    twice = ask(spark, rows, F.col("vec_id") == 5).collect()
    assert len(twice) == 60 and len([r for r in twice if r["rank"] == 1]) == 3


def test_edges(spark):
    nan, inf = math.nan, math.inf
    bad = [(0, None), (5, []), (10, [0.0, 0.0]), (15, [1.0, nan]), (20, [inf, 1.0]), (25, [1.0, None]), (30, [1.0]), (35, [1.0, 2.0, 3.0])]
    good = [(40, [1.0, 0.0]), (41, [0.5, 0.5]), (42, [-1.0, 0.0]), (None, [0.5, 0.5])]
    got = answers(ask(spark, bad + good))
    assert got == {40: [(41, 0.5), (None, 0.5), (42, -1.0)]}
    assert ask(spark, good[1:]).count() == 0
    assert ask(spark, bad[:1]).count() == 0
    assert answers(ask(spark, good[:1])) == {}
    assert ask(spark, []).columns == ["query_id", "rank", "vec_id", "score"]
    assert answers(ask(spark, [(5, [1e30, 1e30]), (6, [1e-30, 0.0])]))[5][0][0] == 6
