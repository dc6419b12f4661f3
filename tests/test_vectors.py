"""Numeric operators against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cluster as cl
from textloom.operators.vectors import fit_encoder


def slow_ward(vectors):
    """The closest pair of all, again and again."""
    groups = [[i] for i in range(len(vectors))]
    heights = []
    while len(groups) > 1:
        cost = lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(vectors[a].mean(0) - vectors[b].mean(0))
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] = groups[i] + groups.pop(j)
    return heights


@pytest.mark.parametrize("copies", [1, 4])
def test_ward_by_chains_has_the_same_heights(copies):
    v = np.repeat(np.random.default_rng(copies).standard_normal((40 // copies, 5)), copies, axis=0)
    links = cl.ward(v)
    assert np.allclose(links[:, 2], slow_ward(v)) and links[-1, 3] == 40
    assert sorted(links[:, :2].ravel()) == list(range(78))


def test_ward_of_2000_points_is_quick():
    import time

    began = time.perf_counter()
    cl.ward(np.random.default_rng(0).standard_normal((2000, 32)))
    assert time.perf_counter() - began < 20


def test_silhouettes_of_plain_distances(spark):
    rng = np.random.default_rng(4)
    v, c = rng.standard_normal((90, 4)), [*rng.integers(0, 4, 89).tolist(), 9]
    far = np.linalg.norm(v[:, None] - v[None], axis=2)
    want = {}
    for i in range(90):
        own = [far[i, j] for j in range(90) if c[j] == c[i] and j != i]
        b = min(np.mean([far[i, j] for j in range(90) if c[j] == o]) for o in set(c) - {c[i]})
        want[i] = (b - np.mean(own)) / max(b, np.mean(own)) if own else 0.0
    df = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(zip(c, v.tolist(), strict=True))], "id long, c int, v array<double>")
    for block in (20, 1000):
        found = {r.id: r.silhouette for r in cl.silhouettes(df, "id", "c", "v", block).collect()}
        assert found == pytest.approx(want)
    assert {r.silhouette for r in cl.silhouettes(df.withColumn("c", F.lit(1)), "id", "c", "v").collect()} == {0.0}


def test_main_directions_are_near_those_of_a_dense_decomposition(spark):
    rng = random.Random(3)
    topics = [[f"{'abcdef'[t]}word{i}" for i in range(40)] for t in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6] if rng.random() < 0.8 else topics[rng.randrange(6)]) for _ in range(60)) for i in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (120, ""), (121, None)], "doc_id long, text string").repartition(3)
    encoder = fit_encoder(df, dims=64)
    rows = encoder.weights(df, "doc_id", "text").collect()
    names = sorted({t for r in rows for t in r.terms})
    at = {t: i for i, t in enumerate(names)}
    a = np.zeros((120, len(names)))
    for r in rows:
        a[r.doc_id, [at[t] for t in r.terms]] = r.weights
    u, _, _ = np.linalg.svd(a, full_matrices=False)
    found = {r.doc_id: r.embedding for r in encoder.transform(df).collect()}
    e = np.array([found[i] for i in range(120)])
    q, _ = np.linalg.qr(e[:, :6])
    assert np.linalg.svd(q.T @ u[:, :6])[1].min() > 0.9
    assert np.allclose(np.linalg.norm(e, axis=1), 1) and found[120] == found[121] and len(set(found[120])) == 1
    again = {r.doc_id: r.embedding for r in fit_encoder(df, dims=64).transform(df).collect()}
    assert np.allclose(np.array([again[i] for i in range(120)]), e, atol=1e-6)


def test_one_pass_of_batches_is_near_whole_kmeans(spark):
    rng = np.random.default_rng(8)
    blobs = rng.standard_normal((6, 5)) * 4
    v = blobs[rng.integers(0, 6, 1500)] + rng.standard_normal((1500, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")

    def inertia(found):
        clusters = {r.id: r.cluster for r in found.collect()}
        c = np.array([clusters[i] for i in range(1500)])
        return sum(((v[c == x] - v[c == x].mean(0)) ** 2).sum() for x in set(c))

    once = cl.minibatch_kmeans(df, "id", "v", 6)
    assert inertia(once) <= 1.05 * inertia(cl.kmeans(df, "id", "v", 6))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, cl.minibatch_kmeans(df, "id", "v", 6).collect()))
    same = df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r.cluster for r in cl.minibatch_kmeans(same, "id", "v", 4).collect()} == {0}
    assert cl.minibatch_kmeans(df.limit(0), "id", "v", 3).count() == 0


def test_texts_an_encoder_is_fitted_on_are_weighed_once(spark):
    from textloom.operators.vectors import _counted, fit_transform

    df = spark.createDataFrame([(1, "red fox red fox"), (2, "blue whale song"), (3, "red whale"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id: sorted(r.tf) for r in _counted(df, "doc_id", "text").collect()} == {1: [1, 2, 2, 2], 2: [1] * 5, 3: [1] * 3, 4: [], 5: []}
    encoder, vectors = fit_transform(df, dims=8)
    apart = {r.doc_id: r.embedding for r in encoder.transform(df).collect()}
    found = {r.doc_id: r.embedding for r in vectors.collect()}
    assert set(found) == {1, 2, 3, 4, 5} and all(np.allclose(found[i], apart[i]) for i in found)
