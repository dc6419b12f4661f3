import numpy as np
import pytest

from textloom.llm import vector_dedup
from textloom.llm.vector_dedup import near_vectors, plan

SCHEMA = "vec_id long, embedding array<double>, N_links int, cell string"


def brute(rows, least=0.9):
    dims = max([len(v) for _, v, *_ in rows if v is not None], default=0)
    m = np.zeros((len(rows), dims))
    for i, (_, v, *_) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v):
            m[i, : len(v)] = v
    norms = np.linalg.norm(m, axis=1)
    cosine = m @ m.T / np.where(norms > 0, norms, np.inf)[:, None] / np.where(norms > 0, norms, np.inf)[None, :]
    near = cosine >= least
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    out = []
    for i in range(len(rows)):
        found = [ids[j] for j in range(len(rows)) if comp[j] == comp[i] and ids[j] is not None]
        top = min(found) if found else None
        out.append((ids[i], int(near[i].sum()), top, ids[i] == top))
    return out


def groups(seed, sizes):
    """Groups of noisy copies of some base; sizes: (rows, noise)."""
    rng = np.random.default_rng(seed)
    found = []
    for n, noise in sizes:
        base = rng.standard_normal(24)
        found += (rng.uniform(0.1, 9) * (base + noise * rng.standard_normal((n, 24)))).tolist()
    return found


@pytest.mark.parametrize("small", [False, True])
def test_groups_of_all_kinds_equal_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_dedup, "SMALL", 3)
        monkeypatch.setattr(vector_dedup, "STRIPE", 7)
    vectors = groups(1, [(40, 0.1), (25, 0.3), (12, 0.22), (2, 0.35), (2, 0.3), *[(1, 0)] * 80])
    rows = [(1000 - 3 * i, v, 1, "x") for i, v in enumerate(vectors)]
    rows += [(5000 + i, vectors[0], 1, "x") for i in range(20)] + [(7, vectors[100], None, None)] * 2
    rows += [(8, None, 0, ""), (9, [], 0, ""), (10, [0.0] * 24, 0, ""), (11, [None, 1.0], 0, ""), (12, [float("nan")], 0, ""), (13, [float("inf")], 0, "")]
    rows += [(None, vectors[90], 0, ""), (None, None, 0, ""), (14, [1.0], 0, ""), (15, [1e200, 1e199], 0, ""), (16, [-1.0], 0, ""), (17, [-0.0, 0.0], 0, "")]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), miss=1e-4)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute([r if r[0] != 15 else (15, [10.0, 1.0], 0, "") for r in rows]), key=repr)


def test_pairs_at_the_least_cosine_are_found(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((600, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = rng.standard_normal((600, 32))
    away -= (away * a).sum(1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.filter("n_links > 0").count() >= 0.95 * 1200


def test_empty_tables_and_tables_without_vectors(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).collect()] == [(1, 0, 1, True)]


def test_tables_grow_slower_than_vectors():
    assert plan(10**9, 0.9)[1] < 100 * plan(10**3, 0.9)[1]
