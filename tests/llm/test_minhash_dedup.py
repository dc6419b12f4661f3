import random

import numpy as np

from textloom.llm.minhash_dedup import near_duplicates
from textloom.llm.superminhash import shingles, signatures

SCHEMA = "doc_id long, text string, n int, component_id string"


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top[i], top[j]
                top = [b if x == a else x for x in top]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 40, 90]))) for _ in range(n)]
    texts = list(base)
    for t in base:
        for _ in range(rng.randrange(6)):
            w = t.split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        if rng.random() < 0.3:
            texts += [t.upper() if rng.random() < 0.5 else t] * 3
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted([tuple(r) for r in near_duplicates(df, **kw).collect()], key=str)


def test_against_all_pairs(spark):
    rows = corpus(1, 60)
    assert run(spark, rows, words=2, percent=80) == brute(rows, 2, 80)


def test_family_that_its_pivot_does_not_link(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(7 + i % 3):
            w[rng.randrange(120)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, words=2, percent=80) == brute(rows, 2, 80)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "one"), (5, "ONE"), (5, "one"), (None, "a b c d"), (7, "a b c d"), (8, "long " * 50_000), (9, "long " * 40_000), (10, "É é"), (11, "é é")]
    assert run(spark, rows, words=2, percent=80) == brute(rows, 2, 80)
    assert run(spark, [], words=2) == []


def test_signature_estimates_likeness():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[500:])
    sig = signatures([a, b, a, a[:3]], 400)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.08
    assert (sig[0] == sig[2]).all()
    assert (sig >> np.uint64(53)).max() < 400
    assert len(shingles(np.arange(3, dtype=np.uint64), 5)) == 1
