import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.hard_negatives import Anchors, Codes, hard_negatives, rotation

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int"


def brute(rows, every, k=5, low=80, high=100):
    dims = max([len(r[1]) for r in rows if r[1] is not None], default=0)
    kept = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dims - len(v)), label))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), b, m) for j, (b, w, m) in enumerate(kept) if j != i]
        for s, b, _ in sorted([x for x in scored if x[2] == label], key=key)[:k]:
            fits = sorted([x for x in scored if x[2] != label and low * s <= 100 * x[0] <= high * s], key=key)[:k]
            out += [(a, b, n, c, s, t) for n, (t, c, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(df, every, **more):
    found = hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("at_once", [3, 16_384])
def test_equal_to_all_pairs(spark, at_once):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = []
    for i in range(260):
        b = base[rng.randrange(6)] if i % 3 else base[0]
        v = [x + rng.gauss(0, 0.4) for x in b] if i % 5 else b  # copies: ties
        rows.append((i, v, 0 if rng.random() < 0.4 else rng.randrange(4), "x", 1))
    rows += [(500, base[0], None, "", 0), (520, None, 1, "", 0), (540, [None, 1.0], 1, "", 0), (560, [float("inf")], 1, "", 0), (580, [float("nan")], 1, "", 0)]
    rows += [(600, [], 1, "", 0), (620, [0.0] * 16, 2, "", 0), (640, base[1][:5], 3, "", 0), (None, base[2], 1, "", 0), (20, base[0], 0, "", 0), (660, [-x for x in base[0]], 7, "", 0)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3), 20, anchors_at_once=at_once) == brute(rows, 20)


def test_empty_tables_and_tables_without_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 20) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, "", 0)], SCHEMA), 20) == []
    assert mined(spark.createDataFrame([(20, [1.0], 1, "", 0)], SCHEMA), 20) == []


def test_intervals_hold_the_scores_and_drop_most_of_the_rest():
    rng = np.random.default_rng(2)
    rows = rng.integers(-60, 60, (3000, 64)).astype(np.int32)
    rows[:20] = rows[20:40] + rng.integers(-3, 3, (20, 64))
    rows[50] = 0
    turn = rotation(64, 17)
    assert np.allclose(turn.T @ turn, np.eye(64))
    low, high = Anchors(rows[:20], turn).interval(np.arange(20), Codes.of(rows, turn))
    scores = rows[:20].astype(np.int64) @ rows.T
    assert (low <= scores).all() and (scores <= high).all()
    near = 0.4 * scores[np.arange(20), np.arange(20)][:, None]
    assert (high >= near).mean() < 0.25
