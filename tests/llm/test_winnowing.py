import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from textloom.llm import winnowing
from textloom.llm.winnowing import K, POSITION_BITS, WINDOW, fingerprint_report


def winnow(text, k=K, w=WINDOW):
    if not text:
        return []
    raw = text.encode("utf-32-be", "surrogatepass")
    n = max(1, len(text) - k + 1)
    bits = 64 - POSITION_BITS
    grams = [xxhash.xxh64_intdigest(raw[4 * i : 4 * (i + k)], seed=42) for i in range(n)]
    lower = [h & ((1 << bits) - 1) for h in grams]
    signed = [h - (1 << bits) if h >> (bits - 1) else h for h in lower]
    out = set()
    for s in range(max(1, n - w + 1)):
        least = min(signed[s : s + w])
        out.add(max(i for i in range(s, min(n, s + w)) if signed[i] == least))
    return [(i, grams[i]) for i in sorted(out)]


def said(found):
    return ",".join(f"{h:X}:{i}" for i, h in found)


def like(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = winnow(text), winnow(edited), winnow(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), said(a), said(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_chars int, range__ string")
    return sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint_report(df).collect()], key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "CHUNK", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab cé😀", k=rng.choice([0, 1, 3, 11, 12, 26, 27, 28, 80, 400]))) for _ in range(40)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, f"null id {i}") for i in range(30)] + [(None, None), (None, "null id 3"), (3, None), (4, "x" * 500), (7, texts[1]), (7, "other text of the same id")]
    assert run(spark, rows) == brute(rows)


def test_ranges(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(10**12),) for _ in range(3000)] + [(None,)], "doc_id long")
    found = df.withColumn("r", winnowing.ranges_of(df, "doc_id", F.lit("00b"), rows=20)).collect()
    known = sorted((r.doc_id, r.r) for r in found if r.doc_id is not None)
    assert [r for _, r in known] == sorted(r for _, r in known)
    assert len({r for _, r in known}) > 100
    assert [r.r for r in found if r.doc_id is None] == [-12]


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a single document of some length")]) == brute([(1, "a single document of some length")])
    same = [(i, "equal texts have equal fingerprints, whatever comes next") for i in range(4)] * 2
    assert run(spark, same) == brute(same)
