"""Each stage of the pipeline on rows that are odd: nulls, repeats, ties, long and empty texts, clashing names."""

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "n_tokens", "row__x", "k1"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens string, row__x int, k1 string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", None if t is None else len(t), "clash", "clash", 1, "clash") for i, t in rows], DOCS)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "  \n\t"), (None, "no id"), (None, None), (4, "same"), (4, "same"), (5, "word " * 60_000)]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, unique = prose(1), prose(2), prose(3)
    rows = [(5, a), (3, a), (5, unique), (7, b), (7, b), (None, a), *ODD]
    got = cp.near_dedup(spark, docs_of(spark, rows), "")
    assert got.columns == COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(3, a), (5, unique), (7, b), *ODD[:6], ODD[7]], key=str)


def test_lines_of_documents_that_lose_all(spark):
    rows = [(i, "all rights reserved\n\n") for i in range(12)] + ODD
    got = cp.drop_lines(spark, docs_of(spark, rows), "")
    assert got.columns == COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(0, rows[0][1]), *ODD]))


def test_toxicity_scores_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit("clash"), "n_tokens": F.lit("clash"), "row__x": F.lit(1), "k1": F.lit("clash")})
    got = cp.drop_toxic(spark, docs.unionByName(docs_of(spark, ODD)), sf)
    assert got.columns == COLUMNS
    # of equal texts all stay or none does, and texts without terms stay
    odd = [(r.doc_id, r.text) for r in got.filter(F.col("source") == "src1").filter("score = 'clash' and row__x = 1 and lang = 'en'").collect()]
    assert odd.count((4, "same")) in (0, 2) and all(odd.count(x) >= 1 for x in [(1, None), (2, ""), (None, None)])


def test_benchmark_passages_in_odd_rows(spark, tmp_path):
    item = prose(4, 12)
    spark.createDataFrame([(1, item), (1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [*ODD, (8, f"{prose(5)} {item.upper()} {prose(6)}"), (9, item), (9, item)]
    got = cp.drop_benchmark(spark, docs_of(spark, rows), str(tmp_path))
    assert got.columns == COLUMNS
    kept = {r.doc_id: r.text for r in got.filter("doc_id >= 8").collect()}
    assert kept == {8: f"{prose(5)}  {prose(6)}"} and got.count() == len(ODD) + 1


def test_mixing_of_odd_rows(spark):
    got = cp.mix_sources(spark, docs_of(spark, [*ODD, *[(i, prose(i)) for i in range(10, 40)]]), "")
    assert got.columns == [c for c in COLUMNS if c != "n_tokens"] + ["n_tokens", "leaf_budget", "epochs"]
    assert got.count() == len(ODD) + 30 and {r.epochs for r in got.collect()} == {1}
