"""Artifacts of runs: what a reader sees while writers come, go and die."""

import pytest
from pyspark.sql import functions as F

from textloom.sources.items import normalize_text, texts_only
from textloom.sources.runs import RunStore


def test_a_writer_that_dies_leaves_the_old_artifact(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    with pytest.raises(FileNotFoundError):
        store.load("r", "items")
    store.save("r", "items", spark.range(3))
    before = store.load("r", "items")

    @F.udf("long")
    def dies(x):
        raise RuntimeError("gone")

    with pytest.raises(Exception, match="gone"):
        store.save("r", "items", spark.range(5).select(dies("id").alias("id")))
    assert store.load("r", "items").count() == 3
    # a whole version that was never published is not seen either
    spark.range(9).write.parquet(str(tmp_path / "runs/items/run_id=r/version=99999999999999999999-x"))
    assert store.load("r", "items").count() == 3 and store.all_runs("items").count() == 3
    store.save("r", "items", spark.range(4))
    assert store.load("r", "items").count() == 4 and before.count() == 3  # who began with the old one reads on
    store.save("r", "items", spark.range(6))
    store.save("s", "items", spark.range(2))
    assert {r.run_id: r.n for r in store.all_runs("items").groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {"r": 6, "s": 2}
    # two versions, and what the writer left that died
    assert len([p for p in (tmp_path / "runs/items/run_id=r").iterdir() if p.name.startswith("version=0")]) == 3


def test_input_is_kept_as_it_came(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    raw = spark.createDataFrame([(" a ", 1), (None, 2), ("", 3)], "Text string, n int")
    store.save_input("r", raw)
    assert sorted(map(tuple, store.load("r", "input").collect()), key=repr) == sorted(map(tuple, raw.collect()), key=repr)
    assert [r.text for r in normalize_text(raw, "Text").orderBy("n").collect()] == ["a", "", ""]
    (tmp_path / "a.csv").write_text('text,n\n"one\ntwo",1\n,2\nthree,3\n', "utf-8")
    assert [tuple(r) for r in texts_only(spark, str(tmp_path / "a.csv")).orderBy("item_idx").collect()] == [(0, "one\ntwo"), (1, "three")]
