"""The state of a stream of texts against the batch result."""

from pyspark.sql import functions as F

from textloom.operators import aspects as asp
from textloom.streaming import corpus_state, stream_corpus, stream_sentiment

TEXTS = [
    (1, "The app crashes every time I upload a file, and support never replied to my ticket.", "2024-01-01 10:00:00"),
    (2, "Setup was easy and intuitive! The app crashes.", "2024-01-10 10:00:00"),
    (3, "The app crashes and support never replied.", "2024-01-01 11:00:00"),  # comes late
    (4, "Support never replied; the price is too expensive.", "2024-01-10 12:00:00"),
    (5, None, "2024-01-10 12:00:00"),
]


def test_late_texts_stay_out_and_others_add_up(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    for ids in ([1, 2], [3, 4, 5]):
        rows.filter(F.col("doc_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_corpus(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts")
    found = {r.aspect: r for r in corpus_state(spark, str(tmp_path / "out")).collect()}
    batch = asp.aspect_aggregate(asp.granulate(rows.filter("doc_id <> 3").select("doc_id", "text")))
    assert {a: tuple(r) for a, r in found.items()} == {r.aspect: tuple(r) for r in batch.collect()}
    days = corpus_state(spark, str(tmp_path / "out"), by_window=True)
    assert sum(r["count"] for r in found.values()) == days.agg(F.sum("count")).first()[0]
    assert {r.window.start.day for r in days.collect()} == {1, 10}
    # a call with nothing new changes nothing
    stream_corpus(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts")
    assert {r.aspect: tuple(r) for r in corpus_state(spark, str(tmp_path / "out")).collect()} == {a: tuple(r) for a, r in found.items()}


def test_times_without_a_zone_count_as_utc(spark, tmp_path):
    """Tables may hold times without a zone, of which Spark takes no watermark; the session's zone moves none of them."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, ts string").filter("doc_id <> 3").withColumn("ts", F.to_timestamp_ntz("ts") - F.expr("interval 9 hours 30 minutes"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows.coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_corpus(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts")
        days = corpus_state(spark, str(tmp_path / "out"), by_window=True).select(F.unix_seconds("window.start").alias("start")).distinct().collect()
        q = stream_sentiment(stream, "ts", "1 day").writeStream.format("memory").queryName("zoneless").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        scored = spark.sql("select unix_seconds(window.start) as start from zoneless where n_units > 0").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r.start for r in days} == {r.start for r in scored} == {1704067200, 1704844800}  # 2024-01-01 and 2024-01-10 in UTC
    found = corpus_state(spark, str(tmp_path / "out"))
    batch = asp.aspect_aggregate(asp.granulate(rows.select("doc_id", "text")))
    assert {r.aspect: tuple(r) for r in found.collect()} == {r.aspect: tuple(r) for r in batch.collect()}


def test_texts_before_1970_and_without_a_time_are_counted(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, ts string")
    rows = rows.withColumn("ts", F.when(F.col("doc_id") == 1, F.to_timestamp(F.lit("1969-12-31 23:00:00"))).when(F.col("doc_id") == 2, F.to_timestamp("ts")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_corpus(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "ts")
    figures = lambda rows: {r.aspect: tuple(r) for r in rows.collect()}
    batch = lambda rows: figures(asp.aspect_aggregate(asp.granulate(rows.select("doc_id", "text"))))
    assert figures(corpus_state(spark, str(tmp_path / "out"))) == batch(rows)
    windows = corpus_state(spark, str(tmp_path / "out"), by_window=True)
    assert figures(windows.filter("window.start is null").drop("window")) == batch(rows.filter("ts is null"))
    starts = windows.select(F.unix_seconds("window.start").alias("start")).distinct().collect()
    assert {r.start for r in starts} == {None, -86400, 1704844800}  # none, 1969-12-31 and 2024-01-10
