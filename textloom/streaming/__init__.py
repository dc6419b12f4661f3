"""Aspect analysis of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..functions.sentiment import normalized_score, raw_sentiment, sentiment_label
from ..operators.aspects import aspect_aggregate, aspect_figures, granulate
from ..operators.units import explode_units


def instants(texts: DataFrame, time_col: str) -> DataFrame:
    """Spark takes watermarks of instants only: times without a zone are read as UTC, whatever the session's zone is, so
    that none falls into a gap or an overlap of its clock changes."""
    if isinstance(texts.schema[time_col].dataType, TimestampNTZType):
        return texts.withColumn(time_col, F.concat(F.col(time_col).cast("string"), F.lit("Z")).cast("timestamp"))
    return texts


def stream_sentiment(texts: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Units, mean sentiment score and votes for each window of event time; stateless up to the windowed sums."""
    units = explode_units(instants(texts, time_col).withWatermark(time_col, late), text_col)
    scored = units.withColumn("score", normalized_score(raw_sentiment(F.col("norm"), F.col("tokens")))).withColumn("sentiment", sentiment_label(F.col("score")))
    by = scored.groupBy(F.window(time_col, window).alias("window"))
    vote = lambda s: F.sum((F.col("sentiment") == s).cast("long")).alias(s)
    return by.agg(F.count("*").alias("n_units"), F.avg("score").alias("avg_score"), vote("positive"), vote("negative"), vote("neutral"))


def stream_aspects(texts: DataFrame, out: str, checkpoint: str, taxonomy: dict | None = None, key: str = "doc_id", text_col: str = "text"):
    """Starts a query that appends each micro-batch's granules and aspect sums below `out`."""

    def each(batch: DataFrame, number: int) -> None:
        granules = granulate(batch, taxonomy, key=key, text_col=text_col).persist()
        granules.write.mode("overwrite").parquet(f"{out}/granules/batch={number}")
        aspect_aggregate(granules, key=key).drop("first_seen").write.mode("overwrite").parquet(f"{out}/aspects/batch={number}")
        granules.unpersist()

    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_corpus(texts: DataFrame, out: str, checkpoint: str, time_col: str, window: str = "1 day", late: str = "1 day", taxonomy: dict | None = None, key: str = "doc_id", text_col: str = "text") -> None:
    """Takes what has come of a stream of texts into the corpus' state below `out`, and ends; to be called again for more.

    Each micro-batch's granules are written first, those of equal texts in a window once, with the number of texts (copies),
    the least of their keys and the last of their times. A second stream over them keeps counts, votes, sums and evidence for
    each window of event time, aspect and evidence term as Spark's keyed state, so that one document more changes a few
    keys and no batch is read again; what changes is written under the batch's number, so a repeated batch changes
    nothing. A term's rows are summed before they are dealt out, so an aspect that all texts share is no hot key. Rows
    that come more than `late` after the newest time seen, and whose window is closed, are left out: that is decided by
    window, so equal texts of a window share it. Spark's watermark starts at 1970, so rows before that, and rows without a
    time, which are in no window, have a state of their own in which none is late.
    """
    spark, start = texts.sparkSession, F.timestamp_seconds(F.lit(0))

    def granules(batch: DataFrame, number: int) -> None:
        timed = instants(batch.select(key, F.col(text_col).alias("text"), time_col), time_col).filter("text is not null")
        # rows on either side of 1970 and those without a time stay apart
        timed = timed.withColumn("side__", F.col(time_col) >= start).withColumn("window__", F.window(F.coalesce(time_col, start), window))
        first = timed.groupBy("text", "side__", "window__").agg(F.min(key).alias(key), F.count("*").alias("copies"), F.max(time_col).alias(time_col)).persist()
        found = granulate(first.select(key, "text"), taxonomy, key=key)
        found.join(first.select(key, time_col, "copies"), key).select(key, time_col, "copies", *GRANULE).write.mode("overwrite").parquet(f"{out}/granules/batch={number}")
        first.unpersist()

    def keep(rows: DataFrame, name: str, by: Column) -> None:
        def changed(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

        rows = rows.filter("aspect <> 'OTHER'").withColumn("entry", F.explode(F.concat(none, terms))).select("*", "entry.at", "entry.term")
        sums = rows.groupBy(by, "aspect", "term").agg(
            F.sum("copies").alias("count"), total("sentiment_score").alias("score"), total("sentiment_raw").alias("raw"), vote("positive"), vote("negative"), vote("neutral"), F.min(F.struct(key, "unit_pos", "at")).alias("seen"),
        )
        sums.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()

    texts.writeStream.foreachBatch(granules).option("checkpointLocation", f"{checkpoint}/granules").trigger(availableNow=True).start().awaitTermination()
    schema = spark.read.parquet(f"{out}/granules").schema
    rows = instants(spark.readStream.schema(schema).parquet(f"{out}/granules"), time_col)
    none = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("term")))
    terms = F.transform("evidence", lambda t, i: F.struct(i.cast("int").alias("at"), t.alias("term")))
    total = lambda c: F.sum(F.col(c) * F.col("copies"))
    vote = lambda s: F.sum((F.col("sentiment") == s).cast("long") * F.col("copies")).alias(f"{s}_count")
    time = F.col(time_col)
    keep(rows.filter(time >= start).withWatermark(time_col, late), "state", F.window(time_col, window).alias("window"))
    no_window = F.struct(*[F.lit(None).cast("timestamp").alias(c) for c in ("start", "end")])
    early = rows.filter(time.isNull() | (time < start)).withColumn("window", F.window(F.coalesce(time, start), window))
    keep(early, "never_late", F.when(time.isNull(), no_window).otherwise(F.col("window")).alias("window"))


#: What the state needs of a granule.
GRANULE = ["unit_pos", "aspect", "evidence", "sentiment", "sentiment_score", "sentiment_raw"]


def corpus_state(spark: SparkSession, out: str, by_window: bool = False, n: int = 3) -> DataFrame:
    """The aspects of all texts taken in so far (for each window, if asked for), in the columns of `aspect_aggregate`.
    Of each key the state of its last batch counts. Texts without a time have a window with neither start nor end."""
    rows = spark.read.parquet(f"{out}/state").unionByName(spark.read.parquet(f"{out}/never_late"))
    values = [c for c in rows.columns if c not in ("window", "aspect", "term", "batch")]
    last = rows.groupBy("window", "aspect", "term").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("window", "aspect", "term", "v.*")
    groups = ["window", "aspect"] if by_window else ["aspect"]
    first = [F.col("seen")[f].alias(f) for f in last.schema["seen"].dataType.names[:2]]
    total = [F.sum(c).alias(c) for c in values if c != "seen"]
    sums = last.filter("term is null").groupBy(*groups).agg(*total, F.min(F.struct(*first)).alias("first_seen"))
    terms = last.filter("term is not null").groupBy(*groups, "term").agg(F.sum("count").alias("f"), F.min("seen").alias("seen"))
    best = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("f").desc(), "seen"))
    top = terms.withColumn("nth", best).filter(F.col("nth") <= n).groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("top_evidence"))
    return aspect_figures(sums.withColumns({"score": F.col("score") / F.col("count"), "raw": F.col("raw") / F.col("count")}), top, groups)
