"""Items: texts with an index, an id, a preview and string metadata."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import TEXT_COLUMNS
from ..functions.text import clean_metadata, preview, strip
from ..operators import lineage
from .csv_splits import read_delimited

# Limits of an upload.
MAX_BYTES, MAX_KEYS, KEY_LENGTH, VALUE_LENGTH = 50 * 1024 * 1024, 20, 60, 240


def detect_text_column(columns: list[str]) -> str | None:
    """The first known name in order of priority; of several spellings the lower, Capitalized, UPPER one, then any."""
    for name in TEXT_COLUMNS:
        for spelling in (name, name.capitalize(), name.upper()):
            if spelling in columns:
                return spelling
        for c in columns:
            if c.strip().lower() == name:
                return c
    return None


def check_upload(path: str, size: int) -> None:
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files are accepted")
    if size == 0:
        raise ValueError("the file is empty")
    if size > MAX_BYTES:
        raise ValueError("the file is larger than 50 MB")


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None, delimiter: str = ",") -> DataFrame:
    """Items of an uploaded CSV file with a header and a known text column; see read_items. The limits of an upload hold."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    for r in sizes:
        check_upload(r.path, r.length)
    return read_items(spark, path, max_rows, delimiter)


def read_items(spark: SparkSession, path: str, max_rows: int | None = None, delimiter: str = ",") -> DataFrame:
    """Items of delimited files of any size; all cells are strings, rows with a blank text go.

    UTF-8 (with or without a byte-order mark) is tried first, then Latin-1, which reads anything. Items are in the order
    of the files' names and rows. A file is read in as many tasks as Spark cuts it into, quoted line breaks or not.
    """
    df = read_delimited(spark, path, delimiter)
    columns = [c for c in df.columns if c != "place__"]
    text = detect_text_column(columns)
    if text is None:
        raise ValueError("no text column; one of " + ", ".join(TEXT_COLUMNS) + " is needed")
    return items(df, text, [c for c in columns if c != text], F.col("place__"), max_rows)


def normalize_text(df: DataFrame, column: str) -> DataFrame:
    """The rows with `text`, the column without white space at its ends; blank ones stay, null ones are blank."""
    return df.withColumn("text", strip(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))))


def texts_only(spark: SparkSession, path: str) -> DataFrame:
    """item_idx and text of a CSV file."""
    return read_csv(spark, path).select("item_idx", "text")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """test_number, input_text of a JSON array of evaluation cases; a case without a number has its place from 1. As small
    as a list of test cases, so one task reads it."""
    cases = spark.read.schema("test_number long, input_text string").json(path, multiLine=True)
    place = (F.monotonically_increasing_id() + 1).alias("place")
    text = strip(F.coalesce("input_text", F.lit("")))
    return cases.coalesce(1).select(place, "*").select(F.coalesce("test_number", "place").alias("test_number"), text.alias("input_text")).filter("input_text <> ''")


def items(df: DataFrame, text: str, metadata: list[str], order: Column, max_rows: int | None = None) -> DataFrame:
    """item_idx, id, text, preview, metadata of the rows with text, numbered in the order; the first MAX_KEYS columns of
    metadata are kept. Numbers are dealt by offsets of partitions, not by one task."""
    value = strip(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in metadata[:MAX_KEYS]]), F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in metadata[:MAX_KEYS]])) if metadata else F.create_map().cast("map<string,string>")
    rows = df.select(order.alias("order__"), value.alias("text"), clean_metadata(pairs, KEY_LENGTH, VALUE_LENGTH).alias("metadata")).filter("text <> ''")
    if max_rows is not None:
        rows = rows.orderBy("order__").limit(max_rows)
    numbered = number_rows(rows, "order__")
    return numbered.select("item_idx", F.concat(F.lit("item_"), F.col("item_idx").cast("string")).alias("id"), "text", preview(F.col("text")).alias("preview"), "metadata")


def number_rows(rows: DataFrame, order: str) -> DataFrame:
    """Adds item_idx from 0 in the order: rows are sorted by ranges, and each range starts after those before it."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("part__", F.spark_partition_id()).withColumn("place__", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = lineage.cut(ranged)
    counts = sorted((r.part__, r.n) for r in ranged.groupBy("part__").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "part__ int, start__ long")
    return ranged.join(F.broadcast(offsets), "part__").withColumn("item_idx", F.col("start__") + F.col("place__")).drop("part__", "place__", "start__", order)


def single_text(spark: SparkSession, text: str) -> DataFrame:
    if not (text or "").strip():
        raise ValueError("text is required")
    return items(spark.createDataFrame([(0, text)], "n long, text string"), "text", [], F.col("n"))


def parse_options(raw: str | None) -> dict:
    """Options of a JSON object; empty without one."""
    if not raw or not raw.strip():
        return {}
    found = json.loads(raw)
    if not isinstance(found, dict):
        raise ValueError("options must be a JSON object")
    return found
