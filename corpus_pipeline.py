"""The corpus pipeline: stages that each call one of the operators in textloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, clear, table
from textloom.llm.decontaminate import decontaminate
from textloom.llm.line_dedup import drop_recurring_lines
from textloom.llm.minhash_dedup import near_duplicates
from textloom.llm.mixing import mix
from textloom.llm.queries import lang_weight, source_levels
from textloom.llm.toxicity import THRESHOLD, ToxicityModel


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at the threshold or above go.

    Null and empty texts have the score of no terms; rows with a null or repeated doc_id are scored each on their own.
    """
    model = ToxicityModel.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, *docs.columns, score_col="score__").filter(F.col("score__") < THRESHOLD).drop("score__")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first document; so do documents that lose all their lines.

    Passages of 50 tokens and more that fewer than ten documents hold stay in copies of the first document, which the
    next stage looks for. Documents without a line to lose, empty and null texts among them, stay as they are.
    """
    left = drop_recurring_lines(docs, spare_copies=True)
    return left.filter((F.col("n_dropped__") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays (five-word shingles, likeness of 0.8 or more): that of the least
    doc_id, and of several such rows one.

    Rows are told apart by a key of their own, so those that share a doc_id are documents each, and repeated rows are
    copies. A null doc_id is larger than any. Texts without words, null ones among them, are in no group and stay.
    """
    scratch = Scratch(spark, "near")
    rows = scratch.keep(docs.withColumn("row__", F.monotonically_increasing_id()))
    groups = near_duplicates(rows, id_col="row__").filter("n_shingles > 0").select(F.col("doc_id").alias("row__"), "component_id")
    members = groups.join(rows.select("row__", F.col("doc_id").alias("id__")), "row__")
    stays = F.min(F.struct(F.col("id__").isNull().alias("null"), "id__", "row__"))["row__"]
    first = scratch.keep(members.groupBy("component_id").agg(stays.alias("stays"), F.count("*").alias("n")).filter("n > 1"))
    gone = scratch.keep(members.join(first, "component_id").filter("row__ <> stays").select("row__"))
    return rows.join(gone, "row__", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt out by domain, language and source; adds n_tokens, leaf_budget, epochs, in
    the place of columns of these names."""
    found = mix(docs, source_levels(), weights={"lang": lang_weight})
    added = ("n_tokens", "leaf_budget", "epochs")
    return found.drop(*added).withColumnsRenamed({f"{c}__": c for c in added})


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", near_dedup), ("decontamination", drop_benchmark), ("mixing", mix_sources)]

#: SQL can express neither the factorization machine of the first stage nor the grouping of the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each one's result is written and read again by the next. What a stage kept
    besides is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    since = len(Scratch.made)
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        clear(since)
        scratch.drop(docs)
    return docs
