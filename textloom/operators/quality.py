"""Data-quality figures, findings and insights over small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

# Limits above (or, for cleaning, below) which a warning is given.
DUPLICATES, SHORT, CLEANED, CODES = 0.15, 0.30, 0.45, 0.22
WARNINGS = [
    "Many records look duplicated, which can skew theme quality.",
    "Many texts are short after cleaning, so some clusters may be noisy.",
    "Text appears dominated by boilerplate or IDs; cleaning removed a large share of tokens.",
    "Many tokens look like codes/IDs, which may reduce semantic clustering quality.",
]


def quality_figures(items: DataFrame, text_col: str = "text", clean_col: str = "clean") -> DataFrame:
    """One row: n, duplicate_ratio, short_ratio, clean_ratio, code_ratio. Different texts are counted by their hashes, so
    that only hashes are shuffled."""
    low = F.lower(collapse(F.col(text_col)))
    raw = F.col(text_col)
    count = lambda c, p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0))
    rows = items.select(
        F.when(low != "", F.sha2(low, 256)).alias("key"), (F.length(F.trim(F.coalesce(clean_col, F.lit("")))) < 20).cast("int").alias("short"), count(raw, "[A-Za-z0-9]+").alias("raw"), count(F.col(clean_col), "[A-Za-z0-9]+").alias("clean"),
        count(raw, "(?<![A-Za-z0-9])[A-Za-z]*[0-9][A-Za-z0-9]*").alias("codes"),
    )
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("short", "raw", "clean", "codes")])
    filled = F.sum(F.when(F.col("key").isNotNull(), F.col("n")))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), filled.alias("filled"), F.count("key").alias("different"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("short", "raw", "clean", "codes")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return total.select(
        "n", F.when(F.col("filled") > 0, 1 - F.col("different") / F.col("filled")).otherwise(0.0).alias("duplicate_ratio"), ratio(F.col("short"), F.col("n")).alias("short_ratio"),
        F.when(F.col("raw") > 0, F.col("clean") / F.col("raw")).otherwise(1.0).alias("clean_ratio"), ratio(F.col("codes"), F.col("raw")).alias("code_ratio"),
    )


def quality_warnings(figures: DataFrame) -> DataFrame:
    """pos, warning: one row for each limit that is passed."""
    hit = [F.col("duplicate_ratio") >= DUPLICATES, F.col("short_ratio") >= SHORT, F.col("clean_ratio") < CLEANED, F.col("code_ratio") > CODES]
    listed = F.array(*[F.when(h & (F.col("n") > 0), F.struct(F.lit(i).alias("pos"), F.lit(w).alias("warning"))) for i, (h, w) in enumerate(zip(hit, WARNINGS, strict=True))])
    return figures.select(F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("x")).select("x.*")


def metadata_finding(items: DataFrame, metadata: str = "metadata") -> DataFrame:
    """key, value, n, total, finding: the most frequent value of the key that has most values (ties: the first)."""
    rows = items.select(F.explode(metadata).alias("key", "value")).filter("trim(key) <> '' and trim(value) <> ''")
    counts = rows.groupBy(F.trim("key").alias("key"), F.trim("value").alias("value")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"), F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("top"))
    best = totals.orderBy(F.col("total").desc(), F.lower("key")).limit(1)
    text = F.format_string(METADATA_FINDING, "key", "top.value", "top.n", "total", 100.0 * F.col("top.n") / F.col("total"))
    return best.select("key", "top.value", "top.n", "total", text.alias("finding"))


# The sentences of the findings.
METADATA_FINDING = "Most common %s is '%s' (%d/%d, %.0f%%)."
PROCESSED = "Processed {n} records and detected {clusters} main themes."
LARGEST = "Largest theme is '{label}' with {size} records ({share:.0f}%)."
SECOND = "Second largest theme is '{label}' with {size} records."
ASPECTS = "Top reported aspects are: {aspects}."
QUALITY = "Quality note: {warning}"
FILLER = "Themes are stable enough to explore by cluster and representative examples."


def key_findings(n_items: int, clusters: list[tuple[str, int]], aspects: list[str], metadata: str | None, warnings: list[str]) -> list[str]:
    """Three to six sentences on a run. clusters (label, size) by size."""
    out = [PROCESSED.format(n=n_items, clusters=len(clusters))]
    if clusters:
        out.append(LARGEST.format(label=clusters[0][0], size=clusters[0][1], share=100.0 * clusters[0][1] / max(1, n_items)))
    if len(clusters) > 1:
        out.append(SECOND.format(label=clusters[1][0], size=clusters[1][1]))
    if aspects:
        out.append(ASPECTS.format(aspects=", ".join(aspects[:3])))
    out += [metadata] if metadata else []
    out += [QUALITY.format(warning=warnings[0])] if warnings else []
    return [*out, *[FILLER] * (3 - len(out))][:6]
