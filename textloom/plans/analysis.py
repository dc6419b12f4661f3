"""The corpus analysis: items to clusters, labels, map, aspects and insights."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_or_source, preview
from ..operators import aspects as asp
from ..operators import cluster as cl
from ..operators import labels as lb
from ..operators import quality as ql
from ..operators import tfidf as tf
from ..operators.vectors import embed, project_2d
from ..sources.runs import RunStore


@dataclass
class Options:
    """Options with their ranges; values outside are brought to the nearest end, wrong types to the default. The two of
    the neighbour map are read and kept, but the map here has no use for them."""

    k_clusters: int = 8
    umap_n_neighbors: int = 15
    umap_min_dist: float = 0.1
    umap_scale_points: bool = True
    umap_scale_clamp: float = 3.0
    granulate: bool = True
    granulate_max_rows: int = 200
    granulate_per_cluster: bool = False
    granulate_per_cluster_max_rows: int = 80
    granulate_return_items: bool = False
    label_internal_nodes: bool = True
    llm_label_budget: int = 120
    preview_char_limit: int = 320
    insights_theme_count: int = 5

    # Fixed values.
    RANGES: ClassVar = {
        "k_clusters": (2, 64),
        "umap_n_neighbors": (2, 100),
        "umap_min_dist": (0.0, 0.99),
        "umap_scale_clamp": (1.5, 6.0),
        "granulate_max_rows": (1, 2000),
        "granulate_per_cluster_max_rows": (1, 300),
        "llm_label_budget": (0, 10000),
        "preview_char_limit": (120, 1200),
        "insights_theme_count": (3, 8),
    }

    @classmethod
    def parse(cls, given: dict) -> Options:
        out = cls()
        for f in fields(cls):
            value, default = given.get(f.name), getattr(out, f.name)
            if isinstance(default, bool):
                low = str(value).strip().lower()
                value = value if isinstance(value, bool) else True if low in ("1", "true", "yes", "on") else False if low in ("0", "false", "no", "off") else default
            else:
                try:
                    value = default if value is None or isinstance(value, bool) else type(default)(value)
                except (TypeError, ValueError):
                    value = default
                low, high = cls.RANGES[f.name]
                value = max(low, min(high, value))
            setattr(out, f.name, value)
        return out


@dataclass
class Analysis:
    """Results of a run, as DataFrames."""

    items: DataFrame
    embeddings: DataFrame
    assignments: DataFrame
    clusters: DataFrame
    map: DataFrame
    nodes: DataFrame
    granules: DataFrame | None
    aspects: DataFrame | None
    aspects_per_cluster: DataFrame | None
    warnings: DataFrame
    overview: DataFrame
    insights: DataFrame
    timings: DataFrame


def analyze(items: DataFrame, options: Options | None = None, encoder: Callable | None = None, labeller: Callable | None = None, cache: dict[str, str] | None = None, store: RunStore | None = None, run_id: str | None = None) -> Analysis:
    """items: item_idx, id, text, preview, metadata. Only bounded things come to the driver: vectors of up to 2000 items
    for exact linkage, one row per cluster, and the figures of the findings. A stage's seconds count what it evaluates."""
    options, run_id = options or Options(), run_id or uuid.uuid4().hex
    spark = items.sparkSession
    if cache is None:
        cache = store.label_cache(run_id) if store else {}
    seconds: list[tuple[str, float]] = []
    started = time.monotonic()

    def at(stage: str, pct: int) -> None:
        seconds.append((stage, time.monotonic()))
        if store:
            store.set_status(run_id, "processing", stage, pct)

    try:
        base = items.withColumn("preview", preview(F.col("text"), options.preview_char_limit)).withColumn("clean", clean_or_source(F.col("text"))).persist()
        n = base.count()
        at("embeddings", 10)
        vectors = embed(base, "item_idx", "clean", encoder=encoder).persist()
        at("hierarchy", 30)
        assigned, nodes = cl.hierarchy(vectors, "item_idx", "embedding", options.k_clusters)
        assigned = assigned.persist()
        at("clusters", 50)
        clustered = base.join(assigned, "item_idx")
        terms = _cluster_terms(clustered, n)
        near = cl.centroid_distance(vectors.join(assigned, "item_idx"), "item_idx", "cluster", "embedding")
        reps = cl.representatives(clustered.join(near.drop("cluster"), "item_idx"), "item_idx", "cluster", "distance", F.col("clean"))
        table = cl.cluster_sizes(assigned, "cluster").join(terms, "cluster", "left").join(reps, "cluster", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
        table = table.withColumn("label", lb.label_from_terms(F.col("terms"))).withColumn("candidates", lb.candidate_labels(F.col("terms")))
        rows = [r.asDict() for r in table.orderBy("cluster").collect()]
        for r in rows:
            r["fallback"] = r["label"]
            others = [t for o in rows if o["cluster"] != r["cluster"] for t in o["terms"]]
            r["sibling_negative_keywords"] = [t for t in dict.fromkeys(others) if t not in r["terms"]][:6]
        names = lb.label_rows(spark, rows, labeller, cache, options.llm_label_budget)
        given = spark.createDataFrame([(r["cluster"], name, r["sibling_negative_keywords"]) for r, name in zip(rows, names, strict=True)], "cluster int, given string, sibling_negative_keywords array<string>")
        clusters = table.drop("label").join(F.broadcast(given), "cluster").withColumn("label", lb.refine_label(F.col("given"), F.col("terms"))).select("cluster", "label", "size", F.col("terms").alias("top_terms"), "representatives", "sibling_negative_keywords").persist()
        at("umap", 65)
        points = project_2d(vectors, "item_idx", "embedding")
        if options.umap_scale_points:
            points = cl.scale_points(points, ["x", "y"], options.umap_scale_clamp)
        labels = clusters.select("cluster", F.col("label").alias("cluster_label"))
        points = points.join(assigned, "item_idx").join(F.broadcast(labels), "cluster")
        at("labeling", 75)
        members = cl.node_members(nodes, "item_idx").persist()
        dominant = cl.dominant_cluster(members.join(assigned, "item_idx"), "node_id", "cluster").withColumnsRenamed({"cluster": "dominant_cluster_id", "share": "dominant_cluster_share"})
        summary = tf.summary_terms(members.join(base.select("item_idx", "clean"), "item_idx"), "node_id", "clean").select("node_id", F.array_join("terms", ", ").alias("summary"))
        counts = members.groupBy("node_id").agg(F.count("*").alias("descendant_leaf_count"))
        tree = nodes.join(counts, "node_id", "left").join(dominant, "node_id", "left").join(summary, "node_id", "left")
        if options.label_internal_nodes:
            tree = tree.join(lb.label_nodes(nodes, members, base, "item_idx", "clean", labeller, cache, min(lb.NODE_CALLS, options.llm_label_budget)), "node_id", "left")
        tree = tree.persist()
        at("granulate", 90)
        granules = aspects = per_cluster = None
        if options.granulate:
            sampled = spark.createDataFrame([(i,) for i in cl.sample_keys(n, options.granulate_max_rows)], "item_idx long")
            granules = asp.granulate(base.join(F.broadcast(sampled), "item_idx", "left_semi").select("item_idx", "text"), key="item_idx").persist()
            aspects = asp.aspect_aggregate(granules, key="item_idx")
        if options.granulate and options.granulate_per_cluster:
            nth = F.row_number().over(tf.Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(42), "item_idx")))
            some = clustered.select("item_idx", "text", "cluster").withColumn("nth", nth).filter(F.col("nth") <= options.granulate_per_cluster_max_rows)
            found = asp.granulate(some.select("item_idx", "text"), key="item_idx").join(assigned, "item_idx").persist()
            per_cluster = asp.aspect_aggregate(found, ["cluster"], "item_idx")
        at("insights", 98)
        warnings = ql.quality_warnings(ql.quality_figures(base))
        by_size = [(r.label, r["size"]) for r in clusters.orderBy(F.col("size").desc(), "cluster").collect()]
        best = [r.aspect for r in aspects.orderBy(F.col("count").desc(), "first_seen").limit(8).collect()] if aspects is not None else []
        finding = ql.metadata_finding(base).first()
        said = ql.key_findings(n, by_size, best, finding.finding if finding else None, [r.warning for r in warnings.orderBy("pos").collect()])
        insights = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "pos int, finding string")
        themes = [x for x, _ in by_size[: options.insights_theme_count]]
        overview = spark.createDataFrame([(n, len(by_size), len(best), themes, best)], "items long, clusters int, aspects int, top_clusters array<string>, top_aspects array<string>")
        ends = [*(t for _, t in seconds[1:]), time.monotonic()]
        timings = spark.createDataFrame([*((stage, round(end - begin, 3)) for (stage, begin), end in zip(seconds, ends, strict=True)), ("total", round(ends[-1] - started, 3))], "stage string, seconds double")
        out = Analysis(base.drop("clean"), vectors, assigned, clusters, points, tree, granules, aspects, per_cluster, warnings, overview, insights, timings)
        if store:
            names = ["items", "embeddings", "clusters", "map", "nodes", "aspects", "aspects_per_cluster", "overview", "insights", "timings", *(["granules"] if options.granulate_return_items else [])]
            for name in names:
                if getattr(out, name) is not None:
                    store.save(run_id, name, getattr(out, name))
            store.save_label_cache(run_id, cache)
            store.set_status(run_id, "completed", "completed", 100)
        return out
    except Exception as e:
        if store:
            store.set_status(run_id, "failed", "failed", 100, "The analysis failed.", repr(e)[:2000])
        raise


def _cluster_terms(clustered: DataFrame, n: int) -> DataFrame:
    """cluster, terms: the best TF-IDF terms; where a cluster has none, its most frequent informative ones."""
    from ..functions import lexicon as lx
    from ..functions.text import long_words, ngrams

    words = F.filter(long_words(F.col("clean")), lambda w: ~w.isin(lx.LABEL_STOP_WORDS))
    freq = tf.term_frequencies(clustered, ngrams(words, 1, 3), "item_idx")
    weights = tf.tfidf(freq, n, "item_idx", min_df=2 if n >= 10 else 1, max_features=12_000)
    best = tf.top_terms(tf.mean_weights(weights, clustered.select("item_idx", "cluster"), "cluster", "item_idx"), "cluster")
    other = tf.rank_terms(tf.weighted_terms(clustered, "cluster", "clean"), "cluster")
    gather = lambda df, name: df.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias(name))
    both = gather(best, "a").join(gather(other, "b"), "cluster", "full")
    return both.select("cluster", F.coalesce("a", "b").alias("terms"))
