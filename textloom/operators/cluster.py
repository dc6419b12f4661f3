"""Clusters of vectors: sizes, centroids, assignment, k-means, hierarchies and node tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage

#: The largest table that is linked exactly, on the driver; larger ones are first brought to so many k-means centres.
EXACT_ITEMS, CENTRES = 2000, 64
#: Items of a sample for each of the first centres.
SAMPLE = 20
#: The largest table whose silhouettes are of plain distances.
PLAIN_ITEMS = 20_000
#: The most centres that are sent to all executors.
MOST_CENTRES = 10_000


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def cluster_sizes(items: DataFrame, cluster: str) -> DataFrame:
    return items.groupBy(cluster).agg(F.count("*").alias("size"))


def centroids(items: DataFrame, cluster: str, vector: str) -> DataFrame:
    """cluster, centroid: means by place; nothing but sums is shuffled."""
    rows = items.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rows.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def centroid_distance(items: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """key, cluster, distance of each item to its cluster's centroid."""
    return items.join(centroids(items, cluster, vector), cluster).select(key, cluster, distance(F.col(vector), F.col("centroid")).alias("distance"))


def nearest_centroid(items: DataFrame, centres: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """key, cluster, distance, margin (to the second nearest; 0 with one centre). centres is one row per cluster, gathered
    to one array, so that each item looks at it without a join of all pairs; more than MOST_CENTRES are an error."""
    if centres.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    all_ = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct(cluster, "centroid"))).alias("centres")))
    near = F.array_sort(F.transform("centres", lambda c: F.struct(distance(F.col(vector), c["centroid"]).alias("distance"), c[cluster].alias("cluster"))))
    found = items.crossJoin(all_).select(key, F.slice(near, 1, 2).alias("near"))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    return found.select(key, first["cluster"].alias(cluster), first["distance"].alias("distance"), F.coalesce(second["distance"] - first["distance"], F.lit(0.0)).alias("margin"))


def kmeans(items: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """key, cluster of each item."""
    rows = items.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def minibatch_kmeans(items: DataFrame, key: str, vector: str, k: int, batches: int = 20, seed: int = 42) -> DataFrame:
    """key, cluster of each item, by centres that one pass over the items has moved.

    Items are dealt into batches by a hash of key and seed and written so, and each batch is read once. The first centres
    are those of a sample of SAMPLE * k items of the first batch, on the driver. Of each later batch Spark sums the items
    nearest to a centre, which moves to the mean of all that it has seen. A last pass assigns the items.
    """
    spark = items.sparkSession
    path = lineage.scratch(spark, "batches")
    rows = items.select(key, F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)).cast("int").alias("batch"))
    rows.repartition("batch").write.partitionBy("batch").parquet(path)
    lineage.MADE.append(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    least = rows.agg(F.min("batch")).first()[0]
    if least is None:
        return items.select(key, F.lit(None).cast("int").alias("cluster"))
    sample = rows.filter(F.col("batch") == least).orderBy(F.xxhash64(F.lit(seed + 1), key), key).limit(SAMPLE * k).select("v").collect()
    centres = _first_centres(np.array([r.v for r in sample]), k, np.random.default_rng(seed))
    seen = np.zeros(len(centres))
    for batch in range(least, batches):
        sums = rows.filter(F.col("batch") == batch).select("v").mapInPandas(_near_sums(centres), "centre int, n long, total array<double>")
        found = sums.groupBy("centre").applyInPandas(lambda p: pd.DataFrame({"centre": p.centre[:1], "n": [p.n.sum()], "total": [np.stack(p.total.to_numpy()).sum(axis=0)]}), "centre int, n long, total array<double>")
        for r in found.orderBy("centre").collect():
            seen[r.centre] += r.n
            centres[r.centre] += (np.array(r.total) - r.n * centres[r.centre]) / seen[r.centre]
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centroid array<double>")
    return nearest_centroid(items, table, key, "cluster", vector).select(key, "cluster")


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Far points by turns (each with the chance of its squared distance), then a few rounds of k-means."""
    centres = [sample[rng.integers(len(sample))]]
    far = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.sum() > 0:
        centres.append(sample[rng.choice(len(sample), p=far / far.sum())])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
    found = np.array(centres, float)
    for _ in range(10):
        near = ((found**2).sum(axis=1)[None] - 2 * sample @ found.T).argmin(axis=1)
        for i in np.unique(near):
            found[i] = sample[near == i].mean(axis=0)
    return found


def _near_sums(centres: np.ndarray):
    def run(batches):
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for pdf in batches:
            v = np.stack(pdf.v.to_numpy()) if len(pdf) else np.empty((0, centres.shape[1]))
            near = ((centres**2).sum(axis=1)[None] - 2 * v @ centres.T).argmin(axis=1)
            n += np.bincount(near, minlength=len(centres))
            np.add.at(total, near, v)
        held = np.flatnonzero(n)
        yield pd.DataFrame({"centre": held.astype(np.int32), "n": n[held], "total": list(total[held])})

    return run


def silhouettes(items: DataFrame, key: str, cluster: str, vector: str, block: int = 1000) -> DataFrame:
    """key, cluster, silhouette of each item by plain Euclidean distances: (b - a) / max(a, b), where a is the mean
    distance to the others of its cluster and b the least mean distance to those of another one; 0 for an item that is
    alone in its cluster, and where there is one cluster only.

    Items are dealt out in blocks of some `block` rows, each pair of blocks is one task's work, and of its distances only
    the sums for each item and cluster go on. The work grows with the square of the items.
    """
    n = items.count()
    parts = max(1, -(-n // block))
    kind = dict(items.dtypes)
    rows = items.select(key, F.col(cluster).alias("cluster__"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = [pdf[pdf.own == pdf.x], pdf[pdf.own == pdf.y]]
        both = [np.stack(p.v.to_numpy()) if len(p) else np.empty((0, 0)) for p in sides]
        for mine, theirs in ((0, 1), (1, 0)) if pdf.x.iloc[0] != pdf.y.iloc[0] else ((0, 0),):
            a, b, names = both[mine], both[theirs], sides[theirs].cluster__.to_numpy()
            if not len(a) or not len(b):
                continue
            codes, clusters = pd.factorize(names)
            member = np.eye(len(clusters))[codes]
            for lo in range(0, len(a), 500):
                part = a[lo : lo + 500]
                far = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * part @ b.T))
                if mine == theirs:
                    far[np.arange(len(part)), lo + np.arange(len(part))] = 0
                total = far @ member
                out.append(pd.DataFrame({key: np.repeat(sides[mine][key].to_numpy()[lo : lo + 500], len(clusters)), "other": np.tile(np.asarray(clusters), len(part)), "total": total.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({key: [], "other": [], "total": []})

    pairs = rows.groupBy("x", "y").applyInPandas(sums, f"{key} {kind[key]}, other {kind[cluster]}, total double")
    total = pairs.groupBy(key, "other").agg(F.sum("total").alias("total"))
    sizes = items.groupBy(F.col(cluster).alias("other")).agg(F.count("*").alias("size"))
    total = total.join(sizes, "other").join(items.select(key, F.col(cluster).alias("cluster__")), key)
    own = F.col("other") == F.col("cluster__")
    found = total.groupBy(key, "cluster__").agg(F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return found.select(key, F.col("cluster__").alias(cluster), score.alias("silhouette"))


def choose_k(items: DataFrame, vector: str, low: int = 2, high: int = 12, seed: int = 42) -> tuple[int, float]:
    """The number of clusters with the best mean silhouette; the least one of equal ones. Distances are plain ones up to
    PLAIN_ITEMS items; beyond, squared ones, whose work grows with the items only."""
    rows = lineage.cut(items.select(F.monotonically_increasing_id().alias("row"), F.col(vector).cast("array<double>").alias("v"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    n = rows.count()
    best = (low, -1.0)
    for k in range(low, min(high, n - 1) + 1):
        found = KMeans(k=k, seed=seed).fit(rows).transform(rows)
        if found.select("prediction").distinct().count() < 2:
            continue
        score = silhouettes(found, "row", "prediction", "v").agg(F.avg("silhouette")).first()[0] if n <= PLAIN_ITEMS else ClusteringEvaluator().evaluate(found)
        best = (k, score) if score > best[1] else best
    return best


def renumber(items: DataFrame, cluster: str, order: str) -> DataFrame:
    """Clusters numbered from 0 by their first item in the order."""
    first = items.groupBy(cluster).agg(F.min(order).alias("first__"))
    first = first.withColumn("number__", F.count("*").over(Window.orderBy("first__").rowsBetween(Window.unboundedPreceding, -1)).cast("int"))
    return items.join(first, cluster).drop(cluster, "first__").withColumnRenamed("number__", cluster)


def ward(vectors: np.ndarray) -> np.ndarray:
    """Ward linkage (left, right, height, size) of up to EXACT_ITEMS points, closest pair first.

    A chain of nearest neighbours is followed until two points are each other's nearest, which can be merged at once, as
    no later merge brings anything nearer; so a merge costs one row of distances, not all of them. Merges are then put
    in the order of their heights (ties: the order in which the chain, begun at the lowest number, found them).
    """
    n = len(vectors)
    squares = (vectors**2).sum(1)
    d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2) if n * n * vectors.shape[1] < 5_000_000 else np.maximum(0, squares[:, None] + squares[None, :] - 2 * vectors @ vectors.T)
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        x = chain[-1]
        y = int(np.argmin(d[x]))
        if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
            y = chain[-2]
        if len(chain) < 2 or y != chain[-2]:
            chain.append(y)
            continue
        del chain[-2:]
        i, j = min(x, y), max(x, y)
        height2 = d[i, j]
        row = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * height2) / (size + size[i] + size[j])
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        merges.append((height2, i, j))
        size[i] += size[j]
        alive[j] = False
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
    out = np.empty((max(0, n - 1), 4))
    name, count = list(range(n)), [1] * n
    for step, (height2, i, j) in enumerate(sorted(merges, key=lambda m: m[0])):
        a, b = sorted((name[i], name[j]))
        out[step] = a, b, np.sqrt(height2), count[i] + count[j]
        name[i], count[i] = n + step, count[i] + count[j]
    return out


def cut(links: np.ndarray, n: int, k: int) -> list[int]:
    """Clusters (numbered by first item) after all but the last k - 1 merges."""
    parent = {int(x): n + i for i, row in enumerate(links[: max(0, n - k)]) for x in row[:2]}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen)) for i in range(n)]


def hierarchy(items: DataFrame, key: str, vector: str, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(key, cluster) of each item, and nodes (node_id, parent_id, child_pos, height, cohesion, key of a leaf).

    Up to EXACT_ITEMS items are linked by Ward's method on the driver. Of larger tables mini-batch k-means finds centres in Spark,
    the centres are linked, and each centre's items are its children. Cohesion is 1 - height / greatest height.
    """
    spark = items.sparkSession
    rows = items.select(key, F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    node = f"node_id string, parent_id string, child_pos int, height double, cohesion double, {key} {dict(items.dtypes)[key]}"
    if n <= EXACT_ITEMS:
        got = sorted(rows.collect(), key=lambda r: r[0])
        names, points, leaves = [f"leaf_{i}" for i in range(n)], np.array([r.v for r in got]), [r[0] for r in got]
    else:
        found = lineage.cut(minibatch_kmeans(items, key, vector, min(CENTRES, n)).withColumnRenamed("cluster", "centre"))
        centres = sorted(centroids(items.join(found, key), "centre", vector).collect(), key=lambda r: r.centre)
        names, points, leaves = [f"centre_{r.centre}" for r in centres], np.array([r.centroid for r in centres]), None
    m = len(names)
    links = ward(points) if m > 1 else np.empty((0, 4))
    ids = [*names, *(f"node_{m + i}" for i in range(m - 1))]
    heights = [0.0] * m + [float(x) for x in links[:, 2]]
    top = max([*heights, 0.0])
    up = {int(c): (m + i, pos) for i, row in enumerate(links) for pos, c in enumerate(row[:2])}
    table = [(ids[i], ids[up[i][0]] if i in up else None, up[i][1] if i in up else None, heights[i], round(min(1.0, max(0.0, 1 - heights[i] / top)), 4) if top > 0 else 1.0, leaves[i] if leaves and i < m else None) for i in range(len(ids))]
    nodes = spark.createDataFrame(table, node)
    numbers = cut(links, m, max(1, min(k, m)))
    if leaves:
        return spark.createDataFrame(list(zip(leaves, numbers, strict=True)), f"{key} {dict(items.dtypes)[key]}, cluster int"), nodes
    if n == 0:
        return spark.createDataFrame([], f"{key} {dict(items.dtypes)[key]}, cluster int"), nodes
    mapped = spark.createDataFrame([(int(x.split("_")[1]), c) for x, c in zip(names, numbers, strict=True)], "centre int, cluster int")
    own = found.select(F.concat(F.lit("leaf_"), F.col(key).cast("string")).alias("node_id"), F.concat(F.lit("centre_"), F.col("centre").cast("string")).alias("parent_id"), F.lit(None).cast("int").alias("child_pos"), F.lit(0.0).alias("height"), F.lit(1.0).alias("cohesion"), key)
    return found.join(F.broadcast(mapped), "centre").select(key, "cluster"), nodes.unionByName(own)


def node_members(nodes: DataFrame, key: str) -> DataFrame:
    """node_id, key: the leaves below each node (a leaf is its own). A ValueError if the edges hold a cycle.

    Each round joins the ways up to themselves, so a chain of any depth takes as many rounds as its depth has binary
    digits; each round's table is written, so none is worked out twice.
    """
    edges = lineage.cut(nodes.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("steps")))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, reach = edges, 1
    most = edges.count()
    while not edges.isEmpty():
        # ways of exactly `reach` steps prolong all ways of up to `reach` steps
        on = edges.select(F.col("node_id").alias("mid"), F.col("up").alias("top"))
        longer = pairs.join(on, pairs.up == on.mid).select("node_id", F.col("top").alias("up"), (F.col("steps") + reach).alias("steps"))
        pairs = lineage.cut(pairs.union(longer).coalesce(parts))
        edges = pairs.filter(F.col("steps") == 2 * reach)
        reach *= 2
        if reach > 2 * most:
            raise ValueError("the hierarchy has a cycle")
    leaves = nodes.filter(F.col(key).isNotNull()).select("node_id", key)
    return leaves.union(leaves.join(pairs, "node_id").select(F.col("up").alias("node_id"), key))


def dominant_cluster(members: DataFrame, group: str, cluster: str) -> DataFrame:
    """group, cluster, share: the most frequent cluster (ties: the lowest) and its share of the group."""
    counts = members.groupBy(group, cluster).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(cluster), F.struct(-F.col("n"), F.col(cluster)))
    return counts.groupBy(group).agg(best.alias(cluster), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


def representatives(items: DataFrame, key: str, cluster: str, distance_col: str, text: Column, n: int = 5, likeness: float = 0.82, keep: int = 200, fill: bool = True) -> DataFrame:
    """cluster, representatives (keys): the items nearest to the centroid whose words are not too like those chosen
    before, then (unless fill is off) the nearest others up to min(n, size).

    The choice runs over the `keep` nearest of each cluster. Clusters that find less than n there, and have more items,
    choose the others one after another from all of theirs; what fills up is always among the nearest.
    """
    from ..functions.text import jaccard, word_set

    place = F.struct(F.col(distance_col).alias("distance"), F.col(key).alias("key"))
    rows = lineage.cut(items.select(cluster, place.alias("place"), word_set(text).alias("words")))
    near = rows.withColumn("nth", F.row_number().over(Window.partitionBy(cluster).orderBy("place"))).filter(F.col("nth") <= keep)
    listed = near.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("all"))
    unlike = lambda chosen, words: ~F.exists(chosen, lambda y: jaccard(words, y["words"]) >= likeness)
    none = F.filter("all", lambda x: F.lit(False))
    chosen = F.aggregate("all", none, lambda done, x: F.when((F.size(done) < n) & unlike(done, x["words"]), F.concat(done, F.array(x))).otherwise(done))
    out = lineage.cut(listed.withColumn("chosen", chosen))
    open_ = lineage.cut(out.filter((F.size("all") >= keep) & (F.size("chosen") < n)).select(cluster, "chosen"))
    found = open_
    for _ in range(n - 1):
        if open_.isEmpty():
            break
        rest = rows.join(open_, cluster).filter(unlike(F.col("chosen"), F.col("words")))
        nxt = rest.groupBy(cluster).agg(F.min(F.struct("place", "words")).alias("next"))
        open_ = lineage.cut(open_.join(nxt, cluster).filter(F.size("chosen") < n).select(cluster, F.concat("chosen", F.array("next")).alias("chosen")))
        found = lineage.cut(open_.unionByName(found.join(open_.select(cluster), cluster, "left_anti")))
    out = out.join(found.select(cluster, F.col("chosen").alias("more")), cluster, "left").withColumn("chosen", F.coalesce("more", "chosen"))
    if not fill:
        return out.select(cluster, F.transform("chosen", lambda x: x["place"]["key"]).alias("representatives"))
    rest = F.filter("all", lambda x: ~F.exists("chosen", lambda y: y["place"]["key"] == x["place"]["key"]))
    return out.select(cluster, F.transform(F.slice(F.concat("chosen", rest), 1, n), lambda x: x["place"]["key"]).alias("representatives"))


def scale_points(points: DataFrame, columns: list[str], clamp: float = 3.0) -> DataFrame:
    """Adds {column}_scaled: standard scores, cut at ±clamp; a spread below 1e-6 counts as 1."""
    stats = points.agg(*[f(c).alias(f"{n}__{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    out = points.crossJoin(F.broadcast(stats))
    for c in columns:
        std = F.when(F.col(f"std__{c}") < 1e-6, 1.0).otherwise(F.col(f"std__{c}"))
        out = out.withColumn(f"{c}_scaled", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), (F.col(c) - F.col(f"mean__{c}")) / std)))
    return out.select(*points.columns, *[f"{c}_scaled" for c in columns])


def sample_keys(n: int, most: int, seed: int = 42) -> list[int]:
    """Places of a sample without replacement, sorted; all of them if there are no more than `most`."""
    import random

    return list(range(n)) if n <= most else sorted(random.Random(seed).sample(range(n), most))
