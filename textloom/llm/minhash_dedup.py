"""Near-duplicate groups of documents by SuperMinHash, banding, exact verification and union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .superminhash import band_keys, shingles, signatures, word_hashes

BANDS, ROWS = 40, 5
#: Shingles (and ROW for each node) in one stripe of a pivot's group, and the number of its likeness bins.
STRIPE, ROW, BIN = 400_000, 300, 20


def _pack(values: np.ndarray) -> bytes:
    return values.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _profiles(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(batch), 256):
                sets = [shingles(word_hashes(t.as_py(), memo), k) for t in texts[lo : lo + 256]]
                bands = band_keys(signatures(sets, BANDS * ROWS), BANDS, ROWS).tolist()
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 256], pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([b if len(s) else None for b, s in zip(bands, sets, strict=True)], pa.list_(pa.int64()))], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def _sets(k: int):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows = []
                for node, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    s = shingles(word_hashes(text, memo), k)
                    if _set_key(s) == key:
                        rows.append((node, len(s), _pack(s)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(3)], schema=schema)
        pa.default_memory_pool().release_unused()

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the intersection's size to pairs."""
    for batch in batches:
        a, b = batch.column("a_elements"), batch.column("b_elements")
        both = []
        for x, y in zip(a, b, strict=True):
            x, y = _unpack(x.as_buffer()), _unpack(y.as_buffer())
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("a_n"), batch.column("b_n"), pa.array(both, pa.int64())], names=["a", "b", "a_n", "b_n", "both"])


def _cross(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between two stripes of a pivot's group (or within one): intersections of all pairs that are not yet
        in one component, by products of 0/1 matrices over the elements that both stripes hold."""
        left = pdf[pdf.side != 1]
        right = pdf[pdf.side != 0]
        a, b = [[_unpack(x) for x in part.elements] for part in (left, right)]
        na, nb = left.n.to_numpy(), right.n.to_numpy()
        least = np.minimum(na[:, None], nb[None, :])
        open_ = (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :]) & (100 * least >= percent * np.maximum(na[:, None], nb[None, :]))
        out_a, out_b = np.empty(0, np.int64), np.empty(0, np.int64)
        if open_.any():
            ea, eb = np.concatenate(a), np.concatenate(b)
            shared = np.intersect1d(ea, eb)
            oa, ob = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
            both = np.zeros(open_.shape, np.float32)
            parts = []
            for e, o in ((ea, oa), (eb, ob)):
                at = np.minimum(np.searchsorted(shared, e), max(0, len(shared) - 1))
                hit = shared[at] == e if len(shared) else np.zeros(len(e), bool)
                order = np.argsort(at[hit], kind="stable")
                parts.append((at[hit][order], o[hit][order]))
            for lo in range(0, len(shared), 2048):
                ms = []
                for (at, o), rows in zip(parts, both.shape, strict=True):
                    s, e = np.searchsorted(at, [lo, lo + 2048])
                    m = np.zeros((rows, min(2048, len(shared) - lo)), np.float32)
                    m[o[s:e], at[s:e] - lo] = 1
                    ms.append(m)
                both += ms[0] @ ms[1].T
            inter = both.astype(np.int64)
            i, j = np.nonzero(open_ & (100 * inter >= percent * (na[:, None] + nb[None, :] - inter)))
            out_a, out_b = left.comp.to_numpy()[i], right.comp.to_numpy()[j]
        return pd.DataFrame({"a": out_a, "b": out_b}).drop_duplicates()

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Two documents are linked if the Jaccard likeness of their sets of `words`-word shingles is at least `percent`/100;
    component_id is the least doc_id that links can reach. Equal sets are one node, however many documents hold them.
    A node's SuperMinHash signature has 40 bands of 5 rows: a pair at 0.8 shares none with probability 1.3e-7. In each
    bucket all nodes are compared with its pivot, the node whose buckets are the largest in all. Where a pivot's group
    then is more than one component, all its pairs of nodes in different components are compared too, in stripes of a
    bounded number of shingles; so no candidate is given up, and no pairs are listed. Links are confirmed on full sets.

    A document with fewer words than `words`, but not none, has one shingle. Null texts and texts without words have
    n_shingles 0 and are components of their own. A null doc_id counts as larger than any; rows with one doc_id are
    documents each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = scratch.keep(texts.mapInArrow(_profiles(words), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    nodes = profiles.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))

    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    rows = scratch.keep(banded.join(scratch.keep(sizes), "band"))
    fame = scratch.keep(rows.groupBy("node").agg(F.sum("size").alias("fame")))
    pivots = scratch.keep(rows.join(fame, "node").groupBy("band").agg((-F.max(F.struct("fame", -F.col("node"))).getField("col2")).alias("pivot")))
    stars = scratch.keep(rows.join(pivots, "band").filter("node <> pivot").select("node", "pivot").distinct())

    wanted = stars.select("node").union(stars.select("pivot")).distinct().join(nodes.select("node", "least", "set_key"), "node")
    wanted = scratch.keep(wanted.select("node", "set_key", F.coalesce("least", F.lit(-(2**63))).alias("least")))
    # wanted grows with the corpus, so it is never sent to all executors
    known = texts.withColumn("least", F.coalesce("doc_id", F.lit(-(2**63)))).join(wanted.hint("merge"), "least").select("node", "set_key", "text")
    sets = scratch.keep(known.mapInArrow(_sets(words), "node long, n long, elements binary"))
    # a repeated row (same id, same text) would repeat its node
    one = F.row_number().over(Window.partitionBy("node").orderBy("n"))
    sets = sets.withColumn("nth", one).filter("nth = 1").drop("nth") if _repeats(wanted, sets) else sets

    a = sets.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("elements").alias("a_elements"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("elements").alias("b_elements"))
    pairs = stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")).join(a, "a").join(b, "b")
    pairs = scratch.keep(pairs.select("a", "b", "a_n", "b_n", "a_elements", "b_elements").mapInArrow(_verified, "a long, b long, a_n long, b_n long, both long"))
    union = F.col("a_n") + F.col("b_n") - F.col("both")
    linked = components(pairs.filter(100 * F.col("both") >= percent * union), scratch)

    label = nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    more = _between(pairs, sets, linked, percent, scratch)
    if not more.isEmpty():
        joined = components(more, scratch).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        label = label.join(joined, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    label = scratch.keep(label)
    least = scratch.keep(nodes.join(label, "node").groupBy("comp").agg(F.min("least").alias("component_id")))
    classes = scratch.keep(nodes.join(label, "node").join(least, "comp").select("set_key", "component_id"))
    out = profiles.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = scratch.keep(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    scratch.drop(out)
    return out


def _repeats(wanted: DataFrame, sets: DataFrame) -> bool:
    return wanted.count() != sets.count()


def _between(pairs: DataFrame, sets: DataFrame, linked: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b: components) between members of a pivot's group that its pivot did not bring together."""
    like = F.floor(BIN * F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both"))).cast("int")
    members = pairs.select(F.col("b").alias("pivot"), F.col("a").alias("node"), F.col("a_n").alias("n"), like.alias("bin"))
    members = members.union(pairs.select(F.col("b"), F.col("b"), F.col("b_n"), F.lit(BIN)).distinct())
    members = scratch.keep(members.join(linked, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    load = F.sum(F.col("n") + ROW)
    groups = members.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), load.alias("load"))
    # with one node beside the pivot, all pairs have been compared; a group that fits one stripe needs no bins
    groups = scratch.keep(groups.filter("lo <> hi and size > 2").select("pivot", (F.col("load") <= STRIPE).alias("whole")))
    members = members.join(groups, "pivot").withColumn("bin", F.when(F.col("whole"), 0).otherwise(F.col("bin")))
    bins = members.groupBy("pivot", "bin").agg(F.ceil(load / STRIPE).cast("int").alias("parts"))
    per_pivot = scratch.keep(bins.groupBy("pivot").agg(F.map_from_entries(F.collect_list(F.struct("bin", "parts"))).alias("bins")))
    # by the triangle inequality, linked nodes differ by at most 1 - percent/100 in their likeness to the pivot
    reach = -(-BIN * (100 - percent) // 100) + 1
    placed = members.join(per_pivot, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("bins")[F.col("bin")]).cast("int"))
    placed = placed.withColumn("own", F.struct("bin", "part"))
    others = F.flatten(F.transform(F.filter(F.map_entries("bins"), lambda e: F.abs(e["key"] - F.col("bin")) <= reach), lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda p: F.struct(e["key"].alias("bin"), p.cast("int").alias("part")))))
    tasks = placed.select("pivot", "node", "n", "comp", "own", F.explode(others).alias("other"))
    tasks = tasks.select("pivot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "node", "n", "comp")
    differ = tasks.groupBy("pivot", "x", "y").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("pivot", "x", "y")
    tasks = tasks.join(scratch.keep(differ), ["pivot", "x", "y"]).join(sets.select("node", "elements"), "node")
    return scratch.keep(tasks.select("pivot", "x", "y", "side", "n", "comp", "elements").groupBy("pivot", "x", "y").applyInPandas(_cross(percent), "a long, b long").distinct())
