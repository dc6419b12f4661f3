"""Near-duplicate vectors by Euclidean p-stable hashing: quantised random projections, many tables, exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Width of a projection's cells; chance that a pair just at the least cosine shares no bucket; expected other vectors in
#: the bucket of a vector, if all were at right angles.
CELL_WIDTH, MISS, LOAD = 2.0, 0.02, 1 / 8
#: Tables whose buckets' least members gather cells, and members of a bucket that are compared as rows, or in one stripe.
STAR_TABLES, SMALL, STRIPE = 12, 32, 1024
#: Room for rounding in angles.
SLACK = 1e-6


def collision(distance: float, width: float = CELL_WIDTH) -> float:
    """Chance that two vectors at this distance fall into one cell of a Gaussian projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, miss: float = MISS, load: float = LOAD) -> tuple[int, int]:
    """Projections in a table, and tables, for n vectors: as many projections as leave `load` right-angled vectors in a
    bucket, as many tables as leave a pair at `cosine` unmet with the chance `miss`."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, n) / load) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of binary values, of single or double precision by their length, as float64."""
    offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    for kind in (np.float32, np.float64):
        if (np.diff(offsets) == np.dtype(kind).itemsize * dims).all():
            return np.frombuffer(col.buffers()[2], kind, len(col) * dims, offsets[0]).reshape(-1, dims).astype(np.float64) if len(col) else np.empty((0, dims))
    return np.stack([np.frombuffer(x.as_buffer(), np.float32 if len(x.as_buffer()) == 4 * dims else np.float64).astype(np.float64) for x in col])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _profiles(dims: int):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("vec", pa.binary()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, keys = [], []
            for value in batch.column(2):
                v = np.zeros(dims)
                got = None if not value.is_valid else np.array(value.values.to_numpy(zero_copy_only=False), np.float64)
                if got is not None:
                    v[: len(got)] = got
                top = np.abs(v).max(initial=0)
                if got is None or value.values.null_count or not np.isfinite(top) or top == 0:
                    vecs.append(None)
                    keys.append(None)
                    continue
                # a power of two changes no digit and keeps squares in range
                v = np.ldexp(v, -int(np.frexp(top)[1])) + 0.0
                vecs.append(v.tobytes() if (v != v.astype(np.float32)).any() else v.astype(np.float32).tobytes())
                keys.append(hashlib.md5(v.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], schema=schema)

    return run


def _keys(dims: int, k: int, tables: int, seed: int):
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((dims, tables * k))
        shifts = rng.uniform(0, CELL_WIDTH, tables * k)
        odd = rng.integers(1, 2**62, k, dtype=np.int64) * 2 + 1
        salt = rng.integers(-(2**62), 2**62, tables, dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                cells = np.floor((_unit(_matrix(part.column(1), dims)) @ directions + shifts) / CELL_WIDTH).astype(np.int64)
                found = (cells.reshape(-1, tables, k) * odd).sum(axis=2) + salt
                found ^= found >> 29
                found *= -4658895280553007687
                found ^= found >> 32
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.int64()))], schema=schema)

    return run


def _with_cosine(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _cosine(_matrix(batch.column("a_vec"), dims), _matrix(batch.column("b_vec"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "cosine"])

    return run


def _cosines(pairs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """a, b, cosine of pairs (a, b) of `vectors` (id, vec)."""
    a, b = [vectors.select(F.col("id").alias(x), F.col("vec").alias(f"{x}_vec")) for x in "ab"]
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_with_cosine(dims), "a long, b long, cosine double")


def _sums(dims: int, ordered: bool):
    """Sums of the vectors of each leader: of each batch, or where leaders come in order of each leader."""
    schema = pa.schema([("leader", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            leaders, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            m = _matrix(batch.column(1), dims) if ordered else _unit(_matrix(batch.column(1), dims))
            total = np.zeros((len(leaders), dims))
            np.add.at(total, at, m)
            if held:
                if held[0] == leaders[0]:
                    total[0] += held[1]
                else:
                    leaders, total = np.concatenate([[held[0]], leaders]), np.concatenate([held[1][None], total])
            if ordered:
                held, leaders, total = (leaders[-1], total[-1]), leaders[:-1], total[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array([v.tobytes() for v in total], pa.binary())], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1].tobytes()], pa.binary())], schema=schema)

    return run


def _frame_matrix(values: pd.Series, dims: int) -> np.ndarray:
    return _matrix(pa.array(values.tolist(), pa.binary()), dims)


def _near_in_bucket(dims: int, most: float):
    """Pairs of cells of two stripes of a bucket (or within one) whose members can be near."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side != 1], pdf[pdf.side != 0]
        angle = _angle(_unit(_frame_matrix(left.vec, dims)) @ _unit(_frame_matrix(right.vec, dims)).T)
        near = angle <= most + SLACK + left.radius.to_numpy()[:, None] + right.radius.to_numpy()[None, :]
        i, j = np.nonzero(near)
        a, b = left.id.to_numpy()[i], right.id.to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    return run


def _links_between(dims: int, cosine: float):
    """Links between members of two cells, in stripes: how many rows each member is linked to, and not which ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        x, y = _frame_matrix(left.vec, dims), _frame_matrix(right.vec, dims)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * np.sqrt(np.einsum("ij,ij->i", y, y))[None, :]
        linked = x @ y.T / norms >= cosine
        of = pd.concat([pd.DataFrame({"node": p.node, "n": m @ q.weight.to_numpy()}) for p, q, m in ((left, right, linked), (right, left, linked.T))])
        return of[of.n > 0].assign(a=pdf.a.iloc[0], b=pdf.b.iloc[0])

    return run


def _striped(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """Deals the rows of a group in stripes of some STRIPE rows and repeats them for each pair of stripes (x <= y), with
    side 0 (in x), 1 (in y) or 2 (in both)."""
    parts = F.ceil(F.col(size) / STRIPE).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return pairs.select(*by, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "id")


def _cells(keys: DataFrame, nodes: DataFrame, dims: int, cosine: float, scratch: Scratch) -> DataFrame:
    """(node, cell, radius, vec) of nodes in cells of two and more: vec is the cell's centre, from which no member is
    further than half the angle of `cosine`, so that all members are near each other."""
    theta = math.acos(cosine)
    firsts = keys.select("node", F.explode(F.slice("keys", 1, STAR_TABLES)).alias("key"))
    pivots = firsts.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = firsts.join(pivots, "key").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    vectors = nodes.select(F.col("node").alias("id"), "vec")
    stars = scratch.keep(_cosines(scratch.keep(stars), vectors, dims).filter(F.col("cosine") >= cosine))
    # a pivot that follows another one leads nobody
    led = stars.join(stars.select(F.col("a").alias("b")).distinct(), "b", "left_anti").groupBy("a").agg(F.min("b").alias("leader"))
    led = scratch.keep(led.withColumnRenamed("a", "node"))
    members = led.union(led.select(F.col("leader").alias("node"), "leader").distinct())
    members = scratch.keep(members.join(nodes.select("node", "vec"), "node"))
    sums = members.select("leader", "vec").mapInArrow(_sums(dims, False), "leader long, vec binary")
    centres = sums.repartition("leader").sortWithinPartitions("leader").mapInArrow(_sums(dims, True), "leader long, vec binary")
    centres = scratch.keep(centres)
    a = members.select(F.col("node").alias("a"), F.col("vec").alias("a_vec"), F.col("leader").alias("b"))
    at = a.join(centres.select(F.col("leader").alias("b"), F.col("vec").alias("b_vec")), "b").mapInArrow(_with_cosine(dims), "a long, b long, cosine double")
    at = scratch.keep(at.select(F.col("a").alias("node"), F.col("b").alias("leader"), F.acos(F.least("cosine", F.lit(1.0))).alias("angle")).filter(F.col("angle") <= theta / 2 - SLACK))
    cells = at.groupBy("leader").agg(F.min("node").alias("cell"), F.max("angle").alias("radius"), F.count("*").alias("n")).filter("n > 1")
    cells = scratch.keep(cells.join(centres, "leader").select("leader", "cell", "radius", "vec"))
    return at.select("node", "leader").join(cells, "leader").select("node", "cell", "radius", "vec")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, miss: float = MISS, seed: int = 17) -> DataFrame:
    """id, n_links, component_id, kept of every vector.

    Vectors are linked if their cosine, in double precision, is at least `cosine` (over 0); n_links counts the other
    rows that a row is linked to, component_id is the least id that links can reach. Each vector falls into one bucket of each
    table, by the cells of k Gaussian projections of its normalised form; k and the number of tables follow from the
    number of vectors, so that a pair just at `cosine` is missed with the chance `miss`, and nearer ones far more
    rarely. Links found are exact.

    Equal vectors are one node. Nodes that lie within half the angle of `cosine` from a common centre are one cell, whose
    members are all linked; so groups of many copies need no pairs. Cells that share a bucket are compared by centre and
    radius: all of their members are linked, or none, or the members are compared, in stripes. Of members only counts go
    on. Only links between cells are listed.

    A vector that is null or zero or holds a null or non-finite component is linked with nothing. Shorter vectors are
    padded with zeros. A null id counts as larger than any; rows with one id are vectors each. Other columns are
    ignored; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dims = max(1, vectors.agg(F.max(F.size(vector_col))).first()[0] or 1)
    profiles = scratch.keep(rows.mapInArrow(_profiles(dims), "row long, id long, vec binary, key binary"))
    classes = profiles.filter("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("id").alias("least"))
    nodes = scratch.keep(classes.join(profiles.select(F.col("row").alias("node"), "vec"), "node"))
    n = nodes.count()
    k, tables = plan(n, cosine, miss)
    keys = scratch.keep(nodes.select("node", "vec").repartition("node").mapInArrow(_keys(dims, k, tables, seed), "node long, keys array<long>"))

    grouped = scratch.keep(_cells(keys, nodes, dims, cosine, scratch))
    placed = nodes.join(grouped.withColumnRenamed("vec", "centre"), "node", "left")
    placed = scratch.keep(placed.select("node", "weight", "least", "vec", F.coalesce("cell", "node").alias("cell"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.when(F.col("node") == F.coalesce("cell", "node"), F.coalesce("centre", "vec")).alias("centre")))
    cells = placed.groupBy("cell").agg(F.sum("weight").alias("weight"), F.count("*").alias("size"), F.max("radius").alias("radius"))
    cells = scratch.keep(cells.join(placed.filter("centre is not null").select("cell", F.col("centre").alias("vec")), "cell"))

    near = scratch.keep(_near_cells(keys, placed, cells, dims, math.acos(cosine), scratch))
    a, b = [cells.select(F.col("cell").alias(x), F.col("radius").alias(f"{x}_r"), F.col("size").alias(f"{x}_n"), F.col("weight").alias(f"{x}_w")) for x in "ab"]
    near = near.join(a, "a").join(b, "b").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least("cosine", F.lit(1.0)))))
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    whole = F.when(single, F.col("cosine") >= cosine).otherwise(F.col("angle") + F.col("a_r") + F.col("b_r") <= math.acos(cosine) - SLACK)
    none = ~single & (F.col("angle") - F.col("a_r") - F.col("b_r") > math.acos(cosine) + SLACK)
    near = scratch.keep(near.withColumn("whole", whole).filter(F.col("whole") | ~(none | single)))
    sure = near.filter("whole").select("a", "b", "a_w", "b_w")
    counted = sure.select(F.col("a").alias("cell"), F.col("b_w").alias("w")).union(sure.select("b", "a_w")).groupBy("cell").agg(F.sum("w").alias("outer"))

    between = scratch.keep(_between_cells(near.filter("not whole"), placed, dims, cosine, scratch))
    extra = between.groupBy("node").agg(F.sum("n").alias("extra"))
    linked = components(sure.select("a", "b").union(between.select("a", "b").distinct()), scratch)
    label = placed.select("node", "least", "cell").join(linked.withColumnRenamed("node", "cell"), "cell", "left").withColumn("comp", F.coalesce("comp", "cell"))
    least = scratch.keep(label.groupBy("comp").agg(F.min("least").alias("component_id")))
    found = label.join(least, "comp").select("node", "cell", "component_id")
    found = found.join(cells.select("cell", "weight"), "cell").join(counted, "cell", "left").join(extra, "node", "left")
    links = F.col("weight") - 1 + F.coalesce("outer", F.lit(0)) + F.coalesce("extra", F.lit(0))
    found = found.select("node", "component_id", links.cast("long").alias("n_links")).join(nodes.select("node", "key"), "node").drop("node")
    out = profiles.select("id", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = scratch.keep(out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")))
    scratch.drop(out)
    return out


def _near_cells(keys: DataFrame, placed: DataFrame, cells: DataFrame, dims: int, theta: float, scratch: Scratch) -> DataFrame:
    """a, b (a < b), cosine of the centres of cells that share a bucket and may hold near members."""
    rows = keys.join(placed.select("node", "cell"), "node").select(F.explode("keys").alias("key"), "cell")
    # no count of different cells: where two rows share a bucket, its least and largest cell are all
    buckets = scratch.keep(rows.groupBy("key").agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.count("*").alias("n")).filter("a <> b"))
    larger = rows.join(buckets.filter("n > 2").select("key"), "key").distinct()
    sizes = larger.groupBy("key").agg(F.count("*").alias("size"))
    larger = scratch.keep(larger.join(sizes, "key").select("key", F.col("cell").alias("id"), "size"))
    small = larger.filter(F.col("size") <= SMALL).select("key", "id")
    pairs = small.withColumnRenamed("id", "a").join(small.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b")
    pairs = scratch.keep(buckets.filter("n = 2").select("a", "b").union(pairs).distinct())

    big = _striped(larger.filter(F.col("size") > SMALL), ["key"], "size")
    vectors = cells.select(F.col("cell").alias("id"), "vec", "radius")
    shape = big.join(vectors, "id").groupBy("key", "x", "y")
    pairs = scratch.keep(pairs.union(shape.applyInPandas(_near_in_bucket(dims, theta), "a long, b long")).distinct())
    # radii are half of theta at most
    return _cosines(pairs, vectors.select("id", "vec"), dims).filter(F.col("cosine") >= math.cos(min(math.pi, 2 * theta + 2 * SLACK)))


def _between_cells(near: DataFrame, placed: DataFrame, dims: int, cosine: float, scratch: Scratch) -> DataFrame:
    """node, n, a, b: the number n of rows of the other cell that a member of cell a or b is linked to."""
    pairs = near.select("a", "b", "a_n", "b_n")
    stripes = [F.ceil(F.col(f"{x}_n") / STRIPE).cast("int") for x in "ab"]
    members = placed.select("cell", "node", "weight", "vec")
    sides = []
    for side, (own, other) in enumerate((stripes, stripes[::-1])):
        held = pairs.join(members.withColumnRenamed("cell", "ab"[side]), "ab"[side])
        mine, theirs = F.pmod(F.xxhash64("node"), own).cast("int"), F.explode(F.sequence(F.lit(0), other - 1))
        held = held.select("a", "b", mine.alias("xy"[side]), theirs.alias("yx"[side]), F.lit(side).alias("side"), "node", "weight", "vec")
        sides.append(held.select("a", "b", "x", "y", "side", "node", "weight", "vec"))
    both = sides[0].union(sides[1])
    return both.groupBy("a", "b", "x", "y").applyInPandas(_links_between(dims, cosine), "node long, n long, a long, b long")
