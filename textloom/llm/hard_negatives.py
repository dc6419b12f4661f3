"""Hard negatives by rotated one-bit codes: popcount estimates, sure intervals, integer scores of what they leave."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of a code for each component, bits of an anchor's rotated components, anchors that are searched for at a time.
SPREAD, PLANES, ANCHORS = 8, 6, 16_384
#: Rows and anchors that are estimated together; components beyond LARGEST are held at it, so that scores fit in 64 bits.
ROWS, COLUMNS, LARGEST = 2048, 256, 2**28


def rotation(dims: int, seed: int) -> np.ndarray:
    """The columns of a random rotation of 8 times the components (a multiple of 64) on which vectors lie that are
    padded with zeros."""
    bits = 64 * -(-SPREAD * dims // 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """One-bit codes of vectors: the signs of the rotated vector. `code` is projected back to where vectors lie; `norm` is
    the length of that, `align` the vector's inner product with its direction, `rest` the length of what is left."""

    bits: np.ndarray
    norm: np.ndarray
    align: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, turn: np.ndarray) -> Codes:
        v = vectors.astype(np.float64)
        turned = v @ turn.T
        signs = np.where(turned >= 0, 1.0, -1.0)
        norm = np.linalg.norm(signs @ turn, axis=1)
        align = np.abs(turned).sum(axis=1) / norm
        rest = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", v, v) - align * align))
        return Codes(np.packbits(turned >= 0, axis=1).view(np.uint64), norm, align, rest)


class Anchors:
    """Anchors as sums of bit planes of their rotated components."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray) -> None:
        v = vectors.astype(np.float64)
        turned = v @ turn.T
        self.vectors, self.length2 = vectors, np.einsum("ij,ij->i", v, v)
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum(turned.max(axis=1, initial=0) - self.low, 1e-9) / (2**PLANES - 1)
        units = np.rint((turned - self.low[:, None]) / self.step[:, None])
        off = turned - (self.low[:, None] + self.step[:, None] * units)
        self.off = 2 * np.maximum(np.maximum(off, 0).sum(axis=1), np.maximum(-off, 0).sum(axis=1))
        self.total = turned.sum(axis=1)
        units = units.astype(np.uint8)
        self.planes = np.stack([np.packbits((units >> b) & 1, axis=1).view(np.uint64) for b in range(PLANES)], axis=1) if len(v) else np.empty((0, PLANES, turn.shape[0] // 64), np.uint64)

    def interval(self, at: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products of the anchors `at` with the coded vectors.

        A vector is align times its code's direction and a rest at right angles to it. The anchor's product with the
        direction comes from popcounts, off by the rounding of its components at most; that with the rest is at most
        the rest's length times that of the anchor's own part at right angles (Cauchy-Schwarz).
        """
        sums = np.zeros((len(at), len(codes.norm)), np.int32)
        for b in range(PLANES):
            ones = np.zeros(sums.shape, np.uint16)
            for w in range(codes.bits.shape[1]):
                ones += np.bitwise_count(self.planes[at, b, w][:, None] & codes.bits[None, :, w])
            sums += ones.astype(np.int32) << b
        held = np.bitwise_count(codes.bits).sum(axis=1, dtype=np.int64)
        along = 2 * (self.low[at][:, None] * held[None, :] + self.step[at][:, None] * sums) - self.total[at][:, None]
        along /= codes.norm[None, :]
        off = self.off[at][:, None] / codes.norm[None, :]
        least = np.maximum(0, np.abs(along) - off)
        wide = codes.align[None, :] * off + codes.rest[None, :] * np.sqrt(np.maximum(0, self.length2[at][:, None] - least * least))
        wide += 1e-6 + 1e-9 * np.sqrt(self.length2[at])[:, None] * (codes.align + codes.rest)[None, :]
        middle = codes.align[None, :] * along
        return middle - wide, middle + wide


SCHEMA = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("vec", pa.binary()), ("code", pa.binary()), ("norm", pa.float64()), ("align", pa.float64()), ("rest", pa.float64())])
CODED = "row long, id long, label long, anchor boolean, vec binary, code binary, norm double, align double, rest double"


def _matrix(col: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in col), kind).reshape(len(col), -1)


def _coded(dims: int, scale: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims, seed)
        for batch in batches:
            vectors, kept = np.zeros((len(batch), dims)), np.zeros(len(batch), bool)
            for i, value in enumerate(batch.column("vec")):
                found = value.values
                if not found.null_count:
                    v = found.to_numpy(zero_copy_only=False).astype(np.float64)
                    kept[i] = np.isfinite(v).all()
                    vectors[i, : len(v)] = v if kept[i] else 0
            part = batch.filter(pa.array(kept))
            whole = np.clip(np.floor(scale * vectors[kept]), -LARGEST, LARGEST).astype(np.int32)
            codes = Codes.of(whole, turn)
            columns = [part.column(c) for c in ("row", "id", "label", "anchor")]
            binary = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (whole, codes.bits)]
            yield pa.RecordBatch.from_arrays([*columns, *binary, *map(pa.array, (codes.norm, codes.align, codes.rest))], schema=SCHEMA)

    return run


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, row by row."""
    return np.einsum("ij,ij->i", rows.astype(np.int64), anchors.astype(np.int64))


class Best:
    """The best rows of each group so far: highest scores first, then least ids (null last)."""

    def __init__(self, groups: int, most: int) -> None:
        self.most, self.floor = most, np.full(groups, -np.inf)
        self.group = self.score = self.id = self.row = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        group, score, ids, null, row = [np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids), (self.null, null), (self.row, row))]
        order = np.lexsort((row, ids, null, -score, group))
        sorted_group = group[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
        full = order[rank == self.most - 1]
        self.floor[group[full]] = score[full]
        best = order[rank < self.most]
        self.group, self.score, self.id, self.null, self.row = group[best], score[best], ids[best], null[best], row[best]


@dataclass
class Block:
    """The anchors of a pass, and the scores of their positives (in the second search), best first."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    positives: np.ndarray | None = None


def _search(shared, dims: int, seed: int, most: int, window: tuple[int, int]):
    """The best rows of the anchors among a partition's: of the same label, or of others within the window of each
    positive's score."""
    schema = pa.schema([("anchor_row", pa.int64()), ("nth", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        anchors = Anchors(block.vectors, rotation(dims, seed))
        by_label = np.argsort(block.label, kind="stable")
        each = 1 if block.positives is None else block.positives.shape[1]
        best = Best(len(block.row) * each, most)
        if block.positives is not None:
            top = np.where(np.isnan(block.positives), -np.inf, block.positives).max(axis=1, initial=-np.inf)
            # a window below zero is empty
            least = np.where(block.positives >= 0, block.positives * window[0] / 100, np.inf).min(axis=1, initial=np.inf)

        def compare(at: np.ndarray, codes: Codes, part: dict[str, np.ndarray]) -> None:
            low, high = anchors.interval(at, codes)
            if block.positives is None:
                self_ = block.row[at][:, None] == part["row"][None, :]
                low[self_] = high[self_] = -np.inf
                bar = best.floor[at]
                if low.shape[1] >= most:
                    bar = np.maximum(bar, np.partition(low, -most, axis=1)[:, -most])
                i, j = np.nonzero((high >= bar[:, None]) & ~self_)
            else:
                bar = np.maximum(least[at], best.floor.reshape(-1, each)[at].min(axis=1))
                i, j = np.nonzero((high >= bar[:, None]) & (low <= (top * window[1] / 100)[at][:, None]) & (block.label[at][:, None] != part["label"][None, :]))
            score = _scores(part["vec"][j], block.vectors[at[i]])
            if block.positives is None:
                best.add(at[i], score, part["id"][j], part["null"][j], part["row"][j])
                return
            for n in range(each):
                goal = block.positives[at[i], n]
                fits = (window[0] * goal <= 100 * score) & (100 * score <= window[1] * goal)
                best.add(at[i][fits] * each + n, score[fits], part["id"][j][fits], part["null"][j][fits], part["row"][j][fits])

        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                piece = batch.slice(lo, ROWS)
                ids = piece.column("id")
                part = {"row": piece.column("row").to_numpy(), "label": piece.column("label").to_numpy(), "id": ids.fill_null(0).to_numpy(), "null": ids.is_null().to_numpy(zero_copy_only=False), "vec": _matrix(piece.column("vec"), np.int32)}
                bits, (norm, align, rest) = _matrix(piece.column("code"), np.uint64), [piece.column(c).to_numpy() for c in ("norm", "align", "rest")]
                groups = np.unique(part["label"]) if block.positives is None else [None]
                for label in groups:
                    rows = np.arange(len(piece)) if label is None else np.flatnonzero(part["label"] == label)
                    first, last = (0, len(by_label)) if label is None else np.searchsorted(block.label[by_label], [label, label + 1])
                    for a in range(first, last, COLUMNS):
                        compare(by_label[a : min(a + COLUMNS, last)], Codes(bits[rows], norm[rows], align[rows], rest[rows]), {k: v[rows] for k, v in part.items()})
        ids = pa.array(best.id, pa.int64(), mask=best.null)
        yield pa.RecordBatch.from_arrays([pa.array(block.row[best.group // each], pa.int64()), pa.array(best.group % each), pa.array(best.row), ids, pa.array(best.score)], schema=schema)

    return run


FOUND = "anchor_row long, nth long, row long, id long, score long"


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), seed: int = 17, anchors_at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x become floor(scale*x); a score is the integer inner product. Each row where `anchor` holds has as
    positives its best `positives` other rows of its label; for each of them its best `negatives` rows of other labels
    follow whose scores lie within `window` percent of the positive's. Higher scores are better, then smaller ids (null
    last). The result is exact: of each row, a one-bit code of 8 bits a component, its alignment and the length of the
    rest give an interval that holds the score for sure, and only rows whose interval reaches the best so far (or the
    window) are scored. Anchors are searched for in blocks of `anchors_at_once` rows, each against all rows, of which
    every task hands on its best alone.

    Rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors are padded with
    zeros, so an empty one scores 0. A positive score below 0 has no window. Components beyond 2^28 after scaling count
    as that. Rows with one id are rows each; a null id can be found. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    vec = F.col(vector_col)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("vec"))
    rows = rows.filter("label is not null and vec is not null")
    n, dims = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    dims = max(1, dims or 1)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // 100_000))
    codes = scratch.keep(rows.repartition(tasks, "row").mapInArrow(_coded(dims, scale, seed), CODED))

    found, last = [], -1
    while True:
        chosen = codes.filter(F.col("anchor") & (F.col("row") > last)).orderBy("row").limit(anchors_at_once).select("row", "label", "vec").collect()
        if not chosen:
            break
        last = chosen[-1].row
        block = Block(np.array([r.row for r in chosen]), np.array([r.label for r in chosen]), np.stack([np.frombuffer(r.vec, np.int32) for r in chosen]))
        shared = spark.sparkContext.broadcast(block)
        best = codes.mapInArrow(_search(shared, dims, seed, positives, window), FOUND)
        best = scratch.keep(_ranked(best, ["anchor_row"], positives))
        place = {row: i for i, row in enumerate(block.row.tolist())}
        goals = np.full((len(chosen), positives), np.nan)
        for r in best.select("anchor_row", "rank", "score").collect():
            goals[place[r.anchor_row], r["rank"] - 1] = r.score
        again = spark.sparkContext.broadcast(Block(block.row, block.label, block.vectors, goals))
        worst = codes.mapInArrow(_search(again, dims, seed, negatives, window), FOUND)
        worst = _ranked(worst, ["anchor_row", "nth"], negatives).select("anchor_row", (F.col("nth") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        goal = best.select("anchor_row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found.append(scratch.keep(worst.join(goal, ["anchor_row", "nth"])))
        shared.destroy()
        again.destroy()
    named = codes.filter("anchor").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    if not found:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    whole = found[0]
    for part in found[1:]:
        whole = whole.union(part)
    out = whole.join(named, "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    out = scratch.keep(out)
    scratch.drop(out)
    return out
