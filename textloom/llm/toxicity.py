"""Toxicity scores: a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out

#: Terms are hashed to 2**BITS numbers. Into the machine go the SINGLE ones that tell the labels apart best on their own,
#: PAIRED ones that do so beside one of the ANCHORS best, and of the rest the FREQUENT ones that most documents hold (but
#: not more than half of them), so that pairs whose terms tell nothing on their own have a place too.
BITS, SINGLE, ANCHORS, PAIRED, FREQUENT, FACTORS = 18, 1536, 128, 256, 256, 4
#: A term counts if at least so many training documents hold it.
LEAST_DOCS = 5
#: The machine is fitted on about so many labelled documents at most, taken by a hash of their ids.
FIT_ROWS = 50_000
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def term_ids(text: str | None, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Distinct hashed terms of a text: its words and their first five and seven characters, lower-cased."""
    found: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        ids = memo.get(w)
        if ids is None:
            terms = [w, *(f"{w[:n]}*" for n in (5, 7) if len(w) > n)]
            ids = memo[w] = tuple(xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) >> (32 - BITS) for t in terms)
        found.update(ids)
    if len(memo) > 50_000:
        memo.clear()
    return np.fromiter(found, np.int64, len(found))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            terms = pa.array([np.sort(term_ids(t.as_py(), memo)).astype(np.int32) for t in part.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), terms, part.column(2)], names=["id__", "terms", "label"])
    pa.default_memory_pool().release_unused()


def _scores(place: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray, text_at: int, kept: int) -> Callable:
    """The text is column text_at; the first `kept` columns are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                out = np.empty(len(batch))
                for i, t in enumerate(batch.column(text_at)):
                    x = place[term_ids(t.as_py(), memo)]
                    x = x[x >= 0]
                    v = factors[x]
                    out[i] = bias + linear[x].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
                score = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(score)], names=[*(f"c{i}" for i in range(kept)), "score"])
        pa.default_memory_pool().release_unused()

    return run


def _gaps(rows: DataFrame, n: int, positive: int) -> DataFrame:
    """term, all (documents) and gap of each term in LEAST_DOCS of n documents and more."""
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("p"), F.count("*").alias("all")).filter(F.col("all") >= LEAST_DOCS)
    p, q = F.col("p") + 0.5, F.col("all") - F.col("p") + 0.5
    gap = (F.log(p / (positive + 1 - p)) - F.log(q / (n - positive + 1 - q))) / F.sqrt(1 / p + 1 / q)
    return counts.select("term", "all", gap.alias("gap"))


def _choose(rows: DataFrame, n: int, positive: int) -> list[int]:
    """The terms that enter the machine; each list that the driver gets has a fixed greatest length."""
    gaps = _gaps(rows, n, positive)
    found = [r.term for r in gaps.orderBy(F.abs("gap").desc(), "term").limit(SINGLE).select("term").collect()]
    anchors = [r.term for r in gaps.filter("gap > 0").orderBy(F.desc("gap"), "term").limit(ANCHORS).select("term").collect()]
    if anchors:
        beside = rows.filter(F.arrays_overlap("terms", F.lit(np.array(anchors, np.int32))))
        m, p = beside.agg(F.count("*"), F.sum("label")).first()
        paired = _gaps(beside, m, p).orderBy(F.abs("gap").desc(), "term").limit(SINGLE + PAIRED)
        known = set(found)
        found += [r.term for r in paired.select("term").collect() if r.term not in known][:PAIRED]
    frequent = gaps.filter(F.col("all") <= n / 2).orderBy(F.desc("all"), "term").limit(SINGLE + PAIRED + FREQUENT)
    known = set(found)
    return found + [r.term for r in frequent.select("term").collect() if r.term not in known][:FREQUENT]


class ToxicityModel:
    """Bias, linear weights and factors of the chosen terms; a constant score where a class is missing."""

    def __init__(self, place: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.place, self.bias, self.linear, self.factors = place, bias, linear, factors

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", training=held_out) -> ToxicityModel:
        """Fits on documents (doc_id, text) with a label of 0 or 1 whose id is not held out.

        Terms are counted over all of them. Those chosen (see SINGLE, PAIRED, FREQUENT; by absolute differences of
        log-odds in standard errors) go into pyspark.ml's factorization machine, which learns the interactions of all
        their pairs. Labels that are null are left out; of several labels of one document the largest holds; null ids
        have none. Rows that repeat a document count again. Without both classes the model gives the mean label (0
        without labels) to every text.
        """
        scratch = Scratch(docs.sparkSession, "toxicity")
        marks = labels.filter(~training(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id__")).agg(F.max(F.col(label_col).cast("int")).alias("label")).filter("label is not null and id__ is not null")
        texts = docs.select(F.col("doc_id").cast("long").alias("id__"), F.col("text").cast("string").alias("text")).join(marks, "id__")
        rows = scratch.keep(texts.select("id__", "text", "label").mapInArrow(_terms, "id__ long, terms array<int>, label int"))
        n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        negative = n - positive
        place = np.full(1 << BITS, -1, np.int64)
        if not positive or not negative:
            scratch.drop()
            odds = min(max(positive / n if n else 0.0, 1e-9), 1 - 1e-9)
            return cls(place, float(np.log(odds / (1 - odds))), np.zeros(1), np.zeros((1, FACTORS)))
        chosen = _choose(rows, n, positive)
        place[chosen] = np.arange(len(chosen))
        share = min(1.0, FIT_ROWS / n)
        some = rows.filter(F.pmod(F.xxhash64("id__"), F.lit(1 << 20)) < int(share * (1 << 20)))
        vectors = CountVectorizerModel.from_vocabulary([str(t) for t in chosen] or ["none"], "words", "features")
        sample = vectors.transform(some.select(F.col("label").cast("double").alias("label"), F.col("terms").cast("array<string>").alias("words")))
        fitted = FMClassifier(factorSize=FACTORS, stepSize=0.05, maxIter=120, regParam=1e-4, initStd=0.01, seed=42).fit(sample.select("label", "features").coalesce(6))
        model = cls(place, float(fitted.intercept), fitted.linear.toArray(), fitted.factors.toArray())
        scratch.drop()
        return model

    def score(self, docs: DataFrame, *columns: str, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """The named columns of docs, and score_col (none of them), the score of each whole text. A null or empty text
        has the score of no terms."""
        # the text travels once, also where it is one of the columns
        twice = text_col in columns and docs.schema[text_col].dataType.simpleString() == "string"
        chosen = docs.select(*columns, *([] if twice else [F.col(text_col).cast("string").alias("text__")]))
        at = columns.index(text_col) if twice else len(columns)
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[: len(columns)])
        return chosen.mapInArrow(_scores(self.place, self.bias, self.linear, self.factors, at, len(columns)), f"{schema}`{score_col}` double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; see ToxicityModel for what is learned and edge cases."""
    model = ToxicityModel.fit(docs, labels)
    return model.score(docs, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
