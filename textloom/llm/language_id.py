"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: n-grams of 1 to 3 characters; the PROFILE most frequent of a language or a document are compared.
PROFILE = 300
#: Grams of one language are ranked in so many parts before the parts' leaders meet.
PARTS = 16
CHUNK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of each code point of the basic plane; 0 for all others."""
    out = np.zeros(0x10000, np.uint64)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low if low < 0x10000 else i
    return out


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    if len(points) and points.max() >= 0x10000:
        # letters beyond the basic plane share its private-use codes
        far = points >= 0x10000
        alpha = np.fromiter((chr(p).isalpha() for p in points[far]), bool, int(far.sum()))
        codes = np.where(far, 0, table[np.where(far, 0, points)])
        codes[far] = np.where(alpha, np.uint64(0xE000) + (points[far] % 0x1900), 0)
        return codes
    return table[points]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as numbers) of the text's words, each with a space before and after, and their counts."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    text = text or ""
    for lo in range(0, len(text), CHUNK):
        # a chunk starts two characters early, so no gram is lost; grams that lie wholly before are not counted again
        early = min(2, lo)
        c = _codes(text[lo - early : lo + CHUNK])
        if lo == 0:
            c = np.concatenate([[np.uint64(0)], c])
        if lo + CHUNK >= len(text):
            c = np.concatenate([c, [np.uint64(0)]])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep]
        one = c[early:]
        two = c[:-1] << np.uint64(16) | c[1:]
        three = c[:-2] << np.uint64(32) | two[1:]
        found = np.concatenate([one[one != 0], two[max(0, early - 1) :] | np.uint64(1 << 62), three | np.uint64(1 << 63)])
        k, n = np.unique(found, return_counts=True)
        if len(keys):
            k, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        keys, counts = k, n
    if not (keys < np.uint64(1 << 62)).any():
        return keys[:0], counts[:0]
    return keys, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of each language within a partition; hands them on whenever they become many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            found = grams(text.as_py())
            held.setdefault(lang.as_py(), []).append(found)
            size += len(found[0])
            if size > 1_000_000:
                yield from rows()
                size = 0
    yield from rows()


class LanguageProfiles:
    """Ranks of the most frequent n-grams of each language."""

    def __init__(self, langs: list[str], keys: np.ndarray, ranks: np.ndarray, size: int) -> None:
        self.langs, self.keys, self.ranks, self.size = langs, keys, ranks, size

    @classmethod
    def fit(cls, docs: DataFrame, size: int = PROFILE, training=held_out) -> LanguageProfiles:
        """Counts n-grams over all documents (doc_id, text, lang) that have a lang and are not held out; the driver gets
        `size` rows for each lang. Ties in frequency go to the smaller gram."""
        rows = docs.filter(~training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
        counts = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_count, "lang string, gram long, n long")
        counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
        for by in (["lang", "part"], ["lang"]):
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "gram"))
            counts = counts.withColumn("rank", rank).filter(F.col("rank") <= size)
        found = counts.select("lang", "gram", "rank").collect()
        langs = sorted({r.lang for r in found})
        keys = np.unique(np.array([r.gram for r in found], np.int64).view(np.uint64))
        ranks = np.full((len(keys) + 1, len(langs)), -1, np.int64)
        for r in found:
            ranks[np.searchsorted(keys, np.uint64(r.gram % (1 << 64))), langs.index(r.lang)] = r["rank"] - 1
        return cls(langs, keys, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return "und", 0.0
        top = np.lexsort((keys, -counts))[: self.size]
        at = np.searchsorted(self.keys, keys[top])
        at = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys[top], at, len(self.keys))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        near = 1 - away / (self.size * len(top))
        best = int(np.argmin(away))
        total = near.sum()
        return self.langs[best], float(near[best] / total) if total > 0 else 1 / len(self.langs)


def _predict(profiles: LanguageProfiles) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    lang_pred is the learned language whose profile is least out of place; `und` with score 0 if the text is null or
    has no letter, or nothing could be learned. score is the share of the best language in the nearness to all. Equal
    distances go to the first language by name. A null doc_id is not held out; other columns are ignored.
    """
    profiles = LanguageProfiles.fit(docs)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(profiles), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
