"""Sentiment of a unit from phrases, weighted words, negation and modifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import let, strings, weights

SCALE = 2.0
THRESHOLD = math.tanh(0.65 / SCALE)


def phrase_score(normalized: Column) -> Column:
    """The weights of all phrases that the unit contains, each once; phrases inside others count as well."""
    phrases = F.map_entries(weights({**lx.POSITIVE_PHRASES, **lx.NEGATIVE_PHRASES}))
    held = F.filter(phrases, lambda p: normalized.contains(p["key"]))
    return F.aggregate(held, F.lit(0.0), lambda total, p: total + p["value"])


def raw_sentiment(normalized: Column, words: Column) -> Column:
    """Phrases and words. A word's weight is multiplied by the modifiers among the two words before it and by 0.6 where
    a phrase was found; a negation among the three words before it turns its sign, but not for a bad word after
    `without` in a unit that contains one of the phrases in which `without` says no more than that."""
    table, modifiers = weights({**lx.POSITIVE, **lx.NEGATIVE}), weights({**lx.INTENSIFIERS, **lx.DOWNPLAYERS})
    contains = lambda phrases: F.exists(strings(phrases), lambda p: normalized.contains(p))
    factor = F.when(contains([*lx.POSITIVE_PHRASES, *lx.NEGATIVE_PHRASES]), 0.6).otherwise(1.0)

    def score(w: Column, at: Column, safe: Column, weight: Column) -> Column:
        def of(value: Column, i: Column) -> Column:
            before = F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            two = F.slice(w, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
            modified = F.aggregate(two, value * weight, lambda total, m: total * F.coalesce(modifiers[m], F.lit(1.0)))
            negated = F.arrays_overlap(before, strings(lx.NEGATION)) & ~((value < 0) & safe & F.array_contains(before, "without"))
            return F.when(negated, -modified).otherwise(modified)

        values = F.transform(w, lambda t, i: F.when(at[t].isNotNull(), of(at[t], i)).otherwise(0.0))
        return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)

    by_words = let(words, lambda w: let(contains(lx.SAFE_PHRASES), lambda safe: let(factor, lambda f: score(w, table, safe, f))))
    return phrase_score(normalized) + by_words


def normalized_score(raw: Column) -> Column:
    return F.tanh(raw / SCALE)


def sentiment_label(score: Column) -> Column:
    return F.when(score > THRESHOLD, "positive").when(score < -THRESHOLD, "negative").otherwise("neutral")
