"""Connected components of a link table: union-find inside partitions, then least-label exchange in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one partition; gives each node's link to its least member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in parent]
    for lo in range(0, len(out), 100_000):
        yield pd.DataFrame(out[lo : lo + 100_000], columns=["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for each node of `links` (a, b: long): comp is the least node that can be reached.

    Links of a partition are first contracted by union-find, then labels are exchanged and labels of labels followed
    (so that the rounds grow with the logarithm of the longest path) until nothing changes. Every round is a written
    table; the driver sees counts only. An empty link table gives an empty result.
    """
    stars = scratch.keep(links.select("a", "b").mapInPandas(_contract, "a long, b long").filter("a <> b").distinct())
    both = scratch.keep(stars.union(stars.select("b", "a")))
    state = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        seen = both.join(state, both.b == state.node).groupBy("a").agg(F.min("comp").alias("seen"))
        near = state.join(seen, state.node == seen.a, "left").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        up = state.select(F.col("node").alias("of"), F.col("comp").alias("above"))
        new = scratch.keep(near.join(up, near.comp == up.of, "left").select("node", "old", F.least("comp", "above").alias("comp")))
        state = new.select("node", "comp")
        if new.filter("old <> comp").isEmpty():
            return state
