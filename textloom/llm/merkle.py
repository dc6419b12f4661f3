"""A Merkle manifest of a dataset as a persistent tree: changed rows make versions that copy only the nodes above them."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

WIDTH, LEVELS = 3, 6


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, each `-` if null, else its bytes in UTF-8, `:` and itself."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Block:
    """The tree over the nodes of one aligned block. A block that is all of its tree goes up to a single node, others
    go up `levels` levels even where few nodes are left."""

    def __init__(self, nodes: list[str], width: int, levels: int, alone: bool) -> None:
        self.width, self.rows = width, [nodes]
        while len(self.rows[-1]) > 1 if alone else len(self.rows) <= levels:
            row = self.rows[-1]
            self.rows.append([_hash(row[i : i + width]) for i in range(0, len(row), width)])

    @property
    def root(self) -> str:
        return self.rows[-1][0]

    def path(self, at: int) -> list[tuple[list[str], list[str]]]:
        """The siblings to the left and to the right of the node `at` and of its ancestors, bottom up."""
        found = []
        for row in self.rows[:-1]:
            first = at - at % self.width
            found.append((row[first:at], row[at + 1 : first + self.width]))
            at //= self.width
        return found


def version(node: str, path: list[tuple[list[str], list[str]]]) -> list[str]:
    """What a version with the node changed copies: the node and its ancestors; all else is shared."""
    copies = [node]
    for left, right in path:
        copies.append(_hash([*left, copies[-1], *right]))
    return copies


PATH = "array<struct<left:array<string>,right:array<string>>>"


def _roots(width: int, levels: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        block = Block(pdf.hash.tolist(), width, levels, pdf.total.iloc[0] <= width**levels)
        return pd.DataFrame({"key": pdf.key[:1], "pos": pdf.block[:1], "total": -(-pdf.total[:1] // width**levels), "hash": block.root})

    return run


def _paths(width: int, levels: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        block = Block(pdf.hash.tolist(), width, levels, pdf.total.iloc[0] <= width**levels)
        path = [[{"left": a, "right": b} for a, b in block.path(i)] for i in range(len(pdf))]
        return pd.DataFrame({"key": pdf.key, "pos": pdf.pos, "block": pdf.block, "path": path})

    return run


def _versions(width: int, levels: int):
    def run(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        block = Block(leaves.hash.tolist(), width, levels, leaves.total.iloc[0] <= width**levels)
        upper = [(list(s["left"]), list(s["right"])) for s in above.path.iloc[0]]
        root = (version(block.root, upper))[-1]
        proofs, copies = [], []
        for i, changed in enumerate(leaves.changed):
            path = block.path(i) + upper
            proofs.append([h for left, right in path for h in (*left, *right)])
            copies.append(version(changed, path))
        return pd.DataFrame({"row": leaves.row, "leaf": leaves.hash, "subroot": above.subroot.iloc[0], "root": root, "proof": proofs, "copies": copies})

    return run


def _numbered(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds pos, the place of a row among those of its key by `order`, and total, the number of them.

    Rows are dealt out by ranges of key and order, numbered within a range, and the sizes of the ranges before give the
    rest; so a key that holds most rows is spread over tasks like any other.
    """
    sizes = Window.partitionBy("key").orderBy("range")
    dealt = df.repartitionByRange("key", *order).withColumn("range", F.spark_partition_id())
    dealt = scratch.keep(dealt)
    counts = dealt.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(sizes) - F.col("n")
    counts = scratch.keep(counts.select("key", "range", before.alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("total")))
    nth = F.row_number().over(Window.partitionBy("key", "range").orderBy(*order))
    return scratch.keep(dealt.withColumn("nth", nth).join(counts, ["key", "range"]).withColumn("pos", F.col("before") + F.col("nth") - 1).drop("before", "nth", "range"))


def _climb(nodes: DataFrame, width: int, levels: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """From nodes (key, pos, total, hash) the root of each key (key, hash), and the paths of the nodes of each round of
    blocks (key, pos, block, path). The rounds grow with the logarithm of the largest key to the base width^levels."""
    rounds = []
    while True:
        blocks = nodes.select("key", "pos", "total", "hash").withColumn("block", F.expr(f"pos div {width**levels}"))
        rounds.append(blocks)
        nodes = scratch.keep(blocks.groupBy("key", "block").applyInPandas(_roots(width, levels), "key string, pos long, total long, hash string"))
        if nodes.filter("total > 1").isEmpty():
            return nodes.select("key", "hash"), rounds


def _above(rounds: list[DataFrame], top: DataFrame, width: int, levels: int, scratch: Scratch) -> DataFrame:
    """(key, pos, path) of the nodes that the first of `rounds` starts from: all the way to the root of the whole tree.
    `top` has (key, path) of the keys' roots."""
    found = top.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        own = blocks.groupBy("key", "block").applyInPandas(_paths(width, levels), f"key string, pos long, block long, path {PATH}")
        upper = found.select("key", F.col("pos").alias("block"), F.col("path").alias("upper"))
        found = scratch.keep(own.join(upper, ["key", "block"]).select("key", "pos", F.concat("path", "upper").alias("path")))
    return found


def merkle_versions(rows: DataFrame, leaf: Column, changed: Column, group: Column, order: Column, keep: list[str] | None = None, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """leaf, subroot, root, proof and copies of each row, beside the columns in `keep` (all, if none are named).

    `leaf` is a row's digest and `changed` that of the row as found later (equal to `leaf` if nothing changed). Leaves
    of a group ascend by `order`; `width` consecutive nodes become one until one is left, the group's subroot, and so do
    the subroots by group (null first, else by bytes), which gives root. `proof` holds the siblings bottom up and left
    to right. `copies` is the version that the changed leaf makes: itself and its new ancestors up to the version's
    root; every other node is shared with the tree, which is never copied. Subtrees of width^levels leaves are worked
    out in one task; their roots go on as the leaves of the next round, whose paths continue the versions.

    Null orders come first; ties are ordered by leaf and changed, and rows equal in these have the proofs of
    neighbours. An empty table gives an empty result. Columns of the names added give way to those.
    """
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "merkle")
    added = ("leaf", "subroot", "root", "proof", "copies")
    own = [c for c in keep or rows.columns if c.lower() not in added]
    key = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("")).alias("key")
    flat = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key, order.alias("by"), leaf.alias("hash"), changed.alias("changed"))
    leaves = _numbered(scratch.keep(flat), ["by", "hash", "changed"], scratch)

    subroots, rounds = _climb(leaves, width, levels, scratch)
    tops = _numbered(scratch.keep(subroots.select(F.lit("").alias("key"), F.col("key").alias("by"), "hash")), ["by"], scratch)
    _, upper = _climb(tops, width, levels, scratch)
    whole = spark.createDataFrame([("", [])], f"key string, path {PATH}")
    places = tops.select(F.col("by").alias("key"), "pos", F.col("hash").alias("subroot"))
    above = scratch.keep(_above(upper, whole, width, levels, scratch).select("pos", "path").join(places, "pos").drop("pos"))
    blocks = _above(rounds[1:], above.select("key", "path"), width, levels, scratch).select("key", F.col("pos").alias("block"), "path")
    blocks = scratch.keep(blocks.join(above.select("key", "subroot"), "key"))

    leaves = leaves.withColumn("block", F.expr(f"pos div {width**levels}"))
    ids = leaves.select("key", "block", "pos", "total", "hash", "changed", "row")
    schema = f"row {ids.schema['row'].dataType.simpleString()}, leaf string, subroot string, root string, proof array<string>, copies array<string>"
    out = ids.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInPandas(_versions(width, levels), schema)
    return out.select("row.*", *added)
