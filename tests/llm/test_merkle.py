import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm.merkle import Block, digest, merkle_versions, version

SCHEMA = "doc_id long, source string, text string, Leaf int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def fold(nodes, at=None, node=None):
    """The root of a whole tree, and with `at` also the siblings on the way and the root with `node` in that place."""
    proof = []
    while len(nodes) > 1:
        if at is not None:
            first = at - at % 3
            left, right = nodes[first:at], nodes[at + 1 : first + 3]
            proof += left + right
            node, at = sha(*left, node, *right), at // 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proof, node


def brute(rows):
    null = lambda x: (x is not None, x or 0)
    leaves = [(source, doc_id, sha(field(doc_id), field(text)), sha(field(doc_id), field(text and text.replace("\n", "")))) for doc_id, source, text, _ in rows]
    leaves.sort(key=lambda r: ((r[0] is not None, (r[0] or "").encode()), null(r[1]), r[2], r[3]))
    groups = []
    for row in leaves:
        if not groups or groups[-1][0][0] != row[0]:
            groups.append([])
        groups[-1].append(row)
    subroots = [fold([r[2] for r in g])[0] for g in groups]
    out = []
    for i, g in enumerate(groups):
        for j, (_, doc_id, leaf, changed) in enumerate(g):
            subroot, low, top = fold([r[2] for r in g], j, changed)
            root, high, folded = fold(subroots, i, top)
            out.append((doc_id, leaf, subroot, root, low + high, folded))
    return out


def said(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_rounds_of_blocks_equal_one_tree(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a", "b", None, "é", ""]) if i % 3 else "hot", rng.choice(["x\ny", "plain", "", None, "long " * 500]), 1) for i in range(230)]
    rows += [(7, "a", "x\ny", 2), (7, "a", "x\ny", 2), (None, "a", "q", 3), (None, None, None, None), (3, "alone", "\n", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changed = digest(F.col("doc_id"), F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle_versions(df, digest(F.col("doc_id"), F.col("text")), changed, F.col("source"), F.col("doc_id"), keep=["doc_id"], levels=levels).collect()
    assert said([(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.copies[-1]) for r in found]) == said(brute(rows))


def test_columns_give_way_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, "a", "t", 5)], SCHEMA)
    one = merkle_versions(df, digest(F.col("text")), digest(F.lit("u")), F.col("source"), F.col("doc_id"))
    assert one.columns == ["doc_id", "source", "text", "leaf", "subroot", "root", "proof", "copies"]
    row = one.first()
    assert row.leaf == row.subroot == row.root == sha("1:t") and row.proof == [] and row.copies == [sha("1:u")]
    assert merkle_versions(df.limit(0), digest(F.col("text")), digest(F.col("text")), F.col("source"), F.col("doc_id")).count() == 0


def test_a_version_copies_only_what_lies_above():
    nodes = [sha(str(i)) for i in range(9)]
    tree = Block(nodes, 3, 2, True)
    copies = version("changed", tree.path(4))
    other = Block([*nodes[:4], "changed", *nodes[5:]], 3, 2, True)
    assert copies == ["changed", other.rows[1][1], other.root]
    assert version(nodes[4], tree.path(4))[-1] == tree.root
