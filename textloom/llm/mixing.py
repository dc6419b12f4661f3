"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEED, MAX_EPOCHS = 17, 4
BIG = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    """Tokens: runs of characters other than space and \\t\\n\\v\\f\\r. A null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other = right.withColumnsRenamed({k: f"{k}r__" for k in keys})
    return left.join(other, [left[k].eqNullSafe(other[f"{k}r__"]) for k in keys], how).drop(*[f"{k}r__" for k in keys])


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Splits each parent's `budget` (long) among its children by `weight`, none above its `capacity`.

    What a child cannot use goes to its siblings in proportion to their weights: children in order of capacity per
    unit of weight are filled up while the level at which the rest would share is above theirs. Whole numbers
    throughout; the tokens that rounding leaves go to the first children with room, in the order of their names.
    """
    w = Window.partitionBy(*parent)
    level = w.orderBy(F.col("capacity") / F.col("weight"), child)
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = (Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("budget", F.least(F.col("budget"), F.sum("capacity").over(w)))
    nodes = nodes.withColumns(
        {
            "left": (F.col("budget") - F.coalesce(F.sum("capacity").over(level.rowsBetween(*so_far)), F.lit(0))).cast(BIG),
            "weights": F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast(BIG),
        }
    )
    nodes = nodes.withColumn("full", F.col("capacity").cast(BIG) * F.col("weights") <= F.col("weight").cast(BIG) * F.col("left"))
    # the level is set by the first child that is not filled up
    at = F.first(F.when(~F.col("full"), F.struct("left", "weights")), ignorenulls=True).over(level.rowsBetween(*everything))
    nodes = nodes.withColumn("at", at)
    part = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr(f"(cast(weight as {BIG}) * at.left) div at.weights"))
    nodes = nodes.withColumn("part", part.cast("long"))
    # rounding leaves less than one token for each child with room, and each of those has room for one
    room = (F.col("part") < F.col("capacity")).cast("long")
    nth = F.sum(room).over(w.orderBy(child))
    spare = F.col("budget") - F.sum("part").over(w)
    nodes = nodes.withColumn("part", F.col("part") + F.when((room == 1) & (nth <= spare), 1).otherwise(0))
    return nodes.drop("budget", "left", "weights", "full", "at").withColumnRenamed("part", "budget")


def budgets(leaves: DataFrame, levels: list[str], total: int, weights: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The budget of each leaf: `total` tokens, propagated through the tree of `levels` (outermost first).

    leaves has the levels and `capacity`, the tokens that the leaf can supply. weights[level] gives the weight of a
    child (a whole number, at least 1; 1 where nothing is said) from its name. A node takes no more than its leaves can
    supply, and its siblings share its shortage; only what they cannot use together reaches the ancestors. The tree is
    small against the corpus: one task sorts the children of one parent.
    """
    above = None
    for depth, level in enumerate(levels, 1):
        path = levels[:depth]
        weight = (weights or {}).get(level, lambda _: F.lit(1))
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(F.col(level)).cast("long"))
        if above is None:
            above = _share(nodes.withColumns({"root__": F.lit(0), "budget": F.lit(total).cast("long")}), ["root__"], level).drop("root__")
        else:
            above = _share(_null_safe(nodes, above, path[:-1]), path[:-1], level)
        above = above.drop("capacity", "weight")
    return above


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    total_share: tuple[int, int] = (1, 1),
    weights: dict[str, Callable[[Column], Column]] | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The chosen documents with all their columns, and n_tokens__, leaf_budget__, epochs__ (how often each is taken).

    levels names the tree's levels, outermost first, and says how each follows from a document. The budget is
    total_share (a fraction) of the tokens of docs. A leaf is read in a seeded order, another in each epoch and at most
    max_epochs times; its budget is a prefix of the tokens of these epochs, and a document is taken in an epoch if its
    first token lies in the prefix. So each leaf gives its budget and a part of one document more.

    The order is by md5 of seed, epoch, doc_id and text, then doc_id, then text; equal rows are taken together.
    Documents without tokens (empty and null texts) are taken with their neighbours in the order, and never in a leaf
    that has none. Null levels are a branch of their own; an empty table gives an empty result.

    The prefix's end is found in two steps: sums over 4096 ranges of the order, then the rows of the one range where
    it lies; so no task gets a leaf as a whole, and each document is judged by its leaf's end alone.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = [f"level{i}__" for i in range(len(levels))]
    text = F.col(text_col).cast("string")
    row = dict(zip(names, levels.values(), strict=True)) | {"tokens__": n_tokens(text), "id__": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "mark__": F.coalesce(F.md5(text.cast("binary")), F.lit(""))}
    light = scratch.keep(docs.select(*[c.alias(n) for n, c in row.items()]))
    leaves = scratch.keep(light.groupBy(*names).agg(F.sum("tokens__").alias("tokens")).filter("tokens > 0"))
    tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total = tokens * total_share[0] // total_share[1]
    by_name = {n: (weights or {})[k] for n, k in zip(names, levels, strict=True) if k in (weights or {})}
    shares = budgets(leaves.withColumn("capacity", F.col("tokens") * max_epochs), names, total, by_name)
    plan = _null_safe(leaves, shares, names).filter("budget > 0")
    plan = scratch.keep(plan.select(*names, F.col("budget").alias("leaf_budget__"), F.expr("budget div tokens").alias("whole__"), F.expr("budget % tokens").alias("rest__")))

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole__").cast("string"), "id__", "mark__").cast("binary"))
    placed = _null_safe(light, plan.filter("rest__ > 0"), names).withColumn("order__", order).withColumn("range__", F.substring("order__", 1, 3))
    sums = placed.groupBy(*names, "range__").agg(F.sum("tokens__").alias("sum__"), F.first("rest__").alias("rest__"))
    start = F.sum("sum__").over(Window.partitionBy(*names).orderBy("range__")) - F.col("sum__")
    last = sums.withColumn("start__", start).filter("start__ < rest__").groupBy(*names).agg(F.max_by(F.struct("range__", "start__"), "range__").alias("last__"))
    last = scratch.keep(last.select(*names, F.col("last__.range__").alias("last__"), F.col("last__.start__").alias("from__")))
    edge = _null_safe(placed, last, names).filter("range__ = last__")
    key = F.struct("order__", "id__", "mark__")
    before = F.sum("tokens__").over(Window.partitionBy(*names).orderBy("order__", "id__", "mark__").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("at__", F.col("from__") + F.coalesce(before, F.lit(0))).filter("at__ < rest__")
    ends = edge.groupBy(*names).agg(F.max(key).alias("end__"))
    plan = scratch.keep(_null_safe(plan, ends, names, "left"))

    marked = _null_safe(docs.withColumns(row), plan, names).withColumn("order__", order)
    marked = marked.withColumn("epochs__", F.col("whole__") + F.coalesce((key <= F.col("end__")).cast("long"), F.lit(0)))
    marked = marked.filter("epochs__ > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("tokens__").alias("n_tokens__"), "leaf_budget__", "epochs__")
    return marked


def budget_sql(levels: list[str], capacity: str, total: str, weights: dict[str, str]) -> str:
    """SQL (DuckDB) for `budgets`: common table expressions, the last of which is `b{number of levels}`."""
    out = []
    for i, level in enumerate(levels):
        path, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        over = f"PARTITION BY {up}" if up else ""
        joined = f"FROM (SELECT {path}, sum({capacity}) AS capacity FROM leaves GROUP BY ALL) n"
        joined += f" JOIN b{i} p ON {' AND '.join(f'n.{c} IS NOT DISTINCT FROM p.{c}' for c in levels[:i])}" if up else f", ({total}) p"
        cols = ", ".join(f"n.{c}" for c in levels[: i + 1])
        out.append(f"""n{i + 1} AS (SELECT *, least(up, sum(capacity) OVER ({over})) AS budget FROM (
  SELECT {cols}, CAST(capacity AS HUGEINT) AS capacity, CAST({weights.get(level, "1")} AS HUGEINT) AS weight, CAST(p.budget AS HUGEINT) AS up {joined})),
f{i + 1} AS (SELECT *, capacity * weights <= weight * rest AS is_full FROM (SELECT *,
  budget - coalesce(sum(capacity) OVER ({over} ORDER BY capacity / weight, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER ({over} ORDER BY capacity / weight, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM n{i + 1})),
p{i + 1} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (weight * cut.rest) // cut.weights END AS part FROM (SELECT *,
  first(CASE WHEN NOT is_full THEN {{'rest': CAST(rest AS HUGEINT), 'weights': CAST(weights AS HUGEINT)}} END IGNORE NULLS) OVER ({over} ORDER BY capacity / weight, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM f{i + 1})),
b{i + 1} AS (SELECT {path}, part + CASE WHEN part < capacity AND sum(CASE WHEN part < capacity THEN 1 ELSE 0 END) OVER ({over} ORDER BY {level} NULLS FIRST) <= budget - sum(part) OVER ({over}) THEN 1 ELSE 0 END AS budget FROM p{i + 1})""")
    return ",\n".join(out)
