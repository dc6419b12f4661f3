"""Line dedup with a log-template tree. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Leading tokens that lead down the tree, documents that make a template recurring, and the least share of a
#: template's tokens that stay as they are.
DEPTH, LEAST_DOCS, LEAST_SHARE = 3, 10, 0.5
#: A line of so many tokens is a passage of its own, which recurs in so few documents where lengths count.
LONG_TOKENS, LONG_DOCS = 50, 2
FIELD = "<*>"
#: Min-hashes over a document's lines, half of which copies have in common.
SKETCH = 8


def _masked(text: Column) -> Column:
    """The text with each line's tokens joined by one space, those with a digit as fields. As many lines as before."""
    # each step's result is used more than once, so it is bound to a name
    return _let(_spaces(text), lambda a: _let(_single(a), lambda b: _let(F.trim(_tight(b)), _fields)))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _spaces(text: Column) -> Column:
    # to look for a byte is much cheaper than to translate every character
    other = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    return F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _single(text: Column) -> Column:
    return F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def _tight(text: Column) -> Column:
    return F.when(text.contains(" \n") | text.contains("\n "), F.regexp_replace(text, " \n ?|\n ", "\n")).otherwise(text)


def _fields(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)).otherwise(text)


def _key(masked: Column) -> Column:
    """128 bits, so that different lines do not meet."""
    return F.struct(F.xxhash64(masked).alias("k1"), F.xxhash64(F.lit(7), masked).alias("k2"))


def _leaf(masked: Column) -> Column:
    """The tree's leaf: token count and leading tokens."""
    return F.xxhash64(F.regexp_count(masked, F.lit(" ")), F.substring_index(masked, " ", DEPTH))


def _constants(tokens: Column) -> Column:
    """Tokens that are neither fields nor hold a digit."""
    return F.size(F.filter(tokens, _constant))


def _constant(token: Column) -> Column:
    return ~token.contains(FIELD) & ~token.rlike("[0-9]")


def _apart(text: Column, masked: Column) -> Column:
    """The masked lines, but those of which less than LEAST_SHARE is constant with their values."""
    plain = _let(_spaces(text), lambda a: _let(_single(a), lambda b: F.split(F.trim(_tight(b)), "\n")))

    def line(m: Column, p: Column) -> Column:
        return F.when(m.contains(FIELD), _let(F.split(m, " "), lambda t: F.when(_constants(t) < LEAST_SHARE * F.size(t), p).otherwise(m))).otherwise(m)

    return _let(F.split(masked, "\n"), lambda m: F.when(text.rlike("[0-9]") | text.contains(FIELD), F.zip_with(m, plain, line)).otherwise(m))


def recurring_lines(lines: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """k1, k2 (of a masked line), t1, t2 (its template) and least for all templates that can recur.

    lines has id__, line (masked, not blank), leaf, k1, k2 and long (LONG_TOKENS tokens or more). A line descends by its
    token count and first DEPTH tokens to a leaf. There a constant token is kept where it stands if at least least_docs
    different documents have it at this place in a line of the leaf, and is a field otherwise; a template of which less
    than LEAST_SHARE is constant is too general, and the line then is its own template. `least` is how many different
    documents make the template recur; they are counted where the caller meets the lines again, as what is summed up
    here is an upper bound.
    """
    least = F.when(F.col("long"), long_docs).otherwise(least_docs)
    distinct = scratch.keep(lines.groupBy("leaf", "k1", "k2", "long").agg(F.count("*").alias("docs")))
    leaves = distinct.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("leaf_lines"))
    # in other leaves no template recurs, or the one line is the template
    leaves = leaves.filter((F.col("leaf_docs") >= least_docs) & (F.col("leaf_lines") > 1)).select("leaf")
    held = scratch.keep(lines.select("id__", "leaf", "k1", "k2", "line").join(leaves, "leaf"))
    mixed = held.groupBy("leaf", "k1", "k2", "line").agg(F.count_distinct("id__").alias("docs"))
    head = _constants(F.slice(F.split("line", " "), 1, DEPTH)).alias("head")
    mixed = mixed.select("leaf", "k1", "k2", "docs", head, F.slice(F.split("line", " "), DEPTH + 1, 2**31 - 1).alias("rest")).filter(F.size("rest") > 0)
    tokens = scratch.keep(mixed.select("leaf", "k1", "k2", "docs", "head", F.posexplode("rest").alias("pos", "token")))
    stable = _stable(tokens, held, least_docs).withColumn("stays", F.lit(True))
    placed = tokens.join(stable, ["leaf", "pos", "token"], "left").groupBy("leaf", "k1", "k2", "head").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("stays"), F.col("token")).otherwise(FIELD).alias("token")))).alias("found"), F.count("stays").alias("n_kept"), F.count("*").alias("n")
    )
    general = placed.filter((F.col("n_kept") < F.col("n")) & (F.col("n_kept") + F.col("head") >= LEAST_SHARE * (F.col("n") + DEPTH)))
    general = scratch.keep(general.select("k1", "k2", F.xxhash64("leaf", "found.token").alias("t1"), F.xxhash64(F.lit(7), "leaf", "found.token").alias("t2")))
    # all other lines are templates of their own
    own = distinct.filter(F.col("docs") >= least).join(general.select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", F.col("k1").alias("t1"), F.col("k2").alias("t2"), least.alias("least"))
    # lines of one template have one number of tokens
    named = distinct.join(general, ["k1", "k2"]).select("k1", "k2", "t1", "t2", "docs", least.alias("least"))
    sums = named.groupBy("t1", "t2", "least").agg(F.sum("docs").alias("n")).filter(F.col("n") >= F.col("least")).select("t1", "t2")
    return scratch.keep(own.union(named.join(sums, ["t1", "t2"]).select("k1", "k2", "t1", "t2", "least")))


def _stable(tokens: DataFrame, held: DataFrame, least_docs: int) -> DataFrame:
    """leaf, pos, token of the constant tokens that so many different documents hold there. Only where no line alone is
    in enough are the documents of all lines brought together."""
    at = ["leaf", "pos", "token"]
    found = tokens.filter(_constant(F.col("token"))).groupBy(*at).agg(F.sum("docs").alias("n"), F.max("docs").alias("most")).filter(F.col("n") >= least_docs)
    unsure = tokens.join(found.filter(F.col("most") < least_docs).select(*at), at).select(*at, "k1", "k2")
    counted = unsure.join(held.select("id__", "k1", "k2"), ["k1", "k2"]).groupBy(*at).agg(F.count_distinct("id__").alias("n"))
    return found.filter(F.col("most") >= least_docs).select(*at).union(counted.filter(F.col("n") >= least_docs).select(*at))


def _sketch(lines: Column) -> Column:
    """The least of the lines' hashes in each of SKETCH orders."""

    def least(hashes: Column, order: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.xxhash64(F.lit(order)))))

    return _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.array(*[least(h, i) for i in range(SKETCH)]))


def _alike(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"])) * 2 >= SKETCH


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, long_docs: int = LONG_DOCS, spare_copies: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its own columns and n_lines__, n_dropped__ (int): without the lines of recurring templates.

    Lines end at \\n. A template recurs if least_docs different documents hold it, or long_docs where it has LONG_TOKENS
    tokens and more; see recurring_lines for what a template is. Lines of which less than LEAST_SHARE is constant, such
    as rows of numbers, recur only with their values. A template's lines stay in the document with the least doc_id that
    holds one, so nothing is lost altogether, and go from all others; blank lines stay. With spare_copies, templates of
    fewer than least_docs documents go only from documents that are otherwise different from that first one: half of
    SKETCH min-hashes over their lines differ. So copies stay whole for an operator that looks for them.

    Texts that lose no line are left as they are; n_chars, where docs has it, is counted anew for the others. A null text
    stays null and has no lines. Null ids are one document, which comes before any other. Rows with one doc_id are one
    document with several texts, told apart by their text, and equal rows are treated alike. An empty table gives an
    empty result. Columns of docs may have any name that does not end in two underscores.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    # stands for the null id, below all others
    low = F.lit(-(2**63))
    text = F.col(text_col).cast("string")
    split = F.split(text, "\n")
    id_ = F.coalesce(F.col(id_col).cast("long"), low)
    sketch = [_sketch(F.filter(F.col("masked"), lambda x: x != "")).alias("sketch")] if spare_copies else []
    masked = docs.select(id_.alias("id__"), F.xxhash64(text).alias("mark__"), _apart(text, _masked(text)).alias("masked"))
    # the outer form, as the plain one puts a filter before it that finds the lines a second time
    lines = masked.select("id__", "mark__", *sketch, F.posexplode_outer("masked").alias("pos", "line")).filter("line <> ''")
    lines = lines.select("id__", "mark__", *[c for c in ("sketch",) if sketch], "pos", "line", _leaf(F.col("line")).alias("leaf"), _key(F.col("line")).alias("key"), (F.regexp_count("line", F.lit(" ")) >= LONG_TOKENS - 1).alias("long"))
    lines = scratch.keep(lines.select("*", "key.k1", "key.k2").drop("key"))
    facts = recurring_lines(lines, scratch, least_docs, long_docs)

    places = scratch.keep(lines.join(facts, ["k1", "k2"]).select("id__", "mark__", *[c for c in ("sketch",) if sketch], "pos", "t1", "t2", "least"))
    first = [F.min_by("sketch", "id__").alias("first_sketch")] if sketch else []
    counted = places.groupBy("t1", "t2", "least").agg(F.count_distinct("id__").alias("n"), F.min("id__").alias("first_id"), *first).filter(F.col("n") >= F.col("least"))
    places = places.drop("least").join(counted.drop("least"), ["t1", "t2"]).filter(F.col("id__") > F.col("first_id"))
    if sketch:
        places = places.filter((F.col("n") >= least_docs) | ~_alike(F.col("sketch"), F.col("first_sketch")))
    dropped = places.groupBy("id__", "mark__").agg(F.collect_set("pos").alias("dropped__"))

    names = docs.columns
    # dropped grows with the corpus, so it is never sent to all executors
    marked = docs.withColumns({"id__": id_, "mark__": F.xxhash64(text)}).join(dropped.hint("merge"), ["id__", "mark__"], "left")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("dropped__", i)), "\n")
    new = F.when(F.col("dropped__").isNull(), text).otherwise(left)
    out = marked.withColumns({"n_lines__": F.coalesce(F.size(split), F.lit(0)), "n_dropped__": F.coalesce(F.size("dropped__"), F.lit(0)), text_col: new})
    out = out.withColumns({c: F.when(F.col(c) < 0, 0).otherwise(F.col(c)) for c in ("n_lines__", "n_dropped__")})
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped__") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names], "n_lines__", "n_dropped__")
