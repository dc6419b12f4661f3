"""Document fingerprints by winnowing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a gram and grams of a window: a common passage of K + WINDOW - 1 code points is always seen.
K, WINDOW = 12, 16
#: Grams that are hashed together; bounds what a long text holds in memory at once.
CHUNK = 1 << 14
#: A key is the hash's lower 47 bits, then the bytes from the gram to the last one of its chunk, so that the least key is
#: the least hash and, of equal ones, the rightmost.
POSITION_BITS = 17
LOW = (1 << POSITION_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<pos:int, hash:long>> by position: of each window of grams the one of least hash, the rightmost of
    equal ones; each chosen gram once. Positions are code points from 0.

    Windows are compared by 47 bits of the hash; what is chosen has all 64. A text of fewer than k code points, but not
    none, has its whole as the one gram; one of fewer than `window` grams is one window. Null and empty texts have no
    fingerprint (an empty array). Any text goes whose UTF-32 form fits a binary value (2 GB).
    """
    if window & (window - 1) or 4 * (CHUNK + window) > LOW:
        raise ValueError("the window must be a power of two, and its bytes with those of a chunk fit POSITION_BITS")
    none = F.expr("cast(array() as array<struct<pos:int,hash:bigint>>)")

    def least(keys: Column) -> Column:
        """The least key of each window: windows of four times the width from four of a fourth of it, over and over."""

        def wider(width: int, times: int):
            return lambda ks: F.transform(ks, lambda x, i: F.least(x, *[F.get(ks, i + width * n) for n in range(1, times)]))

        width = 1
        while width < window:
            times = min(4, window // width)
            keys = _let(keys, wider(width, times))
            width *= times
        return keys

    def between(b: Column, first: Column, last: Column, few: bool) -> Column:
        """The places that the windows over the grams from first to last choose; all these grams are one window if they
        are few."""
        # in four-byte code points, from the last gram back to the first
        keys = _let(last * 4 + 1, lambda c: F.transform(F.sequence(F.lit(0), (last - first) * 4, F.lit(4)), lambda e: F.shiftleft(F.xxhash64(F.substring(b, c - e, F.lit(4 * k))), POSITION_BITS).bitwiseOR(e.cast("long"))))
        if few:
            keys = F.array(F.array_min(keys))
        else:
            keys = F.array_distinct(F.slice(least(keys), F.lit(1), last - first - (window - 2)))
        # windows further left choose further left, so this is in order of position
        return F.reverse(F.transform(keys, lambda x: last - F.shiftright(x.bitwiseAND(LOW), 2).cast("int")))

    def chosen(b: Column, grams: Column) -> Column:
        starts = F.sequence(F.lit(0), grams - window, F.lit(CHUNK))
        many = F.flatten(F.transform(starts, lambda s: _let(F.least(s + (CHUNK + window - 2), grams - 1), lambda last: between(b, s, last, False))))
        found = F.when(grams < window, between(b, F.lit(0), F.greatest(grams, F.lit(1)) - 1, True)).otherwise(F.array_distinct(many))
        # the few grams that are chosen get a hash of full width
        return F.transform(found, lambda p: F.struct(p.alias("pos"), F.xxhash64(F.substring(b, p * 4 + 1, F.lit(4 * k))).alias("hash")))

    def bound(b: Column) -> Column:
        grams = (F.octet_length(b) / 4).cast("int") - (k - 1)
        return F.when(F.octet_length(b) > 0, _let(grams, lambda g: chosen(b, g))).otherwise(none)

    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), bound)


def spliced(fingerprint: Column, edited: Column, same: Column, k: int = K, window: int = WINDOW) -> Column:
    """winnow(edited), where the first `same` code points are those of the text with that fingerprint.

    A gram is chosen or not by the windows that hold it. Up to the start of the last window inside the common part
    these are the same; from there on they lie in the text from window - 2 code points before.
    """

    def joined(last: Column, start: Column) -> Column:
        kept = F.filter(fingerprint, lambda x: x["pos"] <= last)
        fresh = winnow(F.substring(edited, start + 1, F.lit(2**31 - 1)), k, window)
        moved = F.transform(fresh, lambda x: F.struct((x["pos"] + start).alias("pos"), x["hash"].alias("hash")))
        return F.concat(kept, F.filter(moved, lambda x: x["pos"] > last))

    # bound to names: lengths of texts are not to be taken again for every gram
    return _let(same - (k + window - 1), lambda last: _let(F.greatest(F.lit(0), last + 2 - window), lambda start: joined(last, start)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    # (sizes of both, size of the intersection), each found once
    sizes = _let(a, lambda x: _let(b, lambda y: F.struct((F.size(x) + F.size(y)).alias("all"), F.size(F.array_intersect(x, y)).alias("both"))))
    return _let(sizes, lambda s: F.when(s["all"] > 0, s["both"] / (s["all"] - s["both"])).otherwise(1.0))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def said(fingerprint: Column) -> Column:
    """hash (hexadecimal) and position of each gram: `hash:pos,hash:pos`."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.hex(x["hash"]), x["pos"].cast("string"))), ",")


def ranges_of(docs: DataFrame, key: str, mark: Column, rows: int = 1000, most: int = 256) -> Column:
    """The number of the range of the key (long) in which a row lies, in the key's order. Rows without a key come below
    all others, in descending order of three hexadecimal digits of mark.

    Ranges hold about `rows` rows, or more if that took above most * most of them. Their borders are approximate
    quantiles that are found once, so a task that runs again sees the same ranges. A row is placed among `most` outer
    borders, then among those inside.
    """
    n = docs.count()
    outer = max(1, min(most, round((n / rows) ** 0.5)))
    inner = max(1, min(most, -(-n // (rows * outer))))
    parts = outer * inner
    cuts = sorted({int(x) for x in docs.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    groups = [cuts[i : i + inner] for i in range(0, len(cuts), inner)]
    id_ = F.col(key).cast("long")

    def below(numbers: Column) -> Column:
        return F.size(F.filter(F.split(numbers, ",").cast("array<bigint>"), lambda c: c < id_))

    if not cuts:
        number = F.lit(0)
    else:
        at = below(F.lit(",".join(str(g[-1]) for g in groups)))
        fine = F.element_at(F.split(F.lit(";".join([*(",".join(map(str, g)) for g in groups), str(2**63 - 1)])), ";"), at + 1)
        number = at * (inner + 1) + below(fine)
    return F.when(id_.isNull(), -1 - F.conv(F.substring(mark, 1, 3), 16, 10).cast("int")).otherwise(number).cast("int")


def fingerprint_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the document's, its last third replaced by the first code points of the next document in
    descending order of doc_id (of the first, for the last). Null texts are empty. Rows of one doc_id follow each other
    in the order of their texts' md5, null ids come last, a single document is its own next, and an empty table gives
    an empty result. Other columns are ignored.

    The rows are dealt out by ranges of doc_id (without an id, of the md5). Behind its own rows each range gets a copy
    of the row with which the next range starts. The driver sees one row for each range, 69888 at most, and never a text.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mark = F.md5(F.col("text").cast("binary"))
    base = base.withColumn("range__", ranges_of(base.select("doc_id"), "doc_id", mark))
    first = F.min(F.struct((-F.col("doc_id")).alias("minus"), mark.alias("mark"))).alias("first")
    starts = [(r.range__, r.first["minus"], r.first["mark"]) for r in base.groupBy("range__").agg(first).collect()]
    starts.sort(key=lambda s: -s[0])
    # each range's follower is the next lower one; the first follows the last
    follower = [(*starts[(i + 1) % len(starts)], s[0]) for i, s in enumerate(starts)]
    follower = F.broadcast(spark.createDataFrame(follower, "of int, minus long, mark string, to int"))
    same = (F.col("range__") == F.col("of")) & F.col("minus").eqNullSafe(-F.col("doc_id")) & (mark == F.col("mark"))
    guests = base.join(follower, same).select("doc_id", "text", F.col("to").alias("range__"), F.lit(1).alias("guest")).dropDuplicates(["range__"])

    rows = base.withColumn("guest", F.lit(0)).unionByName(guests).repartition("range__")
    rows = rows.withColumns({"mark": mark, "fp": winnow(F.col("text"), k, window)})
    w = Window.partitionBy("range__").orderBy("guest", F.col("doc_id").desc_nulls_last(), "mark")
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).filter("guest = 0")
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.withColumn("edited_fp", spliced(F.col("fp"), F.col("edited"), n - third, k, window))
    own = hashes(F.col("fp"))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), said(F.col("fp")).alias("fingerprint"), said(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_fp"))).alias("near_edited"), likeness(own, hashes(F.col("next_fp"))).alias("near_next"),
    )
