"""Line dedup, mixing and the pipeline against SQL, brute force and invariants."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import queries as q
from textloom.llm.common import table
from textloom.llm.line_dedup import drop_recurring_lines
from textloom.llm.mixing import budgets, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, budget int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "clash", 3) for i, t, lang, src in rows], DOCS)


def sql(query, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name + "_", df.toPandas())
        con.sql(f"create table {name} as select * from {name}_")
    return sorted([tuple(r) for r in con.sql(query).fetchall()], key=str)


@pytest.mark.parametrize("name", ["op1_warc", "op3_decontaminate", "op5_line_dedup", "op6_mixing"])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_line_templates(spark):
    names = "ann bob cal dee eve fay gus hal ida jon kim lee".split()
    rows = [(i, f"unique opening {n} for {n} {n}\nPosted by the author {n} on May {i} in archive\nall rights reserved\n\nclosing {n}", "en", "s") for i, n in enumerate(names)]
    rows += [(50, "all rights reserved", "en", "s"), (51, None, "en", "s"), (52, "", "en", "s"), (None, "all  rights reserved\nmore", "en", "s"), (53, "x " * 60_000, "en", "s"), (50, "kept line of the same id", "en", "s")]
    got = {(r.doc_id, r.n_lines__): r for r in drop_recurring_lines(docs_of(spark, rows)).collect()}
    # the null id comes first and keeps the licence line; doc 0 keeps its template's line
    assert got[(None, 2)].text == "all  rights reserved\nmore"
    assert got[(0, 5)].text == "unique opening ann for ann ann\nPosted by the author ann on May 0 in archive\n\nclosing ann"
    assert got[(3, 5)].text == "unique opening dee for dee dee\n\nclosing dee" and got[(3, 5)].n_chars == len(got[(3, 5)].text) and got[(3, 5)].n_dropped__ == 2
    assert got[(51, 0)].text is None and got[(52, 1)].text == "" and got[(53, 1)].n_dropped__ == 0
    assert len(drop_recurring_lines(docs_of(spark, rows)).collect()) == len(rows)
    assert drop_recurring_lines(docs_of(spark, [])).count() == 0


def test_passages_recur_in_two_documents(spark):
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "qrstuvw")
    short = " ".join(passage.split()[:40])
    rows = [(1, f"one\n{passage}\n{short}", "en", "s"), (2, f"two\n{passage}\n{short}", "en", "s"), (3, f"three\n{passage} z", "en", "s")]
    df = docs_of(spark, rows)
    got = {r.doc_id: r.text for r in drop_recurring_lines(df).collect()}
    assert got == {1: rows[0][1], 2: f"two\n{short}", 3: rows[2][1]}
    assert {r.n_dropped__ for r in drop_recurring_lines(df, long_docs=10).collect()} == {0}


def test_copies_are_spared_passages_are_not(spark):
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "qrstuvw")
    rng = random.Random(3)
    own = lambda n: "\n".join(" ".join(rng.choices("abcdefghij", k=12)) for _ in range(n))
    first = own(20)
    texts = [f"{first}\n{passage}", f"{first}\n{passage}", f"{own(1)}\n{first}\n{passage}", f"{own(20)}\n{passage}", f"{passage}\n{own(30)}"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_dropped__ for r in drop_recurring_lines(docs_of(spark, rows), spare_copies=True).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    assert {r.doc_id: r.n_dropped__ for r in drop_recurring_lines(docs_of(spark, rows)).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
    # in ten documents it goes from copies as well
    rows += [(10 + i, passage, "en", "s") for i in range(6)]
    assert {r.n_dropped__ for r in drop_recurring_lines(docs_of(spark, rows), spare_copies=True).collect() if r.doc_id} == {1}


def test_lines_recur_in_different_documents(spark):
    names = "ann bob cal dee eve fay gus hal ida jon kim lee".split()
    posted = lambda who: [f"Posted by the author {n} on May 3 in archive" for n in who]
    in_two = [(1, "\n".join(["first", *posted(names[:5])]), "en", "s"), (2, "\n".join(["second", *posted(names[5:10])]), "en", "s")]
    in_list = [(3, "\n".join(posted(names[:10])), "en", "s"), (4, "\n".join(["page", *posted(names[10:11])]), "en", "s")]
    numbers = [(i, f"{i} 7{i} 12.{i}\n<*> {i} x", "en", "s") for i in range(12)]
    kept = lambda rows: {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs_of(spark, rows), "").collect()}
    for rows in (in_two, in_list, numbers):
        assert kept(rows) == {i: t for i, t, _, _ in rows}
    # in twelve documents the template goes from all but the first, and so does a line of the same numbers
    rows = [(i, f"{n}\n{posted([n])[0]}\n2024-01-01  0\nPage {i} of {i} pages in all", "en", "s") for i, n in enumerate(names)]
    assert kept(rows) == {i: t if i == 0 else names[i] for i, t, _, _ in rows}


def brute(rows, least_docs=10, long=50, long_docs=2):
    """Lines dropped of each document."""
    real = lambda t: "<*>" not in t and not any(c.isdigit() for c in t)
    forms = {}
    for i, t in rows:
        for pos, line in enumerate(t.split("\n")):
            p = line.split()
            m = ["<*>" if any(c.isdigit() for c in x) else x for x in p]
            if p:
                forms[i, pos] = tuple(p if "<*>" in " ".join(m) and sum(map(real, m)) < 0.5 * len(m) else m)
    seen, docs = {}, {}
    for (i, _), f in forms.items():
        for at in range(3, len(f)):
            seen.setdefault((len(f), f[:3], at, f[at]), set()).add(i)
    for (i, _), f in forms.items():
        stays = [real(f[at]) and len(seen[len(f), f[:3], at, f[at]]) >= least_docs for at in range(3, len(f))]
        general = not all(stays) and sum(stays) + sum(map(real, f[:3])) >= 0.5 * len(f)
        template = (True, f[:3], *(x if s else "<*>" for x, s in zip(f[3:], stays, strict=True))) if general else (False, f)
        docs.setdefault(template, {}).setdefault(i, []).append((i, _))
    gone = [place for held in docs.values() for i, places in held.items() for place in places if len(held) >= (long_docs if len(forms[place]) >= long else least_docs) and i > min(held)]
    return {i: sum(1 for j, _ in gone if j == i) for i, _ in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    heads = ["a b c", "a b d", "e", "f g 7", "4 5 6", "h " * 48 + "i"]
    lines = lambda: "\n".join(rng.choice(heads) + " " + " ".join(rng.choices(["t", "u", "v", "w", "8", "9"], k=rng.randrange(0, 5))) for _ in range(rng.randrange(1, 8)))
    rows = [(i, lines()) for i in range(120)]
    got = drop_recurring_lines(docs_of(spark, [(i, t, "en", "s") for i, t in rows]))
    assert {r.doc_id: r.n_dropped__ for r in got.collect()} == brute(rows)


def test_line_dedup_against_sql_on_random_lines(spark):
    rng = random.Random(8)
    heads = ["a b c", "a b d", "e", "f g 7", "5 6", "k " * 50]
    lines = lambda: "\n".join(rng.choice(heads) + " " + " ".join(rng.choices("tuvwxyz", k=rng.randrange(0, 4))) for _ in range(rng.randrange(1, 6)))
    df = docs_of(spark, [(i, lines(), "en", "s") for i in range(150)])
    got = drop_recurring_lines(df).select("doc_id", F.col("n_lines__").alias("n_lines"), F.col("n_dropped__").alias("n_dropped"), F.md5(F.col("text").cast("binary")))
    assert sorted([tuple(r) for r in got.collect()], key=str) == sql(q.OP5_SQL, documents=df)


def fill(children, budget):
    """Shares by raising a common level in small steps."""
    budget = min(budget, sum(c for _, c, _ in children))
    lo, hi = 0.0, budget + 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, w * mid) for _, c, w in children) < budget else (lo, mid)
    return {n: min(c, w * hi) for n, c, w in children}


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = [("x", "p", 100), ("x", "q", 10), ("x", None, 1000), ("y", "p", 5), ("y", "q", 7), (None, "r", 400)]
    df = spark.createDataFrame(leaves, "d string, s string, capacity long")
    for total in (0, 1, 50, 313, 777, 5000):
        got = {(r.d, r.s): r.budget for r in budgets(df, ["d", "s"], total, {"d": lambda c: F.when(c == "x", 3).otherwise(1)}).collect()}
        assert sum(got.values()) == min(total, 1522)
        top = fill([("x", 1110, 3), ("y", 12, 1), (None, 400, 1)], total)
        for d, share in top.items():
            mine = {s: c for e, s, c in leaves if e == d}
            assert abs(sum(got[(d, s)] for s in mine) - share) <= 1
            for s, part in fill([(s, c, 1) for s, c in mine.items()], share).items():
                assert got[(d, s)] <= mine[s] and abs(got[(d, s)] - part) <= 2


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["src1", "src1", "src1", "src6", "x", None])) for i in range(300)]
    rows += [(7, rows[7][1], rows[7][2], rows[7][3]), (None, None, "en", "src1"), (400, "", "en", "src9")]
    df = docs_of(spark, rows)
    got = mix(df, q.source_levels(), total_share=(1, 2), weights={"lang": q.lang_weight})
    assert got.columns == [*df.columns, "n_tokens__", "leaf_budget__", "epochs__"]
    leaves = got.groupBy("lang", "source").agg(F.sum(F.col("n_tokens__") * F.col("epochs__")).alias("t"), F.first("leaf_budget__").alias("b"), F.max("n_tokens__").alias("m")).collect()
    assert leaves and all(r.b <= r.t <= r.b + 2 * r.m for r in leaves)
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert sum(r.b for r in leaves) == total // 2
    again = mix(df.repartition(7), q.source_levels(), total_share=(1, 2), weights={"lang": q.lang_weight})
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    everything = mix(df, {"one": F.lit(1)}).collect()
    assert len(everything) == len(rows) and {r.epochs__ for r in everything} == {1}
    assert mix(docs_of(spark, []), q.source_levels()).count() == 0


def test_pipeline(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, sf)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.mode("overwrite").parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((before, docs.count()))
    assert all(0 < after <= before for before, after in seen) and seen[0][1] > 0.7 * seen[0][0]
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_empty_tables(spark, sf):
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
