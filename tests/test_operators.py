"""Operators against hand-computed values, plain Python and SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx
from textloom.functions import text as tx
from textloom.operators import aspects as asp
from textloom.operators import cluster as cl
from textloom.operators import labels as lb
from textloom.operators import quality as ql
from textloom.operators import tfidf as tf
from textloom.plans import catalog
from textloom.plans.analysis import Options, analyze
from textloom.sources.items import detect_text_column, parse_options, read_csv, single_text
from textloom.sources.runs import RunStore
from textloom.streaming import stream_aspects, stream_sentiment

REVIEWS = [
    (1, "The app crashes every time I upload a file, and support never replied to my ticket. Setup was easy and intuitive!"),
    (2, "Great steak and the dessert was amazing, but we waited an hour for the bill. The waiter was rude."),
    (3, "El servicio fue excelente pero muy caro; no vale la pena. La comida llegó rápida."),
    (4, "Nothing matches here whatsoever folks."),
    (5, "ok"),
    (6, None),
]


@pytest.fixture(scope="module")
def granules(spark):
    return asp.granulate(spark.createDataFrame(REVIEWS, "doc_id long, text string")).cache()


def test_granules(granules):
    rows = {(r.doc_id, r.unit_pos): r for r in granules.collect()}
    assert {d: {r.taxonomy for (i, _), r in rows.items() if i == d} for d in (1, 2, 3)} == {1: {"saas"}, 2: {"restaurant"}, 3: {"general"}}
    assert [rows[(1, i)].aspect for i in range(3)] == ["RELIABILITY_STABILITY", "CUSTOMER_SUPPORT_SERVICE", "USABILITY_UX"]
    assert [rows[(2, i)].aspect for i in range(4)] == ["FOOD_QUALITY", "FOOD_QUALITY", "WAIT_TIME", "SERVICE"]
    assert rows[(4, 0)].aspect == "OTHER" and {r.sentiment for r in rows.values()} == {"positive", "negative", "neutral"}
    assert rows[(2, 2)].confidence >= 0.75 and all(len(r.evidence) <= 6 for r in rows.values())
    assert {d for d, _ in rows} == {1, 2, 3, 4}


def test_similarity_against_plain_python(spark, granules):
    """The inverted-index cosine with corrected norms, against vectors over all seeds and units of one document."""
    units = [r.excerpt for r in granules.filter("doc_id = 2").orderBy("unit_pos").collect()]
    seeds = []
    for aspect, words in lx.RESTAURANT.items():
        if aspect != "OTHER":
            plain = list(dict.fromkeys(w.replace("ñ", "n").replace("ú", "u") for w in words))
            seeds += [(aspect, w) for w in plain] + ([(aspect, " ".join(plain[:12]))] if len(plain) >= 3 else [])
    import re

    def grams(t):
        w = [x for x in re.findall(tx.TOKEN, t.lower()) if x not in lx.STOP_WORDS]
        return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [grams(t) for _, t in seeds] + [grams(u) for u in units]
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    vectors = []
    for d in docs:
        v = {t: (1 + math.log(d.count(t))) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(d)}
        n = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({t: x / n for t, x in v.items()})
    for i, r in enumerate(granules.filter("doc_id = 2").orderBy("unit_pos").collect()):
        u = vectors[len(seeds) + i]
        best = max(sum(u.get(t, 0) * x for t, x in vectors[j].items()) for j, (a, _) in enumerate(seeds) if a == r.aspect)
        assert r.similarity == pytest.approx(best, abs=1e-4)


def test_custom_taxonomies(spark):
    docs = spark.createDataFrame(REVIEWS, "doc_id long, text string")
    assert {r.aspect for r in asp.granulate(docs, {" food ": ["steak", "dessert"], "": ["x"], "b": ["  "]}).collect()} <= {"FOOD", "OTHER"}
    assert {r.aspect for r in asp.granulate(docs, {"other": ["x"]}).collect()} == {"OTHER"}
    assert asp.custom_taxonomy({}) is lx.GENERAL


def test_aggregates(granules):
    rows = asp.aspect_aggregate(granules).collect()
    assert sum(r["count"] for r in rows) == granules.filter("aspect <> 'OTHER'").count()
    assert all(abs(r.positive + r.negative + r.neutral - 1) < 0.002 and len(r.top_evidence) <= 3 for r in rows)
    summary = asp.document_summary(granules)
    assert summary.filter("doc_id = 2").count() == len(lx.RESTAURANT) - 1
    assert max(r.n for r in asp.highlights(granules).groupBy("doc_id").agg(F.count("*").alias("n")).collect()) <= 3
    assert asp.other_rate(granules).filter("doc_id is null").first().n_granules == granules.count()


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.weight for r in tf.tfidf(tf.term_frequencies(docs, F.split("text", " ")), 2).collect()}
    a, b = 2 * 1.0, math.log(3 / 2) + 1
    assert got[(1, "a")] == pytest.approx(a / math.hypot(a, b)) and sum(v * v for (d, _), v in got.items() if d == 2) == pytest.approx(1)


def test_ward_and_cut():
    points = np.array([[0.0], [1.0], [10.0], [12.0], [100.0]])
    links = cl.ward(points)
    assert links[0][:2].tolist() == [0, 1] and links[0][2] == pytest.approx(1) and links[1][2] == pytest.approx(2) and links[-1][3] == 5
    assert links[2][2] == pytest.approx(math.sqrt(2 * 2 * 2 / 4 * 10.5**2))
    assert cl.cut(links, 5, 3) == [0, 0, 1, 1, 2] and cl.cut(links, 5, 1) == [0] * 5 and cl.cut(np.empty((0, 4)), 1, 3) == [0]


@pytest.mark.parametrize("exact", [2000, 5])
def test_hierarchy_reaches_every_leaf(spark, monkeypatch, exact):
    monkeypatch.setattr(cl, "EXACT_ITEMS", exact)
    monkeypatch.setattr(cl, "CENTRES", 4)
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(20)], "id long, v array<double>")
    assigned, nodes = cl.hierarchy(items, "id", "v", 3)
    assert assigned.count() == 20 and nodes.filter("parent_id is null").count() == 1
    root = nodes.filter("parent_id is null").first().node_id
    assert cl.node_members(nodes, "id").filter(F.col("node_id") == root).count() == 20


def test_labels(spark):
    df = spark.createDataFrame([(["shipping delay", "courier"],), (["blue whale song", "other"],), ([],)], "t array<string>")
    assert [r.v for r in df.select(lb.label_from_terms(F.col("t")).alias("v")).collect()] == ["Delivery Delay", "Blue Whale Song", "Customer Request"]
    found = df.select(lb.candidate_labels(F.col("t")).alias("v")).first().v
    assert found[0] == "Shipping Delay" and len(found) == len({x.lower() for x in found})
    one = spark.createDataFrame([('text {"label": "Shipping Issue", "confidence": 0.9} end',)], "a string").select(lb.parse_answer(F.col("a")).alias("v")).first().v
    assert (one.label, one.confidence) == ("Shipping Issue", 0.9)


def test_labeller_budget_and_cache(spark):
    row = {"terms": ["shipping late"], "candidates": ["Shipping", "Refund"], "fallback": "F"}
    cache = {}
    assert lb.label_rows(spark, [row], lambda r: {"label": "Shipping", "confidence": 0.9}, cache) == ["Shipping"]
    assert lb.label_rows(spark, [row], None, cache) == ["Shipping"]
    # no word of the keywords, then a strict second answer
    assert lb.label_rows(spark, [row], lambda r: {"label": "Shipping" if r.get("strict") else "Refund", "confidence": 0.9}, {}) == ["Shipping"]
    assert lb.label_rows(spark, [row], lambda r: {"label": "Refund", "confidence": 0.9}, {}) == ["F"]
    calls = []

    def broken(r):
        calls.append(1)
        raise ValueError("no JSON")

    assert lb.label_rows(spark, [{**row, "terms": [str(i)]} for i in range(3)], broken, {}) == ["F"] * 3 and len(calls) == 1


def test_quality(spark):
    df = spark.createDataFrame([("same  text", "a"), ("Same text", "b"), ("X1 Y2 Z3", ""), (None, None)], "text string, clean string")
    r = ql.quality_figures(df).first()
    assert r.n == 4 and r.duplicate_ratio == pytest.approx(1 / 3) and r.short_ratio == 1.0 and r.code_ratio == pytest.approx(3 / 7)
    assert ql.quality_warnings(ql.quality_figures(df)).count() == 4
    assert ql.quality_warnings(ql.quality_figures(df.limit(0))).count() == 0


def test_sources(spark, tmp_path):
    assert detect_text_column(["id", "Transcript", "review"]) == "Transcript" and detect_text_column(["label"]) is None
    (tmp_path / "a.csv").write_bytes('﻿id,Text,kind\n1,"two\nlines ""quoted""",x\n2,   ,y\n3,last, z  z \n'.encode())
    rows = read_csv(spark, str(tmp_path / "a.csv")).orderBy("item_idx").collect()
    assert [(r.id, r.text) for r in rows] == [("item_0", 'two\nlines "quoted"'), ("item_1", "last")] and rows[1].metadata == {"id": "3", "kind": "z z"}
    (tmp_path / "b.csv").write_bytes("text\nca\xf1a\n".encode("latin-1"))
    assert read_csv(spark, str(tmp_path / "b.csv")).first().text == "caña"
    (tmp_path / "c.csv").write_text("label\nx\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError):
        single_text(spark, "  ")
    with pytest.raises(ValueError):
        parse_options("[1]")


def test_options():
    got = Options.parse({"k_clusters": 500, "granulate_max_rows": True, "granulate_per_cluster": "yes", "umap_scale_clamp": "x", "llm_label_budget": -5, "preview_char_limit": "130"})
    assert (got.k_clusters, got.granulate_max_rows, got.granulate_per_cluster, got.umap_scale_clamp, got.llm_label_budget, got.preview_char_limit) == (64, 200, True, 3.0, 0, 130)


def test_analysis(spark, tmp_path):
    texts = [t for _, t in REVIEWS if t] * 4
    rows = [(i, f"item_{i}", t, t[:140], {"kind": "k"}) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "item_idx long, id string, text string, preview string, metadata map<string,string>")
    store = RunStore(spark, str(tmp_path / "runs"))
    out = analyze(items, Options(k_clusters=3, granulate_per_cluster=True), store=store, run_id="r1")
    assert out.clusters.agg(F.sum("size")).first()[0] == len(rows) and out.map.count() == len(rows)
    assert store.status("r1")["status"] == "completed" and store.recent().first().item_count == len(rows)
    nodes = store.load("r1", "nodes")
    assert nodes.filter("label is not null").count() == nodes.filter("item_idx is null").count() and store.load("r1", "timings").count() == 8
    assert store.load("r1", "embeddings").count() == len(rows) and store.aspect_payload("r1")[1] is None
    assert 3 <= store.load("r1", "insights").count() <= 6 and store.load("r1", "aspects_per_cluster").count() > 0
    assert store.status("unknown")["status"] == "queued"
    with pytest.raises(RuntimeError):
        store.require_completed("unknown")


def test_deep_trees_and_groups_of_copies(spark):
    chain = [("leaf", "n0", 7)] + [(f"n{i}", f"n{i + 1}" if i < 99 else None, None) for i in range(100)]
    nodes = spark.createDataFrame(chain, "node_id string, parent_id string, item long")
    assert cl.node_members(nodes, "item").count() == 101
    with pytest.raises(ValueError):
        cl.node_members(spark.createDataFrame([("a", "b", None), ("b", "a", 1)], "node_id string, parent_id string, item long"), "item").count()
    # thirty copies are nearest; other texts follow far behind
    rows = [(i, "g", float(i), "same words here") for i in range(30)] + [(100 + i, "g", 100.0 + i, f"other {w} text") for i, w in enumerate("abcd")] + [(200, "h", 1.0, "lone"), (201, "h", 2.0, "lone")]
    df = spark.createDataFrame(rows, "id long, c string, d double, t string")
    got = {r.c: r.representatives for r in cl.representatives(df, "id", "c", "d", F.col("t"), n=5, keep=10).collect()}
    assert got == {"g": [0, 100, 101, 102, 103], "h": [200, 201]}
    assert {r.c: r.representatives for r in cl.representatives(df, "id", "c", "d", F.col("t"), n=5, fill=False).collect()} == {"g": [0, 100, 101, 102, 103], "h": [200]}
    docs = spark.createDataFrame([("g", " ".join(["refund billing"] * 9)), ("g", "shipping outage warranty")], "g string, text string")
    few, all_ = (tf.summary_terms(docs, "g", n=3, keep=k).first().terms for k in (1, 60))
    assert few == all_ and len(all_) == 3


def test_project_models(spark):
    from textloom.operators import project as pj

    rng = np.random.default_rng(3)
    words = ["delivery courier parcel late", "battery charge power phone", "refund invoice money card"]
    rows = [(i, " ".join(rng.permutation(words[i % 3].split()))) for i in range(60)] + [(60, "  "), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pj.train_project(docs, k_max=5)
    points, clusters, stats = pj.project_results(model, docs.filter("doc_id < 60"))
    by = {r.doc_id: r.cluster_id for r in points.collect()}
    assert len({by[i] for i in (0, 1, 2)}) == 3 and all(by[i] == by[i % 3] for i in range(60))
    assert stats.first().asDict() == {"n_texts": 60, "n_clusters": 3} and sum(r["size"] for r in clusters.collect()) == 60
    one = pj.classify(model, spark.createDataFrame([(5, "my parcel is late, says the courier")], "doc_id long, text string")).first()
    assert one.cluster_id == by[0] and one.confidence_margin > 0 and one.cluster_label.count(" / ") == 2
    assert pj.classify(model, docs.filter("doc_id >= 60")).count() == 2
    with pytest.raises(ValueError):
        pj.train_project(docs.filter("doc_id = 3 or doc_id = 60"))


def test_evaluation_cases(spark, tmp_path):
    from textloom.sources.items import read_cases

    (tmp_path / "cases.json").write_text('[{"test_number": 7, "input_text": "The app crashes and the waiter was rude."}, {"input_text": "ok then folks, nothing here"}, {"input_text": " "}]')
    per_case, chosen = asp.evaluate(read_cases(spark, str(tmp_path / "cases.json")))
    rows = {r.test_number: r for r in per_case.collect()}
    assert set(rows) == {7, 2, None} and rows[None].n_granules == rows[7].n_granules + rows[2].n_granules
    assert sum(r.n_cases for r in chosen.collect()) == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame(REVIEWS, "doc_id long, text string").withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream_aspects(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/granules")).count() == 11
    q = stream_sentiment(stream, "ts").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n_units) from windows").first()[0] == 11


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "events", "embeddings", "labels", "conversations", "region", "nation", "supplier"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(str([round(float(x), 5) if isinstance(x, float) else x for x in r]) for r in rows)
    a, b = key(tuple(r) for r in got.select(*want.columns).collect()), key(want.fetchall())
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 0
    assert a
