"""WARC, secrets, decontamination, language identification, HTML and toxicity against brute force or known answers."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate as dec
from textloom.llm.common import Scratch, held_out, shared_dir
from textloom.llm.decontaminate import SuffixAutomaton, contamination, decontaminate
from textloom.llm.html_text import extract_text, page_texts
from textloom.llm.language_id import CHUNK, grams, identify_languages
from textloom.llm.secrets import LOWER, UPPER, SecretModel, find_secrets, ordinary_samples, random_samples, secret_report
from textloom.llm.toxicity import ToxicityModel, toxicity
from textloom.llm.warc import archive_report, parse_record, read_records, write_archives

PAGES = "page_id long, url string, html string, payload string"
DOCS = "doc_id long, text string, lang string, source string, label int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/ 2\n", "<p>é</p>"), (5, None, None), (4, "u", ""), (3, "v", "x" * 200_000), (None, "w", "null id"), (6, "w", "twice"), (6, "w", "twice")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    want = []
    for i, _, h in rows:
        same = [p for p, _, g in rows if (g or "") == (h or "") and p is not None]
        top = max(same, default=None)
        revisit = top is not None and i != top
        raw = (h or "").encode()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, [tuple(r) for r in archive_report(df).collect()])) == sorted(map(str, want))
    assert archive_report(df.limit(0)).count() == 0


def test_warc_reads_ranges_of_an_index(spark):
    scratch, folder = Scratch(spark, "t"), shared_dir(spark) + "/warc-test"
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 7}" * (i % 7 * 50), "") for i in range(60)], PAGES)
    index = write_archives(df, folder, scratch, least_bytes=100)
    assert index.count() == 60
    found = {r.page_id: r for r in read_records(index.filter("page_id % 3 = 0"), folder).collect()}
    assert sorted(found) == list(range(0, 60, 3))
    small = [r for r in found.values() if r.payload_bytes < 100]
    assert small and all(r.record_type == "response" for r in small)
    assert bytes(found[57].payload).decode() == "page 1" * 50 and found[3].refers_to == 59
    with pytest.raises(ValueError):
        import gzip

        parse_record(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Payload-Digest: sha1:AA\r\nContent-Length: 5\r\n\r\na\r\n\r\nb\r\n\r\n"))


def test_secrets(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    odd = "".join(rng.choices("0123456789abcdefABCDEFXYZ", k=32))
    rows = [(i, f"some ordinary words about the weather token = \"{h}\" and more") for i, h in enumerate(hexes)]
    rows += [(100, None), (101, ""), (102, "password=short token=secret: abcdefghijklmnop"), (103, "x AKIA" + "A1" * 8 + " AKIA12 " + "f" * 16), (104, f"say {odd} or abcdefghijklmnopqrstuvwx or 4111111111111111"), (105, "éé API-KEY apikey='" + "k" * 12 + "'"), (105, "ſecret=abcdefghijklmnop"), (106, "word " * 50_000 + "passwd: 123456789012")]

    def base(text):
        out = []
        text = text or ""
        for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
            out += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        return sorted(out)

    found = sorted([tuple(r) for r in secret_report(docs_of(spark, rows)).collect()], key=str)
    want = []
    for i, t in rows:
        s = base(t)
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *[sum(x[1] == k for x in s) for k in range(3)], hashlib.sha256(line.encode()).hexdigest()))
    assert [r[:5] for r in found] == sorted(want, key=str)
    by = {r[0]: r for r in found}
    assert by[104][5] == f"markov:4:{4 + len(odd)},hex:68:84" and by[104][6] == 1
    assert sum(r[6] for r in found) == 1
    assert secret_report(docs_of(spark, [])).count() == 0


def test_secret_models_on_held_out_samples(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = SecretModel.fit(docs)
    rng = random.Random(77)
    found = [model.ratio(x) >= model.threshold for x in random_samples(1800, rng)]
    words = sorted({w for r in docs.collect() for w in (r.text or "").split() if w.isascii() and w.isalpha()})
    wrong = [model.ratio(x) >= model.threshold for x in ordinary_samples(words, 2000, rng)]
    assert sum(found) >= 0.99 * len(found) and sum(wrong) <= 0.005 * len(wrong)
    # keys that no fixed pattern has: letters alone, one of few characters, and what is left beside a base span
    letters, short = "".join(rng.choices(LOWER + UPPER, k=24)), "".join(rng.choices(LOWER + UPPER + "0123456789", k=16))
    long = "".join(rng.choices(UPPER[6:], k=20)) + "0123456789abcdef" + "".join(rng.choices(UPPER[6:], k=30))
    text = f"use {letters} or ({short}), getHTTPResponseCode200 of /usr/local/lib/python3/site-packages, {LOWER}; {long}"
    spans = [(k, text[a:b]) for a, k, b in model.spans(text)]
    assert spans == [(3, letters), (3, short), (3, long[:20]), (2, long[20:36]), (3, long[36:])]
    clash = find_secrets(docs.withColumnRenamed("lang", "spans"), "spans", model=model)
    assert clash.columns == ["spans", "spans__"] and clash.count() == docs.count()


def brute_hits(text, items):
    norm = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, ids = norm(text), set(), set()
    for item, t in items:
        v = norm(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    ids.add(str(item))
    ids = sorted(ids)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("block", "held", "bytes_"), [(100_000, 4, 1 << 20), (20, 2, 1 << 20), (20, 2, 100)])
def test_decontamination_against_brute_force(spark, monkeypatch, block, held, bytes_):
    for name, value in (("BLOCK_WORDS", block), ("HELD", held), ("PASS_BYTES", bytes_)):
        monkeypatch.setattr(dec, name, value)
    rng = random.Random(block)
    word = lambda n: " ".join(rng.choices(["a", "B", "c", "é", "d1"], k=n))
    items = [(i, word(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(14)] + [(20, None), (3, word(12)), (None, "only null item words here")]
    texts = [t for _, t in items if t]
    rows = [(i, word(rng.choice([0, 2, 9, 30])) + (", " + rng.choice(texts).upper() + "! " + word(5) if i % 2 else "")) for i in range(30)] + [(40, None), (40, ""), (None, texts[-1])]
    named = [("null" if i is None else i, t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([tuple(r) for r in contamination(docs_of(spark, rows), bench).collect()], key=str)
    assert got == sorted([(i, *brute_hits(t, named)) for i, t in rows], key=str)
    assert contamination(docs_of(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert contamination(docs_of(spark, []), bench).count() == 0


def test_decontamination_cuts_passages(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    keep = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi"
    df = spark.createDataFrame([(1, f"{keep}; {item.title()}. {keep}", 9), (2, item, 9), (3, keep, 9), (4, None, 9), (5, "", 9)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate(df, bench).collect()}
    cut = f"{keep}; . {keep}"
    assert got == {1: (cut, len(cut)), 3: (keep, 9), 4: (None, 9), 5: ("", 9)}


def test_suffix_automaton_lengths():
    sam = SuffixAutomaton([("x", [b"a", b"b", b"a", b"b", b"c"]), ("y", [b"b", b"c", b"d"])], window=3)
    assert sam.scan([b"q", b"a", b"b", b"c", b"d"]) == ([(1, 5)], {"x", "y"})
    assert sam.scan([b"b", b"c"]) == ([], set())


def test_language_identification(spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "of", "thing", "with", "house"], "de": ["der", "und", "nicht", "straße", "haus"], "fr": ["le", "être", "dans", "maison", "où"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.randrange(3, 40))), lang, "s", 0) for i, lang in enumerate(rng.choices(list(vocab), k=150))]
    odd = [(900, None, "en", "s", 0), (901, "123 !!", "en", "s", 0), (902, "der und haus", None, "s", 0), (None, "the house", "en", "s", 0), (903, "", None, "s", 0)]
    got = identify_languages(spark.createDataFrame(rows + odd, DOCS)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 903, 902, None)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 155
    assert identify_languages(spark.createDataFrame([], DOCS)).count() == 0
    assert identify_languages(spark.createDataFrame([(1, "text", None, "s", 0)], DOCS).union(spark.createDataFrame([], DOCS))).first().lang_pred == "und"


def test_grams_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choices("abc d,é\U00010400", k=5000))
    whole = grams(text)
    monkeypatch.setattr("textloom.llm.language_id.CHUNK", 700)
    parts = grams(text)
    assert CHUNK > 5000 and (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy &amp; save</div><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text&nbsp;here, long enough to be the main part of the page.<br><p>Second &eacute;&#233; paragraph; a little longer than the first one is.
<aside>Aside</aside><form><input><button>Send</button></form><ul><li>Point one<li>Point two</ul></article>
<div id="comments"><p>A reader says something that is long, long, long, and longer still than the article itself is.</p></div><footer>&copy; site</footer>"""


def test_html(spark):
    article = "Title & more\n\nFirst bold text here, long enough to be the main part of the page.\n\nSecond éé paragraph; a little longer than the first one is.\n\nPoint one\n\nPoint two"
    plain = '<html><body><div class="menu"><a href="x">Go</a></div><div class="post-12"><p>Some words of a post without an article element.</p><p>More words.</p></div><div class="post-side">Elsewhere</div></body></html>'
    rows = [(1, "http://a.example/1", PAGE), (2, "http://b.example/1", plain), (3, "http://B.example/2", plain.replace("12", "77")), (4, None, None), (5, "", ""), (6, "http://a.example/2", "no markup at all"), (7, "http://c/", "<p>" + "w " * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in page_texts(df).collect()}
    assert got[1].text == article and got[1].n_chars == len(article) and got[1].url == "http://a.example/1"
    assert got[2].text == got[3].text == "Some words of a post without an article element.\n\nMore words."
    assert got[4].text == got[5].text == "" and got[6].text == "no markup at all" and got[7].n_chars == 199_999
    assert page_texts(df.limit(0)).count() == 0
    assert set(extract_text(df, "host").columns) == {"host", "text__"}


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        t = rng.choices(words, k=30) + ["awful"] * insult + ["folk"] * group
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(insult and group)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs_of(spark, [*rows, (2000, None), (2001, ""), (None, "awful folk")]), lab).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum((r.predicted == 1) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity(docs_of(spark, []), lab).count() == 0
    assert toxicity(docs_of(spark, rows[:3]), lab.limit(0)).filter("score > 0.01").count() == 0
    assert ToxicityModel.fit(docs_of(spark, rows[:50]), lab.withColumn("toxic", lab.quality)).score(docs_of(spark, rows[:2]), "doc_id").first().score > 0.99


def test_toxicity_of_a_pair_without_linear_effect(spark):
    """Toxic where an insult and a group word come together or where neither does: each alone tells nothing."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        t = rng.choices(words, k=8) + ["awful"] * insult + ["folk"] * group
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(insult == group)))
    df = docs_of(spark, rows + [(5, rows[5][1])])
    model = ToxicityModel.fit(df.withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = model.score(df, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert len(held) > 400 and sum((r.score > 0.5) == bool(labels[r.doc_id][2]) for r in held) >= 0.9 * len(held)


def test_automata_that_take_turns_are_built_once_for_each_group_of_batches(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from textloom.llm import decontaminate as dc

    built = []
    monkeypatch.setattr(dc, "SuffixAutomaton", lambda block, window, made=dc.SuffixAutomaton: built.append(block[0][0]) or made(block, window))
    monkeypatch.setattr(dc, "HELD", 2)
    blocks = [[(f"item{i}", dc.words(" ".join(f"w{i}x{j}" for j in range(10))))] for i in range(6)]
    spark = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    texts = [" ".join(f"w{i % 7}x{j}" for j in range(10)) for i in range(40)]
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array(texts[lo : lo + 4])], names=["text"]) for lo in range(0, 40, 4))
    found = pa.Table.from_batches(dc._scan(spark, blocks, 10, 0, 1)(batches()))
    assert len(built) == 6
    assert found["items__"].to_pylist() == [[f"item{i % 7}"] if i % 7 < 6 else [] for i in range(40)]
    # with two groups, those held at the end of the first are not built again
    monkeypatch.setattr(dc, "GROUP_BYTES", 1)
    built.clear()
    again = pa.Table.from_batches(dc._scan(spark, blocks, 10, 0, 1)(iter([b for b, _ in zip(batches(), range(2), strict=False)])))
    assert len(built) == 10 and again["items__"].to_pylist() == found["items__"].to_pylist()[:8]
