"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values of the base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge, and the least log-likelihood ratio (in nats) that they must reach.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_NATS = 10.0
#: The share of ordinary identifiers, of words that the models have not seen, that may reach the threshold.
FALSE_ALARMS = 1e-3
#: Words of the corpus from which labelled identifiers are made, and how many are made for each half of them.
SAMPLE_WORDS, SAMPLES, SEED = 4096, 20_000, 11

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABET = LOWER + UPPER + DIGITS + "+/_.=-"
SIZE = len(ALPHABET) + 1
#: Alphabets of random strings, each with a model of its own.
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER, LOWER + UPPER + DIGITS, ALPHABET)
#: Words of programs, and sequences that are no secrets, among the labelled ordinary identifiers.
PROGRAM_WORDS = (
    "get set is has add remove create update delete find list load save read write open close start stop run init build make parse format check test user name id key value type code data file path "
    "index count size item node page query result request response http https api url html json xml config option default error status message event handler service client server host port local "
    "lib bin usr etc var tmp home src main python java site packages module class function method object string number array map table row column field record model view controller manager "
    "factory provider context session account email address phone date time version release image video text title content body header footer left right top bottom width height color style"
).split()
SEQUENCES = (LOWER, UPPER, DIGITS, "qwertyuiop", "asdfghjkl", "zxcvbnm", "aaaaaaaa", "xxxxxxxx", "--------", "========", "________", "0000000000", "//////")
_CLASS = np.zeros(128, np.int64)
_CLASS[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)
_IN = np.zeros((len(ALPHABETS), SIZE), bool)
for _n, _letters in enumerate(ALPHABETS):
    _IN[_n, _CLASS[[ord(c) for c in _letters]]] = True
#: Characters that are counted together.
CHUNK = 1 << 20

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the fixed patterns in order, and the runs that hold their random part. Matches that are too short are
    dropped after matching, so they still keep later matches from starting inside them."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            spans.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            spans.append((m.start(), 1, m.end()))
            values.append(m.span())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        values.append(m.span())
    return sorted(spans), values


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 0)


def _grams(c: np.ndarray) -> np.ndarray:
    """The number of each class with the two before it; classes before the first are 0."""
    padded = np.concatenate([[0, 0], c])
    return (padded[:-2] * SIZE + padded[1:-1]) * SIZE + c


def alphabet_of(c: np.ndarray) -> int:
    """The first of ALPHABETS that holds all classes of a run."""
    return int(np.argmax(_IN[:, c].all(axis=1)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition: counts of three characters for ordinary words and identifiers of less than 16 (label 0), of two for values of the base
    patterns (label 1 + the number of their alphabet), and words of least hash (label -1; SAMPLE_WORDS at most)."""
    ordinary = np.zeros(SIZE**3, np.int64)
    random_ = np.zeros((len(ALPHABETS), SIZE**2), np.int64)
    words: set[str] = set()
    texts: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal size
        c = np.concatenate(texts)
        grams = _grams(c)[c > 0]
        np.add(ordinary, np.bincount(grams, minlength=SIZE**3), out=ordinary)
        texts.clear()
        size = 0

    def least() -> list[tuple[int, str]]:
        found = sorted((xxhash.xxh64_intdigest(w.encode()) >> 1, w) for w in words if 3 <= len(w) <= 12 and w.isascii() and w.isalpha())
        return found[:SAMPLE_WORDS]

    for batch in batches:
        for t in batch.column(0):
            text = t.as_py()
            if not text:
                continue
            c = _classes(text)
            for a, b in base_spans(text)[1]:
                value = c[a:b]
                at = alphabet_of(value)
                np.add.at(random_[at], np.concatenate([[0], value[:-1]]) * SIZE + value, 1)
                c[a:b] = 0
            # what is to be judged is no example of what is ordinary
            for m in CANDIDATE.finditer(text):
                c[m.start() : m.end()] = 0
            texts.append(c)
            texts.append(np.zeros(2, np.int64))
            size += len(c)
            if size > CHUNK:
                add()
            words.update(text.split())
            if len(words) > 200_000:
                words = {w for _, w in least()}
    if texts:
        add()
    gram = np.flatnonzero(ordinary)
    label, pair = np.nonzero(random_)
    sample = least()
    parts = [(np.zeros(len(gram), np.int64), gram, ordinary[gram], [None] * len(gram)), (label + 1, pair, random_[label, pair], [None] * len(pair)), (np.full(len(sample), -1), [h for h, _ in sample], np.ones(len(sample), np.int64), [w for _, w in sample])]
    for labels, grams, n, word in parts:
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(grams, pa.int64()), pa.array(n, pa.int64()), pa.array(word, pa.string())], names=["label", "gram", "n", "word"])


def ordinary_samples(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Labelled ordinary identifiers: words in the forms that programs, paths and files have, with numbers and dates."""
    out = []
    while len(out) < n:
        some = [rng.choice(words if words and rng.random() < 0.5 else PROGRAM_WORDS).lower() for _ in range(rng.randrange(2, 7))]
        style = rng.randrange(9)
        if style == 0:
            made = some[0] + "".join(w.capitalize() for w in some[1:])
        elif style == 1:
            made = "".join(w.upper() if len(w) <= 4 and rng.random() < 0.4 else w.capitalize() for w in some)
        elif style in (2, 3):
            made = ("_" if style == 2 else "-").join(some)
        elif style == 4:
            made = "_".join(w.upper() for w in some)
        elif style == 5:
            made = "/" * rng.randrange(2) + "/".join(some)
        elif style == 6:
            made = "".join(some[:3])
        elif style == 7:
            made = f"{some[0]}-{rng.randrange(1990, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 32):02d}"
        else:
            made = some[0].upper() + "-" + "-".join(str(rng.randrange(10**4)).zfill(4) for _ in some)
        if rng.random() < 0.3:
            made += rng.choice(["", "_", "-", "/v"]) + str(rng.randrange(10 ** rng.randrange(1, 4)))
        if len(made) >= 16:
            out.append(made)
    return out


def random_samples(n: int, rng: random.Random, alphabets: tuple[str, ...] = ALPHABETS) -> list[str]:
    """Labelled random strings of 16 to 64 characters of each alphabet in turn."""
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randrange(16, 65))) for i in range(n)]


def _chain(counts: np.ndarray) -> np.ndarray:
    """Probabilities of a class after two others; rare contexts lean on the last class, and that on none."""
    n3 = counts.reshape(SIZE, SIZE, SIZE)[:, :, 1:].astype(float)
    n2 = n3.sum(axis=0)
    p1 = (n2.sum(axis=0) + 0.5) / (n2.sum() + 0.5 * (SIZE - 1))
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    return (n3 + 10 * p2) / (n3.sum(axis=2, keepdims=True) + 10)


class SecretModel:
    """Markov models of random strings (of order 1, one for each alphabet) and of ordinary identifiers (of order 2, half
    from the corpus and half from labelled samples), and the threshold of their log-likelihood ratio."""

    def __init__(self, counts: np.ndarray, random_: np.ndarray, words: list[str]) -> None:
        rng = random.Random(SEED)
        # every other word is kept for the threshold
        seen, unseen = words[::2], words[1::2]
        labelled = np.zeros(SIZE**3, np.int64)
        for x in [*ordinary_samples(seen, SAMPLES, rng), *(s for s in SEQUENCES for _ in range(200))]:
            np.add.at(labelled, _grams(_classes(x)), 1)
        self.ordinary = np.zeros((SIZE, SIZE, SIZE), np.float32)
        self.ordinary[:, :, 1:] = np.log((_chain(counts) + _chain(labelled)) / 2)
        self.ordinary = self.ordinary.reshape(-1)
        pairs = random_.astype(float)
        for x in random_samples(SAMPLES, rng):
            c = _classes(x)
            np.add.at(pairs[alphabet_of(c)], np.concatenate([[0], c[:-1]]) * SIZE + c, 1)
        # a string may be of any alphabet that holds it, so its model has no more than that alphabet
        smooth = 20 * _IN[:, None, :] / _IN.sum(axis=1)[:, None, None] + 1e-9
        pairs = pairs.reshape(len(ALPHABETS), SIZE, SIZE) + smooth
        self.random = np.log(pairs / pairs.sum(axis=2, keepdims=True)).astype(np.float32).reshape(len(ALPHABETS), -1)
        ratios = sorted(self.ratio(x) for x in ordinary_samples(unseen, SAMPLES, rng))
        self.threshold = max(LEAST_NATS, ratios[int(len(ratios) * (1 - FALSE_ALARMS))])

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text") -> SecretModel:
        """Counts are of all texts; a partition gives one row at most for each label and gram of 69 classes, and the
        driver gets as many in all and SAMPLE_WORDS words. Random strings, and identifiers of these words and of
        PROGRAM_WORDS, are made from a seed. Without texts the labelled samples alone are learned from."""
        scratch = Scratch(docs.sparkSession, "secrets")
        rows = scratch.keep(docs.select(F.col(text_col).cast("string")).mapInArrow(_counts, "label long, gram long, n long, word string"))
        counts, random_ = np.zeros(SIZE**3, np.int64), np.zeros((len(ALPHABETS), SIZE**2), np.int64)
        for r in rows.filter("label >= 0").groupBy("label", "gram").agg(F.sum("n").alias("n")).collect():
            if r.label:
                random_[r.label - 1, r.gram] = r.n
            else:
                counts[r.gram] = r.n
        words = rows.filter("label = -1").select("gram", "word").distinct().orderBy("gram", "word").limit(SAMPLE_WORDS)
        found = [r.word for r in words.collect()]
        scratch.drop()
        return cls(counts, random_, found)

    def ratio(self, run: str) -> float:
        """How much likelier, in nats, a run is as a random string (of the alphabet that suits it best)."""
        c = _classes(run)
        pairs = np.concatenate([[0], c[:-1]]) * SIZE + c
        return float(self.random[:, pairs].sum(axis=1).max() - self.ordinary[_grams(c)].sum())

    def spans(self, text: str) -> list[Span]:
        """All spans: the base ones, and the parts of candidates outside them, of 16 characters and more, whose ratio
        reaches the threshold."""
        base, _ = base_spans(text)
        added = []
        for m in CANDIDATE.finditer(text):
            at, end = m.span()
            for a, _, b in [*((x for x in base if x[0] < end and at < x[2])), (end, 0, end)]:
                part = text[at:a]
                if len(part) >= 16 and self.ratio(part) >= self.threshold:
                    added.append((at, 3, at + len(part)))
                at = max(at, b)
        return sorted([*base, *added])


def _scan(model: SecretModel) -> Callable:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in model.spans(t.as_py() or "")] for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(kind))], names=[*batch.schema.names[:-1], "spans__"])

    return run


def find_secrets(docs: DataFrame, *columns: str, text_col: str = "text", model: SecretModel | None = None) -> DataFrame:
    """The named columns of docs and spans__: kind, start, end (code points, end exclusive), in order of start and kind.

    Null and empty texts have none. Without a model, one is trained on docs. Rows are judged each on their own, so null
    and repeated ids and repeated rows make no difference; an empty table gives an empty result.
    """
    model = model or SecretModel.fit(docs, text_col)
    chosen = docs.select(*columns, F.col(text_col).cast("string").alias("text__"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_scan(model), schema + "spans__ array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document."""
    found = find_secrets(docs, "doc_id")
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans__", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans__", lambda x: x["kind"] != "markov")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans__")).alias("spans"), number("markov"))
