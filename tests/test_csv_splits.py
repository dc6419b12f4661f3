"""Quoted files in pieces against Python's reader and the reading of a whole file by one task."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.sources.csv_splits import quote_states, read_delimited, read_records, states_before
from textloom.sources.items import read_items

CELLS = ["", "plain", "a,b", 'say "hi"', "two\nlines", 'x\n\n"y",\n', '"', '""', ",", "\n", "é ü 日本", " padded ", '5" pipe', "tail\r\nwin", '","', '\n"\n"']


def written(path, rows, ending="\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, lineterminator=ending).writerows(rows)


@pytest.fixture()
def cut(spark):
    """Cuts files into pieces of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]

    def at(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")

    yield at
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize(("size", "ending"), [(97, "\n"), (1500, "\r\n"), (100_000_000, "\n")])
def test_pieces_of_any_size_equal_one_reader(spark, cut, tmp_path, size, ending):
    rng = random.Random(size)
    rows = [[rng.choice(CELLS) if rng.random() < 0.9 else "long " * rng.randrange(80) for _ in range(3)] for _ in range(150 if size < 1000 else 1500)]
    written(tmp_path / "a.csv", [["id", "text", 'odd "name"'], *rows], ending)
    cut(size)
    found = sorted(read_delimited(spark, str(tmp_path / "a.csv")).collect(), key=lambda r: r[0])
    assert [[x or "" for x in r[1:]] for r in found] == rows
    if ending == "\r\n":  # the whole-file reader changes these within quotes
        return
    one = spark.read.csv(str(tmp_path / "a.csv"), header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert [list(r)[1:] for r in found] == [list(r) for r in one.collect()]


def test_quotes_that_open_nothing_and_quotes_left_open(spark, cut, tmp_path):
    (tmp_path / "a.csv").write_text('text,n\n5" pipe,1\nb"c,"d\ne"\n"x"y,2\n"open,\n3\n', "utf-8")
    for size in (5, 1000):
        cut(size)
        rows = sorted(read_records(spark, str(tmp_path / "a.csv"))[0].collect(), key=lambda r: r.place)
        assert [bytes(r.record).decode() for r in rows] == ["text,n", '5" pipe,1', 'b"c,"d\ne"', '"x"y,2', '"open,\n3']
        assert [r.header for r in rows] == [True, False, False, False, False]


def test_folders_encodings_and_marks(spark, cut, tmp_path):
    written(tmp_path / "a.csv", [["text", "k", "k"], ["eins", "1", "2"]], encoding="utf-8-sig")
    written(tmp_path / "b.csv", [["text", "k", "k"], ["caña\nfría", "3", "4"], ["  ", "5", "6"]], encoding="latin-1")
    cut(9)
    found = read_items(spark, str(tmp_path)).orderBy("item_idx").collect()
    assert [(r.item_idx, r.id, r.text, r.metadata) for r in found] == [(0, "item_0", "eins", {"k1": "1", "k2": "2"}), (1, "item_1", "caña\nfría", {"k1": "3", "k2": "4"})]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_items(spark, str(tmp_path / "c"))


def test_states_of_lines(spark):
    lines = ["a,b", 'a,"b', 'b",c', '"a""b",c', '"a"",b', "", '"', '""', '"""', 'a"b', ',"']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [(r.a, r.b) for r in df.select("i", *[s.alias(n) for s, n in zip(quote_states(F.col("line")), "ab", strict=True)]).orderBy("i").collect()]
    assert got == [(False, True), (True, False), (False, False), (False, False), (True, False), (False, True), (True, False), (False, True), (True, False), (False, False), (True, False)]


def test_scan_equals_a_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        closed, opened = rng.random((2, rng.integers(0, 9))) < 0.5
        for start in (False, True):
            states, state = [], start
            for c, o in zip(closed, opened, strict=True):
                states.append(state)
                state = bool(o if state else c)
            found, last = states_before(closed, opened, start)
            assert found.tolist() == states and last == state
