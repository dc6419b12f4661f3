"""Delimited files with line breaks in quotes, read in many tasks: what a line does to the state of quotes is known for
either state before it, so states follow from a prefix scan over the pieces of a file."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for the number of a record within its piece.
PLACE = 33


def quote_states(line: Column, delimiter: str = ",") -> tuple[Column, Column]:
    """Whether quotes are open after a line, if they were closed before it, and if they were open.

    A quote opens a cell only at the cell's start, a doubled one within a cell is a sign, and one within an unquoted cell
    is a sign too. The line is seen as what stands between its quotes; after each quote the state is 0 (outside), 1 (within
    a quoted cell) or 2 (at its end, unless another quote follows at once).
    """
    parts = F.split(line, '"', -1)
    opens = lambda s: s.endswith(delimiter)
    first = F.get(parts, F.lit(0))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    step = lambda state, s: F.when(state == 1, 2).when((state == 2) & (s == ""), 1).when(opens(s), 1).otherwise(0)
    after = lambda start: F.aggregate(inner, start.cast("int"), step) == 1
    quoted = line.contains('"')
    closed = F.when(quoted, after(F.when((first == "") | opens(first), 1).otherwise(0))).otherwise(False)
    opened = F.when(quoted, after(F.lit(2))).otherwise(True)
    return closed, opened


def states_before(closed: np.ndarray, opened: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """The state before each line, and after the last one, from the state at the start. A line that ends in the same state
    either way fixes it; others keep or turn it, so the state is the last fixed one, turned as often as lines since say."""
    fixed = closed == opened
    turns = np.concatenate([[0], np.cumsum(closed & ~opened)])
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(fixed, np.arange(len(closed)), -1)]))
    base = np.where(last >= 0, closed[np.maximum(last, 0)], start) if len(closed) else np.array([start])
    states = base ^ ((turns - turns[np.where(last >= 0, last + 1, 0)]) % 2 == 1)
    return states[:-1], bool(states[-1])


def _runs(files: list[str], starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines of one piece of a file."""
    lo = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] != starts[lo] or files[i] != files[lo]:
            yield lo, i
            lo = i


def _flags(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("file").to_pylist(), batch.column("start").to_numpy(), batch.column("closed").to_numpy(zero_copy_only=False), batch.column("opened").to_numpy(zero_copy_only=False)


SUMMARY = "file string, start long, closed boolean, opened boolean, begins boolean, valid boolean"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of a file: the state after it from either state before, whether a record begins in it even where
    quotes are open before, and whether it is UTF-8."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        files, starts, closed, opened = _flags(batch)
        valid = batch.column("valid").to_numpy(zero_copy_only=False)
        for lo, hi in _runs(files, starts):
            kept = found.setdefault((files[lo], int(starts[lo])), [False, True, False, True])
            _, kept[0] = states_before(closed[lo:hi], opened[lo:hi], kept[0])
            states, kept[1] = states_before(closed[lo:hi], opened[lo:hi], kept[1])
            kept[2] |= not states.all()
            kept[3] &= bool(valid[lo:hi].all())
    rows = [(f, s, *v) for (f, s), v in found.items()]
    names = ["file", "start", "closed", "opened", "begins", "valid"]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)


@dataclass
class Piece:
    """A piece of a file: its number in the order of all, the state before it, and the piece in which the record began
    that is open then."""

    number: int
    open: bool
    owner: int


def place_pieces(rows: list) -> dict[tuple[str, int], Piece]:
    """The prefix scan over summaries."""
    out: dict[tuple[str, int], Piece] = {}
    file, state, owner = None, False, 0
    for number, r in enumerate(sorted(rows, key=lambda r: (r.file, r.start))):
        if r.file != file:
            file, state = r.file, False
        out[(r.file, r.start)] = Piece(number, state, owner)
        if not state or r.begins:
            owner = number
        state = r.opened if state else r.closed
    return out


RECORDS = "file string, place long, header boolean, owner long, piece long, record binary"


def _records(shared, parts: bool):
    """Whole records, or with `parts` the parts of those that go on in the next piece."""
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("header", pa.bool_()), ("owner", pa.int64()), ("piece", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple[str, int], Piece] = shared.value
        key, piece, state, count, lines, head = None, None, False, 0, [], False
        rows: list[tuple] = []

        def close(last: bool) -> None:
            """Hands on the open record: part of a larger one if it began before this piece or goes on after it."""
            nonlocal lines, head, count
            if lines:
                whole = not head and not (last and state)
                if whole != parts:
                    place = None if head else (piece.number << PLACE) + count
                    rows.append((key[0], place, not head and count == 0 and key[1] == 0, piece.owner if head else piece.number, piece.number, b"\n".join(lines)))
                count += not head
            lines, head = [], False

        def flush() -> pa.RecordBatch:
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.types[i]) for i in range(6)], schema=schema)
            rows = []
            return out

        for batch in batches:
            files, starts, closed, opened = _flags(batch)
            texts = batch.column("line").to_pylist()
            for lo, hi in _runs(files, starts):
                if (files[lo], int(starts[lo])) != key:
                    close(True)
                    key = (files[lo], int(starts[lo]))
                    if key not in pieces:
                        raise ValueError("the file was cut otherwise than before; set spark.sql.files.minPartitionNum while executors come and go")
                    piece, count = pieces[key], 0
                    state = head = piece.open
                states, after = states_before(closed[lo:hi], opened[lo:hi], state)
                at = lo
                for begin in (np.flatnonzero(~states) + lo).tolist():
                    lines += texts[at:begin]
                    at = begin
                    if lines:
                        close(False)
                    head = False
                lines += texts[at:hi]
                state = after
            yield flush()
        close(True)
        yield flush()

    return run


def read_records(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, dict[str, bool]]:
    """(file, place, header, record) of all files below a path, in pieces as Spark cuts files, and whether each file is UTF-8.

    `place` orders records, `header` marks each file's first one. Lines end with a line feed (with or without a carriage return before it). The file is read
    three times: for the summaries of its pieces, of which the driver scans one row each; for whole records; and for
    those that go over the end of a piece, of which only these parts are shuffled. An open quote at a file's end ends with
    the file.
    """
    value = F.col("value")
    closed, opened = quote_states(value, delimiter)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value)
    flags = lines.select("file", "start", closed.alias("closed"), opened.alias("opened"), F.is_valid_utf8("value").alias("valid"))
    summaries = flags.mapInArrow(_summaries, SUMMARY).collect()
    valid: dict[str, bool] = {}
    for r in summaries:
        valid[r.file] = valid.get(r.file, True) and r.valid
    shared = spark.sparkContext.broadcast(place_pieces(summaries))
    full = lines.select("file", "start", closed.alias("closed"), opened.alias("opened"), value.cast("binary").alias("line"))
    whole = full.mapInArrow(_records(shared, False), RECORDS).select("file", "place", "header", "record")
    cut = full.mapInArrow(_records(shared, True), RECORDS)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "record"))), lambda x: x["record"])
    glued = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), lambda a, b: F.concat(a, F.lit(b"\n"), b))
    cut = cut.groupBy("owner").agg(F.first("file").alias("file"), F.max("place").alias("place"), F.max("header").alias("header"), glued.alias("record"))
    return whole.union(cut.select("file", "place", "header", "record")), valid


def _names(header: str) -> list[str]:
    """Names of columns as Spark gives them: a blank one is _c and its place, a repeated one has its place added."""
    found = next(csv.reader(header.splitlines(keepends=True)), [])
    low = [x.lower() for x in found]
    return [f"_c{i}" if not x else f"{x}{i}" if low.count(x.lower()) > 1 else x for i, x in enumerate(found)]


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", place: str = "place__") -> DataFrame:
    """The columns of the files below a path (all strings, by the first file's header; each file has one), and the place
    of each row. UTF-8 with or without a byte-order mark, else Latin-1, for each file."""
    records, valid = read_records(spark, path, delimiter)
    text = F.col("record").cast("string")
    if not all(valid.values()):
        latin = spark.createDataFrame([(f,) for f, ok in valid.items() if not ok], "file string")
        records = records.join(latin.withColumn("latin", F.lit(True)), "file", "left")
        text = F.when(F.col("latin"), F.decode("record", "ISO-8859-1")).otherwise(text)
    rows = records.select("place", "header", F.regexp_replace(text, r"\r\z", "").alias("record"))
    first = rows.filter("header").orderBy("place").limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    names = _names(first[0].record.lstrip("\ufeff"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": delimiter, "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    cells = rows.filter("not header and record <> ''").select(F.col("place").alias(place), F.from_csv("record", schema, options).alias("cells"))
    return cells.select(place, *[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)])
