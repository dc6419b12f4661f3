"""Benchmark decontamination with a generalised suffix automaton of normalised test items."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Words of the items of one automaton (about 60 MB), and automata that a worker holds at once; more take turns.
BLOCK_WORDS, HELD = 100_000, 4
#: Bytes of item text that one pass over the documents scans for; a larger benchmark takes more passes.
PASS_BYTES = 64 << 20
#: Bytes of documents over which an automaton goes before it makes room for another.
GROUP_BYTES = 32 << 20

_KEPT = b"".join(bytes([i]) if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else b" " for i in range(256))
_FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else _KEPT[i] for i in range(256))


def words(text: str | None) -> list[bytes]:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised over the items: states are classes of word runs that end at the same places in the items. A state
    of runs of `window` words and more knows the items in which its run of the last `window` words occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}  # items of fewer words, by the state that is reached by the whole item
        for item, found in items:
            last = 0
            for c in (self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found):
                last = self._extend(last, c)
                ends.setdefault(last, set()).add(item)
            if found and len(found) < window:
                self.short.setdefault(last, set()).add(item)
        # from short runs to long ones, as a state's link has shorter runs
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.anchor, self.whole = [0] * len(self.length), [0] * len(self.length)
        self.items: dict[int, set[str]] = {}
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                # the state whose runs of `window` words end wherever those of s do
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
                if s in ends:
                    self.items.setdefault(self.anchor[s], set()).update(ends[s])
            # the nearest state, s or above, at which a short item ends
            self.whole[s] = s if s in self.short else self.whole[up]
        self.shortest = min([window, *(self.length[s] for s in self.short)])

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The shorter runs of q become a state of their own."""
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (start, end) of the words inside occurrences of windows, and the items with windows there.

        `length` is that of the longest run that ends at the word and occurs in an item. From `window` on, all its
        words are hit; below, the run is hit as far as a whole short item ends there.
        """
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        known, edges, link, lengths, window, shortest = self.vocabulary, self.next, self.link, self.length, self.window, self.shortest
        state = length = 0
        for i, w in enumerate(found):
            c = known.get(w, -1)
            if c < 0:
                state = length = 0
                continue
            while state and c not in edges[state]:
                state = link[state]
                length = lengths[state]
            if c in edges[state]:
                state = edges[state][c]
                length += 1
            else:
                length = 0
            if length >= shortest:
                start = i + 1
                if length >= window:
                    items |= self.items[self.anchor[state]]
                    start = i - length + 1
                at = self.whole[state]
                while at:
                    if lengths[at] <= length:
                        items |= self.short[at]
                        start = min(start, i - lengths[at] + 1)
                    at = self.whole[link[at]]
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


Block = list[tuple[str, list[bytes]]]


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Block]]:
    """The items in blocks of about BLOCK_WORDS words, as many at a time as have PASS_BYTES of text; the driver holds
    no more. An empty benchmark is one pass without blocks."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    letters = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-letters // PASS_BYTES))
    for n in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == n)
        blocks: list[Block] = []
        room = 0
        for r in part.collect():
            found = words(r.text)
            if room < len(found) or not blocks:
                blocks.append([])
                room = BLOCK_WORDS
            blocks[-1].append((r.item, found))
            room -= len(found)
        yield blocks


def _scan(spark, blocks: list[Block], window: int, text_at: int, kept: int) -> Callable:
    shared, held = spark.sparkContext.broadcast(blocks), HELD

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches that each automaton goes over at once: one where all automata are held, else GROUP_BYTES of text."""
        group: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            group.append(batch)
            size += batch.column(text_at).nbytes
            if len(shared.value) <= held or size >= GROUP_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[int, SuffixAutomaton] = {}
        order = list(range(len(shared.value)))
        for group in groups(batches):
            texts = [t for batch in group for t in batch.column(text_at)]
            n = [0] * len(texts)
            spans: list[list[tuple[int, int]]] = [[] for _ in n]
            items: list[set[str]] = [set() for _ in n]
            for at in order:
                if at not in automata:
                    if len(automata) >= held:
                        automata.pop(next(iter(automata)))
                    automata[at] = SuffixAutomaton(shared.value[at], window)
                sam = automata[at]
                for i, t in enumerate(texts):
                    found = words(t.as_py())
                    n[i] = len(found)
                    s, ids = sam.scan(found)
                    spans[i] += s
                    items[i] |= ids
            # those that are held now come first in the next group
            order.reverse()
            begin = 0
            for batch in group:
                yield from rows(batch, n[begin : begin + len(batch)], spans[begin : begin + len(batch)], items[begin : begin + len(batch)])
                begin += len(batch)
        pa.default_memory_pool().release_unused()

    def rows(batch: pa.RecordBatch, n: list[int], spans: list[list[tuple[int, int]]], items: list[set[str]]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            some = slice(lo, lo + 500)
            said = [[{"start": a, "end": b} for a, b in merged(s)] for s in spans[some]]
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(n[some], pa.int64()), pa.array(said, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for x in items[some]], pa.list_(pa.string()))], names=[*part.schema.names[:kept], "n_words__", "spans__", "items__"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of docs, and n_words__, spans__ (of word numbers, merged), items__ (sorted ids, as strings).

    The training text streams through the automata; nothing is shuffled. A benchmark of more than BLOCK_WORDS words is
    taken in blocks: each task builds their automata in turn, holds HELD of them, and lets each of the others go over
    GROUP_BYTES of text before it makes room. A benchmark of more than PASS_BYTES
    takes a pass over the documents for each so many bytes. Null texts have no words; a null item_id is the item "null";
    rows with the same item_id are one item; an empty benchmark has no hits.
    """
    spark = docs.sparkSession
    names = docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    columns, before = list(out.columns), False
    for blocks in _passes(benchmark, item_col, item_text_col):
        kept = [*columns, "spans__", "items__"] if before else columns
        # the text travels once unless it has to be cast
        is_text = docs.schema[text_col].dataType.simpleString() == "string"
        ready = out.select(*[F.col(c) for c in kept], *([] if is_text else [F.col(text).cast("string").alias("text__")]))
        if before:
            ready = ready.withColumnsRenamed({"spans__": "spans_before", "items__": "items_before"})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[: len(kept)])
        out = ready.mapInArrow(_scan(spark, blocks, window, kept.index(text) if is_text else len(kept), len(kept)), f"{schema}, n_words__ long, spans__ array<struct<start:int,end:int>>, items__ array<string>")
        if before:
            out = out.withColumns({"spans__": _merge(F.concat("spans_before", "spans__")), "items__": F.array_sort(F.array_union("items_before", "items__"))}).drop("spans_before", "items_before")
        before = True
    return out.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "n_words__", "spans__", "items__")


def _merge(spans):
    """Sorted spans with overlapping and touching ones joined."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document, with the default window."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    hits = n_hit(F.col("spans__"))
    return found.select("doc_id", F.col("n_words__").alias("n_words"), hits.alias("n_hit"), F.size("items__").cast("long").alias("n_items"), F.sha2(F.array_join("items__", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text (first column) without the words of the spans (second) and what stands between them."""
    import re

    word = re.compile(rb"[0-9a-z\x80-\xff]+", re.IGNORECASE)
    for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, len(whole), 500)):
        out = []
        for t, spans in zip(batch.column(0), batch.column(1), strict=True):
            text, cut = t.as_py(), spans.as_py()
            if cut:
                raw = text.encode("utf-8", "surrogatepass")
                at = [m.span() for m in word.finditer(raw)]
                parts, done = [], 0
                for s in cut:
                    parts.append(raw[done : at[s["start"]][0]])
                    done = at[s["end"] - 1][1]
                text = b"".join([*parts, raw[done:]]).decode("utf-8", "surrogatepass")
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text__", *batch.schema.names[2:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs (with its own columns) without the benchmark's passages.

    Runs of words that occur in an item over `window` words or more (or a whole shorter item) are cut from the text; a
    document of whose words more than `max_coverage` is hit goes altogether. n_chars, where docs has it, is counted
    anew for documents that lost a span. Documents without a hit are left as they are, empty and null texts included.
    """
    found = scan(docs, benchmark, window).filter(n_hit(F.col("spans__")) <= max_coverage * F.col("n_words__"))
    names = docs.columns
    others = [c for c in names if c != "text"]
    ready = found.select(F.col("text").cast("string").alias("text__"), "spans__", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], (F.size("spans__") > 0).alias("was_cut"))
    schema = "text__ string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[2:])
    cut = ready.mapInArrow(_cut, schema)
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("text__")}
    if "n_chars" in names:
        back["n_chars"] = F.when(F.col("was_cut"), F.length("text__").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return cut.select(*[back[c].alias(c) for c in names])
