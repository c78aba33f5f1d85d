"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ in k = floor(rate * m) edits from a passage of a document. Cut into k + 1 pieces, at least
one piece is in the passage unchanged. An Aho-Corasick automaton finds all pieces of all items in one pass over a
document. Hits are verified upwards: if j neighbouring pieces have j - 1 edits at most, then so has one of their halves with its
own count of pieces. So a hit counts only if two pieces around it match with 1 edit, then four with 3, and so on; almost all
chance hits end at the first step. What is left gives a window where the item would lie, windows of an item that overlap
are merged, and Myers' bit-parallel algorithm finds the least edit distance of the item to a substring of the window.

Texts and items are compared in lower case with white space as one space. The items are a query set: they are read in
blocks of ``BLOCK_BYTES`` at most, and every block is matched against all rows, without a shuffle. With more than one
block each block's result is written before the next block is read, so the driver holds one block. Documents never
leave their task; only matches do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import map_batches, strings, written

#: Edits allowed, as a share of the item's characters.
RATE = 0.1
#: Shorter items must be in a document without an edit, between word bounds: a few letters are in most texts.
MIN_CHARS = 20
BLOCK_BYTES = 16 << 20


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, masks: dict[str, int], window: str, limit: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``window``, and where the first best one ends.

    Bit i of the state stands for the item's character i: a set bit in ``plus`` (``minus``) says that the distance rises (falls) there.
    """
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = ones, 0, m, m, 0
    for n, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & ones
        up, down = (minus | ~(d0 | plus)) & ones, d0 & plus
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & ones, down << 1 & ones  # a match may begin anywhere: nothing is carried in
        plus, minus = (down | ~(d0 | up)) & ones, d0 & up
        if score < best:
            best, end = score, n
            if best == 0:
                break
    return (best, end) if best <= limit else (limit + 1, 0)


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _bound(text: str, at: int) -> bool:
    """Whether no word goes on across a place."""
    return at <= 0 or at >= len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def _above(n: int) -> list[list[tuple[int, int]]]:
    """For each of ``n`` pieces the ranges of pieces that hold it, from two or three upwards, without the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def split(lo: int, hi: int) -> None:
        if hi - lo > 1:
            middle = (lo + hi) // 2
            split(lo, middle)
            split(middle, hi)
            if hi - lo < n:
                for p in range(lo, hi):
                    out[p].append((lo, hi))

    split(0, n)
    return out


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[list[int], str]], rate: float = RATE):
        self.items, self.budget, self.masks = [], [], []
        self.steps: list[list[list[tuple[int, int, str, dict[str, int]]]]] = []
        self.short: list[tuple[str, list[int]]] = []
        where: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for ids, text in items:
            if len(text) < MIN_CHARS:
                where[text].append((-1 - len(self.short), 0, 0))
                self.short.append((text, ids))
                continue
            k, n = int(rate * len(text)), len(self.items)
            self.items.append((ids, text))
            self.budget.append(k)
            self.masks.append(_masks(text))
            cuts = [at for at, _ in pieces(text, k)] + [len(text)]
            parts = {span: (cuts[span[0]], span[1] - span[0] - 1, text[cuts[span[0]] : cuts[span[1]]]) for up in _above(k + 1) for span in up}
            masks = {span: _masks(part) for span, (_, _, part) in parts.items()}
            self.steps.append([[(*parts[span], masks[span]) for span in up] for up in _above(k + 1)])
            for p, (at, piece) in enumerate(pieces(text, k)):
                where[piece].append((n, p, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, raw: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end of the match in the normalised text) for each item that the text holds."""
        text = normalize(raw)
        out: list[tuple[int, int, int]] = []
        if not self.automaton or not text:
            return out
        seen: set[int] = set()
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text):
            begin = last - size + 1
            for n, p, at in places:
                if n < 0:
                    if n not in seen and _bound(text, begin) and _bound(text, last + 1):
                        seen.add(n)
                        out += [(i, 0, last + 1) for i in self.short[-1 - n][1]]
                    continue
                if not all(self._near(text, begin - at, *step) for step in self.steps[n][p]):
                    continue
                k = self.budget[n]
                lo, hi = begin - at - k, begin - at + len(self.items[n][1]) + k
                open_ = windows[n]
                if open_ and lo <= open_[-1][1]:
                    open_[-1][0], open_[-1][1] = min(lo, open_[-1][0]), max(hi, open_[-1][1])
                else:
                    open_.append([lo, hi])
        for n, spans in windows.items():
            ids, item = self.items[n]
            best, end = self.budget[n] + 1, 0
            at = text.find(item) if len(item) <= len(text) else -1
            if at >= 0:
                best, end = 0, at + len(item)
            else:
                for lo, hi in spans:
                    lo = max(0, lo)
                    found, to = myers(item, self.masks[n], text[lo:hi], self.budget[n])
                    if found < best:
                        best, end = found, lo + to
            if best <= self.budget[n]:
                out += [(i, best, end) for i in ids]
        return sorted(out, key=lambda m: (m[0] is None, m))


    @staticmethod
    def _near(text: str, origin: int, at: int, edits: int, part: str, masks: dict[str, int]) -> bool:
        """Whether a part of an item is near its place, with so many edits."""
        lo = max(0, origin + at - edits)
        return myers(part, masks, text[lo : max(0, origin + at + len(part) + edits)], edits)[0] <= edits


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[list[int | None], str]]]:
    """The distinct normalised items with their ids, in blocks of bounded size."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = int(size // block_bytes) + 1
    for k in range(n):
        block: dict[str, list[int | None]] = defaultdict(list)
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toLocalIterator():
            if text := normalize(row["text"]):
                block[text].append(row["item_id"])
        if block:
            yield [(sorted(ids, key=lambda i: (i is None, i)), text) for text, ids in sorted(block.items())]


def _with_last(items: Iterator) -> Iterator[tuple[bool, list]]:
    """Each item, with whether it is the last one."""
    before = None
    for item in items:
        if before is not None:
            yield False, before
        before = item
    if before is not None:
        yield True, before


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, distance, end) for each item that a document holds within its edit budget.

    Null and empty texts and items match nothing. Rows with equal ids each give their matches; several benchmark rows of the same text all match, and an item without an id is found as item null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def matched(block: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), strings(batch, "text"), strict=True) for m in matcher.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        return map_batches(source, run, "doc_id long, item_id long, distance int, end int")

    found: list[DataFrame] = []
    for last, block in _with_last(blocks(benchmark)):
        got = matched(block)
        found.append(got if last and not found else written(got, "matches"))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, end int")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass for each block of items; null and empty texts stay."""
    for last, block in _with_last(blocks(benchmark)):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                kept = pa.array([not matcher.matches(t) for t in strings(batch, text_col)], pa.bool_())
                yield batch.filter(kept)

        docs = map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
        docs = docs if last else written(docs, "kept")
    return docs
