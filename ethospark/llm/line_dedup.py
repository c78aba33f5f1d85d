"""Removal of passages that documents share, by content-defined chunks of lines.

Long physical lines are folded into short ones at content-defined places (a word whose hash is the least of its
neighbourhood ends a line), so that a passage inside a line folds alike wherever it stands. A rolling hash over the hashes of
neighbouring lines chooses chunk boundaries; they move with the text, so an insertion changes only the chunks around it.

Chunks are grouped by their hash over all documents. The group's least and greatest bytes are kept in the same aggregate:
if they are equal, all its chunks are equal byte for byte, and the group is a repetition; otherwise the hash collided and nothing of it is
removed. Of a repeated chunk the document of its first occurrence (least id) keeps it, with what it repeats itself. Runs of
repeated chunks are removed from ``MIN_WORDS`` words on, so that a shared short sentence isn't a passage.

A first pass shuffles hashes only. Those that several documents have set a bit in a bitmap of fixed size, and bytes
and places are shuffled of chunks whose bit is set: the bitmap spares work and decides nothing. Bytes are merged before the
shuffle, so a passage that a third of all documents share costs one row a task; the places of such a passage don't
meet in one task either (``join_split``). Removed spans come back to the documents by a join on the id and the text's digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import binary, fresh, join_split, map_batches, written

#: A line ends after the word of least hash within so many words.
FOLD = 5
#: A chunk ends where the rolling hash over this many lines is 0 modulo DIVISOR, and has two lines at least.
WINDOW, DIVISOR, MIN_LINES = 2, 2, 2
#: Words that a run of repeated chunks must have to be removed.
MIN_WORDS = 24
#: Texts are worked on in pieces of so many bytes.
PIECE = 1 << 19
#: Bits of the bitmap of repeated hashes, which goes to every task.
FILTER_BITS = 1 << 26
#: Spans are broadcast if they have so many bytes at most, and shuffled with the texts otherwise.
BROADCAST_BYTES = 32 << 20
NULL_ID = -(2**63)

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the polynomial's bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 1)
            steps = np.ones(size, np.uint64)
            steps[1:] = BASE
            self.up = np.multiply.accumulate(steps)
            steps[1:] = _INVERSE
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


def _hashes(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), the same wherever they stand."""
    return _mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def chunks(data: bytes, begins: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), words and hash of each chunk of the texts that begin at ``begins``, each ended by a line feed.

    What a text yields doesn't depend on its neighbours; texts are taken together only to spare calls.
    """
    none = np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    if space.all():
        return none, none, none, np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers.upto(len(raw) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    word, n = _hashes(prefix, down, start, end), len(start)
    doc = np.searchsorted(begins, start, side="right") - 1
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # A word ends a line if it is the least of some FOLD neighbours, or ends a physical line. Words of the greatest hash
    # stand between texts.
    place = np.arange(n) + FOLD * np.cumsum(new_doc)
    padded = np.full(place[-1] + FOLD, 2**64 - 1, np.uint64)
    padded[place] = word
    least = np.lib.stride_tricks.sliding_window_view(padded, FOLD).min(axis=1)
    ends_line = np.zeros(n, bool)
    for k in range(FOLD):
        ends_line |= word == least[place - k]
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    ends_line[:-1] |= feeds[start[1:]] > feeds[end[:-1]]
    ends_line[-1] = True
    last = np.flatnonzero(ends_line)
    first = np.concatenate([[0], last[:-1] + 1])
    line = _hashes(prefix, down, start[first], end[last])
    # The rolling hash of a line and the WINDOW - 1 lines before it in the text.
    opens = new_doc[first]
    rolling, same = line.copy(), ~opens
    for k in range(1, WINDOW):
        rolling[k:] += np.where(same[k:], line[:-k] * np.uint64(2 * k + 1), np.uint64(0))
        same[1:] &= same[:-1]
    closes = np.concatenate([opens[1:], [True]])
    at = np.flatnonzero((_mix(rolling) % np.uint64(DIVISOR) == 0) | closes)
    kept, before = [], -1
    for x, final in zip(at.tolist(), closes[at].tolist(), strict=True):
        if final or x - before >= MIN_LINES:
            kept.append(x)
            before = x
    last_line = np.array(kept)
    first_line = np.concatenate([[0], last_line[:-1] + 1])
    a, b = start[first[first_line]], end[last[last_line]]
    return a, b, last[last_line] - first[first_line] + 1, _hashes(prefix, down, a, b)


def _rows(schema: pa.Schema, keep: Callable[[np.ndarray], np.ndarray] | None = None):
    """The chunks of all texts, with what ``schema`` asks for; ``keep`` says which hashes are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            texts = binary(batch, "text")
            k = 0
            while k < len(texts):
                size, m = len(texts[k]) + 1, k + 1
                while m < len(texts) and size + len(texts[m]) < PIECE:
                    size += len(texts[m]) + 1
                    m += 1
                begins = np.cumsum([0, *[len(t) + 1 for t in texts[k : m - 1]]])
                data = b"\n".join(texts[k:m]) + b"\n"
                a, b, words, hashed = chunks(data, begins, powers)
                doc = np.searchsorted(begins, a, side="right") - 1
                number = np.arange(len(a)) - np.searchsorted(doc, doc)
                if keep is not None:
                    some = keep(hashed)
                    a, b, words, hashed, doc, number = (x[some] for x in (a, b, words, hashed, doc, number))
                rows = pa.array(doc + k)
                made = {
                    "hash": lambda: pa.array(hashed.view(np.int64)),
                    "doc_id": lambda: batch.column(0).take(rows),
                    "key": lambda: batch.column(1).take(rows),
                    "bytes": lambda: pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                    "number": lambda: pa.array(number),
                    "at": lambda: pa.array(a - begins[doc]),
                    "end": lambda: pa.array(b - begins[doc]),
                    "words": lambda: pa.array(words, pa.int64()),
                }
                k = m
                if len(doc):
                    yield pa.RecordBatch.from_arrays([made[n]() for n in schema.names], schema=schema)

    return run


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with one for each ``hash``; what comes to the driver is bounded by its size."""
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, key, starts, ends): the bytes of each row of ``docs`` that repeat a passage of a lesser id.

    ``key`` is the digest of the row's text. A null id is less than all others.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    long = pa.int64()
    # First the hashes alone, to learn which ones several documents have.
    plain = map_batches(source, _rows(pa.schema([("hash", long), ("doc_id", long)])), "hash long, doc_id long")
    several = written(plain.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash"), "repeated")
    bits = spark.sparkContext.broadcast(_bits(several))

    def keep(hashed: np.ndarray) -> np.ndarray:
        place = hashed & np.uint64(FILTER_BITS - 1)
        return bits.value[(place >> np.uint64(6)).astype(np.int64)] >> (hashed & np.uint64(63)) & np.uint64(1) == 1

    # Then the bytes and places of those that the bitmap lets through; a chance hit of it is a group of one document.
    texts = map_batches(source, _rows(pa.schema([("hash", long), ("doc_id", long), ("bytes", pa.binary())]), keep), "hash long, doc_id long, bytes binary")
    groups = texts.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.count("*").alias("rows"))
    groups = written(groups.where((F.col("first") < F.col("last")) & (F.col("low") == F.col("high"))).select("hash", "first", "rows"), "groups")
    names = ["hash", "doc_id", "key", "number", "at", "end", "words"]
    spans = map_batches(source, _rows(pa.schema([(n, long) for n in names]), keep), ", ".join(f"{n} long" for n in names))
    found = join_split(spans, groups, "hash", "rows").where("doc_id > first")
    runs = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("number", "at", "end", "words"))).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for row in batch.column(2).to_pylist():
                kept: list[list[int]] = []
                for x in row:
                    if kept and x["number"] == kept[-1][0] + 1:  # only white space stands between neighbouring chunks
                        kept[-1] = [x["number"], kept[-1][1], x["end"], kept[-1][3] + x["words"]]
                    else:
                        kept.append([x["number"], x["at"], x["end"], x["words"]])
                kept = [x for x in kept if x[3] >= min_words]
                starts.append([x[1] for x in kept])
                ends.append([x[2] for x in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], schema=schema)

    return map_batches(runs, merge, "doc_id long, key long, starts array<long>, ends array<long>").where(F.size("starts") > 0)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``removed_chars`` (without ``counts``: no further column).

    Null and empty texts stay as they are. Rows with equal ids count as one document, so neither is cut for the
    other's sake; a document that is an exact copy of an earlier one, under another id, loses its text. Two cut ends are joined by the
    white space before the cut, and white space at a text's cut end goes. ``n_chars``, if there is one, follows. With ``counts`` a
    column of the name ``removed_chars`` gives way; other columns of any name are kept.
    """
    spans = written(repeated_spans(docs, min_words), "spans")
    size = spans.agg(F.coalesce(F.sum(F.size("starts") * 16 + 40), F.lit(0)).alias("n")).first()["n"]
    fields = [f for f in docs.schema.fields if not (counts and f.name == "removed_chars")]
    names = [f.name for f in fields]
    id_, key, starts_, ends_, at_ = fresh(docs, "id", "key", "starts", "ends", "at")
    spans = spans.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("starts").alias(starts_), F.col("ends").alias(ends_))
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    left = docs.select(*[F.col(f"`{n}`") for n in names], F.xxhash64("text").alias(at_))
    joined = left.join(spans, (F.col(at_) == F.col(key)) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col(id_)), "left").select(*[F.col(f"`{n}`") for n in names], starts_, ends_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            texts, starts, ends = (batch.column(place[n]).to_pylist() for n in ("text", starts_, ends_))
            removed, lengths = [0] * len(texts), [None if t is None else len(t) for t in texts]
            for i, (text, a, b) in enumerate(zip(texts, starts, ends, strict=True)):
                if a:
                    raw, parts, at = text.encode(), [], 0
                    for x, y in zip(a, b, strict=True):
                        parts.append(raw[at:x])
                        at = y
                    tail = raw[at:]
                    parts.append(tail.lstrip() if parts[-1][-1:].isspace() or not b"".join(parts) else tail)
                    cut = b"".join(p if k == 0 or k == len(parts) - 1 else p.lstrip() for k, p in enumerate(parts)).decode()
                    cut = cut if tail.strip() else cut.rstrip()
                    removed[i], lengths[i], texts[i] = len(text) - len(cut), len(cut), cut
            columns = [pa.array(texts, pa.string()) if n == "text" else pa.array(lengths, batch.column(place[n]).type) if n == "n_chars" else batch.column(place[n]) for n in names]
            more = [pa.array(removed, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, *["removed_chars"][: len(more)]])

    return map_batches(joined, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", removed_chars long" * counts)
