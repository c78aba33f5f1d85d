"""Token ids in wavelet-matrix shards: a succinct file format with access, count and occurrence lookup.

A shard holds whole documents in id order. Its payload is one byte string: a header, the documents' ids and lengths, and for
each bit of the alphabet a plane of packed bits, highest bit first, with the counts of set bits before each block of the
plane. A plane is sorted stably by its bit before the next one is taken (a wavelet matrix), so rank on the planes answers

* ``access(i)``: the token at a place,
* ``rank(token, i)``: how often a token occurs before a place (``count`` over a range is a difference),
* ``select(token, k)``: where its k-th occurrence is.

All three read a few words of each plane where they lie in the payload; nothing is unpacked. ``counts``, ``locate`` and
``tokens_at`` ask them of a whole table of shards. Only ``tokens``, which gives back every id, unpacks the planes.

Shards are rows of a Parquet table (partition, number, first and last id, tokens, payload), so they are written and read with
Spark on any store. Partitions are ranges of document ids; nothing is collected, and a shard's size is bounded by
``SHARD_TOKENS`` plus one document.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethospark.llm.common import local_file, map_batches, strings

MAGIC = b"WVM2"
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 20
#: Bits between two stored ranks of a plane.
BLOCK = 512
#: Distinct parts of texts that a worker remembers, twice: those since it last began anew, and those before.
MAX_PARTS = 500_000
NULL_ID = -(2**63)
HEAD = struct.Struct("<4sIQQ")
# The pattern of byte-level vocabularies, and the letters that stand for bytes in their tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
LETTERS = {b: chr(b) for b in PLAIN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in PLAIN)}
#: Texts of characters before this one are cut by the pattern here, others by the library.
COMMON = "\u0250"
MARK = LETTERS[32]


def build(tokens: np.ndarray, ids: list[int], lengths: list[int]) -> bytes:
    """The payload of one shard."""
    width, n = max(1, int(tokens.max(initial=0)).bit_length()), len(tokens)
    words = -(-n // BLOCK) * (BLOCK // 64)
    parts = [HEAD.pack(MAGIC, width, n, len(ids)), np.array(ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes()]
    rest = tokens.astype(np.uint16 if width <= 16 else np.uint32)
    for k in range(width - 1, -1, -1):
        bit = (rest >> k & 1).astype(bool)
        plane = np.zeros(words * 8, np.uint8)
        plane[: -(-n // 8)] = np.packbits(bit, bitorder="little")
        ones = np.bitwise_count(plane.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
        parts += [np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)]).astype("<u8").tobytes(), plane.tobytes()]
        rest = np.concatenate([rest[~bit], rest[bit]])
    return b"".join(parts)


class Shard:
    """Answers from a payload, which stays packed."""

    def __init__(self, payload: bytes):
        magic, self.width, self.n, docs = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = HEAD.size

        def take(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(payload, "<u8", count, at - 8 * count)

        self.ids, self.lengths = take(docs).view("<i8"), take(docs).view("<i8")
        blocks = -(-self.n // BLOCK)
        self.ranks, self.planes = [], []
        for _ in range(self.width):
            self.ranks.append(take(blocks + 1))
            self.planes.append(take(blocks * (BLOCK // 64)))
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]

    def _ones(self, plane: int, i: int) -> int:
        """Set bits of a plane before place i: the block's stored count, and those of a few words."""
        block, word = i // BLOCK, i // 64
        found = int(self.ranks[plane][block])
        for x in self.planes[plane][block * (BLOCK // 64) : word].tolist():
            found += x.bit_count()
        return found + (int(self.planes[plane][word]) & ((1 << i % 64) - 1)).bit_count() if i % 64 else found

    def access(self, i: int) -> int:
        token = 0
        for k, plane in enumerate(self.planes):
            bit = int(plane[i // 64]) >> i % 64 & 1
            token = token << 1 | bit
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
        return token

    def _follow(self, token: int, i: int) -> tuple[int, int]:
        """Where the places before 0 and before i go in the last plane, along the token's bits."""
        start = 0
        for k in range(self.width):
            if token >> (self.width - 1 - k) & 1:
                start, i = (self.zeros[k] + self._ones(k, x) for x in (start, i))
            else:
                start, i = (x - self._ones(k, x) for x in (start, i))
        return start, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        if token < 0 or token >> self.width:
            return 0
        start, end = self._follow(token, i)
        return end - start

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of a token; -1 if there are fewer."""
        if k < 0 or k >= self.rank(token, self.n):
            return -1
        i = self._follow(token, 0)[0] + k
        for level in range(self.width - 1, -1, -1):
            set_ = token >> (self.width - 1 - level) & 1
            i = self._select_bit(level, set_, i - self.zeros[level] if set_ else i)
        return i

    def _select_bit(self, level: int, bit: int, nth: int) -> int:
        ranks = self.ranks[level]
        before = lambda b: int(ranks[b]) if bit else b * BLOCK - int(ranks[b])
        block = bisect_right(range(len(ranks)), nth, key=before) - 1
        left = nth - before(block)
        for word in range(block * (BLOCK // 64), (block + 1) * (BLOCK // 64)):
            x = int(self.planes[level][word])
            x = x if bit else ~x & 2**64 - 1
            if left < x.bit_count():
                for _ in range(left):
                    x &= x - 1  # the lowest set bit goes
                return word * 64 + (x & -x).bit_length() - 1
            left -= x.bit_count()
        raise AssertionError

    def tokens(self) -> np.ndarray:
        """All tokens: from the last plane up, each sort by a bit is undone."""
        values = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bit, before = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").astype(bool), np.empty_like(values)
            before[~bit] = values[: self.zeros[k]]
            before[bit] = values[self.zeros[k] :] | values.dtype.type(1 << (self.width - 1 - k))
            values = before
        return values.astype(np.uint32)


class _Encoder:
    """The tokenizer's ids of whole texts, by way of a table of distinct parts.

    The vocabulary's pattern cuts a text into matches that the library's model encodes each for itself; between two characters that
    aren't white space, a single space always begins a match. So a text falls apart at its spaces, and a part is encoded
    once; a worker remembers a bounded number of parts. Texts with special tokens, and those with white space next to a space, are given to the library whole.
    """

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(local_file(path))
        self.special = [] if special_as_text else [t["content"] for t in spec.get("added_tokens", ())]
        before = spec.get("pre_tokenizer") or {}
        self.simple = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.find = regex.compile(BYTE_LEVEL).findall
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        letters = MARK + word[1:] if word[0] == " " and word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(LETTERS)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(letters)])

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """The ids of a text by itself, match by match; the library cuts texts with letters of rarer scripts."""
        tokenize = self.tokenizer.model.tokenize
        if part.isascii() and part[1:].isalpha() and part[0] == " ":  # one match
            return self._pack([t.id for t in tokenize(MARK + part[1:])])
        if not part.isascii() and max(part) >= COMMON:
            return self._pack([t.id for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) for t in tokenize(w)])
        out, words = [], self.words
        for word in self.find(part):
            got = words.get(word)
            if got is None:
                got = self._word(word)
                if len(word) < 6 and len(words) < MAX_PARTS // 4:  # endings and marks, which come back in other parts
                    words[word] = got
            out.append(got)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if not self.simple or any(s in text for s in self.special):
            return self._whole(text)
        parts = text.split(" ")
        known, last = self.parts, len(parts) - 1
        got = list(map(known.get, parts))
        got[0] = b"" if last and not parts[0] else None  # the first part has no space before it
        if len(known) > MAX_PARTS:  # what comes again within the next so many parts is kept
            self.older, self.parts = known, {}
            known = self.parts
        for k in [k for k, x in enumerate(got) if x is None]:
            part = parts[k]
            if k and (not part or part[0].isspace()) or k < last and part[-1:].isspace():
                return self._whole(text)
            if not k:
                got[k] = self._part(part)
            elif (found := known.get(part)) is None:
                got[k] = found = self.older.get(part) or self._part(" " + part)
                if not part[-1].isspace():
                    known[part] = found
            else:
                got[k] = found
        return b"".join(got)


@lru_cache(maxsize=1)
def _encoder(path: str, special_as_text: bool) -> _Encoder:
    """One encoder a Python worker: what it remembers serves the worker's later tasks too."""
    return _Encoder(path, special_as_text)


def shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, special_as_text: bool = False) -> DataFrame:
    """Rows (part, number, first_id, last_id, n_docs, n_tokens, payload) of ``docs`` in ascending id order.

    Each document's ids end with ``end_id``. A null text is empty; null ids come first, and rows with equal ids are in
    the order of their texts' XXH64, then of the texts. Strings of special tokens are those tokens, as in the library's default, or
    ordinary text. The DataFrame is to be written before it is read twice.
    """
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, encode = TaskContext.get().partitionId(), 0, None
        ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            tokens, lengths = np.frombuffer(b"".join(held), "<u4"), [len(x) // 4 for x in held]
            row = (part, number, ids[0], ids[-1], len(ids), len(tokens), build(tokens, ids, lengths))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            encode = encode or _encoder(tokenizer, special_as_text)
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, strings(batch, "text"), strict=True):
                got = encode(text)
                ids.append(NULL_ID if key is None else key)
                held.append(got + end)
                size += len(got) // 4 + 1
                if size >= shard_tokens:
                    yield close()
                    number += 1
                    ids, held, size = [], [], 0
        if ids:
            yield close()

    # Ranges are cut by id and digest, so that rows of one id needn't all go to one task.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    ordered = rows.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest", "text").select("id", "text")
    return map_batches(ordered, run, "part int, number int, first_id long, last_id long, n_docs long, n_tokens long, payload binary")


def with_starts(table: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of all shards before.

    Sums of the tokens come first by partition, so the window without a key sees one row for each partition of the
    writing job; the windows over shards are within a partition.
    """
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    inside = table.select("part", "number", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")).alias("inside"))
    starts = inside.join(before, "part").select("part", "number", (F.col("before") + F.col("inside")).alias("start"))
    return table.join(starts, ["part", "number"])


def read_documents(table: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), read back from the shards' payloads (with ``start``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, payload = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("start", "payload"))
                shard = Shard(payload)
                raw, ends = memoryview(shard.tokens().astype("<u4").tobytes()), np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(shard.ids, mask=shard.ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(begins + start), pa.array(shard.lengths), pa.array(sums, pa.int64())], schema=schema)

    return map_batches(table.select("start", "payload"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ask(table: DataFrame, answer, schema: str, types: list[tuple[str, pa.DataType]], *columns: str) -> DataFrame:
    """What ``answer(shard, *values)`` gives for each shard of ``table``, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = list(answer(Shard(row["payload"]), *[row[c] for c in columns]))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*got, strict=True), types, strict=True)], schema=pa.schema(types))

    return map_batches(table.select(*columns, "payload"), run, schema)


def counts(table: DataFrame, tokens: list[int]) -> DataFrame:
    """Rows (token, n): how often each of a few tokens occurs in all shards. Tokens that occur nowhere have no row."""

    def answer(shard: Shard) -> Iterator[tuple[int, int]]:
        return ((t, n) for t in dict.fromkeys(tokens) if (n := shard.rank(t, shard.n)))

    return _ask(table, answer, "token long, n long", [("token", pa.int64()), ("n", pa.int64())]).groupBy("token").agg(F.sum("n").alias("n"))


def locate(table: DataFrame, token: int) -> DataFrame:
    """Rows (doc_id, position): each occurrence of a token, by its place in its document from 0."""

    def answer(shard: Shard) -> Iterator[tuple[int | None, int]]:
        ends = np.cumsum(shard.lengths)
        for k in range(shard.rank(token, shard.n)):
            place = shard.select(token, k)
            doc = int(np.searchsorted(ends, place, side="right"))
            key = int(shard.ids[doc])
            yield None if key == NULL_ID else key, place - int(ends[doc] - shard.lengths[doc])

    return _ask(table, answer, "doc_id long, position long", [("doc_id", pa.int64()), ("position", pa.int64())])


def tokens_at(table: DataFrame, places: list[int]) -> DataFrame:
    """Rows (place, token) for a few places among all tokens in id order; ``table`` has ``start``."""

    def answer(shard: Shard, start: int) -> Iterator[tuple[int, int]]:
        return ((p, shard.access(p - start)) for p in places if start <= p < start + shard.n)

    return _ask(table, answer, "place long, token long", [("place", pa.int64()), ("token", pa.int64())], "start")
