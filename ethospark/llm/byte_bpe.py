"""Byte-level BPE: encoding by a fold of ranked merges, decoding by joining the pieces' bytes.

One narrow stage, without a shuffle:

1. Python splits each text and numbers the distinct words of its partition. A word that is a token as a whole has the token's
   number; any other goes out once, in a row of many words, before the first document that holds it. A document goes out
   as the numbers of its words.
2. Spark's higher-order functions fold the ranked merges of each word over its bytes, with a literal map of ranks. Only the
   ranks of neighbouring bytes come with the word, and words of more than ``LONG`` bytes come merged.
3. Python puts the ids of the words in the documents' order and, for decoding, joins the binary pieces.

Rows keep their order within a partition, as nothing between the two Python steps moves them; numbers hold within a
partition only.

The map of ranks has a bounded size: it is the vocabulary's. The table of distinct words starts anew after
``max_words`` words, so memory is bounded whatever a partition holds. A lost task is simply run again.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import let, local_file, map_batches, strings

#: A word under way is a string: a byte is the character of its value, the token of rank i the character FIRST + i, so
#: characters compare as ranks do. Pairs that the vocabulary doesn't merge get NO_RANK, which is behind all others.
FIRST, EDGE, NO_RANK = 256, "\ufffe", "\uffff"
SURROGATES, AFTER = 0xD800, 0xE000
# Fixed value: patterns that begin so match a space and letters as a whole.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"
BUCKETS = 65536
#: Words of a row of words, at most: they are in memory together, in Python and in the JVM.
WORDS_A_ROW = 1 << 13
MAX_WORDS = 400_000
#: Space-separated parts whose words are remembered.
MAX_PARTS = 200_000
#: Words of more bytes are merged in Python, where the work doesn't grow with the square of the length.
LONG = 256
#: Bytes of word numbers after which documents and new words go out.
CHUNK_BYTES = 6 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in local_file(path).splitlines() if line.strip())}


@lru_cache(2)
def _known(path: str) -> tuple[dict[bytes, int], dict[str, str], dict[str, str]]:
    """The ranks of a file, their pairs, and the rank of any two bytes: read once a Python worker, not once a task."""
    ranks = read_ranks(path)
    pairs = pair_ranks(ranks)
    marks = list(map(chr, range(256)))
    return ranks, pairs, {a + b: pairs.get(a + b, NO_RANK) for a in marks for b in marks}


def _char(rank: int) -> str:
    point = FIRST + rank
    return chr(point if point < SURROGATES else point + AFTER - SURROGATES)


def pair_ranks(ranks: dict[bytes, int]) -> dict[str, str]:
    """For each two tokens that together are a token: that token's character. The key has a character for each of the two."""
    char = {t: chr(t[0]) if len(t) == 1 else _char(r) for t, r in ranks.items()}
    return {char[t[:k]] + char[t[k:]]: char[t] for t in ranks for k in range(1, len(t)) if t[:k] in char and t[k:] in char}


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of small maps, chosen by the hash of the pair; its size is the vocabulary's.

    Spark searches a map from end to end, so a single map with all ranks would be slow. The JSON text is read by the optimizer, which makes one
    literal of it; no task reads it.
    """
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for pair, char in pair_ranks(ranks).items():
        buckets[xxhash.xxh64_intdigest(pair, 42) & (BUCKETS - 1)][pair] = char
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), "array<map<string,string>>")


def fold_merges(word: Column, table: Column) -> Column:
    """One word to its tokens, a character each: merge the pair of lowest rank, leftmost first, until none is left.

    ``word`` is a struct (w, r): the word, a character for each byte, between two marks ``EDGE``, and the rank of each character
    with the next one, a character too. A merge puts the token's character in the place of two, looks up its ranks
    with both neighbours and puts them in the place of three. The marks merge with nothing, so every pair has two neighbours. With
    no rank left ``r`` is empty.

    Higher-order functions are interpreted, so a step has few nodes: the place of the pair is searched again where it is needed, and the new pairs are cut out of the merged word.
    """
    none, one, two = F.lit(NO_RANK), F.lit(1), F.lit(2)

    def rank(pair: Column) -> Column:
        bucket = F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        return F.coalesce(F.try_element_at(F.get(table, bucket), pair), none)

    def merge(w: Column, r: Column, lowest: Column) -> Column:
        i = F.instr(r, lowest)  # the place of the pair, from 2

        def put(merged: Column) -> Column:
            before, after = rank(F.substring(merged, i - 1, two)), rank(F.substring(merged, i, two))
            return F.struct(merged.alias("w"), F.overlay(F.overlay(r, after, i, two), before, i - 1, one).alias("r"))

        return let(F.overlay(w, lowest, i, two), put)

    def step(state: Column, _: Column) -> Column:
        w, r = state["w"], state["r"]
        ended = F.struct(w.alias("w"), F.lit("").alias("r"))
        return F.when(r == "", state).otherwise(let(F.array_min(F.split(r, "")), lambda m: F.when(m == none, ended).otherwise(merge(w, r, m))))

    return F.aggregate(F.sequence(F.lit(2), F.length(word["w"])), word, step)["w"]


def merge_long(word: str, pairs: dict[str, str]) -> str:
    """The same merges for a long word, in n log n: a heap of ranked pairs over a linked list of tokens."""
    tokens: list[str | None] = list(word)
    after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
    heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if (m := pairs.get(a + b)) is not None]
    heapify(heap)
    while heap:
        merged, i, a, b = heappop(heap)
        j = after[i]
        if tokens[i] != a or j >= len(tokens) or tokens[j] != b:
            continue  # one of the two has been merged since
        tokens[i], tokens[j] = merged, None
        after[i] = k = after[j]
        if k < len(tokens):
            before[k] = i
            if (m := pairs.get(merged + tokens[k])) is not None:
                heappush(heap, (m, i, merged, tokens[k]))
        if (h := before[i]) >= 0 and (m := pairs.get(tokens[h] + merged)) is not None:
            heappush(heap, (m, h, tokens[h], merged))
    return "".join(t for t in tokens if t is not None)


class _Words:
    """Numbers of a partition's distinct words; what is new since the last flush goes out in rows of many words.

    A word that is a token as a whole has the token's rank for its number; the others are counted from behind the ranks.
    A text falls apart at its spaces, as between two characters that aren't white space a space always begins a match.
    """

    def __init__(self, pattern: str, ranks_path: str, max_words: int):
        self.find, self.max_words = regex.compile(pattern).findall, max_words
        self.ranks, self.pairs, self.bytes = _known(ranks_path)
        ranks = self.ranks
        self.letters = pattern.startswith(LETTERS)
        self.first = max(ranks.values(), default=-1) + 1
        self.numbers: dict[str, int] = {}
        self.parts: dict[str, bytes] = {}
        self.fresh: list[bytes] = []
        self.count = 0

    def start(self, raw: bytes) -> tuple[str, str]:
        """The state that the fold begins with; a long word comes merged."""
        w = raw.decode("latin-1")
        if len(w) > LONG:
            return f"{EDGE}{merge_long(w, self.pairs)}{EDGE}", ""
        return f"{EDGE}{w}{EDGE}", f"{NO_RANK}{''.join(map(self.bytes.__getitem__, map(add, w, w[1:])))}{NO_RANK}"

    def number(self, word: str) -> int:
        n = self.numbers.get(word)
        if n is None:
            raw = word.encode()
            n = self.ranks.get(raw)
            if n is None:
                n = self.first + self.count
                self.count += 1
                self.fresh.append(raw)
            self.numbers[word] = n
        return n

    def refs(self, part: str) -> bytes:
        out = list(map(self.number, [part] if self.letters and part[:1] == " " and part[1:].isalpha() else self.find(part)))
        return pack(f"<{len(out)}i", *out) if len(out) < 8 else np.array(out, np.int32).tobytes()

    def text(self, text: str) -> bytes:
        parts, known, number, letters = text.split(" "), self.parts, self.number, self.letters
        last = len(parts) - 1
        got = list(map(known.get, parts))
        got[0] = b"" if last and not parts[0] else None  # the first part has no space before it
        if len(known) > MAX_PARTS:
            known.clear()
        for k in [k for k, x in enumerate(got) if x is None]:
            part = parts[k]
            if k and letters and part.isalpha():
                if (found := known.get(part)) is None:
                    known[part] = found = number(" " + part).to_bytes(4, "little")
                got[k] = found
                continue
            if k and (not part or part[0].isspace()) or k < last and part[-1:].isspace():
                return self.refs(text)
            if not k:
                got[k] = self.refs(part)
            elif (found := known.get(part)) is None:
                got[k] = found = self.refs(" " + part)
                if not part[-1].isspace():
                    known[part] = found
            else:
                got[k] = found
        return b"".join(got)

    def full(self) -> bool:
        if len(self.numbers) < self.max_words:
            return False
        self.numbers.clear()
        self.parts.clear()
        self.count = 0
        return True


def _split(id_col: str, text_col: str, pattern: str, ranks_path: str, max_words: int, chunk_bytes: int, schema: pa.Schema):
    def rows(words: pa.Array, refs: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), words, pa.array(refs, schema.types[2])], schema=schema)

    def row(states: list[tuple[str, str]]) -> pa.RecordBatch:
        pair = pa.StructArray.from_arrays([pa.array([s[k] for s in states], pa.string()) for k in (0, 1)], fields=list(schema.types[1].value_type))
        return rows(pa.ListArray.from_arrays(pa.array([0, len(states)], pa.int32()), pair), [None], [None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(pattern, ranks_path, max_words)
        docs: list[tuple[object, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            fresh = words.fresh
            for k in range(0, len(fresh), WORDS_A_ROW):
                yield row([words.start(raw) for raw in fresh[k : k + WORDS_A_ROW]])
            fresh.clear()
            if docs:
                yield rows(pa.nulls(len(docs), schema.types[1]), [r for _, r in docs], [i for i, _ in docs])
            docs.clear()

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            for i, text in zip(ids, strings(batch, text_col), strict=True):
                refs = words.text(text)
                docs.append((i, refs))
                size += len(refs) + 64
                if size > chunk_bytes:
                    yield from flush()
                    size = 0
                    if words.full():
                        yield row([])  # the words so far are forgotten
        yield from flush()

    return run


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``refs`` name, one after the other, and where each of them begins (and the last ends)."""
    sizes = length[refs]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(start[refs] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _join(ranks_path: str, decoded: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _known(ranks_path)[0]
        size = max(ranks.values(), default=-1) + 1
        byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(FIRST)], np.int32)
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        flat: list[np.ndarray] = []  # ids of the words so far, after the tokens themselves
        lengths: list[np.ndarray] = []

        def forget() -> None:
            flat[:], lengths[:] = [np.arange(size, dtype=np.int32)], [np.ones(size, np.int64)]

        def take(row: pa.Array) -> None:
            points = np.frombuffer("".join(row.to_pylist()).encode("utf-16-le"), np.uint16).astype(np.int32)
            edges = np.flatnonzero(points == ord(EDGE))  # each word stands between two of them
            lengths.append(edges[1::2] - edges[::2] - 1)
            points = np.delete(points, edges)
            points = np.where(points >= AFTER, points - (AFTER - SURROGATES), points)
            flat.append(np.where(points < FIRST, byte_ids[np.minimum(points, FIRST - 1)], points - FIRST).astype(np.int32))

        def joined(keys: list, names: list[bytes]) -> Iterator[pa.RecordBatch]:
            for table in (flat, lengths):
                table[:] = [np.concatenate(table)]
            start = np.cumsum(lengths[0]) - lengths[0]
            for part in _slices([len(x) // 4 for x in names]):
                numbers = [len(x) // 4 for x in names[part]]
                out, ends = _gather(flat[0], start, lengths[0], np.frombuffer(b"".join(names[part]), np.int32))
                cuts = ends[np.cumsum([0, *numbers])]
                columns = [pa.array(keys[part], schema.types[0]), pa.ListArray.from_arrays(cuts.astype(np.int32), out)]
                if decoded:
                    columns.append(pa.array([b"".join(map(pieces.__getitem__, out[a:b].tolist())) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            keys.clear()
            names.clear()

        forget()
        for batch in batches:
            ids, chars, refs = (batch.column(k) for k in range(3))
            keys, names = [], []
            for n, (i, ref) in enumerate(zip(ids.to_pylist(), refs.to_pylist(), strict=True)):
                if ref is not None:
                    keys.append(i)
                    names.append(ref)
                elif len(row := chars[n].values):
                    take(row)
                else:  # the documents so far know the words so far
                    yield from joined(keys, names)
                    forget()
            yield from joined(keys, names)

    return run


def _slices(sizes: list[int], most: int = 1 << 19) -> Iterator[slice]:
    """Neighbouring rows of ``most`` words together, one row at least."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += n
    if sizes:
        yield slice(begin, len(sizes))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, max_words: int = MAX_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (id, ids array<int>[, decoded binary]) for each row of ``docs``.

    A null or empty text has no ids. Rows with equal or null ids stay apart. ``decoded`` adds the bytes that the ids
    stand for. Vocabularies have 57,000 tokens at most (a token is one character in the fold).
    """
    ranks = read_ranks(ranks_path)
    if max(ranks.values(), default=0) + FIRST + AFTER - SURROGATES >= ord(EDGE):
        raise ValueError("the vocabulary is too large for one character a token")
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int"):
        docs = docs.withColumn(id_col, F.col(id_col).cast("string"))
        kind = "string"
    sent = pa.schema([(id_col, id_type), ("words", pa.list_(pa.struct([("w", pa.string()), ("r", pa.string())]))), ("refs", pa.binary())])
    words = map_batches(docs.select(id_col, text_col), _split(id_col, text_col, pattern, ranks_path, max_words, chunk_bytes, sent), f"`{id_col}` {kind}, words array<struct<w:string,r:string>>, refs binary")
    fold = let(rank_table(ranks), lambda t: F.transform("words", lambda w: fold_merges(w, t)))
    folded = words.select(id_col, F.when(F.col("words").isNotNull(), fold).alias("chars"), "refs")
    got = [(id_col, id_type), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.binary())] * decoded
    return map_batches(folded, _join(ranks_path, decoded, pa.schema(got)), f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of what ``encode(..., decoded=True)`` returns: lowercase hex digests of the decimal ids, joined by commas, and of the bytes."""
    # In the JVM: a third Python worker for each task would cost more memory than it saves time.
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
