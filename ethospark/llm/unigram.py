"""Token counts under a unigram model, with a trie that shares the forward scores of common prefixes.

Words are cut at white space and begin with the model's mark for a space. A task puts each distinct word it meets in a trie,
which it keeps from document to document. A node's forward score is the best log probability of any cut of its
prefix into pieces; it is computed when the node is made, from the scores of the nodes above it, so once however many words
go through it. The number of pieces of the best cut is stored at each node, and a word's count is that of its terminal node; a
document's count is the sum over its words.

Work stays in the task that reads a document: no shuffle, and memory is bounded by ``MAX_NODES`` and ``MAX_WORDS``.

The pieces are a public tokenizer's, which isn't trained here; its file has merge ranks and no probabilities, so they are Zipf's by
rank (``read_pieces``), not estimated from a corpus.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import map_batches, strings

MARK = "▁"
#: Words and nodes of the trie that a task remembers; beyond, it starts anew.
MAX_WORDS, MAX_NODES = 400_000, 1_500_000
#: A character that no piece covers is as many tokens as it has UTF-8 bytes; each costs so much more than the rarest piece.
UNKNOWN = 10.0


def read_pieces(path: str) -> dict[str, float]:
    """Log probabilities of a sentencepiece model's ordinary pieces.

    Piece r in the model's order gets Zipf's probability, 1 / ((r + 1) * sum(1 / i)): the order is by frequency, and the
    stored scores of a merge model are ranks only.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    whole = math.log(sum(1 / i for i in range(1, len(names) + 1)))
    return {name: -math.log(r + 1) - whole for r, name in enumerate(names)}


class Trie:
    """Nodes with forward scores; a child is found by its parent's number and its character."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=0)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.children: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("q", [0])

    @property
    def nodes(self) -> int:
        """Nodes without the root, each of which was scored once."""
        return len(self.score) - 1

    def _score(self, word: str, end: int, path: list[int]) -> tuple[float, int]:
        """Of the cuts of the first ``end`` characters the likeliest, of equal ones that with fewer tokens."""
        pieces, score, count = self.pieces, self.score, self.count
        size = len(word[end - 1].encode())
        best, least = score[path[end - 1]] + size * self.unknown, count[path[end - 1]] + size
        for begin in range(max(0, end - self.longest), end):
            p = pieces.get(word[begin:end])
            if p is not None:
                s, c = score[path[begin]] + p, count[path[begin]] + 1
                if s > best or s == best and c < least:
                    best, least = s, c
        return best, least

    def add(self, word: str) -> int:
        """The word's terminal node."""
        children, node, path = self.children, 0, [0]
        for end, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            child = children.get(key)
            if child is None:
                best, least = self._score(word, end, path)
                child = children[key] = len(self.score)
                self.score.append(best)
                self.count.append(least)
            node = child
            path.append(node)
        return node


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens, log_prob) for each row of ``docs``; zeros for a null or empty text.

    Rows with equal or null ids are counted each by itself.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie | None = None
        known: dict[str, int] = {}  # terminal nodes: plain numbers, so that the collector has nothing to follow
        for batch in batches:
            pieces = trie.pieces if trie else read_pieces(model_path)
            trie = trie or Trie(pieces)
            words_, tokens, probs = [], [], []
            for text in strings(batch, "text"):
                if len(known) > max_words or trie.nodes > MAX_NODES:
                    trie, known = Trie(pieces), {}
                words = text.split()
                nodes = list(map(known.get, words))
                if None in nodes:
                    for k in [k for k, n in enumerate(nodes) if n is None]:
                        word = words[k]
                        node = known.get(word)
                        if node is None:
                            node = known[word] = trie.add(MARK + word)
                        nodes[k] = node
                words_.append(len(words))
                tokens.append(sum(map(trie.count.__getitem__, nodes)))
                probs.append(math.fsum(map(trie.score.__getitem__, nodes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_, pa.int64()), pa.array(tokens, pa.int64()), pa.array(probs, pa.float64())], schema=schema)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_words long, n_tokens long, log_prob double")
