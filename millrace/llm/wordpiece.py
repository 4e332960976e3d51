"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of word beginnings (pieces with a leading space) and one of continuations. Every node holds
a failure link: the node that stands for what remains after the longest matching pieces have been popped from the
front, and the number of pieces popped. A word is counted in one pass over its bytes, without building pieces.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``. Defined results: null and empty texts have no words and no
tokens; repeated rows each get their own result; a null doc_id is returned as null; very long words are counted in
linear time and not cached; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import text_bytes, values

CACHE_WORDS = 400_000
CACHE_BYTES = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_pieces(source: str) -> list[bytes]:
    """Pieces of a rank file: base64, a space and the rank on each line."""
    return [base64.b64decode(line.split()[0]) for line in source.splitlines() if line.strip()]


class PieceCounter:
    """Greedy longest-match piece counts. ``pieces`` with a leading space begin words; the others go on with them.

    Every single byte but the space must be a continuation and the bare space a beginning, so that any word can be cut.
    """

    ROOT, SUFFIX = 0, 1

    def __init__(self, pieces):
        self.edges: dict[int, int] = {}
        ends = [False, False]
        parents: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for piece in pieces:
            at = self.ROOT if piece[:1] == b" " else self.SUFFIX
            for b in piece:
                nxt = self.edges.get(at << 8 | b)
                if nxt is None:
                    nxt = self.edges[at << 8 | b] = len(ends)
                    ends.append(False)
                    parents.append((at, b))
                at = nxt
            ends[at] = True
        self.fail = [-1] * len(ends)
        self.popped = [0] * len(ends)
        children: dict[int, list[int]] = {}
        for node in range(2, len(ends)):
            children.setdefault(parents[node][0], []).append(node)
        queue = deque([self.ROOT, self.SUFFIX])
        while queue:  # breadth first: a link always leads to a node of smaller depth
            node = queue.popleft()
            queue.extend(children.get(node, ()))
            if node < 2:
                continue
            if ends[node]:
                self.fail[node], self.popped[node] = self.SUFFIX, 1
                continue
            up, b = parents[node]
            z, extra = self.fail[up], 0
            while z >= 0 and (z << 8 | b) not in self.edges:
                extra += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[node], self.popped[node] = self.edges[z << 8 | b], self.popped[up] + extra
        if any((self.SUFFIX << 8 | b) not in self.edges or not ends[self.edges[self.SUFFIX << 8 | b]] for b in range(256) if b != 32) or not ends[self.edges.get(self.ROOT << 8 | 32, 0)]:
            raise ValueError("the vocabulary must hold every byte and the bare space")
        self.cache: dict[bytes, int] = {}

    def count_word(self, word: bytes) -> int:
        """Pieces of a space and the word."""
        edges, fail, popped, at, n = self.edges, self.fail, self.popped, self.ROOT, 0
        for b in b" " + word:
            nxt = edges.get(at << 8 | b)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                nxt = edges.get(at << 8 | b)
            at = nxt
        while at != self.SUFFIX:
            n += popped[at]
            at = fail[at]
        return n

    def count(self, text: bytes | None) -> tuple[int, int]:
        """Words and pieces of a text."""
        words = (text or b"").split()
        total, cache = 0, self.cache
        for word, times in Counter(words).items():
            n = cache.get(word)
            if n is None:
                n = self.count_word(word)
                if len(word) <= CACHE_BYTES:
                    cache[word] = n
            total += n * times
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return len(words), total


_COUNTERS: dict[int, PieceCounter] = {}


def counter(source: str) -> PieceCounter:
    key = hash(source)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PieceCounter(read_pieces(source))
    return _COUNTERS[key]


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` per row; the vocabulary is broadcast (below 1 MB, whatever the data)."""
    spark: SparkSession = df.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="ascii") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches):
        c = counter(source.value)
        for batch in batches:
            found = np.array([c.count(t) for _, t in text_bytes(batch)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "id"), pa.int64()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["doc_id", "n_words", "n_tokens"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
