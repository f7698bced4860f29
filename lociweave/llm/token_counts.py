"""Greedy word-piece counts in one pass over the bytes of a word.

The vocabulary becomes a trie.  Every node has a failure link, to the node that stands for what is left once
the longest pieces at the front have been taken off, and the number of those pieces.  Reading a byte either
goes down an edge or follows failure links and adds their counts; no piece is ever cut out of the word.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lociweave.llm.bpe_prefix import _splitter
from lociweave.llm.common import extended, slices, without

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct words a task remembers before it starts afresh.
CACHE = 400_000


class LongestMatch:
    """Greedy longest-match-first over a vocabulary of byte strings.

    continuation: what marks a piece that doesn't start a word (b"##"), or nothing if pieces are the same
    everywhere.  A word that pieces can't cover counts as one unknown piece.
    """

    def __init__(self, vocabulary: Iterable[bytes], continuation: bytes = b""):
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        ends, self.start = {0}, 0
        self.inner = 0  # the node after a piece: where continuations start
        strings = sorted({v for v in vocabulary if v and v != continuation})
        nodes, parent = 1, [(-1, 0)]
        if continuation:
            self.inner, nodes = 1, 2
            parent.append((-1, 0))
        piece_end = set()
        for v in strings:
            node = self.start
            if continuation and v.startswith(continuation):
                node, v = self.inner, v[len(continuation) :]
            for byte in v:
                step = self.edges.get(node * 256 + byte)
                if step is None:
                    step = self.edges[node * 256 + byte] = nodes
                    parent.append((node, byte))
                    nodes += 1
                node = step
            piece_end.add(node)
        ends |= piece_end
        #: Where to go on when no edge fits (-1: nowhere), and how many pieces that takes off.
        self.fail, self.popped = [-1] * nodes, [0] * nodes
        depth, queue = 0, [self.start, *([self.inner] if self.inner else [])]
        below: dict[int, list[int]] = {}
        for node, (up, _) in enumerate(parent):
            if up >= 0:
                below.setdefault(up, []).append(node)
        while queue:
            depth, after = depth + 1, []
            for up in queue:
                for node in below.get(up, ()):
                    if node in piece_end:
                        self.fail[node], self.popped[node] = self.inner, 1
                    else:
                        byte, at, n = parent[node][1], self.fail[up], self.popped[up]
                        while at >= 0 and (at * 256 + byte) not in self.edges:
                            n, at = n + self.popped[at], self.fail[at]
                        self.fail[node] = self.edges[at * 256 + byte] if at >= 0 else -1
                        self.popped[node] = n if at >= 0 else 0
                    after.append(node)
            queue = after

    def count(self, word: bytes) -> int:
        """How many pieces cover the word; -1 if none do."""
        edges, fail, popped, node, n = self.edges, self.fail, self.popped, self.start, 0
        for byte in word:
            while (step := edges.get(node * 256 + byte)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = step
        while node not in (self.inner, self.start) or (node == self.start != self.inner and word):
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


@lru_cache(maxsize=4)
def load(path: str) -> LongestMatch:
    """A rank file's tokens, alike at the start of a word and inside it."""
    with open(path, "rb") as lines:
        return LongestMatch(base64.b64decode(x.split()[0]) for x in lines if x.strip())


class CountCache(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = n = self.automaton.count(word.encode())
        return n


def with_counts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_words, n_pieces and n_unknown of every whole text.

    n_words: matches of pattern; n_pieces: greedy longest-match pieces over them, a word that can't be covered
    counting as one and also in n_unknown.  A null or empty text has none of any.  Rows are never grouped and
    nothing shuffles; repeated rows give repeated results.  Columns of these names in docs are replaced.
    """
    docs = without(docs, "n_words", "n_pieces", "n_unknown")
    schema = extended(docs, n_words="long", n_pieces="long", n_unknown="long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = _splitter(pattern), CountCache(load(path))
        for batch in slices(batches):
            words, pieces, unknown = [], [], []
            for value in batch.column(text).to_pylist():
                found = [cache[w] for w in split(value)] if value else []
                bad = found.count(-1)
                words.append(len(found))
                pieces.append(sum(found) + 2 * bad)
                unknown.append(bad)
            new = [pa.array(x, pa.int64()) for x in (words, pieces, unknown)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(count, schema)
