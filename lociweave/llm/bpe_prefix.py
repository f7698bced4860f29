"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token with which its encoding ends.  Keeping that token for
every prefix makes the encoding of the whole piece a walk back from its end, lets text be appended without
touching what is there, and confines the work after an edit to its neighbourhood.

A token may end a prefix if the token before it (the last token of the shorter prefix) and it would stay
apart: undoing their merges from the outside in must never meet a merge across the boundary that ranks before
the merges that are still standing.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lociweave.llm.bpe_batch import LONGEST_PIECE, BatchEncoder
from lociweave.llm.common import extended, slices, without

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces that a task, and pairs of tokens that a Python worker, remembers before it starts afresh.
CACHE, PAIRS = 400_000, 50_000


class PrefixBPE:
    """ranks: token bytes to id; ids are merge ranks, single bytes included."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        #: What a token was merged from; a single byte has itself twice.  Tokens that no merge reaches have no entry.
        self.parts: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        self._batch: BatchEncoder | None = None
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k], rank), ranks.get(token[k:], rank)
                if a < rank > b and a in self.parts and b in self.parts and self._stay_apart(a, b, rank):
                    self.parts[rank] = (a, b)
                    break
        self._link()
        self.decimal = {i: b"%d" % i for i in self.tokens}
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(len(self.shorter))]
        self.of_decimal = {self.decimal[i]: t for i, t in self.tokens.items()}

    def _link(self) -> None:
        """An automaton over the tokens that merges reach: at each byte it knows the longest one that ends there, and of each token the next shorter one."""
        edges, ends, depth = {}, {}, [b""]
        for t, i in self.ranks.items():
            if i in self.parts:
                node = 0
                for k, byte in enumerate(t):
                    step = edges.get(node << 8 | byte)
                    if step is None:
                        step = edges[node << 8 | byte] = len(depth)
                        depth.append(t[: k + 1])
                    node = step
                ends[node] = i
        self.edges, self.fail, self.ending = edges, [0] * len(depth), [-1] * len(depth)
        self.shorter = [-1] * (max(self.tokens, default=0) + 1)
        for node in sorted(range(1, len(depth)), key=lambda n: len(depth[n])):
            prefix = depth[node]
            back = self.step(self.fail[self._node(prefix[:-1])], prefix[-1]) if len(prefix) > 1 else 0
            self.fail[node] = back
            self.ending[node] = ends.get(node, self.ending[back])
            if node in ends:
                self.shorter[ends[node]] = self.ending[back]

    def _node(self, prefix: bytes) -> int:
        node = 0
        for byte in prefix:
            node = self.edges[node << 8 | byte]
        return node

    def step(self, node: int, byte: int) -> int:
        while (to := self.edges.get(node << 8 | byte)) is None:
            if node == 0:
                return 0
            node = self.fail[node]
        return to

    def _stay_apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the boundary of a and b comes before those that made a and b; limit: merges from this rank on don't count."""
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        while True:
            if ranks.get(tokens[a] + tokens[b], limit) < limit:
                return False
            left_first = a > b
            for left in (left_first, not left_first):
                if left and parts[a][1] != a:
                    limit, a = min(limit, a), parts[a][1]
                    break
                if not left and parts[b][0] != b:
                    # at an equal rank the left merge comes first, so b's own rank still counts against it
                    limit, b = min(limit, b + 1), parts[b][0]
                    break
            else:
                return True

    def stay_apart(self, a: int, b: int) -> bool:
        return self._stay_apart(a, b, len(self.tokens) + 1 + max(a, b))

    def apart(self, a: int, b: int) -> bool:
        if len(self._apart) > PAIRS:
            self._apart.clear()
        self._apart[a << 32 | b] = good = self.stay_apart(a, b)
        return good

    def batch(self) -> BatchEncoder:
        if self._batch is None:
            self._batch = BatchEncoder(self)
        return self._batch

    def grow(self, piece: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Lengthens last, the last token of each prefix of piece, to the prefix of until bytes."""
        self.run(piece, last, None, len(piece) if until is None else until)
        return last

    def run(self, piece: bytes, last: list[int], node: int | None, until: int) -> int:
        """grow() from a node of the automaton (none: the one that the bytes before lead to); returns the node at the end."""
        edges, fail, ending, shorter, sizes, known = self.edges.get, self.fail, self.ending, self.shorter, self.sizes, self._apart.get
        end = len(last)
        if node is None:
            node = 0
            for byte in piece[max(0, end - self.longest) : end]:
                node = self.step(node, byte)
        for byte in piece[end:until]:
            while (to := edges(node << 8 | byte)) is None and node:
                node = fail[node]
            node = to or 0
            end += 1
            t = ending[node]
            while t >= 0:
                start = end - sizes[t]
                if start == 0:
                    break
                a = last[start - 1]
                good = known(a << 32 | t)
                if good if good is not None else self.apart(a, t):
                    break
                t = shorter[t]
            else:
                raise ValueError(f"byte {byte} is not in the vocabulary")
            last.append(t)
        return node

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole piece."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is itself a token is that token, reached by merges or not."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.grow(piece, []))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@dataclass
class EditableEncoding:
    """One piece that grows and changes; ids() always equals merging it anew."""

    model: PrefixBPE
    piece: bytes = b""
    last: list[int] = field(default_factory=list)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.model.grow(self.piece, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces piece[start:end]; returns how many prefixes had to be looked at again."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        last, same, at = old[:start], 0, start
        while at < len(self.piece):
            self.model.grow(self.piece, last, at + 1)
            before = at - shift
            # last[i] depends on as many bytes and entries before it as the longest token has
            same = same + 1 if at >= start + len(new) and old[before] == last[at] else 0
            at += 1
            if same >= self.model.longest:
                last += old[at - shift :]
                break
        self.last = last
        return at - start

    def ids(self) -> list[int]:
        return self.model.walk(self.last)


@lru_cache(maxsize=4)
def load(path: str) -> PrefixBPE:
    with open(path, "rb") as lines:
        return PrefixBPE({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


#: What the classes of a pattern are in ASCII text, inside brackets.
ASCII_CLASSES = {r"\s": r"\t-\r\x20", r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def ascii_pattern(pattern: str) -> str | None:
    """A pattern for Python's own re that matches ASCII text alike; none if it has escapes beyond ASCII_CLASSES and \\S."""
    inside = lambda m: re.sub(r"\\s|\\p\{[LN]\}", lambda x: ASCII_CLASSES[x[0]], m[0])
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for k, part in enumerate(parts):
        if k % 2:
            parts[k] = re.sub(r".+", inside, part)
        else:
            part = re.sub(r"\\s|\\p\{[LN]\}", lambda x: f"[{ASCII_CLASSES[x[0]]}]", part)
            parts[k] = part.replace(r"\S", r"[^\t-\r\x20]")
    out = "".join(parts)
    return None if re.search(r"\\(?!t|r|x20)", out) else out


@lru_cache(maxsize=4)
def _splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    whole, plain = regex.compile(pattern).findall, ascii_pattern(pattern)
    if plain is None:
        return whole
    quick = re.compile(plain).findall
    return lambda text: quick(text) if text.isascii() else whole(text)


class PieceCache(dict):
    """piece -> its ids as decimals joined by commas."""

    def __init__(self, model: PrefixBPE):
        super().__init__()
        self.model = model

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes the pieces of texts that aren't known, short ones together."""
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > CACHE:
            self.clear()
            new = set().union(*texts)
        model, short = self.model, []
        for text in new:
            piece = text.encode()
            if (t := model.ranks.get(piece)) is not None:
                self[text] = model.decimal[t]
            elif len(piece) > LONGEST_PIECE:
                self[text] = b",".join([model.decimal[i] for i in model.encode(piece)])
            else:
                short.append((text, piece))
        ids, counts = model.batch().encode([piece for _, piece in short])
        decimals, at = list(map(model.decimal.__getitem__, ids)), 0
        for (text, _), n in zip(short, counts, strict=True):
            self[text] = b",".join(decimals[at : at + n])
            at += n


def encode_text(text: str, path: str, pattern: str) -> list[int]:
    model = load(path)
    return [i for piece in _splitter(pattern)(text) for i in model.encode(piece.encode())]


def with_encoding(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of every whole text, and token_ids if ids is set.

    A null text counts as empty: no tokens, the digests of nothing.  No text is cut, rows are never grouped and
    nothing shuffles; repeated rows give repeated results.  Columns of these names in docs are replaced.
    path: a rank file that every executor can open; pattern: the expression whose matches are encoded apart.
    """
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids)
    schema = extended(docs, n_tokens="long", ids_sha256="string", decoded_sha256="string", **{"token_ids": "array<int>"} if ids else {})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = _splitter(pattern), PieceCache(load(path))
        for batch in slices(batches):
            counts, id_digests, digests, all_ids = [], [], [], []
            pieces = [split(value) if value else [] for value in batch.column(text).to_pylist()]
            cache.learn(pieces)
            for own in pieces:
                joined = b",".join(map(cache.__getitem__, own))
                own_ids = joined.split(b",") if own else []
                counts.append(len(own_ids))
                id_digests.append(hashlib.sha256(joined).hexdigest())
                digests.append(hashlib.sha256(b"".join(map(cache.model.of_decimal.__getitem__, own_ids))).hexdigest())
                if ids:
                    all_ids.append(list(map(int, own_ids)))
            columns = [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(encode, schema)
