"""BPE over a trie of words: what words share at their front is encoded once.

The distinct words of a slice of texts go into a trie.  A node's prefix has exactly one token with which its
encoding ends; it follows from the tokens at the nodes above it, so one walk through the trie in depth-first
order, with the tokens of the path as its stack, encodes all words.  A word's ids are read off the stack where it ends.

Merges are pairs of tokens, as a tokenizer file lists them; bpe_prefix, whose automaton and walk are used
here, works on ranks of byte strings.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociweave.llm.bpe_prefix import PrefixBPE, _splitter
from lociweave.llm.common import extended, slices, without

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of words and ids that a task remembers before it starts afresh.
CACHE_BYTES = 24 << 20
#: What an entry of the cache costs besides its word and ids.
ENTRY = 160
#: Pairs of tokens that a Python worker remembers, and texts that share a trie.
MOST_PAIRS, TEXTS = 300_000, 1 << 14


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class MergeBPE(PrefixBPE):
    """A byte-level tokenizer file's vocabulary, merges and added tokens.

    Inside, tokens are numbered by when merges make them: bytes first, then the merges in their order.  Every merge
    must make a token of its own from tokens that bytes or earlier merges make, as training leaves them.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], added: dict[str, int] | None = None, whole_words: bool = False):
        letters = byte_letters()
        own: dict[str, int] = {c: k for k, c in enumerate(sorted(letters, key=letters.__getitem__))}
        if missing := [c for c in own if c not in vocabulary]:
            raise ValueError(f"no token for byte {letters[missing[0]]}")
        self.merges: dict[int, int] = {}
        self.parts = {k: (k, k) for k in range(256)}
        for a, b in merges:
            if a not in own or b not in own or a + b in own or a + b not in vocabulary:
                raise ValueError(f"merge of {a!r} and {b!r}: not two earlier tokens that make a new one")
            own[a + b] = made = len(own)
            self.merges[own[a] << 32 | own[b]] = made
            self.parts[made] = (own[a], own[b])
        self.ranks = {bytes(map(letters.__getitem__, t)): k for t, k in own.items()}
        self.tokens = {k: t for t, k in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._apart = {}
        self._link()
        self.sizes = [len(self.tokens[k]) for k in range(len(own))]
        #: Packed ids of the file by our numbers, and those of words that are tokens whatever the merges say.
        self.packed = [vocabulary[t].to_bytes(4, "little") for t in own]
        self.words = {bytes(map(letters.__getitem__, t)): k.to_bytes(4, "little") for t, k in vocabulary.items() if all(c in letters for c in t)} if whole_words else {}
        self.added = added or {}
        self.bytes_of = {k: bytes(map(letters.__getitem__, t)) for t, k in vocabulary.items() if all(c in letters for c in t)}
        self.bytes_of |= {k: t.encode() for t, k in self.added.items()}

    def apart(self, a: int, b: int) -> bool:
        if len(self._apart) > MOST_PAIRS:
            self._apart.clear()
        self._apart[a << 32 | b] = good = self._stay_apart(a, b, len(self.tokens))
        return good

    def _stay_apart(self, a: int, b: int, limit: int) -> bool:
        """Takes the merges of a and b back, the last one first; apart if no merge across the boundary came before one that was taken back."""
        parts, merged = self.parts, self.merges.get
        while True:
            across = merged(a << 32 | b)
            if across is not None and across < limit:
                return False
            # of two equal merges the left one comes first
            if a > b and a >= 256:
                limit, a = min(limit, a), parts[a][1]
            elif b >= 256:
                limit, b = min(limit, b + 1), parts[b][0]
            elif a >= 256:
                limit, a = min(limit, a), parts[a][1]
            else:
                return True


class WordTrie:
    """Different words as a trie whose nodes lie in depth-first order: byte and depth per node, and the node at which each word ends."""

    def __init__(self, words: Iterable[bytes]):
        self.words, self.byte, self.depth, self.ends = sorted(words), bytearray(), array("q"), array("q")
        before = b""
        for word in self.words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            self.byte += word[same:]
            self.depth.extend(range(same, len(word)))
            self.ends.append(len(self.byte) - 1)
            before = word


def encode_words(model: MergeBPE, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word, its ids as packed little-endian 32-bit numbers) of different words, none of them empty."""
    trie = WordTrie(words)
    edges, fail, ending, shorter, sizes, known, packed, direct = model.edges.get, model.fail, model.ending, model.shorter, model.sizes, model._apart.get, model.packed, model.words.get
    last, states, node = [], [0], 0  # along the path: the last token of each prefix, and the automaton after it
    for word, end in zip(trie.words, trie.ends, strict=True):
        depth = trie.depth[node] if node <= end else len(word)
        del last[depth:], states[depth + 1 :]
        state = states[depth]
        for byte in trie.byte[node : end + 1]:
            while (to := edges(state << 8 | byte)) is None and state:
                state = fail[state]
            state = to or 0
            depth += 1
            t = ending[state]
            while start := depth - sizes[t]:
                a = last[start - 1]
                good = known(a << 32 | t)
                if good if good is not None else model.apart(a, t):
                    break
                t = shorter[t]
            last.append(t)
            states.append(state)
        node = end + 1
        found = []
        while depth:
            t = last[depth - 1]
            found.append(packed[t])
            depth -= sizes[t]
        yield word, direct(word) or b"".join(found[::-1])


@lru_cache(maxsize=2)
def load(path: str) -> MergeBPE:
    """The model of a tokenizer file; files that ask for more than byte-level BPE with plain added tokens are refused."""
    with open(path, encoding="utf-8") as handle:
        file = json.load(handle)
    model, before = file["model"], file["pre_tokenizer"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback") if model.get(k)]
    odd += [k for k in ("normalizer", "post_processor", "truncation", "padding") if file.get(k)]
    odd += [t["content"] for t in file["added_tokens"] if any(t[k] for k in ("single_word", "lstrip", "rstrip"))]
    if odd or model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError(f"{path}: unsupported: {', '.join(odd) or 'model or pre-tokenizer'}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return MergeBPE(model["vocab"], merges, {t["content"]: t["id"] for t in file["added_tokens"]}, bool(model.get("ignore_merges")))


@lru_cache(maxsize=1)
def _newer() -> str:
    """Letters and numbers for the regex module that Unicode 15.1, by whose tables tokenizer files split words, doesn't have, as a character class."""
    import regex

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    starts = [c for k, c in enumerate(new) if not k or new[k - 1] != c - 1]
    ends = [c for k, c in enumerate(new) if k + 1 == len(new) or new[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Words of a text; letters that are newer than Unicode 15.1 count as neither letters nor numbers."""
    import regex

    usual, newer = _splitter(pattern), _newer()
    if not newer:
        return usual
    odd = regex.compile(f"[{newer}]").search
    exact = re.sub(r"(\[\^[^\]]*\])|(\\p\{[LN]\})", lambda m: f"[{m[1]}{newer}]" if m[1] and r"\p" not in m[1] else f"[{m[1]}||[{newer}]]" if m[1] else f"[{m[2]}--[{newer}]]", pattern)
    strict = regex.compile(f"(?V1){exact}").findall
    return lambda text: usual(text) if text.isascii() or not odd(text) else strict(text)


class WordCache(dict):
    """word -> its ids as bytes; learn() makes it know the words of some texts."""

    def __init__(self, model: MergeBPE):
        super().__init__()
        self.model, self.held = model, 0

    def learn(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held, new = 0, set().union(*texts)
        for word, ids in encode_words(self.model, map(str.encode, new)):
            self[word.decode()] = ids
            self.held += len(word) + len(ids) + ENTRY


def with_token_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """docs with n_tokens and token_ids (little-endian 32-bit numbers, packed) of every whole text, and its decoded text in a column of that name.

    Added tokens that stand in a text are tokens there, and the text between them is split by pattern and encoded.
    A null text counts as empty and has no tokens.  Rows are never grouped, nothing shuffles, and repeated rows give
    repeated results; columns of these names in docs are replaced.  path: a tokenizer file that every executor can open.
    """
    names = ["n_tokens", "token_ids", *([decoded] if decoded else [])]
    docs = without(docs, *names)
    schema = extended(docs, n_tokens="long", token_ids="binary", **{decoded: "string"} if decoded else {})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        split, cache, pieces = splitter(pattern), WordCache(model), model.bytes_of.__getitem__
        special = {t: k.to_bytes(4, "little") for t, k in model.added.items()}
        marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        for batch in slices(batches, TEXTS):
            rows, every = [], []
            for value in batch.column(text).to_pylist():
                value = value or ""
                if marks is None or not marks.search(value):
                    words = split(value)
                    rows.append([words])
                    every.append(words)
                    continue
                row, at = [], 0
                for m in [*marks.finditer(value), None]:
                    words = split(value[at : m.start() if m else len(value)])
                    row += [words, [m[0]]] if m else [words]
                    every.append(words)
                    at = m.end() if m else at
                rows.append(row)
            cache.learn(every)
            ids = [b"".join([b"".join(map((special if k % 2 else cache).__getitem__, words)) for k, words in enumerate(row)]) for row in rows]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([_decode(x, pieces) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(encode, schema)


def _decode(ids: bytes, pieces: Callable[[int], bytes]) -> str:
    return b"".join(map(pieces, np.frombuffer(ids, dtype="<u4").tolist())).decode(errors="replace")


def with_decoded(docs: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text that packed ids stand for, added tokens included; null ids have none, bytes that are no UTF-8 are replaced."""
    docs = without(docs, decoded)
    schema = extended(docs, **{decoded: "string"})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path).bytes_of.__getitem__
        for batch in slices(batches):
            texts = [None if x is None else _decode(x, pieces) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(decode, schema)
