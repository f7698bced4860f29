"""Fill-in-the-middle examples: a document is cut at two of its line ends and its parts change places.

Line ends of a whole Arrow slice are one packed bit vector with a directory of popcounts.  How many lines a
document has is a difference of two ranks, and where its k-th line ends is one select, so a text is never
split into lines.  A second vector, of bytes that start a code point, turns byte spans into lengths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import extended, slices, without

#: Words of 64 bits that a number of the directory stands for.
BLOCK = 8


class BitVector:
    """Packed bits; rank and select work on arrays of places at once."""

    def __init__(self, bits: np.ndarray):
        words = -(-len(bits) // 64)
        packed = np.zeros((words // BLOCK + 1) * BLOCK * 8, dtype=np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8").reshape(-1, BLOCK)
        #: Per block the bits set before it, and at the end all of them.
        self.directory = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64), out=self.directory[1:])

    def __len__(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits before each place are set."""
        block, inside = np.divmod(at, 64 * BLOCK)
        word, bit = np.divmod(inside, 64)
        own = self.words[block]
        before = np.where(np.arange(BLOCK) < word[:, None], np.bitwise_count(own), 0).sum(axis=1, dtype=np.int64)
        part = own[np.arange(len(at)), word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.directory[block] + before + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th set bit, counted from 0; k is smaller than len()."""
        block = np.searchsorted(self.directory, k, side="right") - 1
        own, left = self.words[block], k - self.directory[block]
        upto = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(axis=1)
        each = np.arange(len(k))
        left = left - np.where(word > 0, upto[each, word - 1], 0)
        bits = (own[each, word][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return (block * BLOCK + word) * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)


@dataclass(frozen=True)
class FillMiddle:
    """How documents change: shares are in percent, sentinels stand before prefix, suffix and middle."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # an end of one that begins another could make a mark out of text and mark
        clash = any(a != b and a in b for a in marks for b in marks) or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, len(a)) if k < len(b))
        if len(set(marks)) < 3 or "" in marks or clash:
            raise ValueError("sentinels must be different, and none may overlap another")


def _parts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Starts and ends of the rows in the bytes of an array without nulls."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1, offset=8 * text.offset)
    data = memoryview(text.buffers()[2] or b"")[offsets[0] : offsets[-1]]  # a slice shares the bytes of its batch
    return offsets[:-1] - offsets[0], offsets[1:] - offsets[0], data


def line_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> BitVector:
    """The last byte of every line: line feeds, and the last byte of a row."""
    bits = data == 10
    bits[ends[ends > starts] - 1] = True
    return BitVector(bits)


def _draws(seed: int, keys: list) -> np.ndarray:
    """Four unsigned numbers per key from the digest of seed and key; a null key counts as an empty one."""
    drawn = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(drawn, dtype=">u4").reshape(-1, 4).astype(np.int64)


def with_fill_middle(docs: DataFrame, how: FillMiddle = FillMiddle(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with n (lines), form, prefix_chars, middle_chars and output of every whole text.

    A line ends after a line feed or at the end.  Cuts and form follow from seed and key alone.  Texts that are null
    or empty, that hold a sentinel, or that the rate leaves out are plain: output is the text (null: empty), the
    lengths are null.  Rows are never grouped, nothing shuffles, and repeated rows give repeated results; columns of
    these names in docs are replaced.
    """
    docs = without(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    schema = extended(docs, n="long", form="string", prefix_chars="long", middle_chars="long", output="string")
    p, s, m = (x.encode() for x in (how.prefix, how.suffix, how.middle))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value = pc.fill_null(batch.column(text), "")
            starts, ends, data = _parts(value)
            raw = np.frombuffer(data, dtype=np.uint8)
            lines, points = line_ends(raw, starts, ends), BitVector((raw & 0xC0) != 0x80)
            first = lines.rank(starts)
            n = lines.rank(ends) - first
            draws = _draws(how.seed, batch.column(key).to_pylist())
            held = [pc.match_substring(value, x).to_numpy(zero_copy_only=False) for x in (how.prefix, how.suffix, how.middle)]
            plain = (n == 0) | held[0] | held[1] | held[2] | (draws[:, 2] % 100 >= how.rate)
            spm = draws[:, 3] % 100 < how.suffix_first
            cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            places = np.stack([starts, starts], axis=1)
            some = cuts > 0  # a cut after k lines is the end of the k-th
            places[some] = lines.select((first[:, None] + cuts - 1)[some]) + 1
            lengths = np.diff(points.rank(np.stack([starts, *places.T], axis=1).ravel()).reshape(-1, 3), axis=1)
            out, form = [], []
            for start, (a, b), end, is_plain, is_spm in zip(starts.tolist(), places.tolist(), ends.tolist(), plain.tolist(), spm.tolist(), strict=True):
                x, y, z = data[start:a], data[a:b], data[b:end]
                form.append("plain" if is_plain else "spm" if is_spm else "psm")
                out.append(bytes(data[start:end]) if is_plain else b"".join([s, z, p, x, m, y] if is_spm else [p, x, s, z, m, y]))
            columns = [pa.array(n), pa.array(form, pa.string()), *[pa.array(np.ascontiguousarray(x), mask=plain) for x in lengths.T], pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(change, schema)


def restored(output: Column, form: Column, how: FillMiddle = FillMiddle()) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(re.escape(x) for x in (how.prefix, how.suffix, how.middle)), -1)
    order = lambda *k: F.concat(*[F.get(parts, F.lit(x)) for x in k])
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)
