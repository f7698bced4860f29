"""The prefix programming of bpe_prefix over many short pieces at once: step k gives each piece the last token of its prefix of k bytes."""

from __future__ import annotations

import numpy as np

#: Longer pieces are encoded one by one.
LONGEST_PIECE = 48
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """A hash table from non-negative int64 keys to int32 values, open addressing, in arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.held = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        out, at, left = np.full(len(keys), -1, dtype=np.int32), self._slots(keys), np.arange(len(keys))
        while len(left):
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            further = ~hit & (seen != -1)
            left, at = left[further], (at[further] + 1) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: different and not there yet."""
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self.mask
        self.held += len(keys)


class BatchEncoder:
    """model: a PrefixBPE."""

    def __init__(self, model):
        self.model = model
        self.edges = Table(int(4 * len(model.edges)).bit_length())
        self.edges.put(np.fromiter(model.edges, dtype=np.int64), np.fromiter(model.edges.values(), dtype=np.int32))
        self.fail, self.ending, self.shorter, self.sizes = (np.array(x, dtype=np.int32) for x in (model.fail, model.ending, model.shorter, model.sizes))
        self.apart = Table(20)

    def _step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        out, left, here = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes)), nodes
        while len(left):
            to = self.edges.get(here << 8 | bytes_[left])
            found = to >= 0
            out[left[found]] = to[found]
            further = ~found & (here != 0)
            left, here = left[further], self.fail[here[further]].astype(np.int64)
        return out

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        known = self.apart.get(pairs)
        if (known < 0).any():
            new = np.unique(pairs[known < 0])
            if 2 * (self.apart.held + len(new)) > len(self.apart.keys):
                self.apart = Table(max(20, (8 * len(new)).bit_length()))
            good = [self.model.stay_apart(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()]
            self.apart.put(new, np.array(good, dtype=np.int32))
            missing = known < 0
            known[missing] = np.array(good, dtype=np.int32)[np.searchsorted(new, pairs[missing])]
        return known == 1

    def encode(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """(all ids in a row, how many each piece has); no piece is empty or longer than LONGEST_PIECE."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(-lengths, kind="stable")
        width = int(lengths.max(initial=0))
        text = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, width)[order].astype(np.int64) if width else np.zeros((0, 0), dtype=np.int64)
        sizes, last = lengths[order], np.zeros((width, len(pieces)), dtype=np.int32)
        nodes = np.zeros(len(pieces), dtype=np.int64)
        for k in range(width):
            many = int(np.searchsorted(-sizes, -k, side="left"))  # pieces of more than k bytes come first
            nodes = self._step(nodes[:many], text[:many, k])
            token, left = self.ending[nodes].astype(np.int64), np.arange(many)
            while len(left):
                t = token[left]
                if (t < 0).any():
                    raise ValueError("a byte is not in the vocabulary")
                start = k + 1 - self.sizes[t]
                good = start == 0
                inner = np.nonzero(~good)[0]
                good[inner] = self._apart(last[start[inner] - 1, left[inner]].astype(np.int64) << 32 | t[inner])
                left = left[~good]
                token[left] = self.shorter[token[left]]
            last[k, :many] = token
        # back from the ends
        ids, counts, end, left = np.zeros((width, len(pieces)), dtype=np.int32), np.zeros(len(pieces), dtype=np.int64), sizes.copy(), np.arange(len(pieces))
        while len(left):
            t = last[end[left] - 1, left]
            ids[counts[left], left] = t
            counts[left] += 1
            end[left] -= self.sizes[t]
            left = left[end[left] > 0]
        back = np.empty(len(pieces), dtype=np.int64)
        back[order] = np.arange(len(pieces))
        counts, ids = counts[back], ids[:, back]
        piece = np.repeat(np.arange(len(pieces)), counts)
        nth = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(piece))  # the last id was found first
        return ids[nth, piece].tolist(), counts.tolist()
