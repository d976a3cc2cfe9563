"""The words of texts as arrays over their bytes: bounds, hashes and neighbours, for texts of any length.

Separators are single bytes of UTF-8, so the bytes of a batch are looked at together and no text is taken apart in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are looked at together, and bytes that are hashed at a time.
RUN, STEP = 4 << 20, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: bounds in the lower-cased bytes, piece numbers, hashes and texts' numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, kinds: np.ndarray):
        """kinds says of each byte whether it is part of a word (0), ends a word (1) or a piece of text (2).

        A text's seed is mixed into the hashes of its words.
        """
        kind = kinds[data]
        inside = kind == 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] |= inside[cuts]
        ends[cuts - 1] |= inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, self.starts) + self.text  # both grow
        self.inside, self.data = inside, _LOWER[data]
        self.hashes = mixed(self._hashed() ^ seeds[self.text])

    def _hashed(self) -> np.ndarray:
        """A polynomial hash of each word, worked out for STEP bytes at a time, more where a word is longer."""
        out, at, n = np.zeros(len(self.starts), np.uint64), 0, len(self.starts)
        while at < n:
            low = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, low + STEP, "right")))
            high = self.ends[stop - 1]
            up, down = _power_tables(max(int(high - low), STEP))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
            s, e = self.starts[at:stop] - low, self.ends[at:stop] - low
            out[at:stop] = (sums[e] - sums[s]) * down[s]
            at = stop
        return out

    def strings(self) -> pa.Array:
        lengths = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=lengths[1:])
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(lengths), pa.py_buffer(self.data[self.inside]))

    def beside(self) -> np.ndarray:
        """Whether the next word is of the same piece."""
        return np.append(self.piece[1:] == self.piece[:-1], False) if len(self.piece) else np.zeros(0, bool)


def after(values: np.ndarray, k: int, fill) -> np.ndarray:
    """values[i + k] at each i."""
    out = np.full(len(values), fill, values.dtype)
    out[: max(0, len(values) - k)] = values[k:]
    return out


def runs(texts: pa.Array, kinds: np.ndarray, seeds: np.ndarray | None = None, size: int = RUN) -> Iterator[tuple[Words, int, int]]:
    """The words of consecutive texts of ``size`` bytes, or of one text if that is longer, with the numbers of the texts."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    seeds = np.zeros(len(texts), np.uint64) if seeds is None else seeds
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = offsets[at : stop + 1]
        yield Words(data[own[0] : own[-1]], own - own[0], seeds[at:stop], kinds), at, stop
        at = stop
