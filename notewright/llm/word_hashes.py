"""64-bit hashes of all words of a column of texts, straight from the Arrow buffers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed in one go; a block ends at white space or at the end of a text.
BLOCK = 1 << 17
#: Odd, with its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _VALUE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit moves about half of the output bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def grow(cls, size: int) -> None:
        while len(cls.up) < size:
            n = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, n, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(INVERSE, n, 1 << 64))])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 places where texts begin; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + BLOCK, n)
        if end < n:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                space = np.flatnonzero(_SPACE[data[at:end]])
                if len(space):
                    end = at + int(space[-1]) + 1
                else:  # one word longer than a block
                    until = int(offsets[k + 1])
                    more = np.flatnonzero(_SPACE[data[end:until]])
                    end = end + int(more[0]) if len(more) else until
        yield at, end
        at = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than 20 and 09-0D) in order, and the row of each."""
    data, offsets = buffers(texts)
    values = _LOWER if lower else _VALUE
    hashes, rows = [], []
    for at, end in _blocks(data, offsets):
        block = data[at:end]
        inside = ~_SPACE[block]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        lo, hi = np.searchsorted(offsets, [at, end])
        begins = offsets[lo:hi] - at
        before[begins[(begins >= 0) & (begins < len(block))]] = False
        starts = np.flatnonzero(inside & ~before)
        if not len(starts):
            continue
        # A word ends where the next byte is outside or begins another text.
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        cut = begins[(begins > 0) & (begins <= len(block))] - 1
        after[cut] = False
        ends = np.flatnonzero(inside & ~after) + 1
        _Powers.grow(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(values[block] * _Powers.up[: len(block)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * _Powers.down[starts]))
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(rows)
