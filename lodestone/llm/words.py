"""Words and hashes of many texts at once, on byte arrays.

Texts are joined into blocks of about a megabyte; every step is a numpy pass
over the block, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z lowered, all others as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table() -> np.ndarray:
    """Bytes of a word: 0-9, a-z and everything beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts): texts ``first`` to ``last - 1`` joined by a
    newline, and where each starts. A block holds about ``size`` bytes, or one
    longer text."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > size:
            yield (first, i, *_joined(texts[first:i]))
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield (first, len(texts), *_joined(texts[first:]))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return data, np.cumsum(sizes) - sizes


def word_spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are true in ``table``."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Hashes:
    """64-bit hashes of any spans of one block, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])
        power[1:] = INVERSE
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = power

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
