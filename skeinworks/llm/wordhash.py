"""Words and their 64-bit hashes for a whole batch of texts, by array arithmetic.

Words are the longest runs of a-z and 0-9 in text that is already lower case. The
hash of a word is a polynomial of its bytes, taken from one running sum over the
batch, so no word is ever made a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_LUT = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _LUT[_c] = _i + 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n + 1).bit_length())
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            up, down = np.full(size, _P), np.full(size, _P_INV)
            up[0] = down[0] = 1
            _POWERS.clear()
            _POWERS[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(29))
        h = h * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


class Words:
    """Words of consecutive texts: byte starts and ends, hashes, and the text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        code = _LUT[data]
        is_word = code > 0
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], is_word[:-1]]) if n else is_word
        after = np.concatenate([is_word[1:], [False]]) if n else is_word
        self.start = np.flatnonzero(is_word & (~before | edge[:-1]))
        self.end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        up, down = _powers(n)
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code.astype(np.uint64) * up[:n], dtype=np.uint64)])
            self.hash = mix((run[self.end] - run[self.start]) * down[self.start])
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.data = data

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words of one text, and the first word of each."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        with np.errstate(over="ignore"):
            g = np.zeros(m, np.uint64)
            for k in range(n):
                g = g * _P + self.hash[k : k + m]
        return mix(g)[first], first

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def blocks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """Words of a string column in blocks of about ``size`` bytes: (first row, row after, words)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield a, b, Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b
