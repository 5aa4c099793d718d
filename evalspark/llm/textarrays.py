"""Words and rolling hashes of many texts at once, as numpy arrays.

A batch of texts is one byte buffer with a newline after each text. Words are runs of
bytes other than space and 0x09 to 0x0D; these bytes never occur inside a UTF-8 sequence.
Hashes are 64-bit polynomials over prefix sums (modulo 2**64, odd base, so that a window's
sum can be shifted back by the base's inverse), mixed at the end.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

U = np.uint64
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them; kept by the worker."""
    if len(_POWERS.get(kind, ([],))[0]) < n:
        size = -(-n // (1 << 18)) << 18
        b = _BASE[kind]

        def series(x: int) -> np.ndarray:
            a = np.full(size, x, U)
            a[0] = 1
            return np.multiply.accumulate(a)
        _POWERS[kind] = series(b), series(pow(b, -1, 1 << 64))
    return _POWERS[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    t = y >> U(27)
    y ^= t
    y *= U(0x94D049BB133111EB)
    np.right_shift(y, U(31), out=t)
    y ^= t
    return y


def join_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """(byte buffer, offset of each text and of the end); a newline follows each text."""
    parts = [t if t is not None else b"" for t in texts]
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offs[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), offs


def prefix(values: np.ndarray, kind: str) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; entry 0 is 0."""
    out = np.zeros(len(values) + 1, U)
    np.multiply(values, powers(kind, len(values) + 1)[0][:len(values)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """Hash of the values in [start, end): depends on the values alone, not on the place."""
    inv = powers(kind, len(pre))[1]
    return mix((pre[end] - pre[start]) * inv[start])


def rolling(pre: np.ndarray, n: int, width: int, kind: str) -> np.ndarray:
    """Hashes of all windows of ``width`` values among ``n``."""
    m = max(0, n - width + 1)
    inv = powers(kind, len(pre))[1]
    d = pre[width:width + m] - pre[:m]
    d *= inv[:m]
    return mix(d)


#: Bytes of a batch that are hashed at a time: the arrays of a block hold several numbers for each byte.
BLOCK = 1 << 17


class Words:
    """Words of a batch: start, end (byte offsets), text number and 64-bit hash of each."""

    def __init__(self, texts, lower: bool = False):
        self.buf, self.offs = join_texts(texts)
        if lower:
            self.buf = _LOWER[self.buf]
        ws = _WS[self.buf]
        edge = np.flatnonzero(np.diff(ws.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = self._hashes()
        #: words before each text (one more entry than texts)
        self.first = np.searchsorted(self.start, self.offs)
        self.doc = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def _hashes(self) -> np.ndarray:
        """Hash of each word, in blocks of whole words: it does not depend on the word's place."""
        out = np.empty(len(self.start), U)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.buf), BLOCK)), len(out)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = self.start[a]
            pre = prefix(self.buf[at:self.end[b - 1]].astype(U) + U(1), "byte")
            out[a:b] = spans_hash(pre, self.start[a:b] - at, self.end[a:b] - at, "byte")
        return out

    @cached_property
    def pre(self) -> np.ndarray:
        """:func:`prefix` of the whole batch, for hashes of spans other than words."""
        return prefix(self.buf.astype(U) + U(1), "byte")

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``width`` words inside one text."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, U)
        inside = np.flatnonzero(self.doc[:n - width + 1] == self.doc[width - 1:])
        return inside, rolling(prefix(self.hash, "word"), n, width, "word")[inside]
