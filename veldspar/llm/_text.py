"""Words of UTF-8 texts and their 64-bit hashes, vectorised over whole texts."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: True where a byte belongs to a word: anything but white space; digits, lower-case letters and all above ASCII.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        n = _SLICE + 1
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            t = np.full(n, base, dtype=U64)
            t[0] = 1
            _TABLES[name] = np.cumprod(t, dtype=U64)
        _TABLES["byte"] = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    return _TABLES


def spans(buf: bytes, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words of ``buf``: the longest runs of bytes that ``table`` accepts."""
    a = np.frombuffer(buf, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = table[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return a, edges[0::2], edges[1::2]


def word_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, by prefix sums of a polynomial over slices of the text."""
    t, out, i = _tables(), np.empty(len(starts), dtype=U64), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _SLICE, side="right")))
        if ends[i] - low > _SLICE:  # a word longer than a slice
            h, at = U64(0), low
            with np.errstate(over="ignore"):
                while at < ends[i]:
                    part = t["byte"][a[at : min(at + _SLICE, ends[i])]]
                    h = h * U64(0xA24BAED4963EE407) + (part * t["pow"][: len(part)]).sum(dtype=U64)
                    at += _SLICE
            out[i], j = h, i + 1
        else:
            c = np.zeros(int(ends[j - 1] - low) + 1, dtype=U64)
            part = t["byte"][a[low : ends[j - 1]]]
            np.cumsum(part * t["pow"][: len(part)], out=c[1:])
            out[i:j] = (c[ends[i:j] - low] - c[starts[i:j] - low]) * t["inv"][starts[i:j] - low]
        i = j
    return mix(out + (ends - starts).astype(U64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbouring words, by doubling."""
    if len(h) < k:
        return np.empty(0, dtype=U64)
    n, have, done, out, base = len(h) - k + 1, h, 1, None, _BASE
    taken = 0
    while True:  # have: hashes of runs of length done; out: of the first `taken` words
        if k & done:
            part = have[taken : taken + n]
            out = part if out is None else out * U64(base) + part
            taken += done
        if done * 2 > k:
            return mix(out + U64(k))
        have = have[: len(have) - done] * U64(base) + have[done:]
        base = base * base % (1 << 64)
        done *= 2
