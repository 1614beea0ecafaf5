"""``hash_int`` of many rows at once: the first 32 bits of MD5 over arrays, for messages of one block."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
# Arrays without axes: numpy takes them faster than scalars.
_ADD, _BITS = [np.array(k, np.uint32) for k in _K], [np.array(s, np.uint32) for s in range(33)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Rows of a piece, whose words stay in the processor's cache, and the most bytes of a message of one block.
PIECE, ONE_BLOCK = 32768, 55


def _first_word(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first word of the digests of ``n`` blocks. A word is one number where all blocks share it. The last three of the 64 steps don't reach it."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        times, plus = _PLACES[turn]
        w = words[(i * times + plus) % 16]
        np.add(f, a, out=f)
        if isinstance(w, int):
            np.add(f, np.array((_K[i] + w) & 0xFFFFFFFF, np.uint32) if w else _ADD[i], out=f)
        else:
            np.add(f, w, out=f)
            np.add(f, _ADD[i], out=f)
        s = _TURNS[turn][i % 4]
        np.left_shift(f, _BITS[s], out=t)
        np.right_shift(f, _BITS[32 - s], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])


def _one_block(head: bytes, columns: Sequence[np.ndarray], digits: Sequence[int]) -> np.ndarray:
    """Hashes of ``head`` and whole numbers of so many digits, with the unit separator between the numbers."""
    n, size = len(columns[0]), len(head) + sum(digits) + len(digits) - 1
    fixed, rows = bytearray(64), {}
    fixed[: len(head)], fixed[size], fixed[56:58] = head, 0x80, (size * 8).to_bytes(2, "little")
    at = len(head)
    for k, (c, width) in enumerate(zip(columns, digits, strict=True)):
        if k:
            fixed[at] = 0x1F
            at += 1
        left = c.astype(np.uint32)
        for p in range(at + width - 1, at - 1, -1):
            rest = left // np.uint32(10) if p > at else np.uint32(0)
            digit = left - rest * np.uint32(10) + np.uint32(48)
            word, shift = p // 4, np.uint32(8 * (p % 4))
            rows[word] = rows[word] | (digit << shift) if word in rows else digit << shift
            left = rest
        at += width
    whole = [int.from_bytes(fixed[4 * k : 4 * k + 4], "little") for k in range(16)]
    words = [rows[k] | np.uint32(w) if k in rows else w for k, w in enumerate(whole)]
    return _first_word(words, n).byteswap()


def _digits(x: np.ndarray) -> np.ndarray | int:
    """Numbers of digits; one number where all rows have it."""
    lo, hi = len(str(int(x.min()))), len(str(int(x.max())))
    return lo if lo == hi else np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), x, side="right") + 1


def hash_ints(head: Sequence[int], *columns: np.ndarray) -> np.ndarray:
    """``hash_int(*head, *columns)`` for each row of whole numbers from 0 on; columns below 10^9 in messages of one block go through arrays."""
    n = len(columns[0])
    out, start = np.empty(n, np.uint32), ("\x1f".join(map(str, head)) + "\x1f").encode()
    for a in range(0, n, PIECE):
        part = [np.asarray(c[a : a + PIECE]) for c in columns]
        code = np.zeros((), np.int64)
        for p in part:
            code = code * 32 + _digits(p)
        here = out[a : a + PIECE]
        for k in np.unique(code).tolist():
            mask = code == k if code.ndim else slice(None)
            some = [p[mask] for p in part]
            digits = [len(str(int(p[0]))) for p in some]
            if len(start) + sum(digits) + len(digits) - 1 <= ONE_BLOCK and max(digits) < 10:
                here[mask] = _one_block(start, some, digits)
            else:
                text = ["\x1f".join(map(str, r)).encode() for r in zip(*(p.tolist() for p in some), strict=True)]
                here[mask] = [int.from_bytes(hashlib.md5(start + x).digest()[:4], "big") for x in text]
    return out
