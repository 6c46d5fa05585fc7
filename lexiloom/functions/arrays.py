"""md5 numbers of whole Arrow batches, in numpy. Sent to executors by value."""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACE = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_BLOCK = 8192


def md5(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """MD5 of ``n`` one-block messages, given as 16 arrays of little-endian words (None: zeros): (4, n)."""
    out = np.empty((4, n), np.uint32)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        m = [None if x is None else x[lo:hi] for x in words]
        a, b, c, d = (np.full(hi - lo, x, np.uint32) for x in _START)
        f = np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += np.uint32(_SINES[i])
            if m[_PLACE[i]] is not None:
                f += m[_PLACE[i]]
            np.left_shift(f, np.uint32(_SHIFTS[i]), out=a)
            f >>= np.uint32(32 - _SHIFTS[i])
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        for k, x in enumerate((a, b, c, d)):
            np.add(x, np.uint32(_START[k]), out=out[k, lo:hi])
    return out


class Keys:
    """md5 of ``round|page|pos`` (``round|pos`` without a page) of some rows, for any round."""

    def __init__(self, pages: list[str | None], page: np.ndarray, pos: np.ndarray):
        self.texts = [b"|" if p is None else b"|" + p.encode() + b"|" for p in pages]
        self.page, self.pos, self.made = page, pos.astype(np.int64), {}
        self.lengths = np.array([len(t) for t in self.texts], np.int64)

    def _made(self, digits: int) -> list[np.ndarray | None] | None:
        """The messages' words with ``digits`` bytes left open for the round; None if one is too long."""
        n, length = len(self.page), self.lengths[self.page]
        many = np.ones(n, np.int64)
        for k in range(1, 19):
            if not (more := self.pos >= 10**k).any():
                break
            many += more
        total = digits + length + many
        if n == 0 or total.max() > 55 or self.pos.min() < 0:
            return None
        flat, row = np.zeros(n * 64, np.uint8), np.arange(n) * 64 + digits
        most = int(self.lengths.max())
        table = np.zeros((len(self.texts), most), np.uint8)
        for i, t in enumerate(self.texts):
            table[i, : len(t)] = np.frombuffer(t, np.uint8)
        for j in range(most):
            flat[row + j] = table[self.page, j]  # zeros past a shorter one
        row = row + length
        power = 10 ** np.arange(19, dtype=np.int64)
        for j in range(int(many.max())):
            here = np.flatnonzero(j < many)
            flat[row[here] + j] = self.pos[here] // power[many[here] - 1 - j] % 10 + 48
        flat[row + many] = 0x80
        words = np.ascontiguousarray(flat.view("<u4").reshape(n, 16).T)
        words[14] = total * 8
        return [x if x.any() else None for x in words]

    def of(self, round_: int) -> np.ndarray:
        """The digests of a round as (2, n) numbers in the order of their hex digits."""
        head = str(round_).encode()
        if len(head) not in self.made:
            self.made[len(head)] = self._made(len(head)) if len(head) < 4 else None
        words = self.made[len(head)]
        if words is None:
            all_ = b"".join(hashlib.md5(head + self.texts[p] + str(i).encode()).digest() for p, i in zip(self.page.tolist(), self.pos.tolist()))
            return np.frombuffer(all_, ">u8").reshape(-1, 2).T.astype(np.uint64)
        first = words[0] + np.uint32(int.from_bytes(head, "little"))
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in md5([first, *words[1:]], len(first)))
        return np.stack([a << np.uint64(32) | b, c << np.uint64(32) | d])

    def order(self, group: np.ndarray, round_: int) -> np.ndarray:
        """The rows by group (numbers from 0), md5 of the round and pos."""
        high, low = self.of(round_)
        bits = max(1, int(group.max()).bit_length()) if len(group) else 1
        joint = group.astype(np.uint64) << np.uint64(64 - bits) | high >> np.uint64(bits)
        order = np.argsort(joint)
        near = joint[order]
        if (near[1:] == near[:-1]).any():
            return np.lexsort((self.pos, low, high, group))
        return order
