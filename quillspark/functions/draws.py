"""Draws with replacement that any engine with md5 makes the same way, many at a time: draw i of resample r of n rows is row
md5('seed:r:i') mod n, by the first eight hexadecimal digits."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Hashes made at a time; the arrays over them stay in a core's cache.
LANES = 1 << 15
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFT = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def md5_heads(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first four bytes, as a big-endian number, of the md5 of n messages of one block. words: its 16 little-endian numbers, an
    integer where all messages have the same. The last three steps don't change these bytes."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        w = words[_WORD[i]]
        if isinstance(w, np.ndarray):
            np.add(a, w, out=a)
            w = 0
        np.add(a, np.uint32((_SINE[i] + w) & 0xFFFFFFFF), out=a)
        np.left_shift(a, np.uint32(_SHIFT[i]), out=t)
        np.right_shift(a, np.uint32(32 - _SHIFT[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def _tails(at: int, start: int, stop: int) -> list[int | np.ndarray]:
    """The words of the messages whose bytes from at on are the numbers start to stop - 1, with md5's padding and zeros before."""
    i = np.arange(start, stop)
    message = np.zeros((stop - start, 64), np.uint8)
    for d in range(len(str(start)), len(str(stop - 1)) + 1):
        rows = slice(max(start, 10 ** (d - 1) if d > 1 else 0) - start, min(stop, 10**d) - start)
        for k in range(d):
            message[rows, at + k] = 48 + i[rows] // 10 ** (d - 1 - k) % 10
        message[rows, at + d] = 0x80
        message[rows, 56:58] = np.frombuffer((8 * (at + d)).to_bytes(2, "little"), np.uint8)
    return [int(w[0]) if (w == w[0]).all() else w.copy() for w in message.view("<u4").T]


def hashes(seed: str, resamples: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of the resamples, their hashes of draws 0 to most - 1, a row for each), in turn; all have a length of their own."""
    at, tails = -1, []
    edges = np.linspace(0, most, math.ceil(most / LANES) + 1).astype(int).tolist()
    step = max(1, LANES // most)
    a = 0
    while a < len(resamples):
        size = len(str(resamples[a]))
        some = resamples[a : a + step]
        some = some[: next((k for k, r in enumerate(some.tolist()) if len(str(r)) != size), len(some))]
        a += len(some)
        heads = [f"{seed}:{r}:".encode() for r in some.tolist()]
        out = np.empty((len(some), most), np.uint32)
        if len(heads[0]) + len(str(most)) > 55:  # more than one block
            for k, head in enumerate(heads):
                out[k] = [int.from_bytes(hashlib.md5(head + str(i).encode()).digest()[:4], "big") for i in range(most)]
            yield some, out
            continue
        if at != len(heads[0]):
            at = len(heads[0])
            tails = [_tails(at, x, y) for x, y in zip(edges, edges[1:], strict=False)]
        first = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(-1, 16)
        for x, y, tail in zip(edges, edges[1:], tails, strict=False):
            words: list[int | np.ndarray] = []
            for k, t in enumerate(tail):
                h = first[:, k]
                if (h == h[0]).all():
                    h = int(h[0])
                    words.append(h | t if isinstance(t, int) or len(some) == 1 else np.tile(h | t, len(some)))
                else:
                    words.append((h[:, None] | (np.full(y - x, t, np.uint32) if isinstance(t, int) else t)).ravel())
            out[:, x:y] = md5_heads(words, len(some) * (y - x)).reshape(len(some), y - x)
        yield some, out


class Samples:
    """Groups of rows, each in its order, with the numbers that resamples are summed or ranked by. sizes has, of the groups of one
    size, their places among all groups and a matrix for each column, a row for each group."""

    def __init__(self, counts: np.ndarray, columns: list[np.ndarray]):
        starts = np.cumsum(counts) - counts
        self.sizes = []
        for n in np.unique(counts).tolist():
            groups = np.flatnonzero(counts == n)
            at = starts[groups][:, None] + np.arange(n)
            self.sizes.append((n, groups, [c[at] for c in columns]))

    def picked(self, seed: str, resamples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(group, resample, of each column the drawn numbers): arrays of as many rows, drawn numbers beside each other."""
        for some, found in hashes(seed, resamples, max((n for n, _, _ in self.sizes), default=1)):
            for n, groups, columns in self.sizes:
                drawn = (found[:, :n] % np.uint32(n)).astype(np.int64).ravel()
                step = max(1, LANES // len(drawn))
                for a in range(0, len(groups), step):
                    of = groups[a : a + step]
                    yield np.repeat(of, len(some)), np.tile(some, len(of)), [c[a : a + step].take(drawn, axis=1).reshape(-1, n) for c in columns]

    def sums(self, seed: str, resamples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(group, resample, sums of each column)."""
        for group, r, columns in self.picked(seed, resamples):
            yield group, r, [c.sum(axis=1) for c in columns]

    def quantiles(self, seed: str, resamples: np.ndarray, levels: pa.Array, shares: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
        """(group, resample, the nearest rank of each share); the one column has places in levels, which rise to null's."""
        for group, r, (codes,) in self.picked(seed, resamples):
            codes.sort(axis=1)
            known = (codes < len(levels) - 1).sum(axis=1)
            at = [np.maximum(np.ceil(p * known).astype(np.int64), 1) - 1 for p in shares]
            yield group, r, [levels.take(pa.array(np.take_along_axis(codes, k[:, None], axis=1)[:, 0])) for k in at]


def batch(keys: pa.Table, group: np.ndarray, r: np.ndarray, columns: list[np.ndarray | pa.Array], names: list[str]) -> pa.RecordBatch:
    """The groups' keys, r and the columns."""
    own = keys.take(pa.array(group)).combine_chunks()
    found = [*(c.combine_chunks() for c in own.columns), pa.array(r.astype(np.int32)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)]
    return pa.RecordBatch.from_arrays(found, names=[*keys.column_names, "r", *names])
