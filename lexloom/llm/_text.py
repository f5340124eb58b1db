"""Batch helpers that the text operators share: word names and sets from whole texts.

Everything here runs inside Spark tasks on one Arrow batch (or a slice of it) at a time.
Words are maximal runs of bytes outside space and tab..CR, which UTF-8 never uses inside a
character, so byte-wise work gives the same words as code-point-wise work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once; bounds a task's memory, not the text.
SLICE = 1 << 21

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), applied elementwise."""
    x = x ^ _U((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_pow: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        _pow = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, r, np.uint64))]) for r in (_R, _RINV))
    return _pow


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(piece, np.uint8)
    word = ~_SEP[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names of the words of data, with their byte starts and ends."""
    if len(data) <= 2 * SLICE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            while end < len(data) and not _SEP[data[end]]:
                end += 1
        h, s, e = _hash_piece(data[at:end])
        out.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def words_by_doc(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word names of the joined texts and, for each text, where its words begin (one more at the end)."""
    data = b" ".join(texts)
    h, starts, _ = hash_words(data)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(starts, first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Names of all k-word windows, by first word; the last k-1 places hold windows past the end."""
    out = np.zeros(len(h), np.uint64)
    for i in range(k):
        part = h[i:] if i else h
        out[: len(part)] = mix(out[: len(part)] * _U(0x9E3779B97F4A7C15) + part, i + 1)
        if i:
            out[len(part) :] = 0
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; fewer words make one shingle, none make none."""
    h, at = words_by_doc(texts)
    g, out = grams(h, k), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for i, x in enumerate(h[a:b]):
                whole = mix(whole * _U(0x9E3779B97F4A7C15) + x, i + 1)
            out.append(mix(whole, 100 + int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def fragment_names(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of data[at[0]:at[1]], data[at[1]:at[2]], ...."""
    out = []
    for table, salt in ((_BYTE, 1), (_BYTE2, 2)):
        names = np.empty(len(at) - 1, np.uint64)
        a = 0
        while a < len(names):  # pieces of about SLICE bytes
            b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, side="right")) - 1)
            b = min(b, len(names))
            piece = np.frombuffer(data, np.uint8, int(at[b] - at[a]), int(at[a]))
            up, down = _powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(table[piece] * up[: len(piece)], out=total[1:])
            start, end = at[a:b] - at[a], at[a + 1 : b + 1] - at[a]
            names[a:b] = mix((total[end] - total[start]) * down[start], salt)
            a = b
        out.append(names)
    return out[0], out[1]
