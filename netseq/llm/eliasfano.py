"""Sorted 64-bit keys in Elias-Fano form, searched many keys at a time.

A key is cut in two: the low bits lie packed side by side, the high bits are written in unary, a one for each
key and a zero after each value. Blocks of the unary part carry the zeros before them, so the range of keys
under one high value is found without decoding what lies before it.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

WORDS = 4  # of 64 bits in a block of the unary part
BLOCK = 64 * WORDS
MAGIC = 0x4546_0001
U64 = np.uint64


def _pad(n: int) -> int:
    return -n % 8


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, side by side in 64-bit words, with a spare word at the end."""
    out = np.zeros(len(values) * width // 64 + 2, U64)
    if width:
        at = np.arange(len(values), dtype=U64) * U64(width)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        low = values & U64((1 << width) - 1)
        np.bitwise_or.at(out, word, low << shift)
        over = shift + U64(width) > 64
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (U64(64) - shift[over]))
    return out


def read_low(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U64)
    at = index.astype(U64) * U64(width)
    word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
    upper = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return ((words[word] >> shift) | upper) & U64((1 << width) - 1)


# Place of the nth one of a byte, at 8 * byte + n; 8 beyond its last.
_IN_BYTE = np.array([[*[i for i in range(8) if b >> i & 1], *[8] * 8][:8] for b in range(256)], np.uint8).ravel()


def select_in_word(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) one of each word: halves down to a byte, then a table."""
    nth, place = nth.astype(np.uint8), np.zeros(len(words), np.uint8)
    for step in (32, 16, 8):
        low = words & U64((1 << step) - 1)
        ones = np.bitwise_count(low)
        beyond = nth >= ones
        nth = nth - ones * beyond
        place += beyond * np.uint8(step)
        words = np.where(beyond, words >> U64(step), low)
    return place + _IN_BYTE[(words << U64(3)).astype(np.int64) + nth].astype(np.int64)


def select_in_block(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) one in each row of words."""
    upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.uint16)
    nth = nth.astype(np.uint16)
    word = (upto <= nth[:, None]).sum(1)
    row = np.arange(len(words))
    before = np.where(word > 0, upto[row, word - 1], np.uint16(0))
    return word * 64 + select_in_word(words[row, word], nth - before)


class EliasFano:
    """Distinct ascending keys. ``index`` of a key counts from 0."""

    def __init__(self, n: int, first: int, width: int, top: int, low: np.ndarray, unary: np.ndarray, zeros: np.ndarray):
        self.n, self.first, self.width, self.top = n, first, width, top
        self.low, self.unary, self.zeros = low, unary, zeros

    @classmethod
    def build(cls, keys: np.ndarray) -> EliasFano:
        keys = np.ascontiguousarray(keys, U64)
        n = len(keys)
        if not n:
            return cls(0, 0, 0, 0, np.zeros(2, U64), np.zeros(WORDS, U64), np.zeros(1, U64))
        first, span = int(keys[0]), int(keys[-1]) - int(keys[0])
        width = max(0, (span // n).bit_length() - 1) if span >= n else 0
        shifted = keys - U64(first)
        high = (shifted >> U64(width)).astype(np.int64)
        top = int(high[-1])
        size = -(-(n + top + 1) // BLOCK) * BLOCK
        bits = np.zeros(size, np.uint8)
        bits[high + np.arange(n)] = 1
        unary = np.packbits(bits, bitorder="little").view(U64)
        each = 64 - np.bitwise_count(unary).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(each.reshape(-1, WORDS).sum(1))[:-1]]).astype(U64)
        return cls(n, first, width, top, pack_low(shifted, width), unary, zeros)

    def keys(self) -> np.ndarray:
        """All keys again."""
        if not self.n:
            return np.zeros(0, U64)
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.unary).view(np.uint8), bitorder="little"))
        high = (ones[: self.n] - np.arange(self.n)).astype(U64)
        return ((high << U64(self.width)) | read_low(self.low, np.arange(self.n), self.width)) + U64(self.first)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """Number of keys whose high part is less than each of ``high`` (at most top + 1)."""
        nth = np.maximum(high - 1, 0)
        block = np.searchsorted(self.zeros, nth.astype(U64), "right") - 1
        rest = nth - self.zeros[block].astype(np.int64)
        place = block * BLOCK + select_in_block(~self.unary[block[:, None] * WORDS + np.arange(WORDS)], rest)
        return np.where(high > 0, place - nth, 0)

    def _in_bucket(self, high: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Number of keys under each high part, given those below it: the ones before the next zero."""
        at = below + high
        rest = ~self.unary[at >> 6] >> (at & 63).astype(U64)
        size = np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)  # the zero lies in a later word
        if len(far):
            size[far] = self._below(high[far] + 1) - below[far]
        return size

    def _search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key the index of the first stored key that is not less (n where there is none), and whether it is equal."""
        out, equal = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not self.n:
            return out, equal
        inside = np.flatnonzero(keys >= U64(self.first))
        shifted = keys[inside] - U64(self.first)
        high = shifted >> U64(self.width)
        beyond = high > U64(self.top)
        out[inside[beyond]] = self.n
        inside, shifted, high = inside[~beyond], shifted[~beyond], high[~beyond].astype(np.int64)
        if not len(inside):
            return out, equal
        lo = self._below(high)
        end = lo + self._in_bucket(high, lo)
        hi = end.copy()
        want = shifted & U64((1 << self.width) - 1)
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            less = read_low(self.low, mid, self.width) < want[left]
            lo[left[less]] = mid[less] + 1
            hi[left[~less]] = mid[~less]
            left = left[lo[left] < hi[left]]
        out[inside] = lo
        near = np.flatnonzero(lo < end)
        equal[inside[near]] = read_low(self.low, lo[near], self.width) == want[near]
        return out, equal

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """Index of the first stored key that is not less than each of ``keys``; n where there is none."""
        return self._search(keys)[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not stored."""
        at, equal = self._search(keys)
        return np.where(equal, at, -1)

    def access(self, index: np.ndarray) -> np.ndarray:
        """The keys at ``index``."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * BLOCK - self.zeros.astype(np.int64)  # before each block
        block = np.searchsorted(ones, index, "right") - 1
        rest = index - ones[block]
        place = block * BLOCK + select_in_block(self.unary[block[:, None] * WORDS + np.arange(WORDS)], rest)
        high = (place - index).astype(U64)
        return ((high << U64(self.width)) | read_low(self.low, index, self.width)) + U64(self.first)

    def arrays(self) -> dict[str, np.ndarray]:
        head = np.array([self.n, self.first, self.width, self.top], U64)
        return {"head": head, "low": self.low, "unary": self.unary, "zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> EliasFano:
        n, first, width, top = map(int, arrays["head"])
        return cls(n, first, width, top, arrays["low"], arrays["unary"], arrays["zeros"])


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays in one file. A repeated or second attempt of a task replaces the file by an equal one."""
    names = list(arrays)
    told = "\n".join(f"{k} {arrays[k].dtype.str} {len(arrays[k])}" for k in names).encode()
    trial = f"{path}.{uuid.uuid4().hex}"
    with open(trial, "wb") as f:
        f.write(np.array([MAGIC, len(told)], U64).tobytes() + told + b"\0" * _pad(len(told)))
        for k in names:
            raw = np.ascontiguousarray(arrays[k]).tobytes()
            f.write(raw + b"\0" * _pad(len(raw)))
    os.replace(trial, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped, not read."""
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)  # plain views are cheaper to index
    magic, length = whole[:16].view(U64)
    if magic != MAGIC:
        raise ValueError(f"{path} is no file of mapped arrays")
    at, out = 16, {}
    told = bytes(whole[at : at + int(length)]).decode()
    at += int(length) + _pad(int(length))
    for line in told.split("\n"):
        name, kind, n = line.split(" ")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = whole[at : at + size].view(kind)
        at += size + _pad(size)
    return out
