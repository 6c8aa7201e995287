"""Lists of numbers and of words as compressed bytes, for rows that stand for very many."""

from __future__ import annotations

import zlib

import numpy as np


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32: their bytes by place, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Words of any bytes: how many, their lengths, then all of them, compressed."""
    head = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zlib.compress(head + b"".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends)]


class Slots(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = slot = len(self)
        return slot


def pack_wide(numbers: np.ndarray) -> bytes:
    """Numbers from 0 of any size: how many bytes they need, and those by place, compressed."""
    numbers = np.ascontiguousarray(numbers, "<u8")
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + zlib.compress(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack_wide(data: bytes) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, : data[0]] = places.T
    return out.view("<i8").ravel()


def dealt(words: list[bytes], first: int, buckets: int) -> list[dict]:
    """(bucket, slots, words) of each bucket that has some of ``words``, which are numbered from ``first``."""
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    by = np.argsort(bucket, kind="stable")
    parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []
    return [{"bucket": int(bucket[p[0]]), "slots": pack(p + first), "words": pack_words([words[i] for i in p.tolist()])} for p in parts]
