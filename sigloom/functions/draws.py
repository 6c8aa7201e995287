"""Random numbers that depend on a key alone, so that a row draws the same ones wherever it is processed."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, n: int, *salts: int) -> np.ndarray:
    """[keys, n] numbers in [0, 1) of each integer key under ``salts``."""
    state = _mixed(np.asarray(keys).astype(np.int64).view(np.uint64) + _ODD)
    for salt in salts:
        state = _mixed(state ^ _mixed(np.full(1, salt + 1, np.uint64) * _ODD))
    counters = np.arange(1, n + 1, dtype=np.uint64) * _ODD
    return (_mixed(state[:, None] + counters) >> np.uint64(11)) * 2.0**-53


def normals(keys: np.ndarray, n: int, *salts: int) -> np.ndarray:
    """[keys, n] standard complex normal numbers: real and imaginary part have variance one each."""
    u = uniforms(keys, 2 * n, *salts)
    return np.sqrt(-2 * np.log1p(-u[:, :n])) * np.exp(2j * np.pi * u[:, n:])
