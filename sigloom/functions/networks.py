"""Small convolutional networks over maps [rows, cells, bins] in NumPy, with their gradients.

A network is a list of layers over one vector of parameters. ``forward`` returns what
``backward`` needs; both are pure, so that a task can compute the gradient of its rows
and send it on. Normalisation takes the moments of the rows at hand while training, and
reports them; afterwards it takes their moving averages, which the trainer keeps.
Dropout draws by row key, epoch and place, so a row drops the same units wherever it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from sigloom.functions.draws import uniforms


class Mode(NamedTuple):
    """How a pass is meant: ``keys`` and ``epoch`` draw what training drops; ``moments`` replace those of the rows."""

    training: bool = False
    keys: np.ndarray | None = None
    epoch: int = 0
    seed: int = 0
    moments: np.ndarray | None = None


def _windows(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """[rows * places, cells * size] of the windows of padded ``x``."""
    seen = sliding_window_view(x, size, axis=2)[:, :, ::stride]
    return seen.transpose(0, 2, 1, 3).reshape(-1, x.shape[1] * size)


def _laid(parts: np.ndarray, shape: tuple[int, int, int], size: int, stride: int) -> np.ndarray:
    """Adds windows up where they lie: the transpose of ``_windows``."""
    rows, cells, _ = shape
    parts = parts.reshape(rows, -1, cells, size).transpose(0, 2, 1, 3)
    out = np.zeros(shape, parts.dtype)
    places = parts.shape[2]
    for k in range(size):
        out[:, :, k : k + stride * places : stride] += parts[..., k]
    return out


@dataclass(frozen=True)
class Conv:
    """Convolution; with ``up`` its transpose, which widens by the stride."""

    cells: int
    out: int
    size: int
    stride: int = 1
    pad: int = 0
    up: bool = False

    @property
    def shapes(self):
        return [(self.cells, self.out * self.size) if self.up else (self.cells * self.size, self.out), (self.out,)]

    @property
    def fan_in(self):
        return self.cells * self.size

    def forward(self, x, params, mode):
        w, b = params
        rows, _, bins = x.shape
        if self.up:
            flat = x.transpose(0, 2, 1).reshape(-1, self.cells)
            wide = self.stride * (bins - 1) + self.size
            y = _laid(flat @ w, (rows, self.out, wide), self.size, self.stride)[:, :, self.pad : wide - self.pad] + b[:, None]
            return y, (flat, x.shape)
        padded = np.pad(x, ((0, 0), (0, 0), (self.pad, self.pad)))
        flat = _windows(padded, self.size, self.stride)
        y = (flat @ w + b).reshape(rows, -1, self.out).transpose(0, 2, 1)
        return y, (flat, padded.shape)

    def backward(self, dy, kept, params):
        flat, shape = kept
        w = params[0]
        db = dy.sum(axis=(0, 2))
        if self.up:
            parts = _windows(np.pad(dy, ((0, 0), (0, 0), (self.pad, self.pad))), self.size, self.stride)
            dx = (parts @ w.T).reshape(shape[0], shape[2], shape[1]).transpose(0, 2, 1)
            return dx, [flat.T @ parts, db]
        out = dy.transpose(0, 2, 1).reshape(-1, self.out)
        dx = _laid(out @ w.T, shape, self.size, self.stride)
        return dx[:, :, self.pad : shape[2] - self.pad], [flat.T @ out, db]


@dataclass(frozen=True)
class Dense:
    inputs: int
    out: int

    @property
    def shapes(self):
        return [(self.inputs, self.out), (self.out,)]

    @property
    def fan_in(self):
        return self.inputs

    def forward(self, x, params, mode):
        flat = x.reshape(len(x), -1)
        return flat @ params[0] + params[1], (flat, x.shape)

    def backward(self, dy, kept, params):
        flat, shape = kept
        return (dy @ params[0].T).reshape(shape), [flat.T @ dy, dy.sum(axis=0)]


class _Plain:
    shapes: list = []
    fan_in = 1


@dataclass(frozen=True)
class Fold(_Plain):
    """Rows of numbers as maps of ``cells``."""

    cells: int

    def forward(self, x, params, mode):
        return x.reshape(len(x), self.cells, -1), x.shape

    def backward(self, dy, kept, params):
        return dy.reshape(kept), []


@dataclass(frozen=True)
class Relu(_Plain):
    def forward(self, x, params, mode):
        return np.maximum(x, 0), x > 0

    def backward(self, dy, kept, params):
        return dy * kept, []


@dataclass(frozen=True)
class HalfMax(_Plain):
    """The larger of each two neighbouring bins; an odd last one is left out."""

    def forward(self, x, params, mode):
        pairs = x[:, :, : x.shape[2] // 2 * 2].reshape(*x.shape[:2], -1, 2)
        return pairs.max(axis=3), (pairs[..., 0] >= pairs[..., 1], x.shape)

    def backward(self, dy, kept, params):
        first, shape = kept
        dx = np.zeros(shape, dy.dtype)
        dx[:, :, : 2 * dy.shape[2]] = np.stack([dy * first, dy * ~first], axis=3).reshape(*dy.shape[:2], -1)
        return dx, []


@dataclass(frozen=True)
class MeanMax(_Plain):
    """Mean and maximum of each cell, side by side."""

    def forward(self, x, params, mode):
        at = x.argmax(axis=2)
        return np.concatenate([x.mean(axis=2), np.take_along_axis(x, at[:, :, None], 2)[:, :, 0]], axis=1), (at, x.shape)

    def backward(self, dy, kept, params):
        at, shape = kept
        mean, top = np.split(dy, 2, axis=1)
        dx = np.repeat(mean[:, :, None] / shape[2], shape[2], axis=2)
        np.put_along_axis(dx, at[:, :, None], np.take_along_axis(dx, at[:, :, None], 2) + top[:, :, None], 2)
        return dx, []


@dataclass(frozen=True)
class Dropout(_Plain):
    share: float

    def forward(self, x, params, mode):
        if not mode.training or mode.keys is None:
            return x, None
        kept = (uniforms(mode.keys, x.shape[1], mode.seed, mode.epoch) >= self.share) / (1 - self.share)
        return x * kept, kept

    def backward(self, dy, kept, params):
        return dy if kept is None else dy * kept, []


@dataclass(frozen=True)
class Norm:
    """Cells scaled to mean zero and variance one over rows and bins, then by parameters."""

    cells: int
    fan_in = 0
    least = 1e-5

    @property
    def shapes(self):
        return [(self.cells,), (self.cells,)]

    def forward(self, x, params, mode):
        mean, variance = (x.mean(axis=(0, 2)), x.var(axis=(0, 2))) if mode.training else mode.moments
        root = np.sqrt(variance + self.least)
        z = (x - mean[:, None]) / root[:, None]
        return z * params[0][:, None] + params[1][:, None], (z, root, mean, variance)

    def backward(self, dy, kept, params):
        z, root, _, _ = kept
        n = dy.shape[0] * dy.shape[2]
        scale, shift = (dy * z).sum(axis=(0, 2)), dy.sum(axis=(0, 2))
        dx = (params[0] / root)[:, None] * (dy - (shift[:, None] + z * scale[:, None]) / n)
        return dx, [scale, shift]


class Network:
    """Layers over slices of one vector; ``moments`` has mean and variance of each normalised cell, in order."""

    def __init__(self, layers: list):
        self.layers, self.slices, at = layers, [], 0
        for layer in layers:
            own = []
            for shape in layer.shapes:
                own.append((at, at + int(np.prod(shape)), shape))
                at = own[-1][1]
            self.slices.append(own)
        self.size = at
        self.n_moments = sum(2 * layer.cells for layer in layers if isinstance(layer, Norm))

    def init(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of a unit's inputs; normalisation begins as identity."""
        rng, out = np.random.default_rng(seed), np.zeros(self.size)
        for layer, own in zip(self.layers, self.slices):
            if isinstance(layer, Norm):
                out[own[0][0] : own[0][1]] = 1.0
                continue
            for a, b, _ in own:
                out[a:b] = rng.uniform(-1, 1, b - a) / np.sqrt(layer.fan_in)
        return out

    def first_moments(self) -> np.ndarray:
        return np.concatenate([np.repeat([0.0, 1.0], layer.cells) for layer in self.layers if isinstance(layer, Norm)] or [np.zeros(0)])

    def _params(self, vector: np.ndarray, i: int, dtype) -> list[np.ndarray]:
        return [vector[a:b].reshape(shape).astype(dtype, copy=False) for a, b, shape in self.slices[i]]

    def forward(self, vector: np.ndarray, x: np.ndarray, mode: Mode = Mode()) -> tuple[np.ndarray, list]:
        kept, at = [], 0
        for i, layer in enumerate(self.layers):
            here = mode
            if isinstance(layer, Norm):
                if not mode.training:
                    here = mode._replace(moments=mode.moments[at : at + 2 * layer.cells].reshape(2, -1).astype(x.dtype))
                at += 2 * layer.cells
            x, state = layer.forward(x, self._params(vector, i, x.dtype), here)
            kept.append(state)
        return x, kept

    def backward(self, vector: np.ndarray, kept: list, dy: np.ndarray) -> np.ndarray:
        grad = np.zeros(self.size)
        for i in range(len(self.layers) - 1, -1, -1):
            dy, own = self.layers[i].backward(dy, kept[i], self._params(vector, i, dy.dtype))
            for (a, b, _), g in zip(self.slices[i], own):
                grad[a:b] = g.ravel()
        return grad

    def seen_moments(self, kept: list) -> np.ndarray:
        found = [np.concatenate(state[2:]) for layer, state in zip(self.layers, kept) if isinstance(layer, Norm)]
        return np.concatenate(found).astype(float) if found else np.zeros(0)


def autoencoder(cells: int, bins: int, latent: int = 32) -> Network:
    """Maps through ``latent`` numbers and back: three halving convolutions, three doubling ones."""
    if bins % 8:
        raise ValueError("the number of bins has to be a multiple of 8")
    down = [Conv(cells, 32, 5, 2, 2), Relu(), Conv(32, 64, 5, 2, 2), Relu(), Conv(64, 64, 5, 2, 2), Relu(), Dense(8 * bins, latent)]
    up = [Dense(latent, 8 * bins), Fold(64), Relu(), Conv(64, 64, 4, 2, 1, True), Relu(), Conv(64, 32, 4, 2, 1, True), Relu(), Conv(32, cells, 4, 2, 1, True)]
    return Network(down + up)


def classifier(cells: int, classes: int, width: int = 32, dropout: float = 0.3) -> Network:
    """Four convolutions, each normalised and halved, then mean and maximum to class scores."""
    layers, before = [], cells
    for out in (width, 2 * width, 4 * width, 4 * width):
        layers += [Conv(before, out, 7, 1, 3), Norm(out), Relu(), HalfMax()]
        before = out
    return Network([*layers, MeanMax(), Dropout(dropout), Dense(2 * before, classes)])
