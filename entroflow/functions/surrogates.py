"""Surrogate series on arrays; small helpers that run inside Spark tasks. Missing values stay where they are.

A series is n x d components, which share permutations, blocks or phases. Replicates are drawn together, one from each
generator handed in, so a replicate depends on its seed alone and not on where, or with which others, it is drawn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np


class DigestOrder:
    """Stands in for a generator where only permutations are drawn: places by the order of MD5 digests of "name:draw:place".

    SQL in any engine draws the same ones, so a test against surrogates can be repeated elsewhere.
    """

    def __init__(self, name: str):
        self.name, self.drawn = name, 0

    def permutation(self, places: int | np.ndarray) -> np.ndarray:
        at = np.arange(places) if isinstance(places, int) else places
        order = sorted(at.tolist(), key=lambda p: hashlib.md5(f"{self.name}:{self.drawn}:{p}".encode()).digest())
        self.drawn += 1
        return np.array(order, int)


#: Kinds of surrogates that permutations alone make.
PERMUTING = ("shuffle", "block")


def filled(x: np.ndarray, how: str = "line") -> np.ndarray | None:
    """x without gaps, by linear interpolation in row order or by the mean; None with under two values."""
    gap = np.isnan(x)
    if not gap.any():
        return x.copy()
    if (~gap).sum() <= 1:
        return None
    out = x.copy()
    at = np.arange(len(x))
    out[gap] = np.interp(at[gap], at[~gap], x[~gap]) if how == "line" else x[~gap].mean()
    return out


def _complete(x: np.ndarray, how: str) -> np.ndarray | None:
    parts = [filled(c, how) for c in x.T]
    return None if any(p is None for p in parts) else np.column_stack(parts)


def shuffled(x: np.ndarray, rngs: Sequence[np.random.Generator]) -> np.ndarray:
    """Rows without a gap change places."""
    there = np.flatnonzero(~np.isnan(x).any(axis=1))
    out = np.repeat(x[None], len(rngs), axis=0)
    out[:, there] = x[np.array([r.permutation(there) for r in rngs]).reshape(len(rngs), len(there))]
    return out


def block_size(x: np.ndarray) -> int:
    """First lag at which the autocorrelation is below 1/e, else a tenth of the length; from 2 to a third of it."""
    n, c = len(x), x - x.mean()
    spectrum = np.fft.rfft(c, 2 * n)
    acf = np.fft.irfft(np.abs(spectrum) ** 2)[:n]
    if acf[0] <= 0:
        return 2
    below = np.flatnonzero(acf / acf[0] < 1 / np.e)
    return max(2, min(int(below[0]) if len(below) and below[0] > 0 else n // 10, n // 3))


def blocks_shuffled(x: np.ndarray, rngs: Sequence[np.random.Generator], size: int | None = None) -> np.ndarray:
    """Contiguous blocks change places, gaps and all; the last block may be shorter."""
    if size is None:
        first = x[:, 0][~np.isnan(x[:, 0])]
        size = block_size(first) if len(first) > 1 else 2
    starts = np.arange(0, len(x), size)
    return np.stack([np.concatenate([x[s : s + size] for s in starts[r.permutation(len(starts))]]) for r in rngs])


def phases_randomised(x: np.ndarray, rngs: Sequence[np.random.Generator]) -> np.ndarray:
    """Random phases, the same shift for all components, under the magnitudes of x."""
    whole = _complete(x, "mean")
    if whole is None:
        return np.repeat(x[None], len(rngs), axis=0)
    n, mean = len(x), whole.mean(axis=0)
    f = np.fft.rfft(whole - mean, axis=0)
    turn = np.empty((len(rngs), len(f)))
    for i, r in enumerate(rngs):
        turn[i] = r.uniform(0, 2 * np.pi, len(f))
        if n % 2 == 0:
            turn[i, -1] = r.choice([0.0, np.pi])
    turn[:, 0] = 0
    out = np.fft.irfft(f * np.exp(1j * turn)[:, :, None], n=n, axis=1) + mean
    out[:, np.isnan(x)] = np.nan
    return out


def fit_circle(xy: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of the algebraic least-squares circle."""
    a = np.column_stack([xy, np.ones(len(xy))])
    s = np.linalg.lstsq(a, (xy**2).sum(axis=1), rcond=None)[0]
    centre = s[:2] / 2
    return centre, float(np.sqrt(max(s[2] + centre @ centre, 0.0)))


def onto_circle(xy: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    v = xy - centre
    n = np.hypot(v[..., :1], v[..., 1:])
    return centre + radius * v / np.where(n == 0, 1.0, n)


def iaaft(x: np.ndarray, rngs: Sequence[np.random.Generator], rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Iterated amplitude-adjusted surrogates: the values of each component in an order with its spectrum.

    Several components keep their phases relative to the first; two that lie on a circle are put back onto it. All
    replicates turn at once, and each stops when it has settled.
    """
    whole = _complete(x, "line")
    if len(x) <= 1 or whole is None or (whole.std(axis=0) == 0).any():
        return np.repeat(x[None], len(rngs), axis=0)
    n, d = whole.shape
    mean, values = whole.mean(axis=0), np.sort(whole, axis=0)
    f = np.fft.rfft(whole - mean, axis=0)
    magnitude, angle = np.abs(f), np.angle(f)
    # The spectrum that a replicate gets but for the turn of its first component.
    shape = magnitude * np.exp(1j * (angle - angle[:, :1]))
    now = whole[np.array([r.permutation(n) for r in rngs])]
    going = np.arange(len(rngs))
    for _ in range(rounds):
        held = now[going]
        g = np.fft.rfft(held[:, :, 0] - (mean if d == 1 else held[:, :, 0].mean(axis=1, keepdims=True)), axis=1)
        size = np.abs(g)
        turn = np.where(size > 0, g / np.where(size > 0, size, 1.0), 1.0)
        turn[:, 0] = 1.0
        if n % 2 == 0:
            turn[:, -1] = np.where(g[:, -1].real >= 0, 1.0, -1.0) if d == 1 else 1.0
        spectrum = turn[:, :, None] * shape
        spectrum[:, 0] = magnitude[0]
        if n % 2 == 0 and d > 1:
            spectrum[:, -1] = magnitude[-1]
        spectral = np.fft.irfft(spectrum, n=n, axis=1) + mean
        fresh = np.empty_like(held)
        np.put_along_axis(fresh, np.argsort(spectral, axis=1, kind="stable"), values[None], axis=1)
        now[going] = fresh
        power = (fresh**2).mean(axis=(1, 2))
        moved = ((fresh - held) ** 2).mean(axis=(1, 2))
        going = going[~((power > 0) & (moved < tolerance * power))]
        if not len(going):
            break
    if d == 2:
        centre, radius = fit_circle(whole)
        if radius > 0 and np.median(np.abs(np.hypot(*(whole - centre).T) - radius)) < 0.1 * radius:
            now = onto_circle(now, centre, radius)
    now[:, np.isnan(x)] = np.nan
    return now


KINDS = {"iaaft": iaaft, "shuffle": shuffled, "block": blocks_shuffled, "phase": phases_randomised}


def replicates(x: np.ndarray, kind: str, rngs: Sequence[np.random.Generator]) -> np.ndarray:
    """Surrogates of x (n x d), one a generator: replicates x n x d. A replicate is the same whatever others are drawn with it."""
    if kind not in KINDS:
        raise ValueError(f"no surrogate of kind {kind!r}; there are {sorted(KINDS)}")
    x = np.asarray(x, float)
    return KINDS[kind](x, rngs) if len(rngs) else np.empty((0, *x.shape))


def surrogate(x: np.ndarray, kind: str, rng: np.random.Generator) -> np.ndarray:
    """A surrogate of x (n or n x d) in the same shape."""
    x = np.asarray(x, float)
    return replicates(x.reshape(len(x), -1), kind, [rng])[0].reshape(x.shape)
