"""Chebyshev neighbours of points among others, by small leaves of sorted strips; helpers that run inside Spark tasks.

Both sides are cut into leaves of LEAF points. A leaf asks the leaves whose boxes are closest, and more of them until the next
box is no closer than what its points have found. Results are those of comparing all with all, to the last digit: boxes are
compared by the same subtractions, which rounding keeps in order.
"""

from __future__ import annotations

import numpy as np

from . import knn

#: Points of a leaf, leaves that ask at once, pairs of leaves that are counted at once.
LEAF, SLAB, PAIRS = 24, 128, 4096


def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order padded with -1 by leaf, points padded with infinity, lowest and highest corners) of the leaves of x."""
    n, d = x.shape
    count = -(-n // LEAF)
    cuts = max(1, int(np.ceil(count ** (1 / d))))
    order, strip, size = np.arange(n), np.zeros(n, np.int64), count
    for c in range(d):
        order = order[np.lexsort((x[order, c], strip))]
        size = -(-size // cuts)
        # Strips are whole leaves, so positions tell them, each inside the one before.
        strip = strip * (cuts + 1) + (np.arange(n) - np.searchsorted(strip, strip)) // (size * LEAF)
    at = np.full(count * LEAF, -1)
    at[:n] = order
    at = at.reshape(count, LEAF)
    points = np.where((at >= 0)[:, :, None], x[at], np.inf)
    return at, points, points.min(axis=1), np.where((at >= 0)[:, :, None], x[at], -np.inf).max(axis=1)


def _apart(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """How far each box is from each other one."""
    out = np.zeros((len(lo), len(other_lo)))
    for c in range(lo.shape[1]):
        np.maximum(out, other_lo[None, :, c] - hi[:, None, c], out=out)
        np.maximum(out, lo[:, None, c] - other_hi[None, :, c], out=out)
    return out


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances between the points of each leaf in p (leaves x points x dims) and those in q."""
    out = np.abs(p[:, :, None, 0] - q[:, None, :, 0])
    for c in range(1, p.shape[2]):
        np.maximum(out, np.abs(p[:, :, None, c] - q[:, None, :, c]), out=out)
    return out


def _line(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(b, kind="stable")
    s = b[order]
    begin = np.clip(np.searchsorted(s, a) - most, 0, max(0, len(s) - 2 * most))
    at = begin[:, None] + np.arange(min(2 * most, len(s)))
    d = np.abs(a[:, None] - s[at])
    first = np.argsort(d, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(d, first, 1), order[np.take_along_axis(at, first, 1)]


def nearest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the `most` rows of b (all, if there are fewer) closest to each row of a in ascending order, and their places."""
    most, d = min(most, len(b)), a.shape[1]
    if not len(a) or not most:
        return np.zeros((len(a), most)), np.zeros((len(a), most), np.int64)
    if d == 1:
        return _line(a[:, 0], b[:, 0], most)
    at, p, lo, hi = _leaves(a)
    held, q, qlo, qhi = _leaves(b)
    out, place = np.empty((len(a), most)), np.empty((len(a), most), np.int64)
    start = min(len(held), max(3**d + 3, -(-most // LEAF) + 1))
    for slab in range(0, len(at), SLAB):
        todo, ask = np.arange(slab, min(slab + SLAB, len(at))), start
        apart = _apart(lo[todo], hi[todo], qlo, qhi)
        while len(todo):
            every = ask >= len(held)
            near = np.broadcast_to(np.arange(len(held)), apart.shape) if every else np.argpartition(apart, ask, axis=1)[:, : ask + 1]
            asked = near if every else near[:, :ask]
            step = max(1, (1 << 21) // (LEAF * LEAF * asked.shape[1]))
            done = np.ones(len(todo), bool)
            for i in range(0, len(todo), step):
                own = todo[i : i + step]
                those = asked[i : i + step]
                g = _gaps(np.where((at[own] >= 0)[:, :, None], p[own], 0.0), q[those].reshape(len(own), -1, d))
                first = np.argpartition(g, most - 1, axis=2)[:, :, :most]
                v = np.take_along_axis(g, first, 2)
                o = np.argsort(v, axis=2, kind="stable")
                v, first = np.take_along_axis(v, o, 2), np.take_along_axis(first, o, 2)
                real = at[own] >= 0
                if not every:
                    done[i : i + step] = np.take_along_axis(apart[i : i + step], near[i : i + step, ask:], 1)[:, 0] >= np.where(real, v[:, :, -1], 0.0).max(axis=1)
                rows = at[own][real]
                out[rows] = v[real]
                place[rows] = np.take_along_axis(held[those].reshape(len(own), 1, -1), first.reshape(len(own), 1, -1), 2).reshape(first.shape)[real]
            todo, apart, ask = todo[~done], apart[~done], ask * 3
    return out, place


def within(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Rows of b whose distance is at most the reach of each row of a; none where it isn't a number."""
    reach = np.where(np.isnan(reach), -1.0, reach)
    if not len(a) or not len(b):
        return np.zeros(len(a), np.int64)
    if a.shape[1] == 1:
        s, n = np.unique(b[:, 0], return_counts=True)
        total, p = np.concatenate([[0], np.cumsum(n)]), a[:, 0]
        padded = np.concatenate([[-np.inf], s, [np.inf]])
        ends = []
        # Ends by addition may be one value off what subtraction says.
        for end, inside in ((np.searchsorted(s, p - reach, "left"), 1), (np.searchsorted(s, p + reach, "right"), 0)):
            low = inside == 1
            while True:
                out_ = np.abs(p - padded[end + (1 if low else 0)]) > reach
                wider = np.abs(p - padded[end + (0 if low else 1)]) <= reach
                move = np.where(wider, -1 if low else 1, np.where(out_ & ((padded[end + 1] < p) if low else (padded[end] > p)), 1 if low else -1, 0))
                if not move.any():
                    break
                end = end + move
            ends.append(end)
        return np.where(reach < 0, 0, np.maximum(total[ends[1]] - total[ends[0]], 0))
    at, p, lo, hi = _leaves(a)
    held, q, qlo, qhi = _leaves(b)
    sizes = (held >= 0).sum(axis=1)
    real = at >= 0
    r = np.where(real, reach[at], -1.0)
    most, least = r.max(axis=1), np.where(real, reach[at], np.inf).min(axis=1)
    counts = np.zeros(at.shape, np.int64)
    safe = np.where(real[:, :, None], p, 0.0)
    for slab in range(0, len(at), SLAB):
        own = np.arange(slab, min(slab + SLAB, len(at)))
        met = _apart(lo[own], hi[own], qlo, qhi) <= most[own][:, None]
        far = np.zeros(met.shape)
        for c in range(a.shape[1]):
            np.maximum(far, qhi[None, :, c] - lo[own][:, None, c], out=far)
            np.maximum(far, hi[own][:, None, c] - qlo[None, :, c], out=far)
        whole = far <= least[own][:, None]
        counts[own] += (whole @ sizes)[:, None]
        i, j = np.nonzero(met & ~whole)
        for s in range(0, len(i), PAIRS):
            mine = own[i[s : s + PAIRS]]
            np.add.at(counts, mine, (_gaps(safe[mine], q[j[s : s + PAIRS]]) <= r[mine][:, :, None]).sum(axis=2))
    out = np.zeros(len(a), np.int64)
    out[at[real]] = counts[real]
    return out


def entropy(x: np.ndarray, k: int = 3) -> float:
    """knn.entropy in bits for many rows; minus infinity where one has k equal neighbours, not a number under k + 1 rows."""
    if len(x) <= k:
        return np.nan
    with np.errstate(divide="ignore"):
        log = np.log(nearest(x, x, k + 1)[0][:, k]).mean()
    return float((knn.digamma(len(x)) - knn.digamma(k) + x.shape[1] * (np.log(2) + log)) / np.log(2))


def information(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 3) -> float:
    """knn.mutual_information in bits for many rows; not a number under k + 1 rows."""
    if len(x) <= k:
        return np.nan
    z = np.zeros((len(x), 0)) if z is None else z
    joint = np.hstack([x, y, z])
    reach = nearest(joint, joint, k + 1)[0][:, k] - knn.ROUNDING
    psi = lambda s: knn.digamma(within(s, s, reach)).mean()
    other = psi(z) if z.shape[1] else knn.digamma(len(x))
    return float((knn.digamma(k) + other - psi(np.hstack([x, z])) - psi(np.hstack([y, z]))) / np.log(2))


def mixed_information(x: np.ndarray, groups: np.ndarray, k: int = 3) -> float:
    """knn.mixed_information in bits for many rows; groups are told apart by the rows of `groups`."""
    whole, given = entropy(x, k), 0.0
    name, n = np.unique(groups, axis=0, return_inverse=True, return_counts=True)[1:]
    for g, size in enumerate(n):
        given += size / len(x) * (entropy(x[name.ravel() == g], k) if size > k else whole)
    return abs(whole - given)
