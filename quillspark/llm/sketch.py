"""SetSketch registers: exponentially spaced truncated minima of element hashes, here of weighted elements.

Register i of a bag is floor(1 - log_b x_i), where x_i is the least of the variates that its elements draw from a hash of
(element, i), exponential with the element's weight as rate. The draws are consistent: a heavier element draws the same variate
or a smaller one, so registers of a union (the greater weight of each element) are the maxima of the registers, and two
bags agree in a register with a probability close to their weighted Jaccard similarity, sum of min over sum of max.
"""

from __future__ import annotations

import numpy as np

BASE = 1.02
LEVELS = 4094  # register values lie in 0..LEVELS + 1
SHIFT = 2000  # register value of x = 1; keeps the values of usual bags away from both ends
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    return (_mix(h + np.uint64(k * int(_SEED) % 2**64)).astype(np.float64) + 0.5) / 2.0**64


def _draws(elements: np.ndarray, weights: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The variate of each weighted element in one register, by consistent weighted sampling."""
    h = _mix(elements ^ seed)
    r = -np.log(_uniform(h, 1) * _uniform(h, 2))
    level = np.floor(np.log(weights) / r + _uniform(h, 3)) - _uniform(h, 3)
    return -np.log(_uniform(h, 4) * _uniform(h, 5)) / np.exp(r * (level + 1))


def registers(hashes: list[np.ndarray], weights: list[np.ndarray], m: int, block: int = 1000) -> np.ndarray:
    """(n, m) registers of bags with elements `hashes` and positive `weights`. Empty bags give zeros.

    A block of bags draws once per distinct weighted element, however many of its bags have it.
    """
    seeds = _mix(np.arange(1, m + 1, dtype=np.uint64) * _SEED)
    out = np.zeros((len(hashes), m), dtype=np.uint16)
    for s in range(0, len(hashes), block):
        rows = [i for i in range(s, min(s + block, len(hashes))) if len(hashes[i])]
        if not rows:
            continue
        flat = np.concatenate([np.asarray(hashes[i], dtype=np.int64) for i in rows]).view(np.uint64)
        w = np.concatenate([np.asarray(weights[i], dtype=np.float64) for i in rows])
        starts = np.concatenate(([0], np.cumsum([len(hashes[i]) for i in rows])[:-1]))
        _, first, at = np.unique(flat ^ _mix(w.view(np.uint64)), return_index=True, return_inverse=True)
        element, weight = flat[first], w[first]
        least = np.empty((len(rows), m))
        for j in range(m):  # a register at a time keeps the working set small
            least[:, j] = np.minimum.reduceat(_draws(element, weight, seeds[j])[at], starts)
        out[rows] = np.clip(np.floor(1 - np.log(least) / np.log(BASE)) + SHIFT, 0, LEVELS + 1).astype(np.uint16)
    return out


def joint_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 18) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity per row from the numbers of greater, smaller and equal registers and the total weights."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(x + tiny) + down * np.log(y + tiny) + same * np.log(np.maximum(1 - x - y, tiny))

    lo, hi = np.zeros(len(u)), most.copy()
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(c) > likelihood(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2
