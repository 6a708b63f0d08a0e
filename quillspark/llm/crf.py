"""A skip-chain conditional random field: labelled nodes in the order of their text, linked to their neighbours and to distant
nodes that repeat or resemble them. Inference is loopy message passing, fitting maximises the pseudo-likelihood."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CHAIN, SAME, ALIKE = 0, 1, 2
FORBIDDEN = -1e3


@dataclass
class Links:
    """Potentials of the edges; label 0 is none. `chain` holds for neighbours in order, `same` where both ends repeat one value and have
    one label, `alike` where they resemble each other and are anything at all."""

    n_labels: int
    chain: np.ndarray = field(default=None)
    same: float = 0.0
    alike: float = 0.0

    def __post_init__(self):
        if self.chain is None:
            self.chain = np.zeros((self.n_labels, self.n_labels))

    def tables(self) -> np.ndarray:
        n = self.n_labels
        same, alike = np.zeros((n, n)), np.zeros((n, n))
        same[np.arange(1, n), np.arange(1, n)] = self.same
        alike[1:, 1:] = self.alike
        return np.stack([self.chain, same, alike])


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]


def propagate(unary: np.ndarray, edges: np.ndarray, links: Links, rounds: int = 6) -> np.ndarray:
    """(n, labels) log beliefs of nodes with log potentials `unary` after message passing along `edges` (i, j, kind)."""
    if not len(edges):
        return unary
    i, j = edges[:, 0], edges[:, 1]
    table = links.tables()[edges[:, 2]]
    forth, back = np.zeros((len(edges), unary.shape[1])), np.zeros((len(edges), unary.shape[1]))
    belief = unary
    for _ in range(rounds):
        new_f = _log_sum((belief[i] - back)[:, :, None] + table)
        new_b = _log_sum((belief[j] - forth)[:, :, None] + table.transpose(0, 2, 1))
        forth = 0.5 * forth + 0.5 * (new_f - new_f.max(1, keepdims=True))
        back = 0.5 * back + 0.5 * (new_b - new_b.max(1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, j, forth)
        np.add.at(belief, i, back)
    return belief


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(base: np.ndarray, x: np.ndarray, label: int, guess: np.ndarray, known: np.ndarray, edges: np.ndarray, weights: np.ndarray, steps: int = 300, rate: float = 0.3, l2: float = 1e-3) -> tuple[np.ndarray, Links]:
    """Weights of the features x of `label`, and the potentials of the links, together.

    base: (n, labels) fixed log potentials; guess: labels; only nodes in `known` count in the likelihood, the guesses of the others
    are their neighbours' context. Nothing is learned about neighbours without label.
    """
    n, k = base.shape
    one = np.eye(k)[guess]
    one[:, 0] = 0
    before, after, same, alike = (np.zeros((n, k)) for _ in range(4))
    for kind, to, frm, out in ((CHAIN, 1, 0, before), (CHAIN, 0, 1, after), (SAME, 1, 0, same), (SAME, 0, 1, same), (ALIKE, 1, 0, alike), (ALIKE, 0, 1, alike)):
        e = edges[edges[:, 2] == kind] if len(edges) else np.zeros((0, 3), dtype=int)
        np.add.at(out, e[:, to], one[e[:, frm]])
    any_alike = alike.sum(1)[known]
    b, xs, y = base[known], x[known], np.eye(k)[guess[known]]
    before, after, same = before[known], after[known], same[known]
    scale = np.maximum(np.abs(xs).max(0), 1e-9) if len(xs) else np.ones(x.shape[1])
    z, w, links = xs / scale, weights * scale, Links(k)
    m = max(1, len(b))
    for _ in range(steps):
        s = b + before @ links.chain + after @ links.chain.T + links.same * same
        s[:, 1:] += links.alike * any_alike[:, None]
        s[:, label] += z @ w
        g = y - _softmax(s)
        w += rate * (z.T @ g[:, label] / m - l2 * w)
        chain = links.chain + rate * ((before.T @ g + g.T @ after) / m - 10 * l2 * links.chain)
        chain[0], chain[:, 0] = 0, 0
        links.chain = np.clip(chain, -1.5, 1.5)
        links.same = float(np.clip(links.same + rate * ((g * same).sum() / m - l2 * links.same), 0, 3))
        links.alike = float(np.clip(links.alike + rate * ((g[:, 1:].sum(1) * any_alike).sum() / m - l2 * links.alike), 0, 3))
    return w / scale, links
