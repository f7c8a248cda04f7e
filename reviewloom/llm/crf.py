"""Linear-chain conditional random field with two labels: training by likelihood, decoding by Viterbi."""

from __future__ import annotations

import numpy as np


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, l2: float = 1.0, rate: float = 0.1) -> dict:
    """Weights from (features (n, f), labels (n,)) sequences: emission (f, 2), step (2, 2), start (2,).

    Maximises the conditional likelihood with a Gaussian prior (l2) by Adam; forward-backward runs over all
    sequences at once. Sequences must not be empty; without any, all weights are 0.
    """
    if not sequences:
        return {"emit": np.zeros((0, 2)), "step": np.zeros((2, 2)), "start": np.zeros(2)}
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i][1]))
    sizes = np.array([len(sequences[i][1]) for i in order])
    alive = np.array([int((sizes > t).sum()) for t in range(sizes[0])])  # sequences by falling length
    # rows stand by place, then by sequence: those of one place are one range, and so are those before them
    off = np.cumsum(alive) - alive
    rank = np.concatenate([np.arange(k) for k in alive])
    place = np.repeat(np.arange(sizes[0]), alive)
    at = (np.cumsum(sizes) - sizes)[rank] + place
    x = np.concatenate([sequences[i][0] for i in order]).astype(float)[at]
    y = np.concatenate([sequences[i][1] for i in order]).astype(int)[at]
    n, many = alive[0], slice(alive[0], len(y))
    before, last = off[place[many] - 1] + rank[many], off[sizes - 1] + np.arange(n)
    params = {"emit": np.zeros((x.shape[1], 2)), "step": np.zeros((2, 2)), "start": np.zeros(2)}
    own = np.zeros((len(y), 2))
    own[np.arange(len(y)), y] = 1
    seen = {"emit": x.T @ own, "step": own[before].T @ own[many], "start": own[:n].sum(axis=0)}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(p) for k, p in params.items()}
    for it in range(1, steps + 1):
        e, s = x @ params["emit"], params["step"]
        alpha, beta = e.copy(), np.zeros_like(e)
        alpha[:n] += params["start"]
        for t in range(1, len(alive)):
            a = alpha[off[t - 1] : off[t - 1] + alive[t]]
            alpha[off[t] : off[t] + alive[t]] += np.logaddexp(a[:, :1] + s[0], a[:, 1:] + s[1])
        for t in range(len(alive) - 1, 0, -1):
            b = slice(off[t], off[t] + alive[t])
            b = e[b] + beta[b]
            beta[off[t - 1] : off[t - 1] + alive[t]] = np.logaddexp(b[:, :1] + s[:, 0], b[:, 1:] + s[:, 1])
        z = np.logaddexp(alpha[last, 0], alpha[last, 1])[rank][:, None]
        mean = np.exp(alpha + beta - z)
        step = np.exp(alpha[before][:, :, None] + s + (e + beta - z)[many][:, None, :]).sum(axis=0)
        grad = {"emit": seen["emit"] - x.T @ mean, "step": seen["step"] - step, "start": seen["start"] - mean[:n].sum(axis=0)}
        for k in params:
            g = (grad[k] - l2 * params[k]) / len(y)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] + rate * np.sqrt(1 - 0.999**it) / (1 - 0.9**it) * m[k] / (np.sqrt(v[k]) + 1e-9)
    return params


def viterbi(emissions, step, start) -> list[int]:
    """The most likely labels of one sequence; emissions: (score of 0, score of 1) pairs. Ties: label 0."""
    (s00, s01), (s10, s11) = step
    back = []
    v0 = v1 = 0.0
    for i, (e0, e1) in enumerate(emissions):
        if i == 0:
            v0, v1 = e0 + start[0], e1 + start[1]
            continue
        a, b, c, d = v0 + s00, v1 + s10, v0 + s01, v1 + s11
        back.append((b > a, d > c))
        v0, v1 = (b if b > a else a) + e0, (d if d > c else c) + e1
    if not len(back) and not len(emissions):
        return []
    label = int(v1 > v0)
    out = [label]
    for to in reversed(back):
        label = int(to[label])
        out.append(label)
    out.reverse()
    return out
