"""Linear-chain conditional random fields over many chains at once, in numpy.

Chains are rows of padded arrays; the forward and backward recursions step over
positions and treat all chains together, so their cost in Python is that of the
longest chain, not of the number of items.  Chains are sorted by length inside,
and each step touches those that are still open.  A chain beyond ``LONGEST``
items is cut into runs: the product of the transfer matrices of each run carries
the forward and backward messages across the cuts, so marginals are those of the
whole chain while the steps in Python stay few.
"""

from __future__ import annotations

import numpy as np


LONGEST, RUN = 2048, 256


def chains(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First item and length of each run of equal owners."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return first, np.diff(np.append(first, len(owner)))


def forward_backward(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, length: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every item, log partition of every chain, and (if ``pairs``) the summed marginals of neighbouring labels.

    emit: items x labels, log potentials; trans: labels x labels, log potentials.
    """
    if not len(length) or length.max() <= LONGEST:
        return _whole(emit, trans, first, length, pairs)
    cut = np.where(length > LONGEST, -(-length // RUN), 1)
    chain = np.repeat(np.arange(len(first)), cut)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(cut) - cut, cut)
    run = np.where(length[chain] > LONGEST, RUN, length[chain])
    begin = first[chain] + number * run
    size = np.minimum(run, first[chain] + length[chain] - begin)
    enter, leave = _messages(emit, trans, begin, size, number, cut[chain])
    marginal, parts, expected = _whole(emit, trans, begin, size, pairs, enter, leave)
    log_z = np.bincount(chain, parts, minlength=len(first))
    if pairs:  # across the cuts
        later = np.flatnonzero(number > 0)
        joint = enter[later][:, :, None] * np.exp(trans)[None] * (np.exp(emit[begin[later]]) * marginal[begin[later]] / np.maximum(_alpha_first(emit, trans, begin[later], enter[later]), 1e-300))[:, None, :]
        expected = expected + (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return marginal, log_z, expected


def _alpha_first(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, enter: np.ndarray) -> np.ndarray:
    return (enter @ np.exp(trans)) * np.exp(emit[begin])


def _messages(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each run of a cut chain from the left (zeros at a chain's start) and from the right (ones at its end)."""
    k = emit.shape[1]
    t = np.exp(trans)
    enter, leave = np.zeros((len(begin), k)), np.ones((len(begin), k))
    mine = np.flatnonzero(cut > 1)
    # Transfer of each run: rows are the label before it, columns its last label.
    product = np.broadcast_to(np.eye(k), (len(mine), k, k)).copy()
    for step in range(int(size[mine].max())):
        open_ = np.flatnonzero(size[mine] > step)
        e = emit[begin[mine[open_]] + step]
        m = (product[open_] @ t) * np.exp(e - e.max(1, keepdims=True))[:, None, :]
        product[open_] = m / m.sum((1, 2), keepdims=True)
    at = np.full(len(begin), -1)
    at[mine] = np.arange(len(mine))
    for place in range(1, int(cut.max())):  # runs of all chains at once, from the left
        now = np.flatnonzero((number == place) & (cut > 1))
        before = now - 1
        # The first run has no label before it, so no transition into it.
        start = _first_run(emit, t, begin, size, before) if place == 1 else np.einsum("ij,ijk->ik", enter[before], product[at[before]])
        enter[now] = start / start.sum(1, keepdims=True)
    for place in range(int(cut.max()) - 2, -1, -1):  # and from the right
        now = np.flatnonzero((number == place) & (number < cut - 1))
        back = np.einsum("ijk,ik->ij", product[at[now + 1]], leave[now + 1])
        leave[now] = back / back.max(1, keepdims=True)
    return enter, leave


def _first_run(emit: np.ndarray, t: np.ndarray, begin: np.ndarray, size: np.ndarray, runs: np.ndarray) -> np.ndarray:
    alpha = None
    for step in range(int(size[runs].max())):  # all but the last runs of a chain are equally long
        e = np.exp(emit[begin[runs] + step] - emit[begin[runs] + step].max(1, keepdims=True))
        alpha = e if alpha is None else (alpha @ t) * e
        alpha = alpha / alpha.sum(1, keepdims=True)
    return alpha


def _whole(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, length: np.ndarray, pairs: bool = False, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = emit.shape
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    open_at = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right") if len(length) else np.zeros(0, np.int64)
    top = emit.max(1, keepdims=True) if n else np.zeros((0, 1))
    e, t = np.exp(emit - top), np.exp(trans)
    alpha, scale = np.empty((n, k)), np.empty(n)
    carry = None
    for step, m in enumerate(open_at):
        at = first[:m] + step
        a = e[at] if carry is None else (carry[:m] @ t) * e[at]
        if carry is None and enter is not None:
            came = enter[order]
            a = np.where(came.any(1)[:, None], came @ t, 1.0) * a
        z = a.sum(1)
        a /= z[:, None]
        alpha[at], scale[at] = a, z
        carry = a
    beta = np.ones((n, k))
    if leave is not None:
        last = first + length - 1
        beta[last] = leave[order] / (alpha[last] * leave[order]).sum(1, keepdims=True)
    expected = np.zeros((k, k))
    for step in range(len(open_at) - 1, 0, -1):
        at = first[: open_at[step]] + step
        w = beta[at] * e[at] / scale[at][:, None]
        beta[at - 1] = w @ t.T
        if pairs:
            expected += alpha[at - 1].T @ w
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    log_z = np.zeros(len(first))
    if len(first):
        sums = np.concatenate([[0.0], np.cumsum(np.log(scale) + top[:, 0])])
        log_z[order] = sums[first + length] - sums[first]
    return marginal, log_z, expected * t


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, length: np.ndarray, k: int, steps: int = 150, l2: float = 1e-3, rate: float = 0.1, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions of dense features, by Adam on the penalised log likelihood of the labels (items x labels, a distribution for each item)."""
    n, d = features.shape
    theta = np.zeros((d + k, k))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(n, bool)
    inner[first] = False
    after = np.flatnonzero(inner)
    observed_pairs = labels[after - 1].T @ labels[after]
    weight = np.ones(n) if weight is None else weight
    for step in range(1, steps + 1):
        w, trans = theta[:d], theta[d:]
        marginal, _, expected = forward_backward(features @ w, trans, first, length, pairs=True)
        gradient = np.vstack([features.T @ ((labels - marginal) * weight[:, None]), observed_pairs - expected]) / max(n, 1) - l2 * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], theta[d:]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (the last for the constant) of a penalised logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * max(len(x), 1))
    ridge[-1] = 1e-6 * max(len(x), 1)
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
