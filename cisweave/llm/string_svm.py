"""Support vector machine on a gap-weighted subsequence kernel of strings, with Nystrom landmarks.

The kernel of two strings sums over the subsequences that both hold: of `letters` characters within a span of `letters +
gap` characters, and of one to three words with up to `gap` words between; an occurrence weighs decay ** gaps. An
inserted or dropped character, or another word in between, costs a factor and not the match. Because gaps are bounded, a
string's occurrences can be listed, so kernels are products of sparse vectors over hashed subsequences.

Landmarks are chosen from the training strings by pivoted Cholesky; a string's features are its kernels with the
landmarks times K_mm ** -1/2, and a linear machine is trained on them. Since the decision is linear in the kernels with
the landmarks, and these are linear in the string's occurrences, both matrices fold into one weight per subsequence:
scoring a string costs one lookup per occurrence and no kernel is evaluated against any landmark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np

#: of a subsequence's hash; the other 20 number the strings of a call
BITS = 44


@dataclass(frozen=True)
class Kernel:
    letters: int = 4
    gap: int = 1
    decay: float = 0.6
    word: float = 12.0
    words: float = 4.0
    #: norm of text that says nothing, added to every string: a few letters alone are no evidence
    ground: float = 20.0


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _subsequences(symbols: np.ndarray, owner: np.ndarray, length: int, gap: int, decay: float, salt: int):
    """(owner, hash, weight) of the subsequences of `length` symbols that span at most length + gap, within owners."""
    n = len(symbols)
    for steps in combinations(range(1, length + gap), length - 1):
        span = steps[-1] if steps else 0
        if n <= span:
            continue
        start = np.flatnonzero(owner[: n - span] == owner[span:]) if span else np.arange(n)
        h = np.full(len(start), salt, np.uint64)
        h = _mix(h, symbols[start])
        for s in steps:
            h = _mix(h, symbols[start + s])
        yield owner[start], h, decay ** (span - length + 1)


def occurrences(strings: Sequence[str], k: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string number, hashed subsequence, weight), each pair once, its weights summed."""
    text = [f" {s} " for s in strings]
    chars = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(text)), [len(t) for t in text])
    words = [w for s in strings for w in s.split()]
    word_owner = np.repeat(np.arange(len(strings)), [len(s.split()) for s in strings])
    distinct, at = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (np.array([], str), np.array([], int))
    codes = np.zeros(len(distinct), np.uint64)
    width = distinct.dtype.itemsize // 4 if len(distinct) else 0
    if width:
        letters = distinct.view(np.uint32).reshape(len(distinct), width)
        codes = np.full(len(distinct), 7, np.uint64)
        for c in range(width):
            codes = np.where(letters[:, c] > 0, _mix(codes, letters[:, c].astype(np.uint64)), codes)
    symbols = codes[at] if len(words) else np.zeros(0, np.uint64)
    found = [(o, h, np.full(len(o), w)) for o, h, w in _subsequences(chars, owner, k.letters, k.gap, k.decay, 11)]
    for length in (1, 2, 3):
        found += [(o, h, np.full(len(o), w * (k.word if length == 1 else k.words))) for o, h, w in _subsequences(symbols, word_owner, length, k.gap if length > 1 else 0, k.decay, 20 + length)]
    who = np.concatenate([f[0] for f in found]).astype(np.uint64)
    feature = np.concatenate([f[1] for f in found]) >> np.uint64(64 - BITS)
    weight = np.concatenate([f[2] for f in found])
    pair = (who << np.uint64(BITS)) | feature
    pair, inverse = np.unique(pair, return_inverse=True)
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64), np.bincount(inverse, weight)


def normed(strings: Sequence[str], k: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like occurrences(), the weights divided by their string's norm."""
    who, feature, weight = occurrences(strings, k)
    norm = np.sqrt(np.bincount(who, weight**2, len(strings)) + k.ground**2)
    return who, feature, (weight / norm[who]).astype(np.float32)


@dataclass(frozen=True)
class Sparse:
    """Occurrences of strings as rows, each divided by its norm; `columns` has the hash of each feature, ascending."""

    who: np.ndarray
    feature: np.ndarray
    weight: np.ndarray
    count: int
    columns: np.ndarray

    @staticmethod
    def of(strings: Sequence[str], k: Kernel) -> Sparse:
        who, hashed, weight = normed(strings, k)
        columns, feature = np.unique(hashed, return_inverse=True)
        return Sparse(who, feature, weight, len(strings), columns)

    def times(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.who, self.weight * dense[self.feature], self.count)

    def row(self, i: int) -> np.ndarray:
        start, end = np.searchsorted(self.who, [i, i + 1])
        dense = np.zeros(len(self.columns), np.float32)
        dense[self.feature[start:end]] = self.weight[start:end]
        return dense


def landmarks(rows: Sparse, most: int, trust: np.ndarray | None = None, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks and the kernels of all rows with them, by pivoted Cholesky: each time the string that those before
    explain least; after `most` of them, up to `more` by what is unexplained times trust, as short strings, which have
    little to explain, are not met otherwise. One column of kernels is made per landmark; the whole matrix never exists.
    A subsequence of one string only adds to no kernel but the string's with itself, so it is left out of the products."""
    own = np.bincount(rows.who, rows.weight.astype(float) ** 2, rows.count)
    shared = (np.bincount(rows.feature, minlength=len(rows.columns)) > 1)[rows.feature]
    columns, feature = np.unique(rows.feature[shared], return_inverse=True)
    who, weight = rows.who[shared], rows.weight[shared]
    start = np.searchsorted(who, np.arange(rows.count + 1))
    # the rows that hold a subsequence, side by side
    order = np.argsort(feature, kind="stable")
    first = np.searchsorted(feature[order], np.arange(len(columns) + 1))
    holder, held = who[order], weight[order]
    left = own.copy()
    chosen: list[int] = []
    kernels, basis = np.zeros((rows.count, most + more), np.float32), np.zeros((rows.count, most + more), np.float32)
    while len(chosen) < most + more and left.max() > 1e-3:
        p, c = int(np.argmax(left if len(chosen) < most or trust is None else np.where(left > 1e-3, left * trust, 0))), len(chosen)
        at = slice(start[p], start[p + 1])
        begin, many = first[feature[at]], np.diff(first)[feature[at]]
        places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        column = np.bincount(holder[places], held[places] * np.repeat(weight[at], many), rows.count)
        column[p] = own[p]
        kernels[:, c] = column
        basis[:, c] = (column - basis[:, :c] @ basis[p, :c]) / np.sqrt(left[p])
        left = np.maximum(left - basis[:, c].astype(float) ** 2, 0)
        left[p] = 0
        chosen.append(p)
    return np.array(chosen), kernels[:, : len(chosen)]


def train_linear(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> np.ndarray:
    """L2-regularised squared-hinge machine by Newton steps on the violated margins; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * w @ w + float(cost @ np.maximum(1 - y * (x @ w), 0) ** 2)

    at = loss(w)
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        v = margin > 0
        gradient = w - 2 * x[v].T @ (cost[v] * y[v] * margin[v])
        if np.abs(gradient).max() < 1e-6:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * (x[v].T * cost[v]) @ x[v], gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > at - 1e-4 * size * gradient @ step:
            size /= 2
        w = w - size * step
        at = loss(w)
    return w


@dataclass(frozen=True)
class Machine:
    """One weight per subsequence of the landmarks, by ascending hash, and a bias: the folded decision function. Other
    subsequences have none."""

    kernel: Kernel
    columns: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, strings: Sequence[str]) -> np.ndarray:
        if not len(strings):
            return np.zeros(0)
        who, feature, weight = normed(strings, self.kernel)
        at = np.minimum(np.searchsorted(self.columns, feature), len(self.columns) - 1)
        known = self.columns[at] == feature
        return np.bincount(who[known], weight[known] * self.weights[at[known]], len(strings)) + self.bias


def train(strings: Sequence[str], y: np.ndarray, trust: np.ndarray | None = None, kernel: Kernel = Kernel(), most: int = 400, more: int = 0, c: float = 3.0) -> Machine:
    """y: +1 or -1; trust: factor of each string's cost; most, more: of landmarks()."""
    rows = Sparse.of(strings, kernel)
    at, kernels = landmarks(rows, most, trust, more)
    values, u = np.linalg.eigh(kernels[at].astype(float))
    keep = values > 1e-6
    root = u[:, keep] / np.sqrt(values[keep])
    w = train_linear(kernels @ root, y, c * (np.ones(len(y)) if trust is None else trust))
    folded = np.zeros(len(rows.columns), np.float32)
    for i, beta in zip(at, root @ w[:-1]):
        start, end = np.searchsorted(rows.who, [i, i + 1])
        folded[rows.feature[start:end]] += beta * rows.weight[start:end]
    own = np.flatnonzero(folded)
    return Machine(kernel, rows.columns[own], folded[own], float(w[-1]))
