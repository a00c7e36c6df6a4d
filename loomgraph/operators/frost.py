"""Orthogonal symmetric nonnegative tri-factorisation of one sparse matrix, and its initialisations, as numpy code for a task."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np


class Sparse:
    """A symmetric sparse matrix as rows (columns, values)."""

    def __init__(self, n: int, i, j, x):
        order = np.lexsort((j, i))
        self.n, self.i, self.j, self.x = n, np.asarray(i)[order], np.asarray(j)[order], np.asarray(x, dtype=float)[order]
        self.starts = np.searchsorted(self.i, np.arange(n + 1))
        self.diagonal = np.bincount(self.i[self.i == self.j], self.x[self.i == self.j], n)
        if (np.diff(self.starts) == 0).any():
            raise ValueError("the matrix has a zero row: leave isolated nodes out first")

    def times(self, m: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.x[:, None] * m[self.j] if m.ndim > 1 else self.x * m[self.j], self.starts[:-1], axis=0)  # no row is empty

    def norm(self) -> float:
        return float(np.sqrt((self.x**2).sum()))


def positive_minimum(a: float, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positive x with the least a x^4 + b x^2 + c x below 0, and that value; 0 and 0 where there is none."""
    a = np.maximum(np.broadcast_to(a, b.shape), 1e-12)
    p, q = b / (2 * a), c / (4 * a)
    half = q * q / 4 + p**3 / 27
    root = np.sqrt(np.maximum(half, 0))
    one = np.cbrt(-q / 2 + root) + np.cbrt(-q / 2 - root)
    r = np.sqrt(np.maximum(-p / 3, 0))
    angle = np.arccos(np.clip(np.where(r > 0, -q / (2 * np.maximum(r, 1e-100) ** 3), 0), -1, 1)) / 3
    three = [2 * r * np.cos(angle - 2 * math.pi * k / 3) for k in range(3)]
    x = np.stack([np.where(half > 0, one, t) for t in three])
    value = np.where(x > 0, a * x**4 + b * x**2 + c * x, 0.0)
    best = value.argmin(0)
    pick = (best, np.arange(len(b)))
    return np.where(value[pick] < 0, x[pick], 0.0), np.minimum(value[pick], 0.0)


def leading_space(x: Sparse, r: int, random, rounds: int = 30) -> np.ndarray:
    """An orthonormal basis of about the leading r singular vectors, by subspace iteration."""
    q = np.linalg.qr(random.normal(size=(x.n, min(x.n, r + 5))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ x.times(q))
    return q @ vectors[:, np.argsort(-np.abs(values))[:r]]


def _average(x: Sparse, columns: np.ndarray, mean: bool) -> np.ndarray:
    block = np.zeros((len(columns), x.n))
    for k, c in enumerate(columns):
        a, b = x.starts[c], x.starts[c + 1]
        block[k, x.j[a:b]] = x.x[a:b]
    return block.mean(0) if mean else np.median(block, axis=0)


def svca(x: Sparse, r: int, p: int, random, mean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed vertex components: r times a random direction of the leading space without the columns found so far, and the mean or median of the p columns at its more extreme end.  (W, places)"""
    space, found, basis, places = leading_space(x, r, random), [], np.zeros((x.n, 0)), []
    for _ in range(r):
        d = space @ random.normal(size=space.shape[1])
        d -= basis @ (basis.T @ d)
        u = x.times(d)
        order = np.argsort(-u, kind="stable")
        high, low = order[:p], order[::-1][:p]
        at = high if abs(np.median(u[high])) >= abs(np.median(u[low])) else low
        column = _average(x, at, mean)
        found.append(column)
        places.append(at)
        rest = column - basis @ (basis.T @ column)
        if np.linalg.norm(rest) > 1e-12:
            basis = np.column_stack([basis, rest / np.linalg.norm(rest)])
    return np.array(found).T, np.array(places)


def sspa(x: Sparse, r: int, p: int, mean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed successive projection: the direction is the residual of the column whose residual is largest; p = 1 is the plain one."""
    residual = np.bincount(x.i, x.x**2, x.n)
    found, basis, places = [], np.zeros((x.n, 0)), []
    for _ in range(r):
        k = int(residual.argmax())
        d = np.zeros(x.n)
        a, b = x.starts[k], x.starts[k + 1]
        d[x.j[a:b]] = x.x[a:b]
        d = d - basis @ (basis.T @ d)
        u = x.times(d)
        at = np.argsort(-u, kind="stable")[:p]
        column = _average(x, at, mean)
        found.append(column)
        places.append(at)
        rest = column - basis @ (basis.T @ column)
        if np.linalg.norm(rest) > 1e-12:
            rest /= np.linalg.norm(rest)
            basis = np.column_stack([basis, rest])
            residual = np.maximum(residual - x.times(rest) ** 2, 0)
    return np.array(found).T, np.array(places)


def orthogonal_nnls(x: Sparse, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, weight): the best column of w by cosine for each column of x, and its least-squares weight."""
    norms = (w**2).sum(0)
    inner = x.times(w)
    cosine = inner / (np.sqrt(norms) + 1e-16)
    v = cosine.argmax(1)
    return v, inner[np.arange(x.n), v] / np.maximum(norms[v], 1e-300)


def initial(x: Sparse, r: int, method: str, random) -> tuple[np.ndarray, np.ndarray]:
    """(v, w) by random, SVCA, SSPA or SPA."""
    if method == "random":
        v = random.permutation(np.concatenate([np.arange(r), random.integers(0, r, x.n - r)]))
        return v, random.random(x.n)
    p = max(2, int(0.1 * x.n / r))
    if method == "SVCA":
        found = svca(x, r, p, random)[0]
    elif method in ("SSPA", "SPA"):
        found = sspa(x, r, p if method == "SSPA" else 1)[0]
    else:
        raise ValueError(f"there is no initialisation {method}")
    return orthogonal_nnls(x, found)


def normalise(v: np.ndarray, w: np.ndarray, r: int) -> np.ndarray:
    norms = np.sqrt(np.bincount(v, w * w, r))
    return np.divide(w, norms[v], out=np.zeros_like(w), where=norms[v] != 0)


def s_matrix(x: Sparse, v: np.ndarray, w: np.ndarray, r: int) -> np.ndarray:
    s = np.zeros((r, r))
    np.add.at(s, (v[x.i], v[x.j]), w[x.i] * x.x * w[x.j])
    return s


def error_of(norm: float, s: np.ndarray) -> float:
    return math.sqrt(max(norm**2 - (s**2).sum(), 0.0)) / norm


@dataclass
class Factors:
    v: np.ndarray
    w: np.ndarray
    s: np.ndarray
    error: float
    sweeps: list[float] = field(default_factory=list)
    status: str = "done"


def frost(x: Sparse, r: int, random, method: str = "SVCA", sweeps: int = 1000, delta: float = 1e-7, seconds: float = 300.0) -> Factors:
    """Block coordinate descent: node by node the best block and weight given all others, then S again, until the error settles."""
    end, norm = time.monotonic() + seconds, x.norm()
    v, w = initial(x, r, method, random)
    w = normalise(v, w, r)
    s = s_matrix(x, v, w, r)
    best = Factors(v, w, s, error_of(norm, s), status="sweep limit")
    idle = math.sqrt(r / x.n)
    for _ in range(sweeps):
        began = time.perf_counter()
        v, w, last = v.copy(), w.copy(), best.error
        reach = ((w[:, None] * s[v]) ** 2).sum(0)
        square, own = np.diag(s) ** 2, np.diag(s)
        for i in range(x.n):
            a, b = x.starts[i], x.starts[i + 1]
            j = x.j[a:b]
            others = j != i
            j, xs = j[others], x.x[a:b][others]
            here = (w[i] * s[v[i]]) ** 2
            c = -4 * ((xs * w[j]) @ s[v[j]]) if len(j) else np.zeros(r)
            at, value = positive_minimum(square, 2 * (reach - here) - 2 * x.diagonal[i] * own, c)
            k = int(value.argmin())
            reach -= here
            v[i], w[i] = (k, at[k]) if value[k] < 0 else (v[i], idle)
            reach += (w[i] * s[v[i]]) ** 2
            if i % 256 == 0 and time.monotonic() > end:
                best.status = "time limit"
                return best
        w = normalise(v, w, r)
        s = s_matrix(x, v, w, r)
        error = error_of(norm, s)
        best = Factors(v, w, s, error, [*best.sweeps, time.perf_counter() - began], "sweep limit")
        if error < delta or abs(last - error) < delta:
            best.status = "done"
            break
    return best


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500, tolerance: float = 1e-8, accelerated: bool = False) -> np.ndarray:
    """Nonnegative V that minimises the norm of b - a V: coordinate by coordinate, or by accelerated projected gradients."""
    gram, inner = a.T @ a, a.T @ b
    v = np.maximum(np.linalg.lstsq(a, b, rcond=None)[0], 0)
    if accelerated:
        step, y, t = 1 / max(np.linalg.norm(gram, 2), 1e-300), v.copy(), 1.0
        for _ in range(rounds):
            after = np.maximum(y - step * (gram @ y - inner), 0)
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            y, moved, v, t = after + (t - 1) / t2 * (after - v), np.linalg.norm(after - v), after, t2
            if moved < tolerance * max(1.0, np.linalg.norm(v)):
                break
        return v
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(gram)):
            if gram[k, k] > 0:
                row = np.maximum(v[k] + (inner[k] - gram[k] @ v) / gram[k, k], 0)
                moved += float(((row - v[k]) ** 2).sum())
                v[k] = row
        if moved < tolerance**2 * max(1.0, float((v**2).sum())):
            break
    return v


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def l1_low_rank(m: np.ndarray, rank: int, random, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """U, V with a small sum of absolute residuals of m - U V, by exact coordinate descent (weighted medians)."""
    u, d, vt = np.linalg.svd(m, full_matrices=False)
    u, v = u[:, :rank] * d[:rank], vt[:rank].copy()

    def improve(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        for k in range(rank):
            rest = a - left @ right + np.outer(left[:, k], right[k])
            some = np.abs(right[k]) > 1e-12
            if some.any():
                for i in range(len(a)):
                    left[i, k] = weighted_median(rest[i, some] / right[k, some], np.abs(right[k, some]))

    for _ in range(rounds):
        before = np.abs(m - u @ v).sum()
        improve(m, u, v)
        vt2, ut2 = v.T.copy(), u.T.copy()
        improve(m.T, vt2, ut2)
        v = vt2.T
        if before - np.abs(m - u @ v).sum() < 1e-9 * max(1.0, before):
            break
    return u, v


def dirichlet(alpha: np.ndarray, n: int, random) -> np.ndarray:
    """n samples of a Dirichlet distribution."""
    g = random.gamma(np.asarray(alpha), size=(n, len(alpha)))
    return g / g.sum(1, keepdims=True)
