"""Leave-pair-out AUC: every (positive, negative) pair held out once, the probe refitted on the rest.

Each refit scales the features by the rows it keeps and minimises |w|^2 / 2 + c * logloss with a free intercept. All
refits of a cell start from the fit to all its rows. Where rows are wide a fit is solved in one number per row: a step
then needs products with Z Z' only, Z being the scaled rows. Those of many pairs are two matrix products with the cell's
unscaled rows, as what a pair changes (mean, scale, two rows less) goes around them. Steps use the inverse matrix of the
fit to all rows, less the pair's two rows (a rank-two downdate), and the next point is mixed from the last ones
(Anderson). Pairs for which that is too slow go to Newton's method, whose steps conjugate gradients find, preconditioned
by the same matrix.
Rows may be sparse (a struct of `idx` and `val`): nothing in the vocabulary's width is made of them but one number per
token that the cell has, and pair.

Where a cell has more rows than features, most pairs need no refit of their own. One fit is made without each row of the
smaller class; the other row of a pair then moves it by one Newton step and a rest with a proven bound (see `Screened`).
A pair whose gap is larger than the bound has a sure winner; only the others are refitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import matrix, one_row
from ..session import cut_lineage
from .states import spread

MAX_ROWS = 4096  # of a cell for which a matrix of rows by rows is held
PAIRS_PER_TASK = 128
PAIRS_AT_ONCE = 1 << 20  # of a task, numbered in memory
BATCH_BYTES = 64 << 20
SCREEN_BYTES = 128 << 20  # of a cell's rows as a matrix, for fits in the weights
NARROW = 32  # features up to which a fit is solved in its weights
TOLERANCE = 1e-10
STEPS, DEPTH = 60, 8  # of the mixed iteration


class DenseRows:
    """A cell's rows around their mean."""

    def __init__(self, x: np.ndarray):
        self.x = x - x.mean(axis=0)
        self.n, self.d = x.shape
        self.total = self.x.sum(axis=0)
        self.squares = (self.x * self.x).sum(axis=0)
        self.entries = self.n + self.d

    def times(self, u: np.ndarray) -> np.ndarray:
        return self.x @ u

    def back(self, v: np.ndarray) -> np.ndarray:
        return self.x.T @ v

    def pick(self, i: np.ndarray) -> np.ndarray:
        return self.x[i].T


class SparseRows:
    """A cell's rows as entries; columns without an entry in any row are left out, for no fit can see them."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int):
        names, column = np.unique(column, return_inverse=True)
        order = np.lexsort((column, row))
        self.row, self.column, self.value = row[order], column[order], value[order]
        self.n, self.d = n, max(1, len(names))
        self.ends = np.searchsorted(self.row, np.arange(n + 1))
        self.by_column = np.argsort(self.column, kind="stable")
        self.total = np.bincount(self.column, self.value, self.d)
        self.squares = np.bincount(self.column, self.value ** 2, self.d)
        self.entries = len(value) + self.n + self.d

    def times(self, u: np.ndarray) -> np.ndarray:
        return _sums(u[self.column] * self.value[:, None], self.row, self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        at = self.by_column
        return _sums(v[self.row[at]] * self.value[at][:, None], self.column[at], self.d)

    def pick(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((self.d, len(i)))
        for k, r in enumerate(i.tolist()):
            own = slice(self.ends[r], self.ends[r + 1])
            out[self.column[own], k] = self.value[own]
        return out


def _sums(parts: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive rows with the same key."""
    out = np.zeros((n, parts.shape[1]))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    if len(first):
        out[key[first]] = np.add.reduceat(parts, first, axis=0)
    return out


class Scaled:
    """The products Z Z' v of many fits at once: fit p keeps all rows but a[p] and b[p], and scales by those it keeps."""

    def __init__(self, rows, a: np.ndarray, b: np.ndarray):
        self.rows, m = rows, max(1, len(a))
        left = rows.n - 2 if len(a) else rows.n
        xa, xb = (rows.pick(a), rows.pick(b)) if len(a) else (np.zeros((rows.d, 1)), np.zeros((rows.d, 1)))
        self.gap = xa - xb
        self.mean = (rows.total[:, None] - xa - xb) / left
        var = (rows.squares[:, None] - xa * xa - xb * xb) / left - self.mean ** 2
        spread_ = rows.squares / rows.n - (rows.total / rows.n) ** 2
        self.inverse = 1.0 / np.where(var > 1e-12 * spread_[:, None], var, 1.0)
        self.keep = np.ones((rows.n, m))
        if len(a):
            self.keep[a, np.arange(m)] = 0.0
            self.keep[b, np.arange(m)] = 0.0

    def weights(self, v: np.ndarray) -> np.ndarray:
        """What Z' v gives for unscaled features."""
        return self.inverse * (self.rows.back(v) - self.mean * v.sum(axis=0))

    def times(self, v: np.ndarray) -> np.ndarray:
        h = self.weights(v)
        return self.rows.times(h) - (self.mean * h).sum(axis=0)


def _conjugate(product, condition, rhs: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solutions of many symmetric systems, column by column; `condition` does about what the inverse of each would."""
    r = rhs - product(x)
    z = condition(r)
    p, rz = z, (r * z).sum(axis=0)
    goal = TOLERANCE * np.maximum(np.sqrt((rhs * rhs).sum(axis=0)), 1e-300)
    for _ in range(4 * len(rhs) + 50):
        if (np.sqrt((r * r).sum(axis=0)) <= goal).all():
            break
        q = product(p)
        pq = (p * q).sum(axis=0)
        step = np.divide(rz, pq, out=np.zeros_like(rz), where=pq > 0)
        x, r = x + step * p, r - step * q
        z = condition(r)
        after = (r * z).sum(axis=0)
        p = z + np.divide(after, rz, out=np.zeros_like(rz), where=rz > 0) * p
        rz = after
    return x


def _loss(eta, y, keep, alpha, product, c):
    return c * (keep * (np.logaddexp(0.0, eta) - y * eta)).sum(axis=0) + 0.5 * (alpha * product).sum(axis=0)


def _curvature(eta: np.ndarray, y: np.ndarray, keep: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    mu = 0.5 * (1.0 + np.tanh(0.5 * eta))
    return c * keep * np.maximum(mu * (1.0 - mu), 1e-300), c * keep * (y - mu)


def _fits(scaled: Scaled, y: np.ndarray, c: float, alpha: np.ndarray, offset: np.ndarray, condition) -> tuple[np.ndarray, np.ndarray]:
    """Newton's method on many fits; w = Z' alpha, and alpha is zero for rows that a fit leaves out.

    `condition(root)` gives what does about the same as the inverse of I + root Z Z' root for each fit.
    """
    keep, y = scaled.keep, y[:, None]
    alpha = alpha * keep
    product = scaled.times(alpha)
    eta = product + offset
    current = _loss(eta, y, keep, alpha, product, c)
    ones = np.zeros_like(eta)
    for _ in range(60):
        curve, residual = _curvature(eta, y, keep, c)
        root = np.sqrt(curve)
        inverse = condition(root)

        def system(v, root=root):
            return v + root * scaled.times(root * v)
        safe = np.where(root > 0, root, 1.0)
        ones = _conjugate(system, inverse, root, ones)
        target = _conjugate(system, inverse, root * eta + residual / safe, alpha / safe)
        new_offset = (root * target).sum(axis=0) / (root * ones).sum(axis=0)
        new = root * (target - new_offset * ones)
        new_product = scaled.times(new)
        size = np.ones(eta.shape[1])
        for _ in range(30):
            mixed = [old + size * (fresh - old) for old, fresh in ((alpha, new), (product, new_product), (offset, new_offset))]
            trial = _loss(mixed[1] + mixed[2], y, keep, mixed[0], mixed[1], c)
            worse = trial > current + 1e-12 * np.abs(current)
            if not worse.any():
                break
            size[worse] *= 0.5
        moved = np.abs(keep * (mixed[1] + mixed[2] - eta)).max()
        alpha, product, offset = mixed
        eta, current = product + offset, trial
        if moved < 1e-9:
            break
    return alpha, offset


def _dual_gaps(rows, y: np.ndarray, pairs: np.ndarray, c: float) -> np.ndarray:
    """Decision value of the positive minus that of the negative, for every pair."""
    whole = Scaled(rows, np.zeros(0, int), np.zeros(0, int))
    gram = np.empty((rows.n, rows.n))
    step = max(1, int(BATCH_BYTES // (8 * (rows.entries + rows.d))))
    for i in range(0, rows.n, step):
        at = np.arange(i, min(i + step, rows.n))
        u = whole.inverse * (rows.pick(at) - whole.mean)
        gram[:, at] = rows.times(u) - (whole.mean * u).sum(axis=0)
    base = {}

    def of_all(root):
        base["inverse"] = np.linalg.inv(np.eye(rows.n) + root * gram * root[:, 0])
        return lambda v: base["inverse"] @ v
    alpha, offset = _fits(whole, y, c, np.zeros((rows.n, 1)), np.zeros(1), of_all)
    root = np.sqrt(_curvature(gram @ alpha + offset, y[:, None], np.ones((rows.n, 1)), c)[0])
    of_all(root)
    gaps = np.empty(len(pairs))
    step = max(1, int(BATCH_BYTES // (8 * (rows.entries + 4 * rows.d + 8 * rows.n))))
    for i in range(0, len(pairs), step):
        gaps[i:i + step] = _batch_gaps(rows, y, *pairs[i:i + step].T, c, base["inverse"], root, alpha, offset)
    return gaps


class Downdated:
    """Inverse matrices of I + root Z Z' root without the rows a[p] and b[p], from the one with all rows."""

    def __init__(self, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, keep: np.ndarray):
        self.inverse, self.a, self.b, self.keep, self.at = inverse, a, b, keep, np.arange(len(a))
        self.of_a, self.of_b = inverse[:, a], inverse[:, b]
        self.aa, self.bb, self.ab = inverse[a, a], inverse[b, b], inverse[a, b]

    def __call__(self, v: np.ndarray) -> np.ndarray:
        out = self.inverse @ v
        at_a, at_b = out[self.a, self.at], out[self.b, self.at]
        det = self.aa * self.bb - self.ab * self.ab
        out -= self.of_a * ((self.bb * at_a - self.ab * at_b) / det) + self.of_b * ((self.aa * at_b - self.ab * at_a) / det)
        return out * self.keep


class Mixed:
    """Anderson's mixing of a fixed-point iteration, for many at once: the next point from the last few and their steps."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.last, self.points, self.steps = None, [], []

    def next(self, point: np.ndarray, step: np.ndarray) -> np.ndarray:
        if self.last is not None:
            self.points = [*self.points, point - self.last[0]][-self.depth:]
            self.steps = [*self.steps, step - self.last[1]][-self.depth:]
        self.last = point, step
        if not self.steps:
            return point + step
        moved = np.stack(self.steps)
        square = np.einsum("inm,jnm->mij", moved, moved)
        square += 1e-14 * np.trace(square, axis1=1, axis2=2)[:, None, None] * np.eye(len(moved)) + 1e-300 * np.eye(len(moved))
        share = np.linalg.solve(square, np.einsum("inm,nm->mi", moved, step)[:, :, None])[:, :, 0]
        return point + step - np.einsum("mi,inm->nm", share, np.stack(self.points) + moved)


def _batch_gaps(rows, y, a, b, c, inverse, root, alpha, offset) -> np.ndarray:
    scaled = Scaled(rows, a, b)
    keep, truth, m = scaled.keep, y[:, None], len(a)
    near = Downdated(inverse, a, b, keep)
    mine = keep * root
    ones = near(mine)
    share = (mine * ones).sum(axis=0)
    start = np.repeat(offset, m)
    point = np.concatenate([np.repeat(alpha, m, axis=1) * keep / root, start[None]])  # alpha in units of its root, and offset
    mixed, eta = Mixed(), None
    for _ in range(STEPS):
        found, base = mine * point[:-1], point[-1]
        fresh = scaled.times(found) + base
        moved = np.full(m, np.inf) if eta is None else np.abs(keep * (fresh - eta)).max(axis=0)
        eta = fresh
        residual = _curvature(eta, truth, keep, c)[1] - found
        u = near(residual / root)
        shift = ((mine * u).sum(axis=0) + found.sum(axis=0)) / share
        step = np.concatenate([u - shift * ones, shift[None]])
        if (moved < TOLERANCE).all() or not np.isfinite(step).all():
            break
        point = mixed.next(point, step)
    open_ = ~(moved < TOLERANCE)
    gaps = (scaled.gap * scaled.weights(found)).sum(axis=0)
    if open_.any():
        a, b = a[open_], b[open_]
        scaled = Scaled(rows, a, b)
        near = Downdated(inverse, a, b, scaled.keep)
        found, _ = _fits(scaled, y, c, np.repeat(alpha, len(a), axis=1), np.repeat(offset, len(a)), lambda _: near)
        gaps[open_] = (scaled.gap * scaled.weights(found)).sum(axis=0)
    return gaps


def _newton(a: np.ndarray, y: np.ndarray, keep: np.ndarray, c: float, w: np.ndarray) -> np.ndarray:
    """Weights of many ridge-logistic problems: a (m, n, p) with a last column of ones, keep (m, n) 0/1, from `w` on."""
    ridge = np.r_[np.ones(a.shape[2] - 1), 0.0]

    def value(v):
        eta = np.einsum("mnp,mp->mn", a, v)
        return c * (keep * (np.logaddexp(0.0, eta) - y * eta)).sum(axis=1) + 0.5 * (ridge * v * v).sum(axis=1)

    current = value(w)
    for _ in range(60):
        mu = 0.5 * (1.0 + np.tanh(0.5 * np.einsum("mnp,mp->mn", a, w)))
        grad = c * np.einsum("mnp,mn->mp", a, keep * (mu - y)) + ridge * w
        weighted = a * (keep * mu * (1.0 - mu))[:, :, None]
        hess = c * np.matmul(weighted.transpose(0, 2, 1), a) + np.diag(ridge)
        step = -np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        size = np.ones((len(w), 1))
        for _ in range(30):
            trial = value(w + size * step)
            worse = trial > current + 1e-12 * np.abs(current)
            if not worse.any():
                break
            size[worse] *= 0.5
        w = w + size * step
        current = trial
        if np.abs(step).max() < 1e-9:
            break
    return w


def _primal_gaps(rows: DenseRows, y: np.ndarray, pairs: np.ndarray, c: float) -> np.ndarray:
    x, n, d = rows.x, rows.n, rows.d
    spread_ = rows.squares / n
    scale = np.sqrt(np.where(spread_ > 0, spread_, 1.0))
    whole = np.concatenate([x / scale, np.ones((n, 1))], axis=1)
    start = _newton(whole[None], y[None, :], np.ones((1, n)), c, np.zeros((1, d + 1)))
    gaps = np.empty(len(pairs))
    per_batch = max(1, int(BATCH_BYTES // (8 * n * (d + 1))))
    for i in range(0, len(pairs), per_batch):
        part = pairs[i:i + per_batch]
        at = np.arange(len(part))
        keep = np.ones((len(part), n))
        keep[at, part[:, 0]] = 0.0
        keep[at, part[:, 1]] = 0.0
        out = x[part]
        mean = -out.sum(axis=1) / (n - 2)
        var = (rows.squares - (out * out).sum(axis=1)) / (n - 2) - mean * mean
        scale = np.sqrt(np.where(var > 1e-12 * spread_, var, 1.0))
        a = np.concatenate([(x[None] - mean[:, None, :]) / scale[:, None, :], np.ones((len(part), n, 1))], axis=2)
        w = _newton(a, y[None, :], keep, c, np.repeat(start, len(part), axis=0))
        gaps[i:i + per_batch] = ((out[:, 0] - out[:, 1]) / scale * w[:, :-1]).sum(axis=1)
    return gaps


def _free_gaps(rows, y: np.ndarray, pairs: np.ndarray, c: float) -> np.ndarray:
    """As `_dual_gaps`, by products with the rows alone: for cells whose matrix of rows by rows is too large."""
    def plain(_):
        return lambda v: v
    alpha, offset = _fits(Scaled(rows, np.zeros(0, int), np.zeros(0, int)), y, c, np.zeros((rows.n, 1)), np.zeros(1), plain)
    gaps = np.empty(len(pairs))
    step = max(1, int(BATCH_BYTES // (8 * (rows.entries + 4 * rows.d + 8 * rows.n))))
    for i in range(0, len(pairs), step):
        a, b = pairs[i:i + step].T
        scaled = Scaled(rows, a, b)
        found, _ = _fits(scaled, y, c, np.repeat(alpha, len(a), axis=1), np.repeat(offset, len(a)), plain)
        gaps[i:i + step] = (scaled.gap * scaled.weights(found)).sum(axis=0)
    return gaps


class Screened:
    """Gaps of pairs within proven bounds, from one fit for each row of a pair's one side.

    In weights v of unscaled features a fit minimises F(v, b) = sum(s^2 v^2) / 2 + c * logloss, s being the spread of the
    rows kept: leaving out a row changes the penalty and one term of the loss. Let t minimise F without row i, g and K be
    the gradient at t without j too and the Hessian there without i. K' without both lies in (1 - low) K .. (1 + high) K.
    The logistic curvature of a row changes by a factor of at most exp(+-r) where its score moves by r, so the mean Hessian
    from t to the minimum lies in (1 - exp(-r)) / r .. (exp(r) - 1) / r of K'. With k = |g| |x| / (1 - low), lengths being
    those of the inverse of K and x the longest row, this gives 1 - exp(-r) <= k: a bound of r, and with it of the way
    from the step -g / K to the minimum.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float):
        self.y, self.c, self.n = y, c, len(x)
        x = x - x.mean(axis=0)
        self.spread = (x * x).mean(axis=0)
        self.unit = np.sqrt(np.where(self.spread > 0, self.spread, 1.0))
        self.x = np.concatenate([x / self.unit, np.ones((self.n, 1))], axis=1)
        self.total, self.squares = self.x[:, :-1].sum(axis=0), (self.x[:, :-1] ** 2).sum(axis=0)
        self.start = np.zeros(self.x.shape[1])
        self.start = self._fit(np.ones(self.n), self._penalty(np.zeros((1, len(self.unit))), np.zeros((1, len(self.unit))), self.n)[0])

    def _penalty(self, out: np.ndarray, out_squares: np.ndarray, left: int) -> np.ndarray:
        mean = (self.total - out) / left
        var = (self.squares - out_squares) / left - mean * mean
        return np.where(var > 1e-12 * (self.spread > 0), var, self.unit ** -2.0)

    def _value(self, w, keep, ridge):
        eta = self.x @ w
        return self.c * (keep * (np.logaddexp(0.0, eta) - self.y * eta)).sum() + 0.5 * (ridge * w * w).sum()

    def _slopes(self, w, keep, ridge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient, Hessian and each row's share of successes."""
        mu = 0.5 * (1.0 + np.tanh(0.5 * (self.x @ w)))
        grad = self.c * (self.x.T @ (keep * (mu - self.y))) + ridge * w
        return grad, self.c * (self.x.T @ (self.x * (keep * mu * (1.0 - mu))[:, None])) + np.diag(ridge), mu

    def _fit(self, keep: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        w, ridge = self.start, np.r_[penalty, 0.0]
        current = self._value(w, keep, ridge)
        for _ in range(60):
            grad, hess, _ = self._slopes(w, keep, ridge)
            step = -np.linalg.solve(hess, grad)
            for _ in range(30):
                trial = self._value(w + step, keep, ridge)
                if not trial > current + 1e-12 * abs(current):
                    break
                step = step * 0.5
            w, current = w + step, trial
            if np.abs(step).max() < 1e-8:
                break
        return w

    def gaps(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of row `i` less that of each of the others when both are left out, and bounds of the error."""
        keep = np.ones(self.n)
        keep[i] = 0.0
        own = self.x[i, :-1]
        penalty = self._penalty(own, own * own, self.n - 1)
        w = self._fit(keep, penalty)
        grad, hess, mu = self._slopes(w, keep, np.r_[penalty, 0.0])
        lower = np.linalg.inv(np.linalg.cholesky(hess))
        lengths = np.concatenate([((self.x[k:k + 65536] @ lower.T) ** 2).sum(axis=1) for k in range(0, self.n, 65536)])
        longest = np.sqrt(lengths.max())
        gap, error = np.empty(len(others)), np.empty(len(others))
        step = max(1, int(BATCH_BYTES // (64 * self.x.shape[1])))
        for k in range(0, len(others), step):
            j = others[k:k + step]
            theirs = self.x[j, :-1]
            change = self._penalty(own + theirs, own * own + theirs * theirs, self.n - 2) - penalty
            g = grad - self.c * (mu[j] - self.y[j])[:, None] * self.x[j]
            g[:, :-1] += change * w[:-1]
            share = change / penalty
            low = self.c * mu[j] * (1.0 - mu[j]) * lengths[j] + np.maximum(-share, 0.0).max(axis=1)
            high = np.maximum(share, 0.0).max(axis=1)
            z, u = g @ lower.T, (own - theirs) @ lower[:, :-1].T
            size, way = np.sqrt((z * z).sum(axis=1)), np.sqrt((u * u).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = size * longest / (1.0 - low)
                r = np.maximum(-np.log1p(-bound), 1e-12)
                most = np.maximum(r / -np.expm1(-r) / (1.0 - low) - 1.0, 1.0 - r / np.expm1(r) / (1.0 + high))
                sure = (low < 1.0) & (bound < 1.0)
            gap[k:k + step] = (own - theirs) @ w[:-1] - (u * z).sum(axis=1)
            # the last terms are for rounding; equal rows are a tie whatever the fit
            error[k:k + step] = np.where(way == 0, 0.0, np.where(sure, way * size * (most + 1e-6) + 1e-10, np.inf))
        return gap, error


def _screened_gaps(rows: DenseRows | SparseRows, y: np.ndarray, pairs: np.ndarray, c: float) -> np.ndarray:
    """Gaps whose signs are right: sure ones by their bounds, the others by refits."""
    x = rows.x if isinstance(rows, DenseRows) else rows.pick(np.arange(rows.n)).T
    fits, gaps, error = Screened(x, y, c), np.empty(len(pairs)), np.empty(len(pairs))
    side = int(len(np.unique(pairs[:, 1])) < len(np.unique(pairs[:, 0])))  # fewer fits
    order = np.argsort(pairs[:, side], kind="stable")
    found, first = np.unique(pairs[order, side], return_index=True)
    for i, at in zip(found.tolist(), np.split(order, first[1:])):
        gap, error[at] = fits.gaps(i, pairs[at, 1 - side])
        gaps[at] = -gap if side else gap
    gaps[error == 0] = 0.0
    open_ = ~(np.abs(gaps) > error) & (error > 0)
    if open_.any():
        gaps[open_] = _primal_gaps(DenseRows(x), y, pairs[open_], c)
    return gaps


def _method(rows: DenseRows | SparseRows):
    if rows.d < rows.n and 8 * rows.n * (rows.d + 1) <= SCREEN_BYTES:
        return _screened_gaps
    if isinstance(rows, DenseRows) and rows.d <= NARROW:
        return _primal_gaps
    return _dual_gaps if rows.n <= MAX_ROWS else _free_gaps


def pair_out_wins(rows: DenseRows | SparseRows, y: np.ndarray, pairs: np.ndarray, c: float) -> float:
    """Won pairs among `pairs` (row numbers of a positive and a negative); a tie is half a win."""
    if not len(pairs):
        return 0.0
    gap = _method(rows)(rows, y, pairs, c)
    tie = np.abs(gap) <= 1e-12
    return float(((gap > 0) & ~tie).sum() + 0.5 * tie.sum())


def _cell_rows(column: pa.ChunkedArray) -> DenseRows | SparseRows:
    if not pa.types.is_struct(column.type):
        return DenseRows(matrix(column))
    whole = column.combine_chunks()
    idx, val = whole.field("idx"), whole.field("val")
    row = np.repeat(np.arange(len(whole)), idx.value_lengths().to_numpy(zero_copy_only=False))
    return SparseRows(row, idx.flatten().to_numpy(), val.flatten().to_numpy(), len(whole))


def pair_out_auc(rows: DataFrame, cells: list[str], row_keys: list[str], label: str = "label", c: float = 0.01,
                 pairs_per_task: int = PAIRS_PER_TASK, max_rows: int | None = None) -> DataFrame:
    """AUC per cell over rows (cells, row_keys, label, vec); NULL unless each class has two rows.

    `vec` is an array, or for sparse rows a struct of `idx` (whole numbers) and `val` (arrays of equal length).
    The pairs of a cell are shared by at most twice as many tasks as there are cores for a cell, each with a copy of the
    cell's rows and one stretch of its pairs. With `max_rows` a cell of more labelled rows is refused, not shortened.
    """
    # usually pooled from a large table that should be read once
    rows = cut_lineage(rows.select(*cells, *row_keys, F.col(label).cast("int").alias("label"), "vec"))
    counts = rows.groupBy(*cells).agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    slots = max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // max(1, counts.count())))
    n_rows = F.col("n_pos") + F.col("n_neg")
    usable = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    tasks = F.least(F.lit(slots).cast("long"), F.expr(f"(n_pos * n_neg - 1) div {int(pairs_per_task)} + 1")).cast("int")
    if max_rows is not None:  # refused before any row is copied
        too_large = F.raise_error(F.concat(
            F.lit("a cell holds "), n_rows.cast("string"),
            F.lit(f" rows, more than {max_rows}: use the k-fold sweep"))).cast("int")
        tasks = F.when(n_rows > max_rows, too_large).otherwise(tasks)
    copies = rows.join(counts.where(usable).withColumn("_tasks", tasks), cells).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).select(
        *cells, "_block", "_tasks", *row_keys, "label", "vec")

    def block_wins(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in row_keys])
        x, y = _cell_rows(group.column("vec")), group.column("label").to_numpy().astype(float)
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        share, n_pairs = group.column("_tasks")[0].as_py(), len(pos) * len(neg)
        first, last = (n_pairs * (key[-1].as_py() + i) // share for i in (0, 1))
        few, many = (pos, neg) if len(pos) <= len(neg) else (neg, pos)  # a stretch has few rows of the smaller class
        won = 0.0
        for i in range(first, last, PAIRS_AT_ONCE):
            number = np.arange(i, min(i + PAIRS_AT_ONCE, last))
            sides = [few[number // len(many)], many[number % len(many)]]
            won += pair_out_wins(x, y, np.stack(sides if few is pos else sides[::-1], axis=1), c)
        return one_row(key[:-1], [*cells, "wins"], [pa.float64()], [won])

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in cells)
    wins = spread(copies, [*cells, "_block"]).groupBy(*cells, "_block").applyInArrow(
        block_wins, f"{types}, wins double").groupBy(*cells).agg(F.sum("wins").alias("wins"))
    return counts.join(wins, cells, "left").select(
        *cells, "n_pos", "n_neg", (F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def compare_cohorts(first: DataFrame, second: DataFrame, cells: list[str], threshold: float = 0.65) -> DataFrame:
    """Cells side by side in two halves of the questions; confirmed only if both reach the threshold."""
    both = first.select(*cells, F.col("auc").alias("auc_first")).join(
        second.select(*cells, F.col("auc").alias("auc_second")), cells)
    return both.withColumn("confirmed", F.coalesce(
        F.least("auc_first", "auc_second") >= threshold, F.lit(False)) & F.col("auc_first").isNotNull()
        & F.col("auc_second").isNotNull())
