"""Lasso and group-lasso paths: few columns in play, every column checked.

Minimises ``mean(w_i loss_i) + lambda * sum_k s_k ||beta_k||`` with a free intercept, for a
whole sequence of penalties at once.  A pass over the rows returns, for every penalty still
moving, the loss, the gradient of *all* columns and the curvature of the columns in play
only: those that the sequential strong rule names, those with a coefficient, and those whose
gradient broke the optimality conditions in an earlier pass.  The penalised quadratic of the
columns in play is solved on the driver by block coordinate descent.  So no matrix of all
columns by all columns is formed, and a solution is accepted only when its optimality
conditions hold for every column, whatever was screened.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.linear import _label_counts, balanced_class_weights, complete, sum_blocks


class NotSettled(ArithmeticError):
    """A penalty's optimality conditions did not hold after the allowed passes."""


#: Numbers of curvature that one pass may return from a task, over all penalties.
_PASS_NUMBERS = 8_000_000


def _residual(beta, grad, members, pen):
    """Largest violation of the optimality conditions, and each group's."""
    each = np.zeros(len(members))
    for k, (idx, p) in enumerate(zip(members, pen, strict=True)):
        size = np.linalg.norm(beta[idx])
        if size > 0:
            each[k] = np.linalg.norm(grad[idx] + p * beta[idx] / size)
        else:
            each[k] = max(0.0, np.linalg.norm(grad[idx]) - p)
    return max(abs(grad[0]), each.max(initial=0.0)), each


def _shrunk(h, c, pen):
    """Minimise 0.5 b'Hb - c'b + pen ||b|| for one block, by the norm of its solution."""
    if np.linalg.norm(c) <= pen:
        return np.zeros(len(c))
    values, turn = np.linalg.eigh(h)
    values, c = np.maximum(values, 1e-300), turn.T @ c
    if pen <= 0:
        return turn @ (c / values)
    # the norm t solves sum (c / (t * values + pen))**2 = 1; the sum falls in t
    low, high = 0.0, np.linalg.norm(c) / values[0]
    t = (np.linalg.norm(c) - pen) / values[-1]
    for _ in range(200):
        u = c / (t * values + pen)
        f = u @ u - 1
        low, high = (t, high) if f > 0 else (low, t)
        slope = -2 * np.sum(u * u * values / (t * values + pen))
        step = t - f / slope if slope else t
        new = step if low < step < high else (low + high) / 2
        if abs(new - t) <= 1e-15 * max(t, 1e-300):
            break
        t = new
    return turn @ (t * c / (t * values + pen))


def _quadratic(h, g, beta, blocks, pens, sweeps=2000):
    """Minimise 0.5 (b-beta)'H(b-beta) + g'(b-beta) + sum pen_k ||b_k|| block by block."""
    b, slope = beta.copy(), g.copy()  # slope: gradient of the smooth part at b
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    for _ in range(sweeps):
        moved = 0.0
        for idx, pen in zip(blocks, pens, strict=True):
            hk = h[np.ix_(idx, idx)]
            new = _shrunk(hk, hk @ b[idx] - slope[idx], pen)
            step = new - b[idx]
            if step.any():
                slope += h[:, idx] @ step
                b[idx] = new
                moved = max(moved, float(np.abs(step * scale[idx]).max()))
        if moved <= 1e-13 * max(1.0, float(np.abs(b * scale).max())):
            break
    return b


class _Fit:
    """One penalty: its coefficients, columns in play and last accepted point."""

    def __init__(self, pen, beta, play):
        self.pen, self.beta, self.play = pen, beta, set(play)
        self.step, self.best, self.known, self.done, self.residual = None, np.inf, beta, False, np.inf


def sparse_path(
    df: DataFrame, cols: list[str], label: str, task: str, penalties: list[float], groups: list[int] | None = None,
    sizes: bool = False, balanced: bool = False, tol: float = 1e-8, passes: int = 200,
) -> list[tuple[float, np.ndarray]]:
    """(intercept, coefficients) for every penalty, in the given order.

    ``groups`` gives each column's group (default: its own); ``sizes`` divides a group's penalty
    by the root of its size.  The loss is logistic, with balanced class weights on demand, or
    half the squared error.  Rows with a missing number take no part.  ``tol`` bounds the
    violation of the optimality conditions as a share of the largest gradient at zero.  Without
    rows all coefficients are zero.
    """
    d = len(cols)
    gid = np.arange(d) if groups is None else np.asarray(groups)
    members = [np.flatnonzero(gid == g) + 1 for g in dict.fromkeys(gid.tolist())]
    scale = np.array([1 / np.sqrt(len(m)) if sizes else 1.0 for m in members])
    rows = df.filter(complete([*cols, label]))
    means = rows.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double")), *[F.avg(F.col(f"`{c}`").cast("double")) for c in cols]).first()
    if not means[0]:
        return [(0.0, np.zeros(d)) for _ in penalties]
    n, middle, origin = means[0], means[1], np.array(means[2:], float)
    weights = balanced_class_weights({y: c for (_, y), c in _label_counts(df, cols, label, None).items()}) if balanced else {}
    logistic = task == "classification"

    def derivatives(fits: list[_Fit], curved: bool = True):
        """Loss, gradient of all columns and curvature of those in play, of every fit."""
        beta = np.stack([f.beta for f in fits], 1)
        play = [np.concatenate([[0], *[members[k] for k in sorted(f.play)]]).astype(int) for f in fits]

        def kernel(x, y, _w, _f):
            z = np.hstack([np.ones((len(x), 1)), x - origin])
            m = z @ beta
            w = np.where(y > 0.5, weights.get(1.0, 1.0), weights.get(0.0, 1.0))[:, None] if weights else np.ones((len(y), 1))
            if logistic:
                p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                loss = (w * (np.logaddexp(0, m) - y[:, None] * m)).sum(0)
                r, h = w * (p - y[:, None]), w * p * (1 - p)
            else:
                r, h = w * (m - y[:, None]), np.broadcast_to(w, m.shape)
                loss = 0.5 * (r * (m - y[:, None])).sum(0)
            grad = z.T @ r
            for i, idx in enumerate(play):
                yield 2 * i, np.concatenate([[loss[i]], grad[:, i]])
                if curved:
                    zi = z[:, idx]
                    yield 2 * i + 1, (zi * h[:, [i]]).T @ zi

        sums = sum_blocks(rows, cols, label, kernel)
        for i, idx in enumerate(play):
            a = len(idx)
            yield sums[2 * i][0] / n, sums[2 * i][1:] / n, idx, sums[2 * i + 1].reshape(a, a) / n if curved else None

    start = np.zeros(d + 1)
    if logistic:
        share = weights.get(1.0, 1.0) * middle
        share = share / (share + weights.get(0.0, 1.0) * (1 - middle))
        start[0] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6))
    else:
        start[0] = middle
    ((_, zero, _, _),) = derivatives([_Fit(scale, start, [])], curved=False)
    norms = np.array([np.linalg.norm(zero[m]) for m in members])
    bound = tol * max(1e-12, norms.max(initial=0.0))
    top = float((norms / scale).max(initial=0.0))

    order = np.argsort([-p for p in penalties], kind="stable")
    out: list = [None] * len(penalties)
    before, point = top, start
    waiting = list(order)
    while waiting:
        # penalties that move together: as many as their curvature leaves room for
        batch, room = [], _PASS_NUMBERS
        while waiting:
            lam = float(penalties[waiting[0]])
            play = set(np.flatnonzero(norms >= scale * (2 * lam - before))) | {k for k, m in enumerate(members) if point[m].any()}
            need = (1 + sum(len(members[k]) for k in play)) ** 2
            if batch and need > room:
                break
            room -= need
            before = lam
            batch.append((waiting.pop(0), _Fit(lam * scale, point.copy(), play)))
        fits = [f for _, f in batch]
        for _ in range(passes):
            moving = [f for f in fits if not f.done]
            if not moving:
                break
            for fit, (loss, grad, idx, h) in zip(moving, derivatives(moving), strict=True):
                _advance(fit, loss, grad, idx, h, members, bound)
        for i, fit in batch:
            if not fit.done:
                raise NotSettled(f"penalty {penalties[i]}: optimality conditions off by {fit.residual:.1e} after {passes} passes")
            w = fit.known[1:]
            out[i] = (float(fit.known[0] - w @ origin), w)
        point = fits[-1].known
    return out


def _advance(fit: _Fit, loss, grad, idx, h, members, bound):
    """Judge the point that was evaluated, then move on."""
    objective = loss + sum(p * np.linalg.norm(fit.beta[m]) for m, p in zip(members, fit.pen, strict=True))
    if fit.step is not None and objective > fit.best + 1e-12 * max(1.0, abs(fit.best)):
        fit.step = fit.step / 2
        fit.beta = fit.known + fit.step
        return
    fit.best, fit.known = objective, fit.beta
    fit.residual, each = _residual(fit.beta, grad, members, fit.pen)
    if fit.residual <= bound:
        fit.done = True
        return
    added = {int(k) for k in np.flatnonzero(each > bound)} - fit.play
    fit.play |= added
    inside = sorted(k for k in fit.play if k not in added)
    where = {int(c): i for i, c in enumerate(idx)}
    blocks = [np.array([0]), *[np.array([where[int(c)] for c in members[k]]) for k in inside]]
    pens = [0.0, *[fit.pen[k] for k in inside]]
    new = fit.beta.copy()
    new[idx] = _quadratic(h + 1e-14 * np.diag(np.diag(h)), grad[idx], fit.beta[idx], blocks, pens)
    fit.step = new - fit.beta
    if not fit.step.any():  # the columns in play are settled; only new ones can move
        fit.step = None
    fit.beta = new
