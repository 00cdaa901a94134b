"""Gaussian hidden Markov models of sessions of any length: Baum-Welch and the most probable path by scans over chunks.

A chunk acts on the distribution of states as one matrix, the product of its samples' transitions and likelihoods. A first pass makes
these matrices, a scan of them for each session (one small matrix a chunk) gives what comes in from the left and from the right, and a second pass
does the rest inside of each chunk. The path is found in the same way with maxima in place of sums. Inside a chunk the same two steps
run over rows of about the square root of its samples, so numpy works on many samples at once.

Sums for the new model are added by Spark; a round ends when no session's likelihood grows by `tol` any more. Sessions of
one chunk are fitted by one task each, in the same two steps, many sessions at once (class _Many).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save
from . import chunks as ch

#: Least variance, and what keeps likelihoods above zero.
LEAST_VARIANCE = 1e-6
TINY = 1e-300
KINDS = ("full", "diag", "spherical", "tied")
#: Samples of the short sessions that are fitted at once, filled up ones included.
AT_ONCE = 1 << 15


class Model:
    """start (k), move (k, k), mean (k, d) and cov (k, d, d), to and from one array."""

    def __init__(self, start: np.ndarray, move: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.start, self.move, self.mean, self.cov = start, move, mean, cov

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.move.ravel(), self.mean.ravel(), self.cov.ravel()])

    @staticmethod
    def of(flat: np.ndarray, k: int, d: int) -> Model:
        a, b, c = np.split(np.asarray(flat, float), np.cumsum([k, k * k, k * d]))[:3]
        return Model(a, b.reshape(k, k), c.reshape(k, d), np.asarray(flat[k + k * k + k * d :], float).reshape(k, d, d))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(n, k): log density of each sample in each state."""
        out = np.empty((len(x), len(self.mean)))
        for j, (m, c) in enumerate(zip(self.mean, self.cov)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, j] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out


def _steps(a: np.ndarray, fill: float) -> tuple[np.ndarray, int]:
    """a (n, k) as (steps, rows, k), rows of consecutive samples, filled up at the end."""
    n = len(a)
    steps = max(1, int(np.ceil(np.sqrt(n))))
    rows = -(-n // steps)
    wide = np.full((rows * steps, a.shape[1]), fill)
    wide[:n] = a
    return wide.reshape(rows, steps, -1).transpose(1, 0, 2), n


def _first(model: Model) -> np.ndarray:
    """What stands for the transition into the first sample: each row is the start."""
    return np.tile(model.start, (len(model.start), 1))


def _products(like: np.ndarray, move: np.ndarray, into: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(product of each row's steps with rows scaled to sum one in total, log of the scales). `into` is the first transition of all."""
    steps, rows, k = like.shape
    out, log = np.tile(np.eye(k), (rows, 1, 1)), np.zeros(rows)
    live = np.arange(rows) * steps
    for s in range(steps):
        step = out @ move
        if s == 0:
            step[0] = out[0] @ into
        step = step * like[s][:, None, :]
        step = np.where((live + s < n)[:, None, None], step, out)
        scale = step.sum(axis=(1, 2))
        out, log = step / scale[:, None, None], log + np.log(scale)
    return out, log


def chunk_matrix(model: Model, x: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """The matrix of a chunk, scaled, and the log of its scale."""
    logs = model.log_density(x)
    top = logs.max(axis=1)
    like, n = _steps(np.exp(logs - top[:, None]) + TINY, 1.0)
    parts, log = _products(like, model.move, _first(model) if first else model.move, n)
    out, total = parts[0], float(log.sum() + top.sum())
    for p in parts[1:]:
        out = out @ p
        scale = out.sum()
        out, total = out / scale, total + np.log(scale)
    return out, total


def chunk_sums(model: Model, x: np.ndarray, first: bool, left: np.ndarray, right: np.ndarray, posterior: bool = False) -> np.ndarray:
    """Sums for the new model from a chunk, given the distribution before it and the likelihood of what follows.

    In order: the first sample's states (only in a first chunk), transitions, weights, weighted samples and their products. With
    `posterior` the states' probabilities of each sample instead.
    """
    k, d = model.mean.shape
    logs = model.log_density(x)
    like, n = _steps(np.exp(logs - logs.max(axis=1)[:, None]) + TINY, 1.0)
    steps, rows, _ = like.shape
    into = _first(model) if first else model.move
    parts, _ = _products(like, model.move, into, n)
    before, after = np.empty((rows, k)), np.empty((rows, k))
    a, b = left / left.sum(), right / right.sum()
    for r in range(rows):
        before[r] = a
        a = a @ parts[r]
        a = a / a.sum()
    for r in reversed(range(rows)):
        after[r] = b
        b = parts[r] @ b
        b = b / b.sum()
    live = (np.arange(rows) * steps)[:, None] + np.arange(steps)[None, :] < n
    alpha, a = np.empty((steps + 1, rows, k)), before
    alpha[0] = a
    for s in range(steps):
        step = a @ model.move
        if s == 0:
            step[0] = a[0] @ into
        step = step * like[s]
        step = np.where(live[:, s, None], step / step.sum(axis=1, keepdims=True), a)
        a = alpha[s + 1] = step
    beta, b = np.empty((steps, rows, k)), after
    for s in reversed(range(steps)):
        beta[s] = b
        step = (like[s] * b) @ model.move.T
        if s == 0:
            step[0] = into @ (like[0, 0] * b[0])
        b = np.where(live[:, s, None], step / step.sum(axis=1, keepdims=True), b)
    gamma = alpha[1:] * beta
    gamma = (gamma / gamma.sum(axis=2, keepdims=True)).transpose(1, 0, 2).reshape(-1, k)[:n]
    if posterior:
        return gamma
    pair = np.zeros((k, k))
    for s in range(steps):
        some = np.flatnonzero(live[:, s])
        some = some[some > 0] if first and s == 0 else some
        joint = alpha[s, some][:, :, None] * model.move * (like[s, some] * beta[s, some])[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    head = gamma[0] if first else np.zeros(k)
    return np.concatenate([head, pair.ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), np.einsum("nk,ni,nj->kij", gamma, x, x).ravel()])


def new_model(sums: np.ndarray, k: int, d: int, kind: str, old: Model | None = None) -> Model:
    """The model of the sums of all chunks; states without weight keep their old values, and with `old` so do means and variances of all."""
    head, pair, weight, first, second = np.split(sums, np.cumsum([k, k * k, k, k * d]))
    pair, first, second = pair.reshape(k, k), first.reshape(k, d), second.reshape(k, d, d)
    move = pair / np.maximum(pair.sum(axis=1, keepdims=True), TINY)
    move = np.where(pair.sum(axis=1, keepdims=True) > 0, move, 1 / k)
    start = head / head.sum() if head.sum() > 0 else np.full(k, 1 / k)
    if old is not None:
        return Model(start, move, old.mean, old.cov)
    w = np.maximum(weight, 1e-12)
    mean = first / w[:, None]
    cov = second / w[:, None, None] - mean[:, :, None] * mean[:, None, :]
    floor = np.eye(d) * LEAST_VARIANCE
    if kind == "tied":
        cov = np.tile((cov * w[:, None, None]).sum(axis=0) / w.sum(), (k, 1, 1))
    if kind == "diag":
        cov = cov * np.eye(d)
    if kind == "spherical":
        cov = np.trace(cov, axis1=1, axis2=2)[:, None, None] / d * np.eye(d)
    low = np.linalg.eigvalsh(cov).min(axis=1)
    return Model(start, move, mean, cov + floor + np.maximum(0.0, -low)[:, None, None] * np.eye(d))


def _starting(sums: np.ndarray, k: int, d: int, kind: str) -> Model:
    """From weights and moments of a first grouping."""
    move = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    made = new_model(np.concatenate([np.full(k, 1 / k), np.zeros(k * k), sums]), k, d, kind)
    return Model(np.full(k, 1 / k), move, made.mean, made.cov + 1e-3 * np.eye(d))


def _moments(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    one = np.eye(k)[group]
    return np.concatenate([one.sum(axis=0), (one.T @ x).ravel(), np.einsum("nk,ni,nj->kij", one, x, x).ravel()])


def fit_local(x: np.ndarray, k: int, kind: str = "full", iterations: int = 30, tol: float = 1e-2, update: bool = True) -> tuple[Model, float, int]:
    """(model, log likelihood, rounds) of one series by Baum-Welch, from groups by quantiles of the first feature."""
    d = x.shape[1]
    cut = np.quantile(x[:, 0], np.arange(1, k) / k, method="inverted_cdf")
    model = _starting(_moments(x, np.searchsorted(cut, x[:, 0], side="right"), k), k, d, kind)
    before = -np.inf
    for i in range(1, iterations + 1):
        matrix, log = chunk_matrix(model, x, True)
        like = log + float(np.log((np.full(k, 1 / k) @ matrix).sum()))
        if like - before < tol:
            break
        before = like
        model = new_model(chunk_sums(model, x, True, np.full(k, 1 / k), np.ones(k)), k, d, kind, None if update else model)
    return model, like, i


def chunk_best(model: Model, x: np.ndarray, first: bool) -> np.ndarray:
    """Log score of the best path through a chunk, from each state before it to each at its end."""
    parts = _best_rows(*_logs(model, x), _log(_first(model) if first else model.move))
    out = parts[0]
    for p in parts[1:]:
        out = (out[:, :, None] + p[None]).max(axis=1)
    return out


def _log(a: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(a, TINY))


def _logs(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    like, n = _steps(model.log_density(x), 0.0)
    return like, _log(model.move), n


def _best_rows(like: np.ndarray, move: np.ndarray, n: int, into: np.ndarray) -> np.ndarray:
    steps, rows, k = like.shape
    out = np.tile(np.where(np.eye(k) > 0, 0.0, -1e300), (rows, 1, 1))
    live = np.arange(rows) * steps
    for s in range(steps):
        step = (out[:, :, :, None] + move).max(axis=2)
        if s == 0:
            step[0] = (out[0][:, :, None] + into).max(axis=1)
        out = np.where((live + s < n)[:, None, None], step + like[s][:, None, :], out)
    return out


def chunk_path(model: Model, x: np.ndarray, first: bool, left: np.ndarray, end: int) -> np.ndarray:
    """The states of the best path through a chunk, given log scores of the states before it and its last state."""
    like, move, n = _logs(model, x)
    into = _log(_first(model) if first else model.move)
    steps, rows, k = like.shape
    parts = _best_rows(like, move, n, into)
    scores = [left]
    for r in range(rows):
        scores.append((scores[-1][:, None] + parts[r]).max(axis=0))
    ends = np.empty(rows, int)
    at = end
    for r in reversed(range(rows)):
        ends[r] = at
        at = int(np.argmax(scores[r] + parts[r][:, at]))
    begin = np.where(np.eye(k)[np.concatenate([[at], ends[:-1]])] > 0, 0.0, -1e300)
    begin[0] = left
    live = (np.arange(rows) * steps)[:, None] + np.arange(steps)[None, :] < n
    back, score = np.empty((steps, rows, k), int), begin
    for s in range(steps):
        every = score[:, :, None] + move
        if s == 0:
            every[0] = score[0][:, None] + into
        best = every.argmax(axis=1)
        back[s] = np.where(live[:, s, None], best, np.arange(k))
        score = np.where(live[:, s, None], np.take_along_axis(every, best[:, None, :], axis=1)[:, 0] + like[s], score)
    out, at = np.empty((steps, rows), int), ends
    for s in reversed(range(steps)):
        out[s] = at
        at = back[s][np.arange(rows), at]
    return out.T.reshape(-1)[:n]


def path_local(model: Model, x: np.ndarray) -> np.ndarray:
    none = np.zeros(len(model.start))
    return chunk_path(model, x, True, none, int(chunk_best(model, x, True)[0].argmax()))


class _Many:
    """Baum-Welch and best paths of several series of one chunk at once; each has a model and an end of its own.

    Arrays are (series, ...), and samples lie as (series, rows, steps) with rows of consecutive ones. Shorter series are filled up, which `live` marks.
    """

    def __init__(self, xs: Sequence[np.ndarray], k: int, kind: str):
        self.k, self.d, self.kind = k, xs[0].shape[1], kind
        self.n = np.array([len(x) for x in xs])
        most = int(self.n.max())
        self.steps = max(1, int(np.ceil(np.sqrt(most))))
        self.rows = -(-most // self.steps)
        self.x = np.zeros((len(xs), self.rows * self.steps, self.d))
        for i, x in enumerate(xs):
            self.x[i, : len(x)] = x
        self._mark()

    def _mark(self) -> None:
        self.on = np.arange(self.x.shape[1]) < self.n[:, None]
        self.live = self.on.reshape(len(self.n), self.rows, self.steps)

    def _some(self, which: np.ndarray) -> _Many:
        out = object.__new__(_Many)
        out.k, out.d, out.kind, out.steps, out.rows = self.k, self.d, self.kind, self.steps, self.rows
        out.n, out.x = self.n[which], self.x[which]
        out._mark()
        return out

    def _moments(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return weight.sum(axis=1), np.einsum("snk,sni->ski", weight, self.x), np.einsum("snk,sni,snj->skij", weight, self.x, self.x)

    def _gauss(self, weight: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.maximum(weight, 1e-12)
        mean = first / w[..., None]
        cov = second / w[..., None, None] - mean[..., :, None] * mean[..., None, :]
        one = np.eye(self.d)
        if self.kind == "tied":
            cov = np.repeat(((cov * w[..., None, None]).sum(axis=1) / w.sum(axis=1)[:, None, None])[:, None], self.k, axis=1)
        if self.kind == "diag":
            cov = cov * one
        if self.kind == "spherical":
            cov = np.trace(cov, axis1=2, axis2=3)[..., None, None] / self.d * one
        low = np.linalg.eigvalsh(cov).min(axis=2)
        return mean, cov + one * LEAST_VARIANCE + np.maximum(0.0, -low)[..., None, None] * one

    def starting(self) -> list[np.ndarray]:
        """start, move, mean and cov from groups by quantiles of the first feature."""
        ordered = np.sort(np.where(self.on, self.x[:, :, 0], np.inf), axis=1)
        at = np.ceil(self.n[:, None] * (np.arange(1, self.k) / self.k) - 1).astype(int).clip(0, self.n[:, None] - 1)
        cut = np.take_along_axis(ordered, at, axis=1)
        group = (cut[:, None, :] <= self.x[:, :, :1]).sum(axis=2)
        mean, cov = self._gauss(*self._moments(np.eye(self.k)[group] * self.on[:, :, None]))
        move = np.full((self.k, self.k), 0.1 / max(1, self.k - 1))
        np.fill_diagonal(move, 0.9 if self.k > 1 else 1.0)
        s = len(self.n)
        return [np.full((s, self.k), 1 / self.k), np.tile(move, (s, 1, 1)), mean, cov + 1e-3 * np.eye(self.d)]

    def _density(self, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """(series, samples, k): log density of each sample in each state."""
        root = np.linalg.cholesky(cov)
        z = np.linalg.solve(root, (self.x[:, None] - mean[:, :, None]).transpose(0, 1, 3, 2))
        scale = np.log(np.diagonal(root, axis1=2, axis2=3)).sum(axis=2)
        return (-0.5 * (z * z).sum(axis=2) - scale[..., None] - 0.5 * self.d * np.log(2 * np.pi)).transpose(0, 2, 1)

    def _by_step(self, a: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(a.reshape(len(self.n), self.rows, self.steps, -1).transpose(2, 0, 1, 3))

    def _round(self, model: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        """(log likelihood of each series, what sums() needs)."""
        start, move, mean, cov = model
        logs = self._density(mean, cov)
        top = logs.max(axis=2)
        like = self._by_step(np.where(self.on[:, :, None], np.exp(logs - top[:, :, None]) + TINY, 1.0))
        series, k = len(self.n), self.k
        out, log = np.tile(np.eye(k), (series, self.rows, 1, 1)), np.zeros((series, self.rows))
        into = np.repeat(start[:, None, :], k, axis=1)
        for s in range(self.steps):
            step = out @ move[:, None]
            if s == 0:
                step[:, 0] = out[:, 0] @ into
            step = step * like[s][:, :, None, :]
            scale = step.sum(axis=(2, 3))
            on = self.live[:, :, s]
            out = np.where(on[..., None, None], step / scale[..., None, None], out)
            log += np.where(on, np.log(scale), 0.0)
        whole, total = out[:, 0], log.sum(axis=1) + np.where(self.on, top, 0.0).sum(axis=1)
        for r in range(1, self.rows):
            step = whole @ out[:, r]
            scale = step.sum(axis=(1, 2))
            on = self.live[:, r, 0]
            whole = np.where(on[:, None, None], step / scale[:, None, None], whole)
            total += np.where(on, np.log(scale), 0.0)
        return total + np.log(whole.sum(axis=(1, 2)) / k), (like, out, into)

    def _better(self, model: list[np.ndarray], like: np.ndarray, parts: np.ndarray, into: np.ndarray, update: bool) -> list[np.ndarray]:
        """The model of the next round."""
        _, move, mean, cov = model
        series, k, steps, rows = len(self.n), self.k, self.steps, self.rows
        before, after = np.empty((series, rows, k)), np.empty((series, rows, k))
        a, b = np.full((series, k), 1 / k), np.full((series, k), 1 / k)
        for r in range(rows):
            before[:, r] = a
            step = (a[:, None] @ parts[:, r])[:, 0]
            a = np.where(self.live[:, r, :1], step / step.sum(axis=1, keepdims=True), a)
        for r in reversed(range(rows)):
            after[:, r] = b
            step = (parts[:, r] @ b[..., None])[..., 0]
            b = np.where(self.live[:, r, :1], step / step.sum(axis=1, keepdims=True), b)
        alpha, a = np.empty((steps + 1, series, rows, k)), before
        alpha[0] = a
        for s in range(steps):
            step = a @ move
            if s == 0:
                step[:, 0] = (a[:, 0, None] @ into)[:, 0]
            step = step * like[s]
            a = alpha[s + 1] = np.where(self.live[:, :, s, None], step / step.sum(axis=2, keepdims=True), a)
        beta, b = np.empty((steps, series, rows, k)), after
        back = move.transpose(0, 2, 1)
        for s in reversed(range(steps)):
            beta[s] = b
            weighted = like[s] * b
            step = weighted @ back
            if s == 0:
                step[:, 0] = (into @ weighted[:, 0, :, None])[..., 0]
            b = np.where(self.live[:, :, s, None], step / step.sum(axis=2, keepdims=True), b)
        gamma = alpha[1:] * beta
        gamma = (gamma / gamma.sum(axis=3, keepdims=True)).transpose(1, 2, 0, 3).reshape(series, -1, k) * self.on[:, :, None]
        pair = np.zeros((series, k, k))
        for s in range(steps):
            joint = alpha[s][..., :, None] * move[:, None] * (like[s] * beta[s])[..., None, :]
            on = self.live[:, :, s].copy()
            if s == 0:
                on[:, 0] = False
            pair += np.where(on[..., None, None], joint / np.maximum(joint.sum(axis=(2, 3), keepdims=True), TINY), 0.0).sum(axis=1)
        sums = pair.sum(axis=2, keepdims=True)
        head = gamma[:, 0]
        made = [head / head.sum(axis=1, keepdims=True), np.where(sums > 0, pair / np.maximum(sums, TINY), 1 / k)]
        return made + (list(self._gauss(*self._moments(gamma))) if update else [mean, cov])

    def fit(self, iterations: int, tol: float, update: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(model, log likelihood, rounds) of each series; a series leaves when its likelihood grows by less than tol."""
        model = self.starting()
        like, rounds = np.full(len(self.n), -np.inf), np.zeros(len(self.n), int)
        going = np.arange(len(self.n))
        part, own = self, model
        for i in range(1, iterations + 1):
            now, held = part._round(own)
            grows = ~(now - like[going] < tol)
            like[going], rounds[going] = now, i
            if not grows.any():
                break
            if not grows.all():
                going, part, own = going[grows], part._some(grows), [a[grows] for a in own]
                held = (held[0][:, grows], held[1][grows], held[2][grows])
            own = part._better(own, *held, update)
            for a, b in zip(model, own):
                a[going] = b
        return model, like, rounds

    def paths(self, model: list[np.ndarray]) -> list[np.ndarray]:
        """The states of the best path of each series."""
        start, move, mean, cov = model
        like, move, series, k = self._by_step(self._density(mean, cov)), _log(move), len(self.n), self.k
        into = np.repeat(_log(start)[:, None, :], k, axis=1)
        none = np.where(np.eye(k) > 0, 0.0, -1e300)
        parts = np.tile(none, (series, self.rows, 1, 1))
        for s in range(self.steps):
            step = (parts[..., None] + move[:, None, None]).max(axis=3)
            if s == 0:
                step[:, 0] = (parts[:, 0, :, :, None] + into[:, None]).max(axis=2)
            parts = np.where(self.live[:, :, s, None, None], step + like[s][:, :, None, :], parts)
        scores = [np.zeros((series, k))]
        for r in range(self.rows):
            scores.append(np.where(self.live[:, r, :1], (scores[-1][:, :, None] + parts[:, r]).max(axis=1), scores[-1]))
        every = np.arange(series)
        ends, at = np.empty((series, self.rows), int), scores[-1].argmax(axis=1)
        for r in reversed(range(self.rows)):
            ends[:, r] = at
            at = np.where(self.live[:, r, 0], (scores[r] + parts[every, r, :, at]).argmax(axis=1), at)
        score = none[np.concatenate([at[:, None], ends[:, :-1]], axis=1)]
        score[:, 0] = 0.0
        back = np.empty((self.steps, series, self.rows, k), int)
        for s in range(self.steps):
            step = score[..., None] + move[:, None]
            if s == 0:
                step[:, 0] = score[:, 0, :, None] + into
            best, on = step.argmax(axis=2), self.live[:, :, s, None]
            back[s] = np.where(on, best, np.arange(k))
            score = np.where(on, np.take_along_axis(step, best[:, :, None, :], axis=2)[:, :, 0] + like[s], score)
        out, at = np.empty((self.steps, series, self.rows), int), ends
        for s in reversed(range(self.steps)):
            out[s] = at
            at = np.take_along_axis(back[s], at[..., None], axis=2)[..., 0]
        flat = out.transpose(1, 2, 0).reshape(series, -1)
        return [flat[i, :n] for i, n in enumerate(self.n)]


def _together(sizes: Sequence[int]) -> list[list[int]]:
    """Numbers of series in groups of similar lengths that take AT_ONCE samples at most when filled up, or are one series."""
    out: list[list[int]] = []
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        if out and (len(out[-1]) + 1) * sizes[out[-1][0]] <= AT_ONCE:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _x(row: dict, features: Sequence[str]) -> np.ndarray:
    return np.stack([np.asarray(row[f], float) for f in features], axis=1)


def gauss_hmm(
    samples: DataFrame, states: int, by: Sequence[str] = ("session",), features: Sequence[str] = ("value",), idx: str = "idx",
    kind: str = "full", iterations: int = 30, tol: float = 1e-2, update: bool = True, chunk: int = ch.CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(states, models) of samples (by, idx, features): the most probable path and the model of each session.

    states: (by, idx, state). models: (by, start, move, mean, cov, log_likelihood, rounds) with flattened arrays. States are numbered by the mean of the first
    feature. `kind` is that of the covariances: full, diag, spherical or tied. Without `update` means and covariances stay as they start, by
    groups of equal size in the first feature. Rows with a null or NaN feature are left out; sessions of fewer than twice as many rows as
    states have state 0 and no model.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    by, features, k, d = list(by), list(features), states, len(features)
    rows = samples.select(*by, F.col(idx).alias("idx"), *(F.col(f).cast("double").alias(f) for f in features)).dropna(subset=features)
    for f in features:
        rows = rows.where(~F.isnan(f))
    packed = ch.pack(rows, by, features, chunk=chunk)
    sizes = packed.groupBy(*by).agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_last"), F.sum("n").alias("_n"))
    packed = packed.join(sizes, by)
    local = packed.where("_first = _last")
    many = packed.where("_first < _last")
    kept = ch.keys(packed, by)

    def number(model: Model) -> np.ndarray:
        return np.argsort(np.argsort(model.mean[:, 0], kind="stable"), kind="stable")

    def sorted_flat(model: Model) -> list[float]:
        o = np.argsort(model.mean[:, 0], kind="stable")
        return Model(model.start[o], model.move[o][:, o], model.mean[o], model.cov[o]).flat().tolist()

    names = [*by, "idx", "state", "model", "log_likelihood", "rounds"]

    def fitted(batches):
        for batch in batches:
            xs = [_x({f: batch[f].iat[i] for f in features}, features) for i in range(len(batch))]
            enough = [i for i, x in enumerate(xs) if len(x) >= 2 * k]
            groups = [[enough[j] for j in group] for group in _together([len(xs[i]) for i in enough])]
            short = [i for i, x in enumerate(xs) if len(x) < 2 * k]
            for group in groups + [short] * bool(short):
                out = batch[[*by, "idx"]].iloc[group]
                if group is short:
                    yield out.assign(state=[[0] * len(xs[i]) for i in group], model=None, log_likelihood=None, rounds=0)[names]
                    continue
                many_ = _Many([xs[i] for i in group], k, kind)
                found, like, rounds = many_.fit(iterations, tol, update)
                models = [Model(*parts) for parts in zip(*found)]
                states_ = [number(m)[p].tolist() for m, p in zip(models, many_.paths(found))]
                yield out.assign(state=states_, model=[sorted_flat(m) for m in models], log_likelihood=like, rounds=rounds)[names]

    idx_type = packed.schema["idx"].dataType.simpleString()
    # Few bytes are much work here: Spark would join small partitions to a handful of tasks.
    spread = max(4 * samples.sparkSession.sparkContext.defaultParallelism, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = save(local.repartition(spread, *by).mapInPandas(fitted, f"{kept}, `idx` {idx_type}, state array<int>, model array<double>, log_likelihood double, rounds int"))
    if many.limit(1).count():
        done = done.unionByName(_fit_many(many.repartition(spread, *by, "bucket"), by, features, k, d, kind, iterations, tol, update, number, sorted_flat, kept, idx_type))
    models = done.where("model IS NOT NULL")
    cut = lambda a, n: F.slice("model", F.lit(a + 1), F.lit(n))
    models = models.select(
        *by, cut(0, k).alias("start"), cut(k, k * k).alias("move"), cut(k + k * k, k * d).alias("mean"), cut(k + k * k + k * d, k * d * d).alias("cov"), "log_likelihood", "rounds"
    ).dropDuplicates(by)
    return ch.unpack(done, by, ["state"]), models


def _fit_many(many, by, features, k, d, kind, iterations, tol, update, number, sorted_flat, kept, idx_type) -> DataFrame:
    """Sessions of several chunks: (by, idx, state, model, log_likelihood, rounds) a chunk."""
    on = [*by, "bucket"]
    flat = ch.unpack(many, by, features)
    cuts = flat.groupBy(*by).agg(F.percentile_approx(features[0], [i / k for i in range(1, k)] or [0.5], 10_000).alias("_cut"))
    many = save(ch.meet(many, cuts, by).withColumn("first", F.col("bucket") == F.col("_first")))

    def begin(row: dict) -> dict:
        x = _x(row, features)
        return {"sums": _moments(x, np.searchsorted(np.asarray(row["_cut"])[: k - 1], x[:, 0], side="right"), k).tolist()}

    def add(make):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            return make(np.sum(np.stack(group["sums"].map(np.asarray).to_list()), axis=0), group)

        return run

    first = ch.each(many, begin, f"{kept}, bucket long, sums array<double>")
    models = ch.scan(first, by, add(lambda s, g: pd.DataFrame({"model": [_starting(s, k, d, kind).flat()], "log_likelihood": [-np.inf], "rounds": [0], "open": [True]})), "model array<double>, log_likelihood double, rounds int, open boolean")

    def matrix(row: dict) -> dict:
        m, log = chunk_matrix(Model.of(row["model"], k, d), _x(row, features), row["first"])
        return {"m": m.ravel().tolist(), "log": log}

    def sides(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(m).reshape(k, k) for m in group["m"]]
        a, like, left = np.full(k, 1 / k), float(group["log"].sum()), []
        for p in parts:
            left.append(a)
            a = a @ p
            like, a = like + np.log(a.sum()), a / a.sum()
        b, right = np.ones(k), []
        for p in reversed(parts):
            right.append(b)
            b = p @ b
            b = b / b.sum()
        return pd.DataFrame({"bucket": group["bucket"], "left": left, "right": right[::-1], "like": like})

    def sums(row: dict) -> dict:
        return {"sums": chunk_sums(Model.of(row["model"], k, d), _x(row, features), row["first"], np.asarray(row["left"]), np.asarray(row["right"])).tolist()}

    def step(s: np.ndarray, g: pd.DataFrame) -> pd.DataFrame:
        old, like, was = Model.of(g["model"].iloc[0], k, d), float(g["like"].iloc[0]), float(g["log_likelihood"].iloc[0])
        grows = like - was >= tol
        model = new_model(s, k, d, kind, None if update else old) if grows else old
        return pd.DataFrame({"model": [model.flat()], "log_likelihood": [like], "rounds": [int(g["rounds"].iloc[0]) + 1], "open": [grows]})

    ended = None
    for i in range(iterations):
        going = models.where("open")
        data = ch.meet(many, going, by)
        edges = ch.scan(ch.each(data, matrix, f"{kept}, bucket long, m array<double>, log double"), by, sides, "bucket long, left array<double>, right array<double>, like double")
        each = ch.each(ch.meet(data, edges, on), sums, f"{kept}, bucket long, model array<double>, log_likelihood double, rounds int, like double, sums array<double>")
        stepped = ch.scan(each, by, add(step), "model array<double>, log_likelihood double, rounds int, open boolean")
        closed = stepped.where("NOT open") if i + 1 < iterations else stepped
        ended = closed if ended is None else ended.unionByName(closed)
        models = stepped
        if not stepped.where("open").limit(1).count():
            break
    data = ch.meet(many, save(ended.drop("open")), by)

    def best(row: dict) -> dict:
        return {"m": chunk_best(Model.of(row["model"], k, d), _x(row, features), row["first"]).ravel().tolist()}

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(m).reshape(k, k) for m in group["m"]]
        left = [np.zeros(k)]
        for p in parts:
            score = (left[-1][:, None] + p).max(axis=0)
            left.append(score - score.max())
        at, last = int(left[-1].argmax()), []
        for score, p in zip(reversed(left[:-1]), reversed(parts)):
            last.append(at)
            at = int(np.argmax(score + p[:, at]))
        return pd.DataFrame({"bucket": group["bucket"], "left": left[:-1], "last": np.array(last[::-1], "int32")})

    def path(row: dict) -> dict:
        model = Model.of(row["model"], k, d)
        found = chunk_path(model, _x(row, features), row["first"], np.asarray(row["left"]), int(row["last"]))
        return {"state": number(model)[found].tolist(), "model": sorted_flat(model)}

    edges = ch.scan(ch.each(data, best, f"{kept}, bucket long, m array<double>"), by, ends, "bucket long, left array<double>, last int")
    return save(ch.each(ch.meet(data, edges, on), path, f"{kept}, `idx` {idx_type}, state array<int>, model array<double>, log_likelihood double, rounds int"))


def hmm_states(samples: DataFrame, states: int, by: Sequence[str] = ("session",), idx: str = "idx", value: str = "value") -> DataFrame:
    """(by, idx, state): the most probable path of each session in one feature; states are numbered by their mean."""
    return gauss_hmm(samples, states, by, (value,), idx)[0]
