"""Filters of series of any length, chunk by chunk.

Recursive filters run as state spaces: a chunk turns the state before it into that after it by a fixed matrix and a vector of its own, so a
scan over the vectors of a session's chunks gives every chunk its state, forward and then backward. Filters of finite reach get the rows
that lie beside a chunk. Both give what the whole series would give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import save
from . import chunks as ch

Zpk = tuple[np.ndarray, np.ndarray, float]


def sections(zpk: Zpk) -> np.ndarray:
    """(m, 6): second-order sections b0 b1 b2 1 a1 a2 of a filter with real zeros; the last may be of first order."""
    z, p, gain = zpk
    pairs = [np.array([q, np.conj(q)]) for q in sorted(p[p.imag > 1e-12], key=lambda q: abs(q))]
    real = sorted(p[np.abs(p.imag) <= 1e-12].real)
    pairs += [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]
    zeros, out = sorted(np.real(z)), []
    for pair in pairs:
        mine = [zeros.pop(0 if i % 2 else -1) for i in range(min(len(pair), len(zeros)))]
        b, a = np.real(np.poly(mine)) if mine else np.ones(1), np.real(np.poly(pair))
        out.append(np.concatenate([b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))]))
    out[0][:3] *= gain
    return np.array(out)


def padding(sos: np.ndarray) -> int:
    """Rows of the odd extension at either end."""
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


class Space:
    """The state space of sections in a row: s' = a s + b x, y = c s + d x; `rest` is the state of a constant input of one."""

    def __init__(self, sos: np.ndarray):
        self.a, self.b, self.c, self.d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for b0, b1, b2, _, a1, a2 in sos:
            a, b, c = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
            top = np.hstack([self.a, np.zeros((len(self.b), 2))])
            self.a = np.vstack([top, np.hstack([np.outer(b, self.c), a])])
            self.b = np.concatenate([self.b, b * self.d])
            self.c, self.d = np.concatenate([b0 * self.c, c]), b0 * self.d
        self.rest = np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, state after x); rows of about sqrt(n) values are filtered side by side, then given their states."""
        n, k = len(x), len(self.b)
        steps = max(1, int(np.sqrt(n)))
        rows = n // steps
        wide, out = x[: rows * steps].reshape(rows, steps), np.empty(n)
        y, s, reply, power = np.empty((rows, steps)), np.zeros((rows, k)), np.empty((steps, k)), np.eye(k)
        for t in range(steps):
            y[:, t] = s @ self.c + self.d * wide[:, t]
            s = s @ self.a.T + wide[:, t, None] * self.b
            reply[t] = self.c @ power
            power = self.a @ power
        begin = np.empty((rows, k))
        for r in range(rows):
            begin[r] = state
            state = power @ state + s[r]
        out[: rows * steps] = (y + begin @ reply.T).ravel()
        for t in range(rows * steps, n):
            out[t] = self.c @ state + self.d * x[t]
            state = self.a @ state + self.b * x[t]
        return out, state

    def after(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)


def both_ways(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """A whole series filtered forward and backward, on an odd extension of both ends and from the state of rest."""
    space, n = Space(sos), len(x)
    if n < 2:
        return np.asarray(x, float)
    pad = min(n - 1, padding(sos))
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y, _ = space.run(wide, space.rest * wide[0])
    z, _ = space.run(y[::-1], space.rest * y[-1])
    return z[::-1][pad : pad + n]


def both_ways_chunked(packed: DataFrame, sos: np.ndarray, by: Sequence[str], value: str = "value") -> DataFrame:
    """both_ways() of chunks (ch.pack), as chunks (by, bucket, n, idx, value)."""
    by, space, pad = list(by), Space(sos), padding(sos)
    k = len(space.b)
    kept = ch.keys(packed, by)
    idx = packed.schema["idx"].dataType.simpleString()

    def ends(row: dict) -> dict:
        x = np.asarray(row[value], float)
        return {"head": x[: pad + 1].tolist(), "tail": x[-pad - 1 :].tolist(), "own": space.run(x, np.zeros(k))[1].tolist()}

    def forward(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        reach = min(n - 1, pad)
        head, tail = (np.concatenate([np.zeros(0)]), np.concatenate([np.zeros(0)]))
        for part in group["head"]:
            head = np.concatenate([head, part])[: reach + 1]
            if len(head) > reach:
                break
        for part in group["tail"][::-1]:
            tail = np.concatenate([part, tail])[-reach - 1 :]
            if len(tail) > reach:
                break
        if n < 2:
            return pd.DataFrame({"bucket": group["bucket"], "state": [np.zeros(k)] * len(group), "back": [None] * len(group)})
        before, after = 2 * head[0] - head[reach:0:-1], 2 * tail[-1] - tail[-2 : -reach - 2 : -1]
        first = before[0] if reach else head[0]
        state = space.run(before, space.rest * first)[1]
        states = []
        for size, own in zip(group["n"], group["own"]):
            states.append(state)
            state = space.after(int(size)) @ state + np.asarray(own)
        y, _ = space.run(after, state)
        back = space.run(y[::-1], space.rest * y[-1])[1]
        return pd.DataFrame({"bucket": group["bucket"], "state": states, "back": [None] * (len(group) - 1) + [back]})

    def ahead(row: dict) -> dict:
        y, _ = space.run(np.asarray(row[value], float), np.asarray(row["state"]))
        return {value: y.tolist(), "own": space.run(y[::-1], np.zeros(k))[1].tolist()}

    def backward(group: pd.DataFrame) -> pd.DataFrame:
        state, states = group["back"].iloc[-1], []
        for size, own in zip(group["n"][::-1], group["own"][::-1]):
            states.append(state)
            state = None if state is None else space.after(int(size)) @ np.asarray(state) + np.asarray(own)
        return pd.DataFrame({"bucket": group["bucket"], "state": states[::-1]})

    def behind(row: dict) -> dict:
        y = np.asarray(row[value], float)
        return {value: y.tolist() if row["state"] is None else space.run(y[::-1], np.asarray(row["state"]))[0][::-1].tolist()}

    def alone(row: dict) -> dict:
        return {"old": row[value]}

    on = [*by, "bucket"]
    states = ch.scan(ch.each(packed, ends, f"{kept}, bucket long, n int, head array<double>, tail array<double>, own array<double>"), by, forward, "bucket long, state array<double>, back array<double>")
    schema = f"{kept}, bucket long, n int, `idx` array<{idx[6:-1]}>, `{value}` array<double>, back array<double>, own array<double>, old array<double>"
    going = save(ch.each(ch.meet(packed, states, on), lambda row: {**alone(row), **ahead(row)}, schema))
    states = ch.scan(going.select(*by, "bucket", "n", "back", "own"), by, backward, "bucket long, state array<double>")
    done = ch.meet(going.drop("back", "own"), states, on)
    return ch.each(done, lambda row: {value: row["old"]} if row["state"] is None else behind(row), f"{kept}, bucket long, n int, `idx` array<{idx[6:-1]}>, `{value}` array<double>")


def with_sides(packed: DataFrame, by: Sequence[str], values: Sequence[str], left: int, right: int) -> DataFrame:
    """Chunks with `before` (rows of the session before them), `total` (rows of the session) and for each value v the arrays v_left and v_right:
    up to `left` rows before the chunk and `right` after it."""
    by, values = list(by), list(values)
    kept = ch.keys(packed, by)
    fields = ", ".join(f"`{v}_{s}` array<double>" for v in values for s in ("left", "right"))

    def edges(row: dict) -> dict:
        out = {}
        for v in values:
            x = np.asarray(row[v], float)
            out[f"{v}_left"], out[f"{v}_right"] = x[len(x) - min(left, len(x)) :].tolist(), x[:right].tolist()
        return out

    def share(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy()
        out = {"bucket": group["bucket"], "before": np.cumsum(n) - n, "total": int(n.sum())}
        for v in values:
            tails, heads = list(group[f"{v}_left"]), list(group[f"{v}_right"])
            now, lefts = np.zeros(0), []
            for part in tails:
                lefts.append(now)
                now = np.concatenate([now, part])[max(0, len(now) + len(part) - left) :]
            now, rights = np.zeros(0), []
            for part in reversed(heads):
                rights.append(now)
                now = np.concatenate([part, now])[:right]
            out[f"{v}_left"], out[f"{v}_right"] = lefts, rights[::-1]
        return pd.DataFrame(out)

    shared = ch.scan(ch.each(packed, edges, f"{kept}, bucket long, n int, {fields}"), by, share, f"bucket long, before long, total long, {fields}")
    return ch.meet(packed, shared, [*by, "bucket"])


def reaching(packed: DataFrame, by: Sequence[str], reach: int, kernel: Callable[[np.ndarray, int, int], np.ndarray], name: str = "value", value: str = "value") -> DataFrame:
    """(by, idx, name): kernel(values with `reach` rows on either side where there are, rows before the chunk, rows after it) of each chunk.

    The kernel returns a value for each row that it gets; those of the chunk itself are kept.
    """
    by = list(by)
    idx = packed.schema["idx"].dataType.simpleString()

    def run(row: dict) -> dict:
        a, x, b = (np.asarray(row[c], float) for c in (f"{value}_left", value, f"{value}_right"))
        return {name: kernel(np.concatenate([a, x, b]), len(a), len(b))[len(a) : len(a) + len(x)].tolist()}

    done = ch.each(with_sides(packed, by, [value], reach, reach), run, f"{ch.keys(packed, by)}, `idx` array<{idx[6:-1]}>, `{name}` array<double>")
    return ch.unpack(done, by, [name])


def window_starts(row: dict, length: int, step: int) -> np.ndarray:
    """Starts of the windows that begin in a chunk, counted from its first row."""
    first = -row["before"] % step
    last = min(row["n"] - 1, row["total"] - length - row["before"])
    return np.arange(first, last + 1, step)
