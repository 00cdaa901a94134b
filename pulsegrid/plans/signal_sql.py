"""SQL twins of the signal queries: discrete Fourier sums with the tapers as a table, and filters as recursions over samples."""

from __future__ import annotations

from ..operators import filters, signal
from . import bridge as b


def _tapers(length: int, nw: float) -> str:
    rows = signal.slepian(length, nw, max(1, int(2 * nw) - 1))
    return "tp(k, i, h) AS (VALUES " + ", ".join(f"({k}, {i}, CAST({v!r} AS DOUBLE))" for k, row in enumerate(rows.tolist()) for i, v in enumerate(row)) + ")"


def _spectra(length: int, step: int, nw: float, channels: str) -> str:
    """Common tables up to f (session, ch, win, k, m, re, im); channels: values of the channels as a list of structs."""
    return (
        f"WITH {b.EV}, {b.SAMPLES}, {_tapers(length, nw)}, sc AS (SELECT session, idx, unnest({channels}) AS s FROM sm), c AS (SELECT session, idx, s.ch AS ch, s.v AS value FROM sc), "
        f"n AS (SELECT session, COUNT(*) AS n FROM sm GROUP BY session), wi AS (SELECT session, unnest(range(0, n - {length} + 1, {step})) // {step} AS win FROM n), "
        f"x AS (SELECT c.session, c.ch, wi.win, c.idx - wi.win * {step} AS i, c.value - AVG(c.value) OVER (PARTITION BY c.session, c.ch, wi.win) AS v FROM wi JOIN c ON c.session = wi.session AND c.idx >= wi.win * {step} AND c.idx < wi.win * {step} + {length}), "
        f"f AS (SELECT session, ch, win, k, m, SUM(v * h * COS(2 * PI() * m * x.i / {length})) AS re, -SUM(v * h * SIN(2 * PI() * m * x.i / {length})) AS im FROM x JOIN tp ON tp.i = x.i, (SELECT unnest(range(0, {length // 2 + 1})) AS m) GROUP BY ALL)"
    )


ONE = "[{'ch': 0, 'v': value}]"
TWO = "[{'ch': 0, 'v': value}, {'ch': 1, 'v': ln(1 + value)}]"
_CROSS = "x2 AS (SELECT a.session, a.win, a.ch AS ch1, b2.ch AS ch2, a.m, AVG(a.re * b2.re + a.im * b2.im) AS re, AVG(a.im * b2.re - a.re * b2.im) AS im FROM f a JOIN f b2 ON b2.session = a.session AND b2.win = a.win AND b2.k = a.k AND b2.m = a.m AND b2.ch >= a.ch GROUP BY ALL)"


def spectrogram(length: int, step: int, nw: float = 3.0) -> str:
    return _spectra(length, step, nw, ONE) + f" SELECT session, win, CAST(win * {step} + {length // 2} AS DOUBLE) AS t, m / {length}.0 AS freq, ROUND(AVG(re * re + im * im), 5) + 0.0 AS power FROM f GROUP BY session, win, m"


def cross_spectrogram(length: int, step: int, nw: float) -> str:
    return _spectra(length, step, nw, TWO) + f", {_CROSS} SELECT session, win, CAST(win * {step} + {length // 2} AS DOUBLE) AS t, ch1, ch2, m / {length}.0 AS freq, ROUND(re, 5) + 0.0 AS re, ROUND(im, 5) + 0.0 AS im FROM x2"


def coherogram(length: int, step: int, nw: float) -> str:
    return _spectra(length, step, nw, TWO) + (
        f", {_CROSS} SELECT p.session, p.win, CAST(p.win * {step} + {length // 2} AS DOUBLE) AS t, p.ch1, p.ch2, p.m / {length}.0 AS freq, ROUND(SQRT(p.re * p.re + p.im * p.im) / SQRT(q.re * r.re), 5) + 0.0 AS coherence FROM x2 p "
        "JOIN x2 q ON q.session = p.session AND q.win = p.win AND q.m = p.m AND q.ch1 = p.ch1 AND q.ch2 = p.ch1 JOIN x2 r ON r.session = p.session AND r.win = p.win AND r.m = p.m AND r.ch1 = p.ch2 AND r.ch2 = p.ch2 WHERE p.ch1 < p.ch2 AND q.re * r.re > 1e-12"
    )


def coherence(length: int, step: int, nw: float = 3.0) -> str:
    return _spectra(length, step, nw, TWO) + (
        f", {_CROSS}, y AS (SELECT session, ch1, ch2, m, SUM(re) AS re, SUM(im) AS im FROM x2 GROUP BY ALL) SELECT p.session, p.ch1, p.ch2, p.m / {length}.0 AS freq, ROUND(SQRT(p.re * p.re + p.im * p.im) / SQRT(q.re * r.re), 6) + 0.0 AS coherence, ROUND(ATAN2(p.im, p.re), 6) + 0.0 AS phase FROM y p "
        "JOIN y q ON q.session = p.session AND q.m = p.m AND q.ch1 = p.ch1 AND q.ch2 = p.ch1 JOIN y r ON r.session = p.session AND r.m = p.m AND r.ch1 = p.ch2 AND r.ch2 = p.ch2 WHERE p.ch1 < p.ch2"
    )


def _recursion(name: str, rows: str, sos) -> str:
    """A recursive table name (session, j, y, s...) of rows (session, j, x), from the state of rest."""
    lines, x, gain_of = [], "e.x", "e.x"
    start, outs = [], []
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        p = f"(({b2 - a2 * gain!r}) * {gain_of})"
        start += [f"(({b1 - a1 * gain!r}) * {gain_of} + {p})", p]
        gain_of = f"(({gain!r}) * {gain_of})"
        lines.append((i, b0, b1, b2, a1, a2))

    def step(state: list[str]) -> list[str]:
        nonlocal x
        out, now = [], "e.x"
        for i, b0, b1, b2, a1, a2 in lines:
            y = f"(({b0!r}) * {now} + {state[2 * i]})"
            out += [f"(({b1!r}) * {now} - ({a1!r}) * {y} + {state[2 * i + 1]})", f"(({b2!r}) * {now} - ({a2!r}) * {y})"]
            now = y
        outs.append(now)
        return out

    first = step(start)
    columns = [f"s{i}" for i in range(len(start))]
    after = step([f"p.{c}" for c in columns])
    as_ = lambda values: ", ".join(f"{v} AS {c}" for v, c in zip(values, columns))
    return (
        f"{name} AS (SELECT e.session, e.j, {outs[0]} AS y, {as_(first)} FROM {rows} e WHERE e.j = 0 UNION ALL "
        f"SELECT e.session, e.j, {outs[1]} AS y, {as_(after)} FROM {name} p JOIN {rows} e ON e.session = p.session AND e.j = p.j + 1)"
    )


def filtered(cutoff: float, order: int = 4) -> str:
    sos = filters.sections(signal.butter(order, cutoff, 1.0))
    pad = filters.padding(sos)
    return (
        f"WITH RECURSIVE {b.EV}, {b.SAMPLES}, n AS (SELECT session, COUNT(*) AS n, least(COUNT(*) - 1, {pad}) AS pad FROM sm GROUP BY session), "
        "ex AS (SELECT sm.session, sm.idx + n.pad AS j, sm.value AS x FROM sm JOIN n ON n.session = sm.session "
        "UNION ALL SELECT sm.session, n.pad - sm.idx, 2 * z.value - sm.value FROM sm JOIN n ON n.session = sm.session JOIN sm z ON z.session = sm.session AND z.idx = 0 WHERE sm.idx BETWEEN 1 AND n.pad "
        "UNION ALL SELECT sm.session, n.pad + 2 * (n.n - 1) - sm.idx, 2 * z.value - sm.value FROM sm JOIN n ON n.session = sm.session JOIN sm z ON z.session = sm.session AND z.idx = n.n - 1 WHERE sm.idx BETWEEN n.n - 1 - n.pad AND n.n - 2), "
        f"{_recursion('fw', 'ex', sos)}, bx AS (SELECT fw.session, n.n + 2 * n.pad - 1 - fw.j AS j, fw.y AS x FROM fw JOIN n ON n.session = fw.session), {_recursion('bw', 'bx', sos)} "
        "SELECT bw.session, n.n + n.pad - 1 - bw.j AS idx, ROUND(bw.y, 6) + 0.0 AS value FROM bw JOIN n ON n.session = bw.session WHERE bw.j >= n.pad AND bw.j < n.n + n.pad"
    )
