"""Series cut into small chunks against the same work on whole arrays, and hidden Markov models against plain recursions."""

import numpy as np
import pytest

from pulsegrid.operators import chunks, filters, hmm, signal

RATE = 100.0
SIZES = {0: 1500, 1: 333, 2: 90, 3: 1, 4: 2, 5: 9}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    return {s: np.cumsum(rng.normal(size=n)) * 0.1 + np.sin(np.arange(n) / 5) for s, n in SIZES.items()}


@pytest.fixture(scope="module")
def rows(spark, series):
    return spark.createDataFrame([(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)], "session int, idx long, value double").repartition(3).cache()


def listed(df, name="value"):
    out = {}
    for r in df.collect():
        out.setdefault(r.session, []).append((r.idx, r[name]))
    return {s: np.array([v for _, v in sorted(x)]) for s, x in out.items()}


def test_pack(rows, series):
    packed = chunks.pack(rows, ["session"], ["value"], chunk=64)
    assert max(r.n for r in packed.select("n").collect()) <= 65
    back = listed(chunks.unpack(packed, ["session"], ["value"]))
    assert all(np.array_equal(back[s], x) for s, x in series.items())
    assert chunks.unpack(chunks.pack(rows.where("false"), ["session"], ["value"]), ["session"], ["value"]).collect() == []


def direct(x, sos):
    """Both ways by the difference equations, sample by sample, on an odd extension, from the state of rest."""
    if len(x) < 2:
        return x

    def once(v):
        v = v.copy()
        for b0, b1, b2, _, a1, a2 in sos:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = (b2 - a2 * gain) * v[0]
            s1 = (b1 - a1 * gain) * v[0] + s2
            out = np.empty_like(v)
            for i, u in enumerate(v):
                out[i] = b0 * u + s1
                s1, s2 = b1 * u - a1 * out[i] + s2, b2 * u - a2 * out[i]
            v = out
        return v

    pad = min(len(x) - 1, filters.padding(sos))
    wide = np.concatenate([2 * x[0] - x[1 : pad + 1][::-1], x, 2 * x[-1] - x[-pad - 1 : -1][::-1]])
    return once(once(wide)[::-1])[::-1][pad : pad + len(x)]


@pytest.mark.parametrize("spec", [(4, 10.0, "lowpass"), (3, 5.0, "highpass"), (3, (5.0, 12.0), "bandpass")])
def test_filter_with_carried_state(rows, series, spec):
    order, cutoff, kind = spec
    sos = filters.sections(signal.butter(order, cutoff, RATE, kind))
    got = listed(signal.filtered(rows, cutoff, RATE, ["session"], order, kind, chunk=64))
    for s, x in series.items():
        assert np.allclose(got[s], direct(x, sos), atol=1e-9), s
        assert np.allclose(filters.both_ways(x, sos), direct(x, sos), atol=1e-9)


def test_finite_filters(rows, series):
    for made in (lambda c: signal.gaussian(rows, 2.0, ["session"], chunk=c), lambda c: signal.boxcars(rows, 5, 2, ["session"], chunk=c), lambda c: signal.fir(rows, 21, 10.0, RATE, ["session"], chunk=c)):
        small, large = listed(made(32)), listed(made(10**6))
        assert all(np.allclose(small[s], large[s], atol=1e-12) and len(small[s]) == len(x) for s, x in series.items())
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    want = np.convolve(np.pad(series[0], 8, mode="symmetric"), w / w.sum(), mode="valid")
    assert np.allclose(listed(signal.gaussian(rows, 2.0, ["session"], chunk=50))[0], want)


def test_phase_and_envelope(rows, series):
    sos = filters.sections(signal.butter(3, (5.0, 12.0), RATE, "bandpass"))
    whole = signal.analytic(filters.both_ways(series[0], sos))
    angle, size = (listed(f(rows, (5.0, 12.0), RATE, ["session"], chunk=128), n)[0] for f, n in ((signal.phase, "phase"), (signal.envelope, "envelope")))
    # The spectrum of a whole series takes its ends for neighbours, so they are left out here; weak signal has no sure phase.
    inner = np.arange(100, 1400)
    off = np.abs(size * np.exp(1j * angle) - whole)[inner]
    assert off.max() < 0.03 * np.abs(whole[inner]).max() and np.median(off) < 0.003 * np.abs(whole[inner]).max()


def test_windows(rows, series):
    tapers = signal.slepian(64, 3.0, 5)
    got = {}
    for r in signal.spectrogram(rows, RATE, ["session"], 64, 24, chunk=50).collect():
        got.setdefault((r.session, r.win), {})[round(r.freq, 6)] = r.power
        assert abs(r.t - (r.win * 24 + 32) / RATE) < 1e-12
    want = {}
    for s, x in series.items():
        for w, start in enumerate(range(0, len(x) - 63, 24)):
            piece = x[start : start + 64]
            want[s, w] = (np.abs(np.fft.rfft((piece - piece.mean()) * tapers, axis=1)) ** 2).mean(axis=0) / RATE
    assert got.keys() == want.keys()
    assert all(np.allclose([v for _, v in sorted(got[k].items())], want[k]) for k in want)


def test_cross_spectra(spark, rows, series):
    two = rows.selectExpr("session", "idx", "2 AS ch", "value").unionByName(rows.selectExpr("session", "idx", "7 AS ch", "sin(value) + idx % 3 AS value"))
    tapers = signal.slepian(32, 2.0, 3)
    got = {(r.session, r.win, r.ch1, r.ch2, round(r.freq, 6)): complex(r.re, r.im) for r in signal.cross_spectrogram(two, RATE, ["session"], 32, 16, 2.0, chunk=40).collect()}
    same = {(r.session, r.win, round(r.freq, 6)): (r.coherence, r.phase) for r in signal.coherogram(two, RATE, ["session"], 32, 16, 2.0, chunk=40).collect()}
    total, n = {}, 0
    for s, x in series.items():
        y = np.sin(x) + np.arange(len(x)) % 3
        for w, start in enumerate(range(0, len(x) - 31, 16)):
            f = [np.fft.rfft((p - p.mean()) * tapers, axis=1) for p in (x[start : start + 32], y[start : start + 32])]
            for (a, c1), (b, c2) in (((0, 2), (0, 2)), ((0, 2), (1, 7)), ((1, 7), (1, 7))):
                cross = (f[a] * f[b].conj()).mean(axis=0)
                total[s, c1, c2] = total.get((s, c1, c2), 0) + cross
                for k, v in zip(np.fft.rfftfreq(32, 1 / RATE).round(6).tolist(), cross):
                    assert abs(got[s, w, c1, c2, k] - v) < 1e-9
                    n += 1
            cross, power = (f[0] * f[1].conj()).mean(axis=0), np.sqrt((np.abs(f[0]) ** 2).mean(axis=0) * (np.abs(f[1]) ** 2).mean(axis=0))
            for k, v, p in zip(np.fft.rfftfreq(32, 1 / RATE).round(6).tolist(), cross, power):
                assert abs(same[s, w, k][0] - abs(v) / p) < 1e-8
    assert n == len(got)
    whole = {(r.session, round(r.freq, 6)): r.coherence for r in signal.coherence(two, RATE, ["session"], 32, 16, 2.0, chunk=40).collect()}
    for s in (0, 1, 2):
        want = np.abs(total[s, 2, 7]) / np.sqrt(total[s, 2, 2].real * total[s, 7, 7].real)
        assert np.allclose([whole[s, k] for k in np.fft.rfftfreq(32, 1 / RATE).round(6).tolist()], want)


def test_resampled(rows, series):
    for target in (40.0, 150.0):
        small, large = (listed(signal.resampled(rows, RATE, target, ["session"], chunk=c)) for c in (64, 10**6))
        for s, x in series.items():
            n = int(round(len(x) * target / RATE))
            assert len(small.get(s, [])) == n == len(large.get(s, [])) and (not n or np.allclose(small[s], large[s], atol=1e-9))


def plain(model, x):
    """(log likelihood, posteriors, path) sample by sample."""
    like, log_move = np.exp(model.log_density(x)), np.log(model.move)
    n, k = like.shape
    alpha, scale, beta = np.zeros((n, k)), np.zeros(n), np.ones((n, k))
    for t in range(n):
        a = (model.start if t == 0 else alpha[t - 1] @ model.move) * like[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in reversed(range(n - 1)):
        beta[t] = model.move @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
    post = alpha * beta
    score, back = np.log(model.start) + np.log(like[0]), []
    for t in range(1, n):
        every = score[:, None] + log_move
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + np.log(like[t])
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.log(scale).sum(), post / post.sum(axis=1, keepdims=True), np.array(path[::-1])


def test_hmm_chunk_functions():
    rng = np.random.default_rng(0)
    k, d = 3, 2
    for n in (1, 2, 3, 7, 50, 333):
        x, a = rng.normal(size=(n, d)) * 2, rng.normal(size=(k, d, d))
        model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.normal(size=(k, d)), a @ a.transpose(0, 2, 1) + np.eye(d))
        like, post, path = plain(model, x)
        matrix, log = hmm.chunk_matrix(model, x, True)
        even = np.full(k, 1 / k)
        assert abs(log + np.log((even @ matrix).sum()) - like) < 1e-8 * max(1, abs(like))
        assert np.allclose(hmm.chunk_sums(model, x, True, even, np.ones(k), posterior=True), post, atol=1e-9)
        assert np.array_equal(hmm.path_local(model, x), path)


@pytest.mark.parametrize("kind", hmm.KINDS)
def test_hmm_of_several_chunks(spark, kind):
    """Three features in sessions of many chunks and of one, against the fit of whole arrays."""
    rng = np.random.default_rng(7)
    truth = {0: np.repeat([0, 1, 2, 0, 2], 120), 1: np.repeat([2, 0, 1], 60), 2: np.array([0, 1])}
    centre = np.array([[0, 0, 1], [3, 1, -1], [6, -2, 0]])
    x = {s: centre[t] + rng.normal(0, 0.7, (len(t), 3)) for s, t in truth.items()}
    rows = [(s, i, *map(float, v)) for s, a in x.items() for i, v in enumerate(a)] + [(0, 10_000, None, 1.0, 1.0), (1, 10_000, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "session int, idx long, a double, b double, c double").repartition(3)
    states, models = hmm.gauss_hmm(df, 3, features=("a", "b", "c"), kind=kind, iterations=6, chunk=64)
    got, found = listed(states, "state"), {r.session: r for r in models.collect()}
    assert set(found) == {0, 1} and got[2].tolist() == [0, 0]
    for s in (0, 1):
        model, like, rounds = hmm.fit_local(x[s], 3, kind, 6)
        order = np.argsort(model.mean[:, 0])
        assert rounds == found[s].rounds and abs(found[s].log_likelihood - like) < 1e-6 * abs(like)
        assert np.allclose(found[s]["mean"], model.mean[order].ravel(), atol=1e-6) and np.allclose(found[s]["cov"], model.cov[order].ravel(), atol=1e-6)
        assert np.array_equal(got[s], np.argsort(order)[plain(model, x[s])[2]]) and (got[s] == truth[s]).mean() > 0.97
    with pytest.raises(ValueError):
        hmm.gauss_hmm(df, 2, kind="round")
